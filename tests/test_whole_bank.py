"""Queries over the whole bank: small banks in plain Python, the tables against SQL."""

import glob
import os

import duckdb
import pytest

from kalmia.operators import recommend
from kalmia.plans import catalogue
from kalmia.sources import bank as banks

SF = "/root/testdata/sf0.01"
BANK = "id long, difficulty string, acceptance_rate double"
PASSED = "user_id long, problem_id long, verdict string"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def held(spark, duck, name):
    """The query equals its SQL."""
    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    plain = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
    rows = sorted((plain(r[c] for c in names) for r in got.collect()), key=str)
    assert rows and rows == sorted(map(plain, want.project(", ".join(f'"{c}"' for c in names)).fetchall()), key=str)


def test_first_unsolved_of_a_large_bank(spark):
    bank = [(i, "Hard" if i < 1000 else "Easy", None if i % 7 == 0 else float(i % 5)) for i in range(900, 1100)]
    order = [i for _, _, i in sorted((d, -(a or 0.0), i) for i, d, a in bank)]
    done = {1: [], 2: order[:3], 3: order[1:4], 4: order[:150], 5: order}
    subs = [(u, i, "pass") for u, ids in done.items() for i in [*ids, *ids[:1]]] + [(1, order[0], "fail"), (1, None, "pass")]
    users = spark.createDataFrame([(u,) for u in done], "user_id long")
    got = recommend.first_unsolved(users, spark.createDataFrame(bank, BANK), spark.createDataFrame(subs, PASSED))
    assert {r["user_id"]: r["problem_id"] for r in got.collect()} == {1: order[0], 2: order[3], 3: order[0], 4: order[150]}


def test_first_unsolved_query(spark, duck):
    held(spark, duck, "first_unsolved")


def test_top_of_a_large_bank(spark):
    bank = [("p" if i < 400 else "q", i, None if i % 7 == 0 else float(i % 5)) for i in range(100, 500)]
    order = {p: [i for _, i in sorted((-(a or 0.0), i) for x, i, a in bank if x == p)] for p in "pq"}
    done = {1: [], 2: order["p"][:3], 3: order["p"], 4: [*order["p"][:2], *order["q"][1:]]}
    subs = [(u, i, "pass", "z") for u, ids in done.items() for i in ids] + [(1, None, "pass", "z"), (1, order["p"][0], "fail", "z")]
    scores = spark.createDataFrame([(u, p, 600.0, 0.0) for u in done for p in "pq"], "user_id long, pattern_id string, elo double, gap_strength double")
    got = recommend.top_recommendations(scores, spark.createDataFrame(bank, "pattern_id string, id long, acceptance_rate double"), spark.createDataFrame(subs, f"{PASSED}, detected_pattern string"))
    want = {}
    for u, ids in done.items():
        for p in "pq":
            left = [i for i in order[p] if i not in ids]
            want[u, p] = ((left or order[p])[0], 0.375 if left else 0.175)
    assert {(r["user_id"], r["pattern_id"]): (r["problem_id"], r["expected_learning_gain"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["top5_recommendation", "recommendation_strategy", "standalone_recommendation", "next_recommendation", "elo_updates", "elo_global_summary"])
def test_query(spark, duck, name):
    held(spark, duck, name)


def test_weak_patterns(spark):
    users, patterns = spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "pattern_id string")
    profiles = spark.createDataFrame([(1, "a", 600.0), (1, "x", 400.0)], "user_id long, topic string, elo_rating double")
    signals = spark.createDataFrame([(1, "b", 0.8), (2, "c", 0.5)], "user_id long, pattern_id string, gap_strength double")
    subs = spark.createDataFrame([(2, "c", "pass"), (1, "b", "fail")], "user_id long, detected_pattern string, verdict string")
    got = recommend.weak_patterns(recommend.pattern_scores(users, patterns, profiles, signals), patterns, subs)
    rows = sorted((r["user_id"], r["rank"], r["pattern_id"], r["elo"], r["score"]) for r in got.collect())
    assert rows == [(1, 1, "b", 1200.0, 0.4), (1, 2, "a", 600.0, 0.25), (1, 3, "c", 1200.0, 0.0), (2, 1, "c", 1200.0, 0.125), (2, 2, "a", 1200.0, 0.0), (2, 3, "b", 1200.0, 0.0)]


def test_active(spark):
    rows = [(1, 1, 5, "pass"), (2, 1, 120, "fail"), (3, 2, 7, "tle"), (4, 3, 999, "fail"), (5, 4, None, "error"), (6, 5, 120, "fail"), (7, 6, 120, "fail"), (8, 6, 5, "pass")]
    subs = spark.createDataFrame(rows, "id long, user_id long, problem_id long, verdict string").selectExpr("*", "'t' AS topic", "timestamp_seconds(id) AS submitted_at")
    bank = spark.createDataFrame([(5, "Easy"), (7, "Hard"), (120, "Medium")], "id long, difficulty string")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,), (6,)], "user_id long")
    got = {r["user_id"]: (r["id"], r["difficulty"]) for r in recommend.active(subs, users, bank).collect()}
    assert got == {1: (2, "Medium"), 2: (3, "Hard"), 3: (4, None), 4: (5, None)}


def test_active_query(spark, duck):
    held(spark, duck, "active_recommendations")
    assert not catalogue.QUERIES["active_recommendations"](spark, SF).filter("difficulty IS NULL").count()


def test_lookup(spark):
    bank = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id long, title string")
    wanted = spark.createDataFrame([(1, "b"), (3, "x"), (4, "a"), (7, "b"), (8, "x"), (9, None)], "k long, name string")
    assert {r["k"]: r["title"] for r in banks.lookup(wanted, bank).collect()} == {1: "a", 3: "b", 4: "a", 7: "b", 8: None, 9: None}
    assert banks.lookup(wanted, bank).count() == 6


def test_lookup_query(spark, duck):
    held(spark, duck, "priority_lookup")
    assert catalogue.QUERIES["priority_lookup"](spark, SF).count() == 2000


def test_standalone_chain(spark):
    bank = spark.createDataFrame(
        [(1, "Easy", "a", "a", 5.0), (2, "Medium", "a", "a", 5.0), (3, "Hard", "a", "a", 5.0), (4, "Easy", "b", "b", 5.0), (5, "Hard", "c", "c", 5.0), (6, "Hard", "c", "c", 7.0)],
        "id long, difficulty string, topics string, primary_pattern string, acceptance_rate double",
    )
    # 1: scan finds; 2: only the second weakest topic has one; 3: the weakest topic at other levels; 4: the bank's first; 5: all solved; 6: no profile.
    done = {1: [], 2: [1], 3: [1, 4], 4: [1, 2, 3, 4], 5: [1, 2, 3, 4, 5, 6], 6: [1]}
    subs = spark.createDataFrame([(u, i, "pass") for u, ids in done.items() for i in ids], PASSED)
    weakest = spark.createDataFrame([(u, t, n, 800.0) for u in range(1, 6) for n, t in ((1, "a"), (2, "b"))], "user_id long, topic string, rn int, elo_rating double")
    users = spark.createDataFrame([(u,) for u in done], "user_id long")
    got = recommend.standalone(users, weakest, recommend.topic_problems(bank, weakest), bank, subs)
    assert {r["user_id"]: (r["topic"], r["difficulty"], r["problem_id"]) for r in got.collect()} == {1: ("a", "Easy", 1), 2: ("b", "Easy", 4), 3: ("a", "Medium", 2), 4: ("c", "Hard", 6), 6: ("b", "Easy", 4)}
