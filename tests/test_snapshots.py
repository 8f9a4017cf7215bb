"""Users with late rows go on from the last snapshot before them."""

import pytest
from pyspark.sql import functions as F

from kalmia.operators import interleaved, submissions
from kalmia.plans.catalogue import Tables
from kalmia.sources import serving

TABLES = ("submissions", "topic_profiles", "gap_signals", "user_pattern_elo", "streaks", "attempts", "states")


@pytest.fixture
def quiet(spark, monkeypatch):
    monkeypatch.setattr(serving, "BUCKETS", 2)
    monkeypatch.setattr(submissions, "EVERY", 3)
    none = spark.createDataFrame([], "user_id long, problem_id long, topic string, difficulty string, reason string")
    monkeypatch.setattr(submissions, "_advice", lambda *_: none)  # recommendations are a batch's own; not compared here


def contents(spark, root, names=TABLES):
    def shown(name):
        rows = serving.published(spark, root, name)
        if name in ("states", "snapshots"):  # patterns in any order
            rows = rows.withColumn("state", F.struct("state.submissions", "state.last_at", "state.last_id", F.array_sort("state.patterns").alias("patterns")))
        if name == "snapshots":
            rows = rows.withColumn("profiles", F.array_sort("profiles"))
        return sorted(map(str, rows.select(*sorted(rows.columns)).collect()))

    return {n: shown(n) for n in names}


def test_late_rows_are_folded_from_the_last_snapshot(spark, tmp_path, monkeypatch, quiet):
    t, root = Tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "late")
    rows = t.submissions.filter("user_id <= 2").withColumn("d", F.dayofmonth("submitted_at")).cache()
    late, very_late = F.expr("id % 5 = 0 AND d BETWEEN 22 AND 25"), F.expr("id % 6 = 1 AND d <= 4")
    held = ~(late | very_late)
    parts = [held & (F.col("d") < 10), held & F.col("d").between(10, 21), held & F.col("d").between(22, 26), late | (held & (F.col("d") > 26)), very_late]
    assert all(rows.filter(p).count() for p in parts)
    folded, replay = [], interleaved.replay

    def counted(new, *more, **how):
        folded.append(new.count())
        return replay(new, *more, **how)

    monkeypatch.setattr(interleaved, "replay", counted)
    for batch, part in enumerate(parts):
        if batch == 3:
            before = {r["user_id"]: (r["upto_at"], r["upto_id"]) for r in serving.published(spark, root, "snapshots").filter("upto_at < unix_micros(timestamp '2024-01-22')").groupBy("user_id").agg(F.max(F.struct("upto_at", "upto_id")).alias("m")).select("user_id", "m.*").collect()}
        submissions.persist(rows.filter(part).drop("d"), t.problems, root, batch)
    place = lambda r: (int(r["at"]), r["id"])
    every = rows.select("user_id", "id", F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("at"), (late | (F.col("d") > 26)).alias("new"), very_late.alias("after"), late.alias("late")).collect()
    users = {r["user_id"] for r in every if r["late"]}
    assert before.keys() == users == {0, 1, 2}
    since = [r for r in every if not r["after"] and place(r) > before[r["user_id"]]]
    assert folded[3] == len(since) < sum(not r["after"] for r in every) / 2  # new rows and those since the snapshot
    whole = str(tmp_path / "whole")
    submissions.persist(rows.drop("d"), t.problems, whole, 0)
    assert contents(spark, root) == contents(spark, whole)
    # Snapshots after a late row are gone: what is left is what a replay up to there gives.
    for r in serving.published(spark, root, "snapshots").collect():
        upto = [x for x in every if x["user_id"] == r["user_id"] and place(x) <= (r["upto_at"], r["upto_id"])]
        assert r["state"]["submissions"] == len(upto)
    serving.delete_owners(spark, rows.filter("user_id = 1").select("user_id").distinct(), root, len(parts))
    assert {r["user_id"] for r in serving.published(spark, root, "snapshots").collect()} == {0, 2}
