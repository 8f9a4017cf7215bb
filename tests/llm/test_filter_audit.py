import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from kalmia.llm import filter_audit


def brute(docs, labels):
    """Rows of the contract, document by document and order by order."""
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            key = d["text"] or ""
            first[key] = min(first.get(key, d["doc_id"]), d["doc_id"])
    good, toxic = ({r["doc_id"] for r in labels if r["doc_id"] is not None and r[c] == 1} for c in ("quality", "toxic"))
    fails = []
    for d in docs:
        text = d["text"] or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        bad = "".join(
            f
            for f, yes in (
                ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                ("D", bool(re.search("[#$%&*|]", text))), ("E", d["doc_id"] is not None and d["doc_id"] > first[text]),
            ) if yes
        )
        fails.append((d["source"] or "", bad, d["doc_id"] in good, d["doc_id"] in toxic))
    out, total = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, name in enumerate(order, 1):
                gone, left = [f for f in left if name in f[1]], [f for f in left if name not in f[1]]
                every = [f for f in fails if f[0] == part and name in f[1]]
                total[part, name] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(f[1] == name for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["part"], r["filter_order"], r["step"]].append(tuple(r[c] for c in COLUMNS))
    assert all(len(v) == 1 for v in got.values())
    return {k: v[0] for k, v in got.items()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (9, None, 1), (9, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def more(odd):
    """Each of the flags on its own, copies over parts, one id with two texts, names that clash with the operator's."""
    text = lambda x, n=60: " ".join(f"{x}{i}" for i in range(n))
    made = [
        (50, text("w")), (51, text("w")), (52, text("w")), (40, "short"), (41, " ".join(["again"] * 80)), (42, text("LOUD")), (43, text("w") + " #"), (44, " ".join(["A|"] * 30)), (50, text("w")), (50, "other"), (None, text("w")),
        (60, text("x", 50)), (61, text("x", 49)), (62, "\x0b\x0c".join(f"y{i}" for i in range(50)) + "\x85\xa0"), (63, "É" * 60), (64, "É Z\n" * 60), (65, "a" * 95 + " " + "B" * 5), (66, "a" * 94 + " " + "B" * 5),
    ]
    extra = [(i, t, "en", ("p", None, "big", "")[k % 4], 1, *["clash"] * 9) for k, (i, t) in enumerate(made)]
    return odd.unionByName(odd.sparkSession.createDataFrame(extra, odd.schema)).withColumns({"a": F.lit(1), "n": F.lit(2), "digest": F.lit("x"), "part": F.lit(9)})


def test_by_brute_force(spark, docs, more, labels):
    real = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for table, said in ((docs, real), (more, labels), (more, labels.limit(0))):
        assert rows(filter_audit.query(table, said)) == brute(table.collect(), said.collect())


def test_all_parts_together(more, labels):
    got = rows(filter_audit.audit(more, labels))
    whole = brute([{"doc_id": r["doc_id"], "text": r["text"], "source": "all"} for r in more.collect()], labels.collect())
    assert {k: v for k, v in got.items() if k[0] is None} == {(None, *k[1:]): v for k, v in whole.items()}
    assert {k: v for k, v in got.items() if k[0] is not None} == brute(more.collect(), labels.collect())


def test_empty_and_other_parts(none, more, labels):
    assert filter_audit.query(none, labels).count() == 0 and filter_audit.audit(none, labels).count() == 0
    by_lang = filter_audit.audit(more, labels, part="a.b", whole=False)
    assert {r["part"] for r in by_lang.select("part").distinct().collect()} == {"clash", ""}


def test_sql_on_odd_rows(more, labels):
    c = duckdb.connect()
    c.register("documents", more.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    c.register("labels", labels.toPandas().astype("Int64"))
    names = ("part", "filter_order", "step", *COLUMNS)
    want = {r[:3]: r[3:] for r in c.sql(filter_audit.SQL).project(", ".join(names)).fetchall()}
    assert rows(filter_audit.query(more, labels)) == want


def test_texts_are_read_once_and_not_shuffled(docs, spark):
    plan = filter_audit.failures(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("documents.parquet") == 1 and "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert not any("text#" in line for line in physical.splitlines() if "Exchange" in line)
