"""Numbers and pages over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from kalmia.operators import ordering


def rows_of(seed, n, kinds):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(kinds)]), rng.choice([None, "a", "b"]), i) for i in range(n)]


def key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)


@pytest.mark.parametrize(("n", "kinds", "ranges"), [(0, 3, 4), (1, 1, 4), (500, 2, 7), (500, 400, 16)])
def test_numbers_are_dense_and_in_order(spark, n, kinds, ranges):
    rows = rows_of(n, n, kinds)
    table = spark.createDataFrame(rows, "k long, s string, v long")
    got = ordering.numbered(table, ["k", "s", "v"], "no", after=10, ranges=ranges).orderBy("no").collect()
    want = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""), r[2]))
    assert [(r["k"], r["s"], r["v"]) for r in got] == want and [r["no"] for r in got] == list(range(11, 11 + n))


def test_any_partitioning_and_hot_keys(spark):
    table = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = {r["v"]: r["no"] for r in ordering.numbered(table.coalesce(1), ["k"], "no", ranges=5).collect()}
    two = {r["v"]: r["no"] for r in ordering.numbered(table.repartition(11), ["k"], "no", ranges=13).collect()}
    assert one == two and sorted(one.values()) == list(range(1, 3_001))
    sizes = [r["n"] for r in ordering._ranged(table, ["k"], 10).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3_000 / 3  # a third of the rows have one key


def test_numbers_replace_a_column(spark):
    table = spark.createDataFrame([(7, "b"), (9, "a")], "id long, s string")
    assert sorted((r["id"], r["s"]) for r in ordering.numbered(table, ["s"]).collect()) == [(1, "a"), (2, "b")]


def test_pages(spark, tmp_path):
    table = spark.range(1_000).select((F.col("id") * 37 % 1_000).alias("k"), F.col("id").cast("string").alias("s"))
    pages = ordering.paged(table, ["k"], str(tmp_path / "p"), ranges=10)
    assert pages.total == 1_000
    for number in (1, 2, 25, 49, 50, 51):
        assert [r["k"] for r in pages.page(number, 20).collect()] == list(range((number - 1) * 20, min(number * 20, 1_000)))
    assert [r["k"] for r in pages.page(0, 500).collect()] == list(range(100))
    plan = pages.page(25, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert pages.page(25, 20).rdd.getNumPartitions() <= 2
    assert ordering.paged(table.limit(0), ["k"], str(tmp_path / "e")).page(1, 20).count() == 0
