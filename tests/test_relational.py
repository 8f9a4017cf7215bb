"""Reads over JDBC from an embedded database: ranges of equal size on skewed keys, pushdown, resumed copies."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalmia.sources import bank, relational

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def stored(spark, rows):
    url = f"jdbc:derby:memory:kalmia{uuid.uuid4().hex};create=true"
    rows.coalesce(1).write.jdbc(url, "ATTEMPTS", properties=DRIVER)
    return relational.Source(spark, url, "ATTEMPTS", DRIVER)


def skewed(spark, n=6_000):
    """A third of the rows has key 7, one is far away, some are null; the rest is dense."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 7).when(i == 1, F.lit(1 << 40)).when(i % 50 == 2, None).otherwise(i % 900 - 400)
    return spark.range(n).select(key.cast("long").alias("K"), F.when(i % 400 == 0, None).otherwise(i).alias("T"), (i % 11).cast("int").alias("V"))


def sizes(rows):
    return [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ranges_are_even_on_a_hot_key_and_whole(spark):
    rows = skewed(spark)
    source = stored(spark, rows)
    read = relational.read_ranges(source, "K", 8, "T")
    assert same(read.select("K", "T", "V"), rows)
    by_range = sizes(read)
    nulls = rows.filter("K IS NULL").count()
    assert by_range[-1] == nulls
    share = rows.count() / 8
    assert all(0.75 * share <= n <= 1.25 * share for n in by_range[:-2])
    assert max(by_range) <= 1.25 * share
    # Without a second column the hot key is one range, and nothing is lost.
    assert max(sizes(relational.read_ranges(source, "K", 8))) >= rows.count() // 3
    assert same(bank.read_jdbc(spark, source.url, "ATTEMPTS", "K", 8, **DRIVER).select("K", "T", "V"), rows)


def test_filters_and_columns_reach_the_database(spark):
    rows = skewed(spark, 2_000)
    read = relational.read_ranges(stored(spark, rows), "K", 4, "T", where="V > 6").select("K")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(V), *GreaterThan(V,6)]" in plan and "ReadSchema: struct<K:bigint>" in plan
    assert same(read, rows.filter("V > 6").select("K"))
    found = sizes(read)
    assert max(found) <= 1.3 * sum(found) / 4  # the counting heeds the filter


def test_empty_table_single_row_and_null_keys(spark):
    none = stored(spark, skewed(spark, 10).filter("V < 0"))
    assert relational.key_cuts(none, "K", 4, "T") == ([], []) and relational.read_ranges(none, "K", 4, "T").count() == 0
    nulls = spark.range(100).select(F.lit(None).cast("long").alias("K"), F.col("id").alias("T"))
    read = relational.read_ranges(stored(spark, nulls), "K", 4, "T")
    assert same(read.select("K", "T"), nulls) and max(sizes(read)) <= 30
    one = spark.range(1).select(F.lit(-5).cast("long").alias("K"), F.lit(None).cast("long").alias("T"))
    assert same(relational.read_ranges(stored(spark, one), "K", 4, "T").select("K", "T"), one)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(-3, 3), st.none() | st.integers(-2, 2)), max_size=4, unique=True),
    st.lists(st.integers(-2, 2), max_size=3, unique=True),
)
def test_each_row_meets_one_condition(cuts, null_cuts):
    import duckdb

    cuts = sorted(cuts, key=lambda c: (c[0], c[1] is not None, c[1] or 0))
    conditions = relational.predicates("k", cuts, "t", sorted(null_cuts))
    counted = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in conditions)
    space = "(SELECT unnest([-4,-3,-2,-1,0,1,2,3,4,NULL]) AS k) a, (SELECT unnest([-3,-2,-1,0,1,2,3,NULL]) AS t) b"
    assert duckdb.sql(f"SELECT count(*) FROM {space} WHERE {counted} <> 1").fetchall() == [(0,)]


def test_copy_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    rows = skewed(spark, 3_000)
    source, path = stored(spark, rows), str(tmp_path / "copy")
    read, asked = relational._ranges, []

    def failing(s, conditions):
        asked.append(tuple(conditions))
        if len(asked) == 3:
            raise ConnectionError("gone")
        return read(s, conditions)

    monkeypatch.setattr(relational, "_ranges", failing)
    with pytest.raises(ConnectionError):
        relational.extract(source, "K", path, 8, "T", columns=["K", "T"], wave=2)
    again = relational.extract(source, "K", path, 8, "T", columns=["K", "T"], wave=5)
    assert same(again, rows.select("K", "T"))
    assert asked[3] == asked[2] and len(set(asked)) == len(asked) - 1  # finished waves weren't asked for again
