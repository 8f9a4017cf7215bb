"""Where rounding decides: deviations on their limit, halves and means, to the last digit as SQL has them."""

import datetime

import duckdb
from pyspark.sql import functions as F

from kalmia.functions import ratings as R
from kalmia.operators import gaps
from kalmia.operators import ratings as folds

START = datetime.datetime(2024, 1, 1)


def test_spreads_on_the_limit(spark):
    pairs = [(i, p) for i, p in enumerate([[a, a + 40] for a in range(61)] + [[a + 40, a] for a in range(61)])]
    rows = [(2 * u + i, u, "p", h / 100, START + datetime.timedelta(hours=i)) for u, p in pairs for i, h in enumerate(p)]
    table = spark.createDataFrame(rows, "id long, user_id long, detected_pattern string, detected_confidence double, submitted_at timestamp").repartition(7)
    stats = gaps.history_stats(table, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    got = {r["user_id"] for r in gaps.inconsistent(stats, table.groupBy("user_id").agg(F.count("*").alias("total"))).collect()}
    values = ", ".join(f"({i}, {u}, {c}::DOUBLE)" for i, u, _, c, _ in rows)
    sql = duckdb.sql(f"SELECT u FROM (SELECT u, stddev_pop(c ORDER BY i DESC) AS s FROM (VALUES {values}) v(i, u, c) GROUP BY u) WHERE s > 0.2").fetchall()
    assert got == {r[0] for r in sql}
    assert 0 < len(got) < len(pairs)


def test_halves(spark):
    got = spark.range(10_000).select(((F.col("id") * 2 + 1) / 20_000).alias("x")).select("x", R.rounded(F.col("x"), 4).alias("y"))
    rows = got.collect()
    sql = duckdb.sql("SELECT round((i * 2 + 1) / 20000, 4) FROM range(10000) r(i) ORDER BY i").fetchall()
    assert [r["y"] for r in rows] == [r[0] for r in sql]

def test_means_of_changes(spark):
    rows = [(u, i, f"p{i}", round(10 + u * 0.00137 + i * 0.00001 * (u % 3), 6)) for u in range(300) for i in range(4)]
    table = spark.createDataFrame(rows, "user_id long, place int, pattern_id string, delta double").repartition(5)
    got = {r["user_id"]: r["average_elo_change"] for r in folds.global_summary(table, ["user_id"], places=5).collect()}
    values = ", ".join(f"({u}, {i}, {d}::DOUBLE)" for u, i, _, d in rows)
    sql = duckdb.sql(f"SELECT u, round(avg(d ORDER BY d, i DESC), 5) FROM (VALUES {values}) v(u, i, d) GROUP BY u").fetchall()
    assert got == dict(sql)


def test_learning_gains(spark):
    from kalmia.operators import recommend

    rows = spark.range(20_000).select((F.col("id") / 20_000).alias("x"), (F.col("id") % 2 == 0).alias("open"))
    got = [r["y"] for r in rows.select(recommend.learning_gain(F.col("x"), F.col("open")).alias("y")).collect()]
    sql = duckdb.sql("SELECT round(least(1, (i / 20000) * 0.7 + CASE WHEN i % 2 = 0 THEN 0.2 ELSE 0 END), 4) FROM range(20000) r(i) ORDER BY i").fetchall()
    assert got == [r[0] for r in sql]


def test_recency_halves(spark, tmp_path):
    from kalmia.plans import catalogue

    con = duckdb.connect()
    event = "i AS event_id, TIMESTAMP '2024-01-31 00:00:00' - to_seconds(162 * (2 * i + 1)) AS ts, i AS user_id, 'view' AS event_type, 50.0::DOUBLE AS value, '{}' AS props FROM range(4000) r(i)"
    part = "i + 1 AS p_partkey, 'n' AS p_name, 't' AS p_type, 'b' AS p_brand, 1 AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(150) r(i)"
    for name, rows in {"events": event, "part": part}.items():
        con.execute(f"COPY (SELECT {rows}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    got = {(r["user_id"], r["pattern_id"]): r["recency"] for r in catalogue.QUERIES["gap_history"](spark, str(tmp_path)).collect()}
    sql = con.execute(f"SELECT user_id, pattern_id, recency FROM ({catalogue.ORACLE_SQL['gap_history']})").fetchall()
    assert got == {(u, p): r for u, p, r in sql}
    assert len(got) == 4000
