"""The gate before a write: each rule found, filters without misses."""

from collections import Counter

from pyspark.sql import functions as F

from kalmia.operators import gate

SHAPE = "id long, user_id long, problem_id long, verdict string, topic string, detected_confidence double, submitted_at string, gap_identified boolean, attempt_number int"
GOOD = (1, 1, 5, "pass", "t", 0.5, "2024-01-01", True, 1)


def row(i, **changed):
    names = [c.split()[0] for c in SHAPE.split(", ")]
    return tuple((dict(zip(names, GOOD, strict=True)) | {"id": i} | changed)[n] for n in names)


def judged(spark, rows, **how):
    return sorted((r["id"] if r["id"] is not None else -1, sorted(r["broken"])) for r in gate.judged(spark.createDataFrame(rows, SHAPE), gate.TABLES["submissions"], **how).collect())


def test_each_rule(spark):
    rows = [
        row(1), row(2, verdict="maybe"), row(3, detected_confidence=1.01), row(4, detected_confidence=-0.1, verdict=None), row(5, topic=None, attempt_number=0), row(6, problem_id=99), row(7, problem_id=None),
        row(8), row(8), row(8, verdict="bad"), row(9), row(None), row(None), row(10, attempt_number=None, detected_confidence=1.0),
    ]
    stored = spark.createDataFrame([(9,), (None,), (77,)], "id long")
    problems = spark.createDataFrame([(5,), (6,)], "id long")
    assert judged(spark, rows, stored=stored, parents={"problem_id": problems}) == sorted([
        (1, []), (2, ["verdict_known"]), (3, ["detected_confidence_range"]), (4, ["detected_confidence_range", "verdict_missing"]), (5, ["attempt_number_range", "topic_missing"]), (6, ["problem_id_unknown"]), (7, []),
        (8, []), (8, ["repeated_key"]), (8, ["repeated_key", "verdict_known"]), (9, ["key_exists"]), (-1, ["id_missing"]), (-1, ["id_missing"]), (10, []),
    ])
    assert judged(spark, []) == [] and judged(spark, rows[:1], stored=stored.limit(0)) == [(1, [])]


def test_gate_parts_a_batch(spark):
    rows = spark.createDataFrame([row(1), row(2, verdict="maybe"), row(2)], SHAPE)
    passed, held = gate.gate(rows, "submissions")
    assert sorted(r["id"] for r in passed.collect()) == [1, 2] and [(r["table_name"], r["broken"]) for r in held.collect()] == [("submissions", ["verdict_known", "repeated_key"])]
    assert passed.columns == rows.columns


def test_other_tables(spark):
    profiles = spark.createDataFrame([(1, "a", 399.0, 0.5, 2, 1), (1, "b", 400.0, 1.5, 2, 3), (1, "c", 500.0, 1.0, 2, 2), (1, "c", 500.0, 1.0, 2, 2)], "user_id long, topic string, elo_rating double, accuracy double, attempt_count int, pass_count int")
    got = gate.judged(profiles, gate.TABLES["topic_profiles"]).collect()
    assert Counter((r["topic"], *sorted(r["broken"])) for r in got) == Counter([("a", "elo_floor"), ("b", "accuracy_range", "counts"), ("c",), ("c", "repeated_key")])


def test_filter_has_no_misses_and_few_others(spark):
    keys = spark.range(5_000).select((F.col("id") * 7919).alias("k"), F.col("id").cast("string").alias("s"))
    stored = spark.range(60_000).select((F.col("id") * 7919).alias("k"), F.col("id").cast("string").alias("s"))
    left = gate.pruned(stored, keys)
    got = {r["k"] for r in left.collect()}
    assert {r["k"] for r in keys.collect()} <= got and len(got) < 5_000 + 600
    assert gate.pruned(stored, keys.limit(0)).count() == 0


def test_stored_keys_are_not_shuffled_before_the_filter(spark):
    plan = gate.pruned(spark.range(10**6).select(F.col("id").alias("k")), spark.range(10).select(F.col("id").alias("k")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Range (0, 1000000" in plan
    stored_side = plan[: plan.index("Range (0, 1000000")].rsplit("BroadcastNestedLoopJoin", 1)[1]
    assert "Exchange hashpartitioning" not in stored_side


def test_a_stored_row_meets_one_bitmap_of_a_large_filter(spark):
    keys = spark.range(100_000).select((F.col("id") * 3).alias("k"))
    stored = spark.range(300_000).select(F.col("id").alias("k"))
    left = gate.pruned(stored, keys)
    got = {r["k"] for r in left.collect()}
    assert set(range(0, 300_000, 3)) <= got and len(got) < 100_000 + 2_000
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan[: plan.index("Range (0, 300000")]
