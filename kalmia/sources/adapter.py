"""Learning tables over the driver's star schema: problems from part, submissions from events."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalmia.functions.taxonomy import ORDER, pattern_dim, pattern_dim_sql

PRIMARY = 27


def pattern_at(ix: Column) -> Column:
    """A pattern's id by its place; a literal lookup, so no join."""
    return F.element_at(F.array(*[F.lit(p) for p in ORDER]), (ix + 1).cast("int"))


@dataclasses.dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def pattern_dim(self) -> DataFrame:
        return pattern_dim(self.spark)

    @property
    def problems(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        primary, second = pattern_at(key % PRIMARY), pattern_at((key * 7 + 3) % len(ORDER))
        return self.read("part").select(
            key.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("topics"), F.col("p_brand").alias("category"),
            F.when(size <= 16, "Easy").when(size <= 41, "Medium").otherwise("Hard").alias("difficulty"),
            primary.alias("primary_pattern"), F.concat(F.lit('["'), primary, F.lit('","'), second, F.lit('"]')).alias("pattern"),
            F.col("p_retailprice").cast("double").alias("acceptance_rate"),
        )

    @property
    def submissions(self) -> DataFrame:
        pid = (F.col("event_id") * 31 + F.col("user_id")) % 150 + 1
        kind = F.col("event_type")
        verdict = F.when(kind.isin("purchase", "signup"), "pass").when(kind == "view", "fail").when(kind == "click", "tle").otherwise("error")
        events = self.read("events").select(
            F.col("event_id").alias("id"), "user_id", pid.alias("problem_id"), F.col("ts").cast("timestamp").alias("submitted_at"), verdict.alias("verdict"),
            (F.floor("value").cast("bigint") % 101).cast("double").alias("hundredths"),
        )
        known = self.problems.select(F.col("id").alias("problem_id"), F.col("primary_pattern").alias("expected_pattern"))
        rows = events.join(known, "problem_id")
        detected = pattern_at(F.when(F.col("id") % 3 == 0, F.col("problem_id") % PRIMARY).otherwise((F.col("id") * 5) % len(ORDER)))
        return rows.select(
            "id", "user_id", "problem_id", "submitted_at", "verdict", "expected_pattern", F.col("expected_pattern").alias("topic"),
            detected.alias("detected_pattern"), (F.col("hundredths") / 100).alias("detected_confidence"), (detected != F.col("expected_pattern")).alias("gap_identified"),
        )

    @property
    def users(self) -> DataFrame:
        return self.submissions.select("user_id").distinct()


#: The same relations for DuckDB; every oracle begins with them.
SQL = f"""WITH RECURSIVE {pattern_dim_sql()},
problems AS (
  SELECT p_partkey AS id, p_name AS title, p_type AS topics, p_brand AS category,
    CASE WHEN p_size <= 16 THEN 'Easy' WHEN p_size <= 41 THEN 'Medium' ELSE 'Hard' END AS difficulty,
    a.pattern_id AS primary_pattern, '["' || a.pattern_id || '","' || b.pattern_id || '"]' AS pattern, CAST(p_retailprice AS DOUBLE) AS acceptance_rate
  FROM part JOIN pattern_dim a ON a.ix = p_partkey % {PRIMARY} JOIN pattern_dim b ON b.ix = (p_partkey * 7 + 3) % {len(ORDER)}
), raw_submissions AS (
  SELECT event_id AS id, user_id, (event_id * 31 + user_id) % 150 + 1 AS problem_id, ts AS submitted_at,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'pass' WHEN event_type = 'view' THEN 'fail' WHEN event_type = 'click' THEN 'tle' ELSE 'error' END AS verdict,
    CAST(CAST(floor(value) AS BIGINT) % 101 AS DOUBLE) / 100 AS detected_confidence
  FROM events
), submissions AS (
  SELECT s.id, s.user_id, s.problem_id, s.submitted_at, s.verdict, p.primary_pattern AS expected_pattern, p.primary_pattern AS topic,
    d.pattern_id AS detected_pattern, s.detected_confidence, d.pattern_id <> p.primary_pattern AS gap_identified
  FROM raw_submissions s JOIN problems p ON p.id = s.problem_id
  JOIN pattern_dim d ON d.ix = CASE WHEN s.id % 3 = 0 THEN s.problem_id % {PRIMARY} ELSE (s.id * 5) % {len(ORDER)} END
)"""
