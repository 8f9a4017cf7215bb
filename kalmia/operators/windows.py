"""Ranking, runs and streaks: what a user's ordered history says.

Every order ends with the id, so that equal times don't make a result depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], n: int, at: str = "submitted_at") -> DataFrame:
    """Each key's last ``n`` rows, with rn (1: the newest). The rank filter lets Spark limit groups early."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("id").desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Each key's first ``n`` rows in an order, with rn."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def leading_run(rows: DataFrame, keys: Sequence[str], holds: Column, at: str = "submitted_at") -> DataFrame:
    """How many of each key's newest rows hold, up to the first that doesn't."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.sum(F.when(holds, 0).otherwise(1)).over(w)
    return rows.withColumn("broken", broken).groupBy(*keys).agg(F.count_if(F.col("broken") == 0).alias("run"))


def daily_streak(rows: DataFrame, at: str = "submitted_at") -> DataFrame:
    """user_id, last_submission_date, current_streak: days in a row up to the last day with a row."""
    days = rows.select("user_id", F.to_date(at).alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    islands = days.withColumn("island", F.date_sub("day", rank)).groupBy("user_id", "island").agg(F.max("day").alias("last_submission_date"), F.count("*").alias("current_streak"))
    return islands.groupBy("user_id").agg(F.max(F.struct("last_submission_date", "current_streak")).alias("x")).select("user_id", "x.*")


def longest_runs(rows: DataFrame, value: str, at: str = "submitted_at") -> DataFrame:
    """Each user's longest run of one value."""
    w = Window.partitionBy("user_id").orderBy(at, "id")
    v = Window.partitionBy("user_id", value).orderBy(at, "id")
    islands = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    return islands.groupBy("user_id", value, "island").count().groupBy("user_id").agg(F.max("count").alias("longest_run"))


def switches(rows: DataFrame, value: str, at: str = "submitted_at") -> DataFrame:
    """Each user's changes of a value, and their share of the steps."""
    before = F.lag(value).over(Window.partitionBy("user_id").orderBy(at, "id"))
    counted = rows.withColumn("changed", F.coalesce(before != F.col(value), F.lit(False)))
    return counted.groupBy("user_id").agg(F.count_if("changed").alias("switches"), F.count("*").alias("steps")).withColumn("switch_rate", F.round(F.col("switches") / F.greatest(F.col("steps") - 1, F.lit(1)), 6))


def attempts(rows: DataFrame) -> DataFrame:
    """attempt_number per user and problem; 1 where no problem is known."""
    rank = F.row_number().over(Window.partitionBy("user_id", "problem_id").orderBy("submitted_at", "id"))
    return rows.withColumn("attempt_number", F.when(F.col("problem_id").isNull(), 1).otherwise(rank))
