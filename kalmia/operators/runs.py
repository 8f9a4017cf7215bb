"""Runs of equal values in users' histories, as summaries that merge.

A slice of a history, however long, says all that runs need in a few numbers: its first and last value, how
long the runs at both ends are, its best run, its changes and its length. Two slices that follow each other
merge into the slice of both. So histories are cut by ranges of (user, time, id), a user with half of all rows
into many slices; each is summed up on its own, and a user's few summaries are merged in order. New rows are
one more summary: ``merged`` goes on from stored ones.

Null values are a value. Results are those of ``windows.longest_runs``, ``switches`` and ``leading_run``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.operators import ordering

#: What a summary says, besides the user and its place.
FIELDS = ("first", "last", "head", "tail", "best", "changes", "n")


def summaries(rows: DataFrame, value: Column, at: str = "submitted_at", ranges: int | None = None) -> DataFrame:
    """user_id, slice (its place in time) and ``FIELDS`` for each user's rows in each range."""
    narrow = rows.select("user_id", F.col(at).alias("at"), "id", value.alias("v"))
    placed = ordering._ranged(narrow, ["user_id", "at", "id"], ranges)
    within = Window.partitionBy("user_id", "_range").orderBy("_at")
    changed = F.lag(F.struct("v")).over(within)
    marked = placed.withColumn("_new", F.when(changed.isNull(), 0).otherwise((~changed["v"].eqNullSafe(F.col("v"))).cast("int")))
    run = marked.withColumn("_run", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    each = run.groupBy("user_id", "_range", "_run").agg(F.count("*").alias("n"), F.first("v").alias("v"))
    ends = each.groupBy("user_id", F.col("_range").alias("slice")).agg(
        F.min_by(F.struct("v", "n"), "_run").alias("a"), F.max_by(F.struct("v", "n"), "_run").alias("b"), F.max("n").alias("best"), F.max("_run").alias("changes"), F.sum("n").alias("n"),
    )
    return ends.select("user_id", "slice", F.col("a.v").alias("first"), F.col("b.v").alias("last"), F.col("a.n").alias("head"), F.col("b.n").alias("tail"), "best", F.col("changes").cast("long").alias("changes"), "n")


def _joined(a: Column, b: Column) -> Column:
    """The summary of two slices, b after a."""
    same = a["last"].eqNullSafe(b["first"])
    across = a["tail"] + b["head"]
    whole = lambda s: s["changes"] == 0
    return F.struct(
        a["first"].alias("first"), b["last"].alias("last"), F.when(same & whole(a), across).otherwise(a["head"]).alias("head"), F.when(same & whole(b), across).otherwise(b["tail"]).alias("tail"),
        F.greatest(a["best"], b["best"], F.when(same, across).otherwise(0)).alias("best"), (a["changes"] + b["changes"] + F.when(same, 0).otherwise(1)).alias("changes"), (a["n"] + b["n"]).alias("n"),
    )


def merged(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One summary a user (slice 0) of summaries in order; ``before``: earlier rows' ones, as this returns them.

    A user has at most one summary a range, which bounds what is gathered, whatever the length of the history.
    """
    if before is not None:
        found = found.withColumn("slice", F.col("slice") + 1).unionByName(before)
    parts = F.array_sort(F.collect_list(F.struct("slice", *FIELDS)))
    held = found.groupBy("user_id").agg(F.transform(parts, lambda x: F.struct(*[x[f].alias(f) for f in FIELDS])).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    return held.select("user_id", F.lit(0).cast("long").alias("slice"), F.aggregate(rest, F.col("parts")[0], _joined).alias("s")).select("user_id", "slice", "s.*")


def longest_runs(summed: DataFrame) -> DataFrame:
    return summed.select("user_id", F.col("best").alias("longest_run"))


def switches(summed: DataFrame) -> DataFrame:
    rate = F.round(F.col("changes") / F.greatest(F.col("n") - 1, F.lit(1)), 6)
    return summed.select("user_id", F.col("changes").alias("switches"), F.col("n").alias("steps"), rate.alias("switch_rate"))


def leading_run(summed: DataFrame) -> DataFrame:
    """Of summaries of a condition: how many of the newest rows hold."""
    return summed.select("user_id", F.when(F.col("last"), F.col("tail")).otherwise(0).alias("run"))
