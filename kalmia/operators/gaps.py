"""Gap signals: how strongly a user misses a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.functions import ratings as R
from kalmia.operators import windows

# Fixed values.
MISS, RECENCY, PENALTY = 0.5, 0.3, 0.2
STRONG, MODERATE, LOW, LEAST = 0.7, 0.4, 0.6, 0.01
RECENT, HORIZON_HOURS = 5, 720.0
#: Confidences scatter over this deviation; so near to it rounding decides.
SPREAD, NOISE = 0.2, 1e-9


def confidence_penalty(confidence: Column) -> Column:
    return F.when(confidence >= LOW, 0.0).otherwise((LOW - confidence) / LOW)


def level(strength: Column) -> Column:
    return F.when(strength >= STRONG, "strong_gaps").when(strength >= MODERATE, "moderate_gaps").otherwise("weak_gaps")


def running_deviation(values: Column) -> Column:
    """The population deviation of an array, taken up value by value: in one order one result, to the last bit."""
    x0 = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["sq"] + (x - mean) * (x - s["mean"])).alias("sq"))

    return F.aggregate(values, x0, step, lambda s: F.sqrt(s["sq"] / s["n"]))


def history_stats(rows: DataFrame, as_of: Column) -> DataFrame:
    """Per (user_id, pattern): frequency, recency, spread and anti-bias over the user's submissions.

    One window pass: each pattern's newest five rows weigh by age (to 0 after 30 days before ``as_of``) and place.
    Spreads within ``NOISE`` of the limit are taken up from the newest row on, so that neither partitions nor an
    engine's own formula decide on which side they are.
    """
    known = rows.filter(F.coalesce("detected_pattern", F.lit("")) != "").withColumnRenamed("detected_pattern", "pattern_id")
    newest = Window.partitionBy("user_id", "pattern_id").orderBy(F.col("submitted_at").desc(), F.col("id").desc())
    whole = Window.partitionBy("user_id", "pattern_id")
    ranked = known.withColumns({"rn": F.row_number().over(newest), "n": F.count("*").over(whole), "_spread": F.stddev_pop("detected_confidence").over(whole)})
    held = F.least("n", F.lit(RECENT))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("submitted_at")) / 3600.0
    weight = F.greatest(F.lit(0.0), 1 - age / HORIZON_HOURS) * (held - F.col("rn") + 1) / held
    recent = F.col("rn") <= RECENT
    near = (F.abs(F.col("_spread") - SPREAD) < NOISE) & F.col("detected_confidence").isNotNull()
    held_near = F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("rn", F.col("detected_confidence").cast("double").alias("c"))))), lambda x: x["c"])
    spread = F.when(F.size(held_near) > 0, running_deviation(held_near)).otherwise(F.max("_spread"))
    return ranked.groupBy("user_id", "pattern_id").agg(
        F.count("*").alias("frequency"), F.least(F.lit(1.0), F.sum(F.when(recent, weight)) / F.max(held)).alias("recency"), spread.alias("spread"),
        (F.count_if(recent & (F.coalesce("detected_confidence", F.lit(0.0)) >= LOW)) == F.max(held)).alias("all_confident"), F.max("submitted_at").alias("last_seen"),
    )


def inconsistent(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Patterns with two rows or more and a spread over 0.2, of users with two or more."""
    return stats.join(totals, "user_id").filter((F.col("frequency") >= 2) & (F.col("spread") > SPREAD) & (F.col("total") >= 2))


def signals(candidates: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Gap signals of candidates (user_id, pattern_id, unmatched bool, confidence of the last detection or null, match_result)."""
    stats = history_stats(rows, as_of)
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    shaky = inconsistent(stats, totals).select("user_id", "pattern_id", F.lit(True).alias("shaky"))
    everyone = candidates.join(shaky, ["user_id", "pattern_id"], "full_outer").join(stats, ["user_id", "pattern_id"], "left").join(totals, "user_id", "left")
    weak = F.when(F.col("confidence") < LOW, confidence_penalty(F.col("confidence"))).when(F.col("shaky"), 0.3).otherwise(0.0)
    unmatched = F.coalesce("unmatched", F.lit(False))
    penalty = F.when(weak > 0, weak).when(unmatched, 0.5).otherwise(0.0)
    is_candidate = unmatched | F.coalesce(F.col("confidence") < LOW, F.lit(False)) | F.coalesce("shaky", F.lit(False))
    free = ~F.coalesce(F.col("all_confident"), F.lit(False)) & (F.coalesce("match_result", F.lit("")) != "FULL_MATCH")
    miss = F.least(F.lit(1.0), F.coalesce(F.col("frequency") / F.greatest("total", F.lit(1)), F.lit(0.0)))
    recency = F.coalesce("recency", F.lit(0.0))
    strength = R.rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), miss * MISS + recency * RECENCY + penalty * PENALTY)), 4)
    out = everyone.filter(is_candidate & free).select(
        "user_id", "pattern_id", strength.alias("gap_strength"), F.coalesce("frequency", F.lit(0)).alias("frequency"),
        F.round(recency, 4).alias("recency_score"), F.round(penalty, 4).alias("confidence_penalty"),
    )
    return out.filter(F.col("gap_strength") >= LEAST)


def current(submissions: DataFrame, as_of: Column) -> DataFrame:
    """Gap signals of each user by the latest submission: its pattern, and the expected one if that was missed. A full match silences all of a user's signals."""
    last = windows.latest(submissions, ["user_id"], 1)
    seen = last.select("user_id", F.col("detected_pattern").alias("pattern_id"), F.col("detected_confidence").alias("confidence"), F.lit(False).alias("unmatched"))
    missed = last.filter("gap_identified").select("user_id", F.col("expected_pattern").alias("pattern_id"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("unmatched"))
    found = signals(seen.unionByName(missed).withColumn("match_result", F.lit(None).cast("string")), submissions, as_of)
    return found.join(last.filter("NOT gap_identified").select("user_id"), "user_id", "left_anti")


def by_strength(found: DataFrame) -> DataFrame:
    """Per user the signals from the strongest on, equal ones by pattern: user_id, patterns, strengths."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("gap_strength")).alias("s"), F.col("pattern_id").alias("p"))))
    return found.groupBy("user_id").agg(ordered.alias("o")).select("user_id", F.transform("o", lambda x: x["p"]).alias("patterns"), F.transform("o", lambda x: -x["s"]).alias("strengths"))


def summary(found: DataFrame) -> DataFrame:
    """Per user the patterns of each level, in order of the pattern."""
    names = [F.array_join(F.array_sort(F.collect_list(F.when(level(F.col("gap_strength")) == k, F.col("pattern_id")))), ",").alias(k) for k in ("strong_gaps", "moderate_gaps", "weak_gaps")]
    return found.groupBy("user_id").agg(*names)
