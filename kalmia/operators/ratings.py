"""Ordered rating folds.

Updates with a floor don't commute, so each key's rows are gathered, sorted and folded; a key is a
(user, topic) and its history is short. The fold runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalmia.functions import ratings as R


def _history(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    step = F.struct("submitted_at", "id", "verdict", "difficulty", "detected_pattern", "expected_pattern")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def _fold(rows: DataFrame, keys: Sequence[str], failures: Callable[[Column, Column, Column], Column], matches: bool, places: int | None, start_at: DataFrame | None = None) -> DataFrame:
    """``start_at``: profiles to go on from, as this returns them."""
    fresh = {"elo": F.lit(R.START), **{n: F.lit(0) for n in ("attempts", "passes", "matched")}, "failures": F.lit(0).cast("bigint")}
    known = dict(zip(fresh, ("elo_rating", "attempt_count", "pass_count", "pattern_match_count", "recent_failures"), strict=True))
    start = F.struct(*[(v if start_at is None else F.coalesce(F.col(f"_from.{n}"), v)).alias(n) for n, v in fresh.items()])

    def step(s: Column, x: Column) -> Column:
        won = R.outcome(x["verdict"], x["detected_pattern"], x["expected_pattern"])
        passed = x["verdict"] == "pass"
        hit = (passed & x["detected_pattern"].eqNullSafe(x["expected_pattern"])) if matches else F.lit(False)
        return F.struct(
            R.updated(s["elo"], x["difficulty"], won, places).alias("elo"), (s["attempts"] + 1).alias("attempts"), (s["passes"] + passed.cast("int")).alias("passes"),
            (s["matched"] + hit.cast("int")).alias("matched"), failures(s["failures"], x["verdict"], won).cast("bigint").alias("failures"),
        )

    history = _history(rows, keys)
    if start_at is not None:
        history = history.join(start_at.select(*keys, F.struct(*[F.col(c).alias(n) for n, c in known.items()]).alias("_from")), list(keys), "left")
    folded = history.select(*keys, F.aggregate("steps", start, step).alias("s"), F.element_at("steps", -1)["submitted_at"].alias("last_attempt_at"))
    return folded.select(
        *keys, F.col("s.elo").alias("elo_rating"), F.col("s.attempts").alias("attempt_count"), F.col("s.passes").alias("pass_count"),
        F.col("s.matched").alias("pattern_match_count"), (F.col("s.passes") / F.col("s.attempts")).alias("accuracy"), F.col("s.failures").alias("recent_failures"), "last_attempt_at",
    )


def topic_profiles(rows: DataFrame, places: int | None = 2, start_at: DataFrame | None = None) -> DataFrame:
    """Profiles per (user_id, topic) from submissions with a difficulty. A fail raises recent_failures,
    anything else lowers it by one, to no less than 0. ``start_at``: what earlier submissions left of these profiles."""
    fail = lambda n, verdict, _: F.when(verdict == "fail", n + 1).otherwise(F.greatest(F.lit(0).cast("bigint"), n - 1))
    return _fold(rows.filter("difficulty IS NOT NULL"), ["user_id", "topic"], fail, True, places, start_at)


def backfilled_profiles(rows: DataFrame, places: int | None = 2) -> DataFrame:
    """Profiles rebuilt from raw submissions: the topic is the detected, expected or stated one, a missing
    difficulty is Easy, matches stay 0, and recent_failures follows the backfill's own rule: a row that
    isn't a full win adds 1, a full win adds max(0, n - 1)."""
    chosen = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("detected_pattern", "expected_pattern", "topic")])
    ready = rows.withColumns({"topic": chosen, "difficulty": F.coalesce("difficulty", F.lit("Easy"))}).filter("topic IS NOT NULL")
    fail = lambda n, _, won: n + F.when(won < 1.0, F.lit(1).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), n - 1))
    return _fold(ready, ["user_id", "topic"], fail, False, places)


def seeded(users: DataFrame, patterns: DataFrame) -> DataFrame:
    """First profiles: each user (experience_level, confident_areas) with each pattern of the fixed dimension."""
    level = F.lower(F.trim(F.coalesce("experience_level", F.lit("beginner"))))
    sure = F.array_contains(F.coalesce("confident_areas", F.array().cast("array<string>")), F.col("category"))
    elo = R.of(R.BASELINES, level) + F.when(sure, R.BONUS).otherwise(0.0)
    return users.join(F.broadcast(patterns), F.lit(True)).select("user_id", F.col("pattern_id").alias("topic"), elo.alias("elo_rating"))


def pattern_updates(candidates: DataFrame, places: int | None = 2) -> DataFrame:
    """One submission's rating changes per pattern.

    candidates: match_result, gap_strength, confidence, old_elo, history, full_count, none_count (nulls: no gap,
    not detected, first rating, no history).
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gap, conf, old = zero(F.col("gap_strength")), zero(F.col("confidence")), F.coalesce("old_elo", F.lit(R.PATTERN_START))
    n = lambda c: F.coalesce(c, F.lit(0))
    score = R.resolved_score(R.match_score(F.col("match_result")), gap, conf) * R.drift(F.col("match_result"), n(F.col("full_count")), n(F.col("none_count")))
    delta = R.k_factor(gap, n(F.col("history"))) * (score - R.expected(old, R.opponent_for(conf)))
    new = F.greatest(F.lit(R.FLOOR), old + delta)
    new = new if places is None else F.round(new, places)
    return candidates.withColumns({"old_elo": old, "new_elo": new, "delta": new - old, "confidence_weight": R.confidence_weight(F.col("match_result"), gap, conf)})


def pattern_replay(rows: DataFrame) -> DataFrame:
    """Pattern ratings per (user_id, pattern_id) after all submissions, each taken with its own pattern's outcome.

    rows: user_id, pattern_id, submitted_at, id, match_result, gap_strength, confidence.
    """
    step_in = F.struct("submitted_at", "id", "match_result", F.coalesce("gap_strength", F.lit(0.0)).alias("gap"), F.coalesce("confidence", F.lit(0.0)).alias("conf"))
    history = rows.groupBy("user_id", "pattern_id").agg(F.array_sort(F.collect_list(step_in)).alias("steps"))

    def step(elo: Column, x: Column) -> Column:
        score = R.resolved_score(R.match_score(x["match_result"]), x["gap"], x["conf"])
        return F.round(F.greatest(F.lit(R.FLOOR), elo + R.k_factor(x["gap"], F.lit(0)) * (score - R.expected(elo, R.opponent_for(x["conf"])))), 2)

    return history.select("user_id", "pattern_id", F.aggregate("steps", F.lit(R.PATTERN_START), step).alias("elo"), F.size("steps").alias("updates"))


def candidate_patterns(gaps: Column, detected: Column, unmatched: Column) -> Column:
    """The patterns that a submission rates: those with gaps, detected, unmatched, in this order and once each; ``default`` if there are none."""
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(c, none) for c in (gaps, detected, unmatched)])
    found = F.array_distinct(F.filter(every, lambda p: F.coalesce(p, F.lit("")) != ""))
    return F.when(F.size(found) == 0, F.array(F.lit("default"))).otherwise(found)


def submission_updates(rows: DataFrame, places: int | None = 2) -> DataFrame:
    """Rating changes by whole submissions: a row for each candidate pattern (place: its order) with pattern_id, old_elo, new_elo, delta and confidence_weight.

    rows: match_result, gaps array<struct<pattern_id, gap_strength>>, detections array<struct<pattern_id, confidence>>,
    unmatched array<string>, elos map<string, double>, and keys, which stay; nulls: none. A pattern's history is its newest
    results, ``histories`` map<string, array<string>>, if there is such a column. Gaps count by strength, then name.
    """
    one = "array<struct<pattern_id:string,{}:double>>"
    gaps, seen = (F.coalesce(F.col(c).cast(one.format(v)), F.array().cast(one.format(v))) for c, v in (("gaps", "gap_strength"), ("detections", "confidence")))
    ordered = F.transform(F.array_sort(F.transform(gaps, lambda g: F.struct((-g["gap_strength"]).alias("s"), g["pattern_id"].alias("p")))), lambda g: g["p"])
    last_of = lambda xs, p, v: F.element_at(F.filter(xs, lambda x: x["pattern_id"] == p), -1)[v]
    used = ("gaps", "detections", "unmatched", "elos", "histories")
    keys = [c for c in rows.columns if c not in (*used, "match_result")]
    base = rows.withColumns({"_gaps": gaps, "_seen": seen, "_all": candidate_patterns(ordered, F.transform(seen, lambda d: d["pattern_id"]), F.col("unmatched"))})
    p = F.col("pattern_id")
    recent = F.slice(F.reverse(F.coalesce(F.try_element_at("histories", p), F.array().cast("array<string>"))), 1, 5) if "histories" in rows.columns else F.array().cast("array<string>")
    length = F.size(F.coalesce(F.try_element_at("histories", p), F.array().cast("array<string>"))) if "histories" in rows.columns else F.lit(0)
    long = base.select("*", F.posexplode("_all").alias("place", "pattern_id")).withColumns({"_recent": recent, "history": length})
    ready = long.withColumns({
        "gap_strength": F.when(F.exists("_gaps", lambda g: g["pattern_id"] == p), last_of(F.col("_gaps"), p, "gap_strength")),
        "confidence": F.when(F.exists("_seen", lambda d: d["pattern_id"] == p), last_of(F.col("_seen"), p, "confidence")),
        "old_elo": F.try_element_at("elos", p), "full_count": F.size(F.filter("_recent", lambda m: m == "FULL_MATCH")), "none_count": F.size(F.filter("_recent", lambda m: m == "NO_MATCH")),
    })
    done = pattern_updates(ready, places)
    shown = (lambda c, n: F.col(c)) if places is None else (lambda c, n: F.round(c, n).alias(c))
    return done.select(*keys, "place", "pattern_id", shown("old_elo", 2), "new_elo", shown("delta", 2), shown("confidence_weight", 4))


def global_summary(updates: DataFrame, keys: Sequence[str], places: int = 2) -> DataFrame:
    """``keys``, average_elo_change, up to three strongest gains and three worst losses; equal ones in the candidates' order (losses: against it)."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("delta")).alias("d"), F.col("place").alias("o"), F.col("pattern_id").alias("p")))), 1, 3)
    low = F.slice(F.array_sort(F.collect_list(F.struct(F.col("delta").alias("d"), (-F.col("place")).alias("o"), F.col("pattern_id").alias("p")))), 1, 3)
    pick = lambda xs: F.transform(F.filter(xs, lambda x: x["d"] < 0), lambda x: x["p"])
    # Summed from the greatest loss on, so that the last digit doesn't depend on partitions.
    deltas = F.array_sort(F.collect_list(F.struct(F.col("delta").cast("double").alias("d"), (-F.col("place")).alias("o"))))
    mean = F.aggregate(deltas, F.lit(0.0), lambda s, x: s + F.coalesce(x["d"], F.lit(0.0))) / F.count("delta")
    return updates.groupBy(*keys).agg(R.rounded(mean, places).alias("average_elo_change"), pick(top).alias("strongest_improvement_patterns"), pick(low).alias("weakest_patterns"))
