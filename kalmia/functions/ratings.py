"""Rating kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic ratings.
START, FLOOR = 800.0, 400.0
RATING = {"Easy": 900.0, "Medium": 1200.0, "Hard": 1500.0}
K = {"Easy": 32.0, "Medium": 24.0, "Hard": 16.0}
# Pattern ratings.
PATTERN_START, OPPONENT = 1200.0, 1200.0
# First ratings by experience, and what a confident area adds.
BASELINES, BONUS = {"beginner": 700.0, "intermediate": 900.0, "advanced": 1100.0}, 150.0


def of(table: dict[str, float], key: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def rounded(value: Column, places: int) -> Column:
    """Rounds the scaled number, as SQL engines in C do: 0.25505, a little less in binary, goes down."""
    return F.round(value * 10.0**places, 0) / 10.0**places


def expected(rating: Column, opponent: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (opponent - rating) / 400))


def updated(rating: Column, difficulty: Column, outcome: Column, places: int | None = 2) -> Column:
    """The next topic rating, never below the floor. ``places`` None keeps every digit."""
    new = F.greatest(F.lit(FLOOR), rating + of(K, difficulty) * (outcome - expected(rating, of(RATING, difficulty))))
    return new if places is None else F.round(new, places)


def outcome(verdict: Column, detected: Column, wanted: Column) -> Column:
    """1 for a pass with the wanted pattern (two missing ones agree), 0.5 for another pass, else 0."""
    return F.when(verdict == "pass", F.when(detected.eqNullSafe(wanted), 1.0).otherwise(0.5)).otherwise(0.0)


def difficulty_for(rating: Column) -> Column:
    return F.when(rating < 1000, "Easy").when(rating <= 1300, "Medium").otherwise("Hard")


def moved(difficulty: Column, by: Column) -> Column:
    """A difficulty one tier up or down, within bounds."""
    tiers = F.array(F.lit("Easy"), F.lit("Medium"), F.lit("Hard"))
    return F.element_at(tiers, F.greatest(F.lit(1), F.least(F.lit(3), F.array_position(tiers, difficulty).cast("int") + by)))


def match_score(result: Column) -> Column:
    return F.when(result == "FULL_MATCH", 1.0).when(result == "PARTIAL_MATCH", 0.5).otherwise(0.0)


def k_factor(gap: Column, history: Column) -> Column:
    raised = F.lit(32.0) + F.when(gap > 0.5, 16.0).otherwise(0.0)
    return F.least(F.lit(64.0), F.when(history >= 3, F.greatest(raised - 8, F.lit(8.0))).otherwise(raised))


def drift(result: Column, full: Column, none: Column) -> Column:
    """What repeated full or missing matches among the last five take off a score."""
    return (
        F.when((result == "FULL_MATCH") & (full >= 3), F.greatest(1 - (full - 2) * 0.1, F.lit(0.5)))
        .when((result == "NO_MATCH") & (none >= 3), F.greatest(1 - (none - 2) * 0.15, F.lit(0.3)))
        .otherwise(1.0)
    )


def resolved_score(base: Column, gap: Column, confidence: Column) -> Column:
    lowered = F.when(gap > 0.6, F.greatest(F.lit(0.0), base - 0.3)).when(gap > 0.3, F.greatest(F.lit(0.0), base - 0.15)).otherwise(base)
    return F.when((confidence > 0) & (base < 0.5), F.greatest(lowered, F.lit(0.2))).otherwise(lowered)


def opponent_for(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, OPPONENT + 200).otherwise(OPPONENT)


def confidence_weight(result: Column, gap: Column, confidence: Column) -> Column:
    base = F.when(result == "NO_MATCH", 0.4).when(result == "PARTIAL_MATCH", 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base - gap * 0.3 + confidence * 0.2))
