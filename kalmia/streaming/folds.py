"""Incremental forms: keyed state for ratings and streaks, event-time windows.

Rows of a micro-batch are sorted per key before they are folded. ``topic_profiles`` and ``pattern_ratings``
take them as they come, so their input must be in order per key across batches; given ``late``, they hold
rows back until the watermark has passed them, so that any order within that time gives the same ratings
and later rows are left out. On such input batch and stream give the same state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kalmia.functions import ratings as R

PROFILE = "user_id long, topic string, elo_rating double, attempt_count long, pass_count long, recent_failures long"
PROFILE_STATE = "elo double, attempts long, passes long, failures long"
PATTERN = "user_id long, pattern_id string, elo double, updates long"
STREAK = "user_id long, last_submission_date date, current_streak long"


def _held(start: tuple, fold: Callable[[tuple, list[dict]], tuple], show: Callable[[tuple, tuple], dict], waits: bool):
    """A state function of ``fold``: over all rows at once, or (``waits``) over those that the watermark has passed; the rest stay in the state."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *old, waiting = state.get if state.exists else (*start, "[]")
        rows = json.loads(waiting) + [r for b in batches for r in b.drop(columns="submitted_at").to_dict("records")]
        seen = state.getCurrentWatermarkMs() if waits else None
        ready = sorted((r for r in rows if not waits or r["at_us"] <= seen * 1000), key=lambda r: (r["at_us"], r["id"]))
        rest = [r for r in rows if waits and r["at_us"] > seen * 1000]
        new = fold(tuple(old), ready)
        state.update((*new, json.dumps(rest, default=lambda x: x.item())))
        if rest:
            state.setTimeoutTimestamp(max(seen + 1, min(r["at_us"] for r in rest) // 1000))
        if ready:
            yield pd.DataFrame([show(key, new)])

    return step


def _kept(stream: DataFrame, columns: tuple[str, ...], fold, start: tuple, show, shape: str, state: str, late: str | None) -> DataFrame:
    rows = stream.select(*columns, F.col("submitted_at").cast("timestamp").alias("submitted_at"), F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("at_us"), "id")
    rows = rows.withWatermark("submitted_at", late) if late else rows
    wait = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy(*columns[:2]).applyInPandasWithState(_held(start, fold, show, bool(late)), shape, f"{state}, waiting string", "update", wait)


def _profile(old: tuple, rows: list[dict]) -> tuple:
    elo, attempts, passes, failures = old
    for row in rows:
        won = (1.0 if row["detected_pattern"] == row["expected_pattern"] else 0.5) if row["verdict"] == "pass" else 0.0
        hope = 1 / (1 + 10 ** ((R.RATING[row["difficulty"]] - elo) / 400))
        elo = max(R.FLOOR, elo + R.K[row["difficulty"]] * (won - hope))
        attempts, passes = attempts + 1, passes + (row["verdict"] == "pass")
        failures = failures + 1 if row["verdict"] == "fail" else max(0, failures - 1)
    return float(elo), int(attempts), int(passes), int(failures)


def topic_profiles(stream: DataFrame, late: str | None = None) -> DataFrame:
    """The profiles that a micro-batch changed, as they stand after it (unrounded)."""
    show = lambda key, s: {"user_id": key[0], "topic": key[1], "elo_rating": s[0], "attempt_count": s[1], "pass_count": s[2], "recent_failures": s[3]}
    columns = ("user_id", "topic", "verdict", "difficulty", "detected_pattern", "expected_pattern")
    return _kept(stream, columns, _profile, (R.START, 0, 0, 0), show, PROFILE, PROFILE_STATE, late)


def _two_places(x: float) -> float:
    """Halves away from zero on the shortest decimal form, as the JVM rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _pattern(old: tuple, rows: list[dict]) -> tuple:
    elo, updates = old
    for row in rows:
        hope = 1 / (1 + 10 ** ((row["opponent"] - elo) / 400))
        elo, updates = _two_places(max(R.FLOOR, elo + row["k"] * (row["score"] - hope))), updates + 1
    return float(elo), int(updates)


def pattern_ratings(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Pattern ratings that a micro-batch changed. Scores, K factors and opponents don't depend on the state
    and so are expressions; input as ``operators.ratings.pattern_replay``'s."""
    gap, conf = (F.coalesce(c, F.lit(0.0)) for c in ("gap_strength", "confidence"))
    ready = stream.select(
        "user_id", "pattern_id", "submitted_at", "id", R.resolved_score(R.match_score(F.col("match_result")), gap, conf).alias("score"),
        R.k_factor(gap, F.lit(0)).alias("k"), R.opponent_for(conf).alias("opponent"),
    )
    show = lambda key, s: {"user_id": key[0], "pattern_id": key[1], "elo": s[0], "updates": s[1]}
    return _kept(ready, ("user_id", "pattern_id", "score", "k", "opponent"), _pattern, (R.PATTERN_START, 0), show, PATTERN, "elo double, updates long", late)


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, run = state.get if state.exists else (None, 0)
    for day in sorted({d.toordinal() for b in batches for d in b["day"]}):
        if last is None or day > last:
            run, last = run + 1 if last is not None and day == last + 1 else 1, day
    state.update((last, run))
    yield pd.DataFrame({"user_id": [key[0]], "last_submission_date": [pd.Timestamp.fromordinal(last).date()], "current_streak": [run]})


def daily_streaks(stream: DataFrame) -> DataFrame:
    """Streaks up to each user's newest day. A day before that changes nothing: the state has no room for gaps."""
    days = stream.select("user_id", F.to_date("submitted_at").alias("day"))
    return days.groupBy("user_id").applyInPandasWithState(_streak, STREAK, "last long, run long", "update", GroupStateTimeout.NoTimeout)


def event_windows(stream: DataFrame, width: str = "1 day", late: str = "2 hours", once: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and type; rows of one ``once`` within the lateness count once."""
    timed = stream.withWatermark("ts", late)
    timed = timed.dropDuplicatesWithinWatermark([once]) if once else timed
    kept = timed.groupBy(F.window("ts", width).alias("w"), "event_type")
    return kept.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts per user and session."""
    kept = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return kept.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(out: DataFrame, mode: str, target: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, each micro-batch to its own folder: a batch that runs twice
    writes the same folder twice."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/part={batch}")

    query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
