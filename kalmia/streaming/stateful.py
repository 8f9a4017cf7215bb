"""Keyed state of several parts: values, maps and timers in the RocksDB store.

``held`` rows wait in a map of their own, one entry a row, until the watermark has passed them; a timer at
the earliest wakes their key. So a batch writes the rows that came and removes those that were folded, and
never writes again what still waits. Rows later than the watermark are left out by Spark.

* ``topic_profiles``: a user's profiles by topic, as one value, which the taxonomy bounds: a call to the store
  costs more than the few profiles that it brings.
* ``pattern_ratings``: the interleaved fold: a user's counters and patterns, which the taxonomy bounds too, as
  one value for the same reason: each batch reads all of a user's patterns anyhow.
* ``daily_streaks``: a user's days as runs, in two maps (first day to last, last day to first), so that a day
  joins its neighbours' runs in any order of arrival: a late day that closes a gap makes two runs one. A batch
  reads the runs in one call and writes those that changed.

On input in order, or with ``late`` on input out of order by less than that, streams and batches agree.
``ttl`` (milliseconds) lets state of keys go that were idle for so long, where repeated visits aren't expected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kalmia.functions import ratings as R
from kalmia.operators import interleaved
from kalmia.runtime import ship_package
from kalmia.streaming import folds

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A moment as microseconds: a frame of its own for each user makes conversions of times and nested values dear.
RATING = "user_id long, pattern_id string, elo double, updates long, gap_strength double, frequency long, last_seen_us long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Ordered(StatefulProcessor):
    """Folds a key's rows in order of (at_us, id): as they come, or (``waits``) once the watermark has passed them."""

    def __init__(self, waits: bool, ttl: int | None) -> None:
        self.waits, self.ttl = waits, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.waits:
            self.waiting = handle.getMapState("waiting", "at_us long, id long, n long", "body string", self.ttl)
        self.parts(handle)

    def parts(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key: tuple, rows: list[dict]) -> list[dict]:
        raise NotImplementedError

    def read(self, batch: pd.DataFrame) -> list[dict]:
        return json.loads(batch.drop(columns=["submitted_at"], errors="ignore").to_json(orient="records"))

    def _out(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(self.fold(key, sorted(rows, key=lambda r: (r["at_us"], r["id"]))))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        came = [r for batch in rows for r in self.read(batch)]
        if not self.waits:
            yield from self._out(key, came)
            return
        for r in came:
            n = 0  # rows that are alike are rows of their own
            while self.waiting.containsKey(at := (r["at_us"], r["id"], n)):
                n += 1
            self.waiting.updateValue(at, (json.dumps(r),))
        self._wake(min(r["at_us"] for r in came))

    def _wake(self, at_us: int) -> None:
        at, set_ = -(-at_us // 1000), list(self.handle.listTimers())
        if not set_ or at < min(set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], None
        for at, body in list(self.waiting.iterator()):
            if at[0] <= passed:
                ready.append(json.loads(body[0]))
                self.waiting.removeKey(at)
            else:
                later = at[0] if later is None else min(later, at[0])
        if later is not None:
            self.handle.registerTimer(-(-later // 1000))
        yield from self._out(key, ready)

    def close(self) -> None:
        pass


class _Profiles(_Ordered):
    def parts(self, handle):
        self.profiles = handle.getValueState("profiles", "body string", self.ttl)

    def fold(self, key, rows):
        held = json.loads(self.profiles.get()[0]) if self.profiles.exists() else {}
        came: dict[str, list[dict]] = {}
        for r in rows:
            came.setdefault(r["topic"], []).append(r)
        for topic, theirs in came.items():
            # A null topic is a topic too: JSON has no null as a key.
            held[json.dumps(topic)] = folds._profile(held.get(json.dumps(topic), (R.START, 0, 0, 0)), theirs)
        self.profiles.update((json.dumps(held),))
        out = [(topic, held[json.dumps(topic)]) for topic in came]
        return [{"user_id": key[0], "topic": t, "elo_rating": n[0], "attempt_count": n[1], "pass_count": n[2], "recent_failures": n[3]} for t, n in out]


class _Ratings(_Ordered):
    def __init__(self, waits, ttl, places, histories):
        super().__init__(waits, ttl)
        self.places, self.histories = places, histories

    def parts(self, handle):
        self.user = handle.getValueState("user", "submissions long, last_at long, last_id long, patterns string", self.ttl)

    def read(self, batch):
        return [json.loads(body) for body in batch["body"]]

    def fold(self, key, rows):
        names = ("submissions", "last_at", "last_id", "patterns")
        told = dict(zip(names, self.user.get(), strict=True)) if self.user.exists() else None
        user = interleaved.User.of(told and told | {"patterns": json.loads(told["patterns"])})
        before = {p: (k.seen, k.rated) for p, k in user.patterns.items()}
        for r in rows:
            interleaved.submit(user, r | {"at": r["at_us"]}, self.places, self.histories, told=False)
        after = user.state()
        self.user.update((*(after[n] for n in names[:3]), json.dumps(after["patterns"])))
        out = []
        for state in after["patterns"]:
            if before.get(p := state["pattern_id"]) != (state["seen"], state["rated"]) and state["elo"] is not None:
                out.append({"user_id": key[0], "pattern_id": p, "elo": state["elo"], "updates": state["rated"], "gap_strength": state["strength"], "frequency": state["frequency"], "last_seen_us": state["last_seen"]})
        return out


def _merged(runs: dict[int, int], days: list[int]) -> dict[int, int]:
    """Runs of days (first to last) with more days."""
    out: dict[int, int] = {}
    first = last = None
    for a, b in sorted([*runs.items(), *((d, d) for d in days)]):
        if last is not None and a <= last + 1:
            last = max(last, b)
        else:
            first, last = a, b
        out[first] = last
    return out


class _Streaks(StatefulProcessor):
    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle):
        self.last_of = handle.getMapState("last_of", "first long", "last long", self.ttl)
        self.first_of = handle.getMapState("first_of", "last long", "first long", self.ttl)
        self.newest = handle.getValueState("newest", "day long", self.ttl)

    def add(self, *days: int) -> None:
        """Takes all of a batch's days at once: the runs are read in one call, and only those that changed are written."""
        held = {first: last for (first,), (last,) in self.last_of.iterator()} if self.newest.exists() else {}
        runs = _merged(held, [*days])
        for first, last in held.items() - runs.items():
            if first not in runs:
                self.last_of.removeKey((first,))
            if runs.get(self._first(runs, last)) != last:
                self.first_of.removeKey((last,))
        for first, last in runs.items() - held.items():
            self.last_of.updateValue((first,), (last,))
            self.first_of.updateValue((last,), (first,))
        if runs and runs != held:
            self.newest.update((max(runs.values()),))
        self.current = max(runs.items(), default=None)

    @staticmethod
    def _first(runs: dict[int, int], last: int) -> int:
        """The first day of the run that holds a day."""
        return max(first for first in runs if first <= last)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        self.add(*{d.toordinal() for batch in rows for d in batch["day"].dropna().unique()})
        if self.current:
            first, last = self.current
            yield pd.DataFrame({"user_id": [key[0]], "last_submission_date": [date.fromordinal(last)], "current_streak": [last - first + 1]})

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, keys: tuple[str, ...], processor: Callable[[bool], StatefulProcessor], shape: str, late: str | None) -> DataFrame:
    ship_package(rows.sparkSession)
    timed = rows.withWatermark("submitted_at", late) if late else rows
    return timed.groupBy(*keys).transformWithStateInPandas(processor(bool(late)), T.StructType.fromDDL(shape), "Update", "EventTime" if late else "None")


def topic_profiles(stream: DataFrame, late: str | None = None, ttl: int | None = None) -> DataFrame:
    """The profiles that a micro-batch changed, as they stand after it (unrounded). stream: as ``folds.topic_profiles`` takes it."""
    columns = ("user_id", "topic", "verdict", "difficulty", "detected_pattern", "expected_pattern", "id")
    at = F.col("submitted_at").cast("timestamp")
    rows = stream.select(*columns, at.alias("submitted_at"), F.unix_micros(at).alias("at_us"))
    return _keyed(rows, ("user_id",), lambda waits: _Profiles(waits, ttl), folds.PROFILE, late)


def pattern_ratings(stream: DataFrame, late: str | None = None, places: int | None = 2, histories: bool = False, ttl: int | None = None) -> DataFrame:
    """Ratings and latest gap signals of the patterns that a micro-batch changed. stream: submissions as ``interleaved.analysed`` takes them."""
    rows = interleaved.analysed(stream).withColumnRenamed("at", "at_us")
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "user_id"]), {"ignoreNullFields": "false"}).alias("body")
    ready = rows.select("user_id", body, *([F.timestamp_micros("at_us").alias("submitted_at")] if late else []))
    out = _keyed(ready, ("user_id",), lambda waits: _Ratings(waits, ttl, places, histories), RATING, late)
    return out.withColumn("last_seen", F.timestamp_micros("last_seen_us")).drop("last_seen_us")


def daily_streaks(stream: DataFrame, ttl: int | None = None) -> DataFrame:
    """user_id, last_submission_date, current_streak of the users of a micro-batch, days in any order."""
    days = stream.select("user_id", F.to_date("submitted_at").alias("day"))
    ship_package(stream.sparkSession)
    return days.groupBy("user_id").transformWithStateInPandas(_Streaks(ttl), T.StructType.fromDDL(folds.STREAK), "Update", "None")


def drain(out: DataFrame, mode: str, target: str, checkpoint: str) -> None:
    """As ``folds.drain``, with RocksDB."""
    with rocksdb(out.sparkSession):
        folds.drain(out, mode, target, checkpoint)
