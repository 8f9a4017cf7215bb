"""Relational tables over JDBC in ranges of equal numbers of rows, also where keys are skewed.

``key_cuts`` has the database count rows per bucket of a whole-number key (an aggregate: the driver gets buckets, never
rows), and once more within each bucket that holds too many, until a bucket is small or is one key. One key with too many
rows is cut by a second whole-number column, ``tie``, in the same way. ``predicates`` turns the cuts into conditions that
leave no row out and none twice: the first and last are open, so rows that come after the counting belong to one of them;
null keys have conditions of their own, and null ties come first within their key.

``read_ranges`` is a DataFrame with a partition for each condition. Filters and columns on it reach the database. A task
that fails asks for its own range again, as Spark repeats tasks. ``extract`` copies such a table into Parquet in waves of
ranges; each finished wave is noted in a log, so a run that broke off goes on with the ranges that are still missing.

Empty tables give one range. A key without ``tie`` is never cut, so its rows stay one range. Keys may span up to 2**62.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kalmia.sources import serving

FINENESS = 8  # a bucket holds at most a range's share of rows, divided by this, if its keys allow that
AT_ONCE = 40  # buckets refined by one statement


@dataclass(frozen=True)
class Source:
    """A table at a database; ``options`` are Spark's JDBC options (driver, user, password, fetchsize, ...)."""

    spark: SparkSession
    url: str
    table: str
    options: Mapping[str, str] = field(default_factory=dict)

    def ask(self, sql: str) -> list[tuple]:
        """The few rows of an aggregate, worked out by the database."""
        return [tuple(r) for r in self.spark.read.jdbc(self.url, f"({sql}) asked", properties=dict(self.options)).collect()]


@dataclass(frozen=True)
class Bucket:
    """Keys ``low`` to ``high`` (both in it); with ``within``, values of the tie among the rows where that holds."""

    low: int
    high: int
    rows: int


def _both(*conditions: str | None) -> str:
    return " AND ".join(f"({c})" for c in conditions if c) or "1 = 1"


def _counted(source: Source, column: str, ranges: Sequence[tuple[int, int]], pieces: int, where: str | None) -> list[list[Bucket]]:
    """The filled buckets of each range, some ``pieces`` of them, counted by one statement for every AT_ONCE ranges."""
    found: list[list[Bucket]] = [[] for _ in ranges]
    for first in range(0, len(ranges), AT_ONCE):
        asked = []
        for i, (low, high) in enumerate(ranges[first : first + AT_ONCE], first):
            width = max(1, -(-(high - low + 1) // pieces))
            rows = f"SELECT FLOOR(({column} - ({low})) / {width}) AS b FROM {source.table} WHERE {_both(where, f'{column} >= {low}', f'{column} <= {high}')}"
            asked.append(f"SELECT {i} AS r, b, COUNT(*) AS n FROM ({rows}) q{i} GROUP BY b")
        for i, b, n in source.ask(" UNION ALL ".join(asked)):
            low, high = ranges[i]
            width = max(1, -(-(high - low + 1) // pieces))
            start = low + int(b) * width
            found[i].append(Bucket(start, min(high, start + width - 1), int(n)))
    return [sorted(f, key=lambda x: x.low) for f in found]


def histogram(source: Source, column: str, most: int, pieces: int, where: str | None = None) -> list[Bucket]:
    """The filled buckets of a column in order, each of at most ``most`` rows or of one value. Nulls aren't in it."""
    low, high = source.ask(f"SELECT MIN({column}) AS a, MAX({column}) AS b FROM {source.table} WHERE {_both(where)}")[0]
    if low is None:
        return []
    done: list[Bucket] = []
    open_ = [(int(low), int(high))]
    while open_:
        buckets = [b for found in _counted(source, column, open_, max(pieces, 2), where) for b in found]
        heavy = [b for b in buckets if b.rows > most and b.low < b.high]
        done += [b for b in buckets if b not in heavy]
        open_ = [(b.low, b.high) for b in heavy]
    return sorted(done, key=lambda b: b.low)


def key_cuts(source: Source, key: str, partitions: int, tie: str | None = None, where: str | None = None) -> tuple[list[tuple[int, int | None]], list[int]]:
    """(cuts between ranges, as (key, tie or null) where a range begins; cuts of the null keys by their tie)."""
    total = int(source.ask(f"SELECT COUNT(*) AS n FROM {source.table} WHERE {_both(where)}")[0][0])
    share = max(1.0, total / max(partitions, 1))
    most, pieces = max(1, int(share / FINENESS)), FINENESS * max(partitions, 1)

    steps: list[tuple[tuple[int, int | None], int]] = []
    for bucket in histogram(source, key, most, pieces, where):
        parts = histogram(source, tie, most, pieces, _both(where, f"{key} = {bucket.low}")) if tie and bucket.rows > most and bucket.low == bucket.high else []
        if len(parts) < 2:
            steps.append(((bucket.low, None), bucket.rows))
            continue
        # The first part also takes the key's null ties.
        rest = sum(p.rows for p in parts[1:])
        steps.append(((bucket.low, None), bucket.rows - rest))
        steps += [((bucket.low, p.low), p.rows) for p in parts[1:]]
    nulls = [(p.low, p.rows) for p in histogram(source, tie, most, pieces, _both(where, f"{key} IS NULL"))] if tie else []
    return _evenly(steps, share), _evenly(nulls, share)


def _evenly(steps: list, share: float) -> list:
    """Where ranges begin, but for the first: as soon as the rows before reach the next multiple of the share."""
    cuts, before, reached = [], 0, share
    for at, n in steps:
        # The bucket goes to the side on which the sum is nearer to the multiple.
        if before and before + n / 2 > reached:
            cuts.append(at)
            while reached < before + n / 2:
                reached += share
        before += n
    return cuts


def predicates(key: str, cuts: Sequence[tuple[int, int | None]], tie: str | None = None, null_cuts: Sequence[int] = ()) -> list[str]:
    """A condition for each range: every row meets one of them and no more."""

    def since(cut: tuple[int, int | None]) -> str:
        k, t = cut
        return f"{key} >= {k}" if t is None else f"({key} > {k} OR ({key} = {k} AND {tie} >= {t}))"

    def until(cut: tuple[int, int | None]) -> str:
        k, t = cut
        return f"{key} < {k}" if t is None else f"({key} < {k} OR ({key} = {k} AND ({tie} < {t} OR {tie} IS NULL)))"

    ends = [None, *cuts, None]
    out = [" AND ".join(x for x in (a and since(a), b and until(b)) if x) or f"{key} IS NOT NULL" for a, b in zip(ends, ends[1:], strict=False)]
    bounds = [None, *null_cuts, None]
    for a, b in zip(bounds, bounds[1:], strict=False):
        parts = [f"{key} IS NULL", f"{tie} >= {a}" if a is not None else None, None if b is None else f"{tie} < {b}" if a is not None else f"({tie} < {b} OR {tie} IS NULL)"]
        out.append(" AND ".join(p for p in parts if p))
    return out


def read_ranges(source: Source, key: str, partitions: int, tie: str | None = None, where: str | None = None) -> DataFrame:
    """The table in about ``partitions`` partitions of equal numbers of the rows that meet ``where`` (and one for null keys)."""
    rows = _ranges(source, predicates(key, *_arranged(source, key, partitions, tie, where)))
    return rows.filter(where) if where else rows


def _arranged(source: Source, key: str, partitions: int, tie: str | None, where: str | None):
    cuts, null_cuts = key_cuts(source, key, partitions, tie, where)
    return cuts, tie, null_cuts


def _ranges(source: Source, conditions: Sequence[str]) -> DataFrame:
    return source.spark.read.jdbc(source.url, source.table, predicates=list(conditions), properties=dict(source.options))


def extract(source: Source, key: str, path: str, partitions: int, tie: str | None = None, where: str | None = None, columns: Sequence[str] | None = None, wave: int = 64) -> DataFrame:
    """The table as Parquet under ``path``, ``wave`` ranges a job. A run that broke off is taken up again: its conditions and
    the waves that are there are read from ``path``/_log (its own ``partitions`` and ``wave`` hold); an unfinished wave is
    written anew, never twice."""
    spark, log = source.spark, f"{path}/_log"
    if not serving.exists(spark, f"{log}/plan.json"):
        plan = {"conditions": predicates(key, *_arranged(source, key, partitions, tie, where)), "wave": wave}
        serving.put(spark, f"{log}/plan.json", json.dumps(plan))
    plan = json.loads(spark.read.text(f"{log}/plan.json", wholetext=True).first()[0])
    conditions, wave = plan["conditions"], plan["wave"]
    waves = range(0, len(conditions), wave)
    for first in waves:
        if serving.exists(spark, f"{log}/{first}.done"):
            continue
        rows = _ranges(source, conditions[first : first + wave])
        kept = rows.filter(where) if where else rows
        (kept.select(*columns) if columns else kept).write.mode("overwrite").parquet(f"{path}/{first}")
        serving.put(spark, f"{log}/{first}.done", "")
    return spark.read.parquet(*[f"{path}/{first}" for first in waves])
