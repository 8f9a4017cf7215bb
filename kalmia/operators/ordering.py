"""Places in one order over a whole table, without a window over all rows.

Rows are dealt by ranges of the order (cut points come from a sample), sorted within each, written once and
counted; a row's place is its place in its range and the rows of the ranges before. No task sees more than a
range, and equal keys are told apart by the row's hash, so a hot key is cut like any other.

``numbered`` gives dense numbers. ``paged`` keeps the ranges as a table: counts, first places and bounds are the
order statistics that send page n to the files of its range, so deep pages cost as much as early ones.

Nulls come first. Rows that are alike in everything are told apart by nothing: they get neighbouring numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalmia.runtime import written


def _ranged(rows: DataFrame, order: Sequence[str], ranges: int | None) -> DataFrame:
    """``rows``, written in ranges of the order, with _range and _at (place in it)."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    tie = F.xxhash64(*[F.to_json(F.struct(c)) for c in rows.columns])
    tied = rows.withColumn("_tie", tie)
    by = [*keys, F.col("_tie")]
    dealt = tied.repartitionByRange(*by) if ranges is None else tied.repartitionByRange(ranges, *by)
    low = (1 << 33) - 1
    # Within a partition these ids count from 0, behind the partition's number.
    placed = dealt.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()).drop("_tie")
    return written(placed.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(low))}).drop("_id"))


def _starts(placed: DataFrame) -> DataFrame:
    """_range, _n and _start: how many rows come before a range. One row a range, so its window is as small as their number."""
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    out, before = [], 0
    for k in sorted(counts):
        out.append((k, counts[k], before))
        before += counts[k]
    return placed.sparkSession.createDataFrame(out, "_range long, _n long, _start long")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id", after: int = 0, ranges: int | None = None) -> DataFrame:
    """``rows`` with numbers ``after`` + 1, ``after`` + 2, ... in an order, without gaps."""
    placed = _ranged(rows, order, ranges)
    number = (F.col("_start") + F.col("_at") + 1 + after).alias(name)
    return placed.join(F.broadcast(_starts(placed)), "_range").select(*[c for c in rows.columns if c != name], number)


@dataclass(frozen=True)
class Pages:
    """A table in an order, by ranges. ``starts``: (range, rows, rows before), one for each range."""

    rows: DataFrame
    starts: list[tuple[int, int, int]]
    columns: list[str]

    @property
    def total(self) -> int:
        return sum(n for _, n, _ in self.starts)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows (1 to 100), in order, read from its ranges only."""
        number, size = max(number, 1), min(max(size, 1), 100)
        first, last = (number - 1) * size, number * size
        of: Column = F.lit(False)
        for k, n, start in self.starts:
            if start < last and first < start + n:
                of = of | ((F.col("_range") == k) & F.col("_at").between(first - start, last - 1 - start))
        return self.rows.filter(of).orderBy("_range", "_at").select(*self.columns)


def paged(rows: DataFrame, order: Sequence[str], path: str, ranges: int = 64) -> Pages:
    """``rows`` written to ``path`` in an order, a folder for each range, to be read page by page."""
    placed = _ranged(rows, order, ranges)
    placed.write.mode("overwrite").partitionBy("_range").parquet(path)
    kept = rows.sparkSession.read.schema(placed.schema).parquet(path)
    return Pages(kept, [tuple(r) for r in _starts(placed).orderBy("_range").collect()], rows.columns)
