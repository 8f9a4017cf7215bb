"""Constraints as a gate before a write: rows that keep them all, and a quarantine of those that don't.

* Row rules (ranges, enumerations, columns that must be there) are one array expression in the pass that
  reads the rows.
* A unique key is looked up among the batch's own rows, of which the one with the least hash passes, and
  among stored keys. A Bloom filter of the batch's keys, as many bitmaps of one size as it needs, sent to all
  tasks and found by the key's hash, drops stored keys where they are read; only what is left, true repeats and
  a few others, is shuffled for the exact join. Parents of foreign keys are looked up the same way.

So work besides one scan of the stored key column grows with the batch. A row's rules are listed by name. Null
keys and null foreign keys break no rule but those of columns that must be there. Of rows that are alike in
everything one passes.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalmia.runtime import written
from kalmia.sources.schemas import DIFFICULTIES, VERDICTS

#: Bits of the filter for each key, and how many a key sets.
BITS, HASHES = 16, 4
#: Bits of one bitmap.
BITMAP = 32_768
#: Keys of a batch up to which their filter is sent to all tasks (64 MB); beyond that stored keys are joined as they are.
MOST = 1 << 25


@dataclass(frozen=True)
class Rules:
    """A table's constraints. checks: name to SQL condition that a row breaks only if it is false."""

    keys: tuple[str, ...]
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)


def _one_of(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _share(column: str) -> str:
    return f"{column} BETWEEN 0 AND 1"


#: The learning tables' constraints.
TABLES = {
    "problems": Rules(("id",), ("id", "title", "difficulty", "topics", "pattern"), {"difficulty_known": _one_of("difficulty", DIFFICULTIES)}),
    "submissions": Rules(
        ("id",), ("id", "user_id", "verdict", "topic", "submitted_at", "detected_confidence", "gap_identified"),
        {"verdict_known": _one_of("verdict", VERDICTS), "detected_confidence_range": _share("detected_confidence"), "diagnosis_confidence_range": _share("diagnosis_confidence"), "attempt_number_range": "attempt_number >= 1"},
        {"problem_id": "problems"},
    ),
    "topic_profiles": Rules(("user_id", "topic"), ("user_id", "topic", "elo_rating"), {"accuracy_range": _share("accuracy"), "elo_floor": "elo_rating >= 400", "counts": "pass_count BETWEEN 0 AND attempt_count"}),
    "gap_signals": Rules(("user_id", "pattern_id"), ("user_id", "pattern_id", "last_seen"), {"gap_strength_range": _share("gap_strength"), "frequency_range": "frequency >= 0"}),
    "user_pattern_elo": Rules(("user_id", "pattern_id"), ("user_id", "pattern_id"), {"elo_floor": "elo >= 400"}),
}


def _block(keys: Sequence[str], blocks: int) -> Column:
    """The filter's bitmap that a key belongs to."""
    return F.pmod(F.xxhash64(*keys, F.lit(HASHES)), F.lit(blocks))


def _places(keys: Sequence[str]) -> list[Column]:
    """The bits of its bitmap that a key sets."""
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(BITMAP)) for i in range(HASHES)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(_block, _bitmap): bitmaps of ``BITMAP`` bits each with the bits that the keys set; none where no key belongs."""
    at = keys.select(_block(keys.columns, blocks).alias("_block"), F.explode(F.array(*_places(keys.columns))).alias("at"))
    return at.groupBy("_block").agg(F.bitmap_construct_agg("at").alias("_bitmap"))


def pruned(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``stored`` whose keys may be among ``keys`` (the same columns), without a shuffle of the others.

    All of a key's bits are in one bitmap, so a stored row meets a single one, whatever the filter's size.
    """
    n = keys.count()
    if n == 0 or n > MOST:
        return stored.limit(0) if n == 0 else stored
    blocks = -(-n * BITS // BITMAP)

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1

    # At most MOST * BITS bits go to all tasks.
    bits = F.broadcast(bloom(keys, blocks))
    met = stored.join(bits.drop("_block"), F.lit(True)) if blocks == 1 else stored.withColumn("_block", _block(keys.columns, blocks)).join(bits, "_block")
    return met.filter(functools.reduce(Column.__and__, map(is_set, _places(keys.columns)))).drop("_block", "_bitmap")


def _known(rows: DataFrame, keys: Sequence[str], stored: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: whether their key is stored."""
    whole = rows.select(*keys).dropna().distinct()
    found = pruned(stored.select(*keys).dropna(), whole).distinct().withColumn(name, F.lit(True))
    return rows.join(found, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def judged(rows: DataFrame, rules: Rules, stored: DataFrame | None = None, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``broken``: the names of the rules that each breaks.

    Rules on columns that the rows don't have don't count. ``stored``: rows with the keys, that are there already.
    ``parents``: by foreign key column, a table with an id.
    """
    has, own = set(rows.columns), list(rows.columns)
    tests = {f"{c}_missing": F.col(c).isNull() for c in rules.required if c in has}
    tests |= {n: ~F.coalesce(F.expr(c), F.lit(True)) for n, c in rules.checks.items() if c.split()[0] in has}
    keyed = F.lit(True)
    for k in rules.keys:
        keyed = keyed & F.col(k).isNotNull()
    rest = F.xxhash64(*[F.to_json(F.struct(c)) for c in own])
    numbered = written(rows.withColumns({"_row": F.monotonically_increasing_id(), "_hash": rest, "_broken": F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).cast("array<string>")}))
    # Of a key's rows the first that breaks no rule of its own passes; a partial aggregate, so a hot key is one row a task.
    least = F.struct(F.size("_broken") > 0, "_hash", "_row")
    first = numbered.filter(keyed).groupBy(*rules.keys).agg(F.min(least).alias("_first"))
    marked = numbered.join(first, list(rules.keys), "left").withColumn("_again", keyed & (least != F.col("_first")))
    extra = [F.when(F.col("_again"), F.lit("repeated_key"))]
    if stored is not None:
        marked = _known(marked, rules.keys, stored, "_stored")
        extra.append(F.when(F.col("_stored"), F.lit("key_exists")))
    for i, (column, _) in enumerate(rules.parents.items()):
        if column in has and column in (parents or {}):
            marked = _known(marked, [column], parents[column].select(F.col("id").alias(column)), f"_parent{i}")
            extra.append(F.when(F.col(column).isNotNull() & ~F.col(f"_parent{i}"), F.lit(f"{column}_unknown")))
    return marked.select(*own, F.concat("_broken", F.array_compact(F.array(*extra))).alias("broken"))


def gate(rows: DataFrame, table: str, stored: DataFrame | None = None, parents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all of the table's rules; the quarantine: table_name, broken, row as JSON) of a batch.

    Both are read from one judgement: write it first (``runtime.written``) or they are worked out twice.
    """
    from kalmia.runtime import written

    found = written(judged(rows, TABLES[table], stored, parents))
    held = found.filter(F.size("broken") > 0).select(F.lit(table).alias("table_name"), "broken", F.to_json(F.struct(*rows.columns)).alias("row"))
    return found.filter(F.size("broken") == 0).select(*rows.columns), held
