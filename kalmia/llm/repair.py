"""Operator 11, conversation structure repair by rank-compressed dynamic programming.

A conversation's turns are edited, as cheaply as can be, until the initials of its roles read
``(s?(ua)+)?``: Keep a turn (0), Rerole it to user or assistant (2), Delete it (3; blank and duplicate
turns have to go), Insert an empty user or assistant turn anywhere (2); a truncated turn that stays adds
1. Among equally cheap ways the one whose edits' initials, put together, come first in ASCII is taken.

**Codes.** Edits come as macro edits: a run of inserts and one turn's edit, D, ID, IID, IIK, ..., K, R.
Each ends with its only letter other than I, so none is another one's beginning, and their order is that
of the strings they spell, however many follow. (A third insert in a row would come back to a state that
was there two inserts earlier.)

**Layers.** After each turn a path is in one of four states (nothing yet, system, user, assistant); only
the best path into each state can go on. A layer keeps their costs and, instead of their strings, their
ranks among each other: a path's string is its parent's and a code, so (parent's rank, code) orders the
next layer. The strings are spelt afterwards along the parent pointers. Costs are kept relative to the
layer's least, and states that another one beats at any end are left out, so that few layers exist and
a step is a look-up.

**Segments.** Rows are ordered by range (conversation, turn, role, digest), which cuts even one huge
conversation over many tasks, and go on in segments of ``SEGMENT`` rows. A segment's summary, what it
costs from each state into each state and how the paths rank, makes segments a chain of 4 x 4 tables;
going along a conversation's chain and back gives each segment its states at both ends, and then all
segments spell their edits on their own. Texts aren't in any of this.

``repair`` has a row for each edit. Digests over a conversation stream over its rows in one task, as a
digest over all its turns needs.

Rows are in the order of (turn, nulls first; role; the text's digest). Null roles and texts are one
space, a null conv_id is one conversation. Repeated rows are turns of their own, all but the first
duplicates. Very long texts count whole. Other columns aren't read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kalmia.llm._common import materialize, portions, prepare

SEGMENT_BITS = 12
#: Rows of a segment at most.
SEGMENT = 1 << SEGMENT_BITS

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: A role's initial as a number; any other one is the last.
INITIALS = "sua?"
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
MOST_INSERTS = 2
CODES = sorted("I" * n + last for n in range(MOST_INSERTS + 1) for last in "DKR")
ROLES = {"u": "user", "a": "assistant"}

#: A layer: (cost beyond the layer's least, rank) of the best path into each state, or None.
Layer = tuple


def needed(state: int) -> str:
    """The initial that goes on from a state when an edit chooses it."""
    return "a" if state == USER else "u"


def inserted(state: int, n: int) -> tuple[str, int]:
    """Initials of n inserts, and the state after them."""
    run = ""
    for _ in range(n):
        run += needed(state)
        state = NEXT[state, run[-1]]
    return run, state


@lru_cache(maxsize=None)
def moves(state: int, kind: int) -> tuple[tuple[int, int, int], ...]:
    """(state after, cost, code) of each macro edit on a turn of a kind (4 x initial + fault)."""
    initial, fault = INITIALS[kind >> 2], kind & 3
    out = []
    for code, text in enumerate(CODES):
        run = len(text) - 1
        at, late = inserted(state, run)[1], fault == TRUNCATED
        if text[-1] == "D":
            out.append((at, 2 * run + 3, code))
        elif fault in (CLEAN, TRUNCATED):
            into = NEXT.get((at, initial if text[-1] == "K" else needed(at)))
            if into is not None:
                out.append((into, 2 * run + late + (2 if text[-1] == "R" else 0), code))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def advance(layer: Layer, kind: int) -> tuple[Layer, int, tuple]:
    """The next layer, by how much its least cost grew, and each state's (parent, code)."""
    best: dict[int, tuple] = {}
    for state, cell in enumerate(layer):
        if cell is not None:
            for into, cost, code in moves(state, kind):
                key = (cell[0] + cost, cell[1], code, state)
                if into not in best or key < best[into]:
                    best[into] = key
    # From the assistant's state all goes on as from the others: after a system turn at no cost, from the
    # start at 3 (a system turn that would have been kept is deleted). Dearer ones never win.
    if ASSISTANT in best:
        for state, more in ((START, 3), (SYSTEM, 0)):
            if state in best and best[state][0] > best[ASSISTANT][0] + more:
                del best[state]
    least = min(k[0] for k in best.values())
    rank = {s: r for r, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    cells = tuple((best[s][0] - least, rank[s]) if s in best else None for s in STATES)
    return cells, least, tuple((best[s][3], best[s][2]) if s in best else None for s in STATES)


def alone(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def summary(kinds: list[int]) -> list[list[tuple[int, int] | None]]:
    """(cost, rank) from each state into each state over some turns; ranks compare paths from one state."""
    out = []
    for state in STATES:
        layer, total = alone(state), 0
        for kind in kinds:
            layer, grown, _ = advance(layer, kind)
            total += grown
        out.append([None if c is None else (c[0] + total, c[1]) for c in layer])
    return out


def chain(summaries: list[list[list[tuple[int, int] | None]]]) -> tuple[int, int, list[tuple[int, int]]]:
    """Cost, inserts at the end, and each segment's (first, last) state of a conversation."""
    layer, pointers = {START: (0, 0)}, []
    for table in summaries:
        best: dict[int, tuple] = {}
        for state, (cost, rank) in layer.items():
            for into, cell in enumerate(table[state]):
                if cell is not None:
                    key = (cost + cell[0], rank, cell[1], state)
                    if into not in best or key < best[into]:
                        best[into] = key
        order = {s: r for r, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        layer = {s: (best[s][0], order[s]) for s in best}
        pointers.append({s: best[s][3] for s in best})
    ends = [(cost + 2 * n, rank, n, s) for s, (cost, rank) in layer.items() for n in range(MOST_INSERTS + 1) if inserted(s, n)[1] in ENDS]
    cost, _, run, state = min(ends)
    through = []
    for back in reversed(pointers):
        through.append((back[state], state))
        state = back[state]
    return cost, run, through[::-1]


def spell(kinds: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """(state before, code) of each turn on the best path between two states."""
    layer, pointers = alone(first), []
    for kind in kinds:
        layer, _, back = advance(layer, kind)
        pointers.append(back)
    out, state = [], last
    for back in reversed(pointers):
        state, code = back[state]
        out.append((state, code))
    return out[::-1]


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage, by CRC-32 of conversation and turn; nulls become one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    again = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def _own(turns: DataFrame) -> DataFrame:
    """Only what is read, nulls as one space, and a number for each row, written once."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return materialize(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")).withColumn("row", F.monotonically_increasing_id()))


def _layers(rows: DataFrame) -> DataFrame:
    """conv_id, turn, row, place (in the order of all rows), segment, kind; no texts."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    number = F.coalesce(*[F.when(initial == c, i) for i, c in enumerate(INITIALS[:3])], F.lit(3))
    early = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(CLEAN)
    narrow = rows.select("conv_id", "turn", "role", F.sha2(text, 256).alias("digest"), "row", number.alias("initial"), early.alias("fault"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    # Numbers follow the order: partitions are ranges, and the rows in them are sorted.
    placed = materialize(narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    found = placed.join(first, "place", "left").select("conv_id", "turn", "row", "place", F.shiftright("place", SEGMENT_BITS).alias("segment"), (F.col("initial") * 4 + fault).alias("kind"))
    return materialize(found)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows that follow each other with equal keys, over batches' ends."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _map(rows: DataFrame, work, fields: str) -> DataFrame:
    """``mapInArrow`` of dicts: ``work`` takes batches and yields rows of conv_id and ``fields``."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(fields).fields])
    return rows.mapInArrow(lambda batches: _batches(work(batches), to_arrow_schema(schema)), schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A row for each conversation in each segment: counts, both ends, and the table of states."""
    for run in _runs(batches, ["segment", "conv_id"]):
        kinds, turns = [r["kind"] for r in run], [r["turn"] for r in run if r["turn"] is not None]
        initials = [INITIALS[k >> 2] for k in kinds]
        table = [c for row in summary(kinds) for c in row]
        yield {
            "conv_id": run[0]["conv_id"], "segment": run[0]["segment"], "ends": initials[0] + initials[-1], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            **{n: sum(k & 3 == f for k in kinds) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
            "costs": [-1 if c is None else c[0] for c in table], "ranks": [-1 if c is None else c[1] for c in table], "finish": run[-1]["place"],
        }


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each segment's states at both ends; the conversation's counts, cost and last inserts in its last one."""
    n = len(STATES)
    for run in _runs(batches, ["conv_id"]):
        tables = [[[None if c < 0 else (c, k) for c, k in zip(r["costs"][n * s : n * s + n], r["ranks"][n * s : n * s + n], strict=True)] for s in STATES] for r in run]
        cost, inserts, through = chain(tables)
        spread = [r for r in run if r["turns"]]
        distinct = sum(r["turns"] for r in spread) - sum(a["high"] == b["low"] for a, b in zip(spread, spread[1:], strict=False))
        counts = {c: sum(r[c] for r in run) for c in ("blank", "duplicate", "truncated", "illegal")}
        counts["illegal"] += sum(a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(run, run[1:], strict=False))
        counts |= {"gaps": spread[-1]["high"] - spread[0]["low"] + 1 - distinct if spread else 0, "cost": cost, "after": inserted(through[-1][1], inserts)[0], "finish": run[-1]["finish"]}
        for i, (r, (first, last)) in enumerate(zip(run, through, strict=True)):
            yield {"conv_id": r["conv_id"], "segment": r["segment"], "first": first, "last": last, **(counts if i == len(run) - 1 else {})}


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for run in _runs(batches, ["segment", "conv_id"]):
        for r, (state, code) in zip(run, spell([r["kind"] for r in run], run[0]["first"], run[0]["last"]), strict=True):
            before, at = inserted(state, len(CODES[code]) - 1)
            yield {"conv_id": r["conv_id"], "row": r["row"], "place": r["place"], "before": before, "edit": CODES[code][-1], "into": needed(at), "after": r["after"] if r["place"] == r["finish"] else ""}


def _solve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits by row, and counts and costs by conversation."""
    prepare(rows.sparkSession)
    layers = _layers(rows)
    near = lambda df: df.repartition("segment").sortWithinPartitions("segment", "place")
    table = "segment long, ends string, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long, costs array<long>, ranks array<int>, finish long"
    summaries = _map(near(layers), _summaries, table)
    order = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    chains = materialize(_map(order, _chains, "segment long, first int, last int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, after string, finish long"))
    placed = layers.alias("l").join(chains.alias("c"), (F.col("l.segment") == F.col("c.segment")) & F.col("l.conv_id").eqNullSafe(F.col("c.conv_id")))
    placed = placed.select("l.conv_id", "l.segment", "row", "place", "kind", "first", "last", "after", "finish")
    edits = _map(near(placed), _spelt, "row long, place long, before string, edit string, into string, after string")
    return edits, chains.filter("cost IS NOT NULL").drop("segment", "first", "last")


def _edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    role = lambda c: F.when(c == "a", ROLES["a"]).otherwise(ROLES["u"])

    def step(slot: int, edit: Column, role: Column, text: Column) -> Column:
        return F.struct(F.lit(slot).alias("slot"), edit.alias("edit"), role.alias("role"), text.alias("text"))

    def insert(slot: int, run: str, i: int) -> Column:
        letter = F.substring(run, i, 1)
        return F.when(letter != "", step(slot, F.lit("I"), role(letter), F.lit("")))

    own = step(MOST_INSERTS, F.col("edit"), F.when(F.col("edit") == "R", role(F.col("into"))).otherwise(F.col("role")), F.col("text"))
    steps = [*(insert(i, "before", i + 1) for i in range(MOST_INSERTS)), own, *(insert(MOST_INSERTS + 1 + i, "after", i + 1) for i in range(MOST_INSERTS))]
    joined = rows.select("row", "role", "text").join(edits, "row")
    return joined.select("conv_id", "place", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("conv_id", "place", "s.slot", "s.edit", "s.role", "s.text")


def repair(turns: DataFrame) -> DataFrame:
    """A row for each edit: conv_id, place and slot (their order), edit (D, I, K or R), role, text.

    Without the rows of edit D it is the repaired conversation.
    """
    rows = _own(turns)
    return _edited(rows, _solve(rows)[0])


def digests(edited: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of ``repair``'s rows, streamed in order, a conversation in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state: list | None = None
        close = lambda: {"conv_id": state[0], "audit": "".join(state[1]), "repaired_sha256": state[2].hexdigest()}
        for batch in portions(batches, "text"):
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        yield close()
                    state = [row["conv_id"], [], hashlib.sha256(), False]
                state[1].append(row["edit"])
                if row["edit"] != "D":
                    state[2].update((("\n" if state[3] else "") + row["role"] + ":" + row["text"]).encode())
                    state[3] = True
        if state is not None:
            yield close()

    return _map(edited.repartition("conv_id").sortWithinPartitions("conv_id", "place", "slot"), work, "audit string, repaired_sha256 string")


def audit(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row for each conversation (of ``conversations``, if given): its faults, cost, audit and the repaired turns' digest."""
    rows = _own(turns)
    edits, counts = _solve(rows)
    told = digests(_edited(rows, edits))
    every = (turns if conversations is None else conversations).select("conv_id").distinct().alias("e")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    joined = every.join(counts.alias("c"), same("e", "c"), "left").join(told.alias("d"), same("e", "d"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "e.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def query(turns: DataFrame) -> DataFrame:
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return audit(damage(turns), turns)


#: The contract in DuckDB's SQL: every state's best edits as whole strings, turn by turn, with CRC-32 bit by bit.
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes,
    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295) % 20 AS fate
  FROM keyed
), spoilt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, left(role, 1) AS initial FROM spoilt
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed
), turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
  FROM turns GROUP BY conv_id
), inserts(q, k, into_, lines) AS (
  VALUES (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
    (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
), moves(from_, edit, needs, goes, price) AS (
  VALUES (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
    (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2)
), layers AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT l.conv_id, t.n, m.goes, l.cost + 2 * i.k + m.price + CASE WHEN m.edit <> 'D' AND t.fault = 'truncated' THEN 1 ELSE 0 END AS total, l.audit || repeat('I', i.k) || m.edit AS said,
    l.lines || i.lines || CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE WHEN m.goes = 3 THEN 'assistant:' ELSE 'user:' END || t.text] END
  FROM layers l JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.n = l.n + 1 JOIN inserts i ON i.q = l.q JOIN moves m ON m.from_ = i.into_
  WHERE (m.needs IS NULL OR m.needs = t.initial) AND (m.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
  QUALIFY row_number() OVER (PARTITION BY l.conv_id, m.goes ORDER BY total, said) = 1
), ended AS (
  SELECT l.conv_id, l.cost + 2 * i.k AS total, l.audit || repeat('I', i.k) AS said, l.lines || i.lines AS lines
  FROM layers l JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.last = l.n JOIN inserts i ON i.q = l.q
  WHERE i.into_ IN (0, 3) QUALIFY row_number() OVER (PARTITION BY l.conv_id ORDER BY total, said) = 1
)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(e.total, 0)::BIGINT AS cost, coalesce(e.said, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
