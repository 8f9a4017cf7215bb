import hashlib
import heapq
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalmia.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.strip(SPACE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired turns): all edit strings in the order of (cost, string), until one gives the shape."""
    found = faults(rows)
    heap = [(0, "", 0, ())]
    while True:
        cost, done, i, turns = heapq.heappop(heap)
        if i == len(rows) and SHAPE.match("".join(r[:1] or "?" for r, _ in turns)):
            return cost, done, turns
        if len(turns) < 2 * len(rows) + 4:
            for role in ("user", "assistant"):
                push(heap, cost + 2, done + "I", i, (*turns, (role, "")))
        if i < len(rows):
            _, role, text = rows[i]
            late = found[i] == "truncated"
            push(heap, cost + 3, done + "D", i + 1, turns)
            if found[i] in ("", "truncated"):
                push(heap, cost + late, done + "K", i + 1, (*turns, (role, text)))
                for new in ("user", "assistant"):
                    push(heap, cost + 2 + late, done + "R", i + 1, (*turns, (new, text)))


def push(heap, cost, done, i, turns):
    """Only what can still become the shape."""
    if re.match(r"(s?(ua)*u?)\Z", "".join(r[:1] or "?" for r, _ in turns)):
        heapq.heappush(heap, (cost, done, i, turns))


def wanted(rows):
    """The contract's row of a conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    cost, audit, turns = cheapest(rows)
    found, known = faults(rows), [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    )


def damaged(table):
    out, every = {}, set()
    for r in table:
        every.add(r["conv_id"])
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        word = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{word(r['conv_id'])}:{word(r['turn'])}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        if fate:
            out.setdefault(r["conv_id"], []).extend([(r["turn"], "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1))
    return out, every


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def check(table, spoilt=True):
    if spoilt:
        rows, every = damaged(table.collect())
        got = repair.query(table).collect()
    else:
        rows, got = {}, repair.audit(table).collect()
        for r in table.collect():
            rows.setdefault(r["conv_id"], []).append((r["turn"], " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]))
        every = set(rows)
    assert len(got) == len(every) == len({r["conv_id"] for r in got})
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == (wanted(rows[r["conv_id"]]) if r["conv_id"] in rows else EMPTY), r["conv_id"]


def path(kinds, size):
    """Cost and audit through segments of some rows."""
    cuts = [kinds[i : i + size] for i in range(0, len(kinds), size)]
    cost, run, through = repair.chain([repair.summary(c) for c in cuts])
    codes = [code for c, (a, b) in zip(cuts, through, strict=True) for _, code in repair.spell(c, a, b)]
    return cost, "".join(repair.CODES[c] for c in codes) + "I" * run


TEXT = {repair.CLEAN: "fine {}.", repair.TRUNCATED: "cut {}", repair.BLANK: " "}


def turns_of(kinds):
    return [(i, {"s": "system", "u": "user", "a": "assistant", "?": "tool"}[repair.INITIALS[k >> 2]], TEXT[k & 3].format(i)) for i, k in enumerate(kinds)]


KINDS = [4 * i + f for i in range(4) for f in (repair.CLEAN, repair.TRUNCATED, repair.BLANK)]


def test_every_short_conversation():
    for n in range(4):
        for kinds in product(KINDS, repeat=n):
            cost, audit, _ = cheapest(turns_of(kinds))
            for size in (1, 2, 9):
                assert path(list(kinds), size) == (cost, audit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(KINDS), min_size=4, max_size=9), st.integers(1, 10))
def test_longer_conversations(kinds, size):
    assert path(kinds, size) == cheapest(turns_of(kinds))[:2]


def test_codes_are_prefix_free():
    assert all(not b.startswith(a) for a in repair.CODES for b in repair.CODES if a != b)


SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in ("row", "place", "segment", "kind", "edit", "audit", "a.b")],
])


@pytest.fixture(scope="module")
def strange(spark):
    """Nulls anywhere, ties, repeated rows, blank and very long texts, roles of any kind."""
    texts, roles = [None, "", " \t\x0b", "ok.", "ok.\n \r", "no", "why?!", ". x", "\xa0", "long " * 40_000 + ".", "é."], ["user", "assistant", "system", None, "", "tool", "ux"]
    rows = [(c if c != 7 else None, None if (c + t) % 5 == 4 else t * 2 - c % 3, roles[(c * t + t // 2) % 7], texts[(c + 3 * t) % 11], *["clash"] * 7) for c in range(60) for t in range(c % 7)]
    return spark.createDataFrame([*rows, *rows[:25], *[(99, 1, "user", "hi.", *["x"] * 7)] * 4], SCHEMA)


def test_on_the_given_table(spark, strange):
    check(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    check(strange)
    check(strange, spoilt=False)
    assert repair.query(strange.limit(0)).count() == 0 and repair.repair(strange.limit(0)).count() == 0


def test_conversations_over_many_segments(spark, strange, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_BITS", 1)
    check(strange, spoilt=False)
    one = spark.range(3_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    got, rows = repair.audit(one).first(), one.orderBy("turn").collect()
    kinds = [4 * "sua".index(r["role"][0]) for r in rows]
    assert (got["cost"], got["audit"]) == path(kinds, len(kinds))


def test_repaired_rows(strange):
    edits = [(r["conv_id"], r["place"], r["slot"], r["edit"], r["role"], r["text"]) for r in repair.repair(strange).collect()]
    said = {r["conv_id"]: r for r in repair.audit(strange).collect()}
    for conv, want in said.items():
        own = sorted(e[1:] for e in edits if e[0] == conv)
        assert "".join(e[2] for e in own) == want["audit"] and SHAPE.match("".join(e[3][:1] for e in own if e[2] != "D"))


def test_sql_on_strange_rows(spark, strange):
    import duckdb

    small = strange.filter("length(coalesce(text, '')) < 1000").select("conv_id", "turn", "role", "text")
    c = duckdb.connect()
    c.register("conversations", small.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = c.sql(repair.SQL)
    assert sorted(map(str, repair.query(small).select(*want.columns).collect())) == sorted(str(repair_row(want.columns, r)) for r in want.fetchall())


def repair_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values, strict=True)))
