"""Operator 1, best-fit packing by sums of squares.

Each document's ids, with the separator at the end, go into sequences of at most ``capacity``
tokens. A document stays whole unless it alone is longer; then it is cut into full pieces, of which
the first may be shorter. An item goes where the sum, over all residual gaps, of the squared number
of open sequences with that gap becomes smallest (Csirik, Johnson, Kenyon et al., "On the
Sum-of-Squares algorithm for bin packing").

The items, a few numbers each, are dealt by hash into groups of bounded size and packed group by
group, longest first. Sequences that come out full are done; the items of the others are dealt
again at the next level, into fewer groups, until one group of bounded size holds all that is left.
So no task ever holds more than a group, whatever one source or one text's copies make up of the
corpus. Where a level settles less than a tenth of its items, as lengths don't add up to the capacity, sequences into
which no item fits any more and the fuller half stay as they are, and the rest goes on to the next level.

Null texts count as empty (one separator). Repeated rows, equal doc_ids and ties are packed row by
row. An empty table gives an empty result. Other columns than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalmia.llm._common import materialize, portions, prepare
from kalmia.llm.tokens import SPLIT_CHARS, safe_parts, tokenizer

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
SEPARATOR = 0
#: Items (about) in one group.
GROUP = 4_000
#: A sequence's number: its group, numbered through all levels, then its place in the group. A group has far fewer
#: sequences than the low bits count, and 2**39 groups of ``GROUP`` items are left room for.
_BIN_BITS = 24

#: Over these characters the two libraries' pre-token rules agree in any Unicode version.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏΑ-ΡΣ-ωА-я–-…€]")
_ranks: dict = {}


def _fast(vocabulary: str):
    """The same vocabulary and merges in the quicker library, or None if there is no rank file."""
    if vocabulary not in _ranks:
        import base64
        import os

        import public_tokenizers as P
        import tiktoken

        path = P.path(vocabulary.removesuffix(".json") + ".tiktoken")
        if not os.path.exists(path):
            _ranks[vocabulary] = None
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in tokenizer(vocabulary).get_added_tokens_decoder().items()}
            _ranks[vocabulary] = tiktoken.Encoding("same", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ranks[vocabulary]


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids that the vocabulary's own library gives without added special tokens.

    Plain texts go through the equivalent, several times quicker library; texts with characters
    whose class depends on a library's Unicode version go through the vocabulary's own. So do long
    stretches without a safe place, over whose white space the quicker one's patterns run out of stack.
    """
    fast, out = _fast(vocabulary), []
    for part in safe_parts(text):
        if fast is not None and len(part) <= 4 * SPLIT_CHARS and not _PLAIN.search(part):
            out.append(np.asarray(fast.encode(part, allowed_special="all"), dtype=np.uint32))
        else:
            out.append(np.asarray(tokenizer(vocabulary).encode(part, add_special_tokens=False).ids, dtype=np.uint32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if len(ids) <= capacity:
        return [(0, len(ids))]
    first = len(ids) % capacity
    starts = ([0] if first else []) + list(range(first, len(ids), capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or "", vocabulary), np.uint32(SEPARATOR)).astype("<u4")
                for n, (start, length) in enumerate(pieces_of(ids, capacity)):
                    for column, value in zip(rows, (i, n, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins per gap; full ones don't count
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # By how much the sum changes if the item goes into a bin of each gap from its size on.
        change = np.where(count[size:capacity] > 0, count[: capacity - size] - count[size:capacity], far)
        gap, best = -1, count[capacity - size] if size < capacity else -1
        if len(change):
            if change[0] != far:  # it fills the gap: the old bin goes and none comes
                change[0] = -count[size]
            at = int(change.argmin())
            # Halved sums: a new bin adds 2n + 1, moving one adds 2(m - n) + 2, filling one takes 2n - 1.
            here = 2 * change[at] + (2 if at else 1) if change[at] != far else far
            if here <= 2 * best + 1:
                gap = at + size
        if gap < 0:
            bins[i], offsets[i], gap = made, 0, capacity
            where = made
            made += 1
        else:
            where = of_gap[gap].pop()
            count[gap] -= 1
            bins[i], offsets[i] = where, capacity - gap
        if left := gap - size:
            of_gap[left].append(where)
            count[left] += 1
    return bins, offsets


def _pack_group(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        base = np.int64(group["grp"].iloc[0]) << _BIN_BITS
        used = np.bincount(bins, weights=group["length"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"item": group["item"].to_numpy(), "bin": base + bins, "at": offsets, "length": group["length"].to_numpy(), "used": used[bins]})

    return pack


def pack_items(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items (item long, length long, at most ``capacity`` each) to (item, bin, at); levels as above."""
    schema = "item long, bin long, at long, length long, used long"
    level, n, tag, first, placed = items, items.count(), 0, 0, None
    while True:
        groups = max(1, n // group)
        dealt = level.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(tag)), F.lit(groups)) + F.lit(first))
        now = materialize(dealt.groupBy("grp").applyInPandas(_pack_group(capacity), schema))
        gap = F.col("gap")
        now = now.withColumn("gap", F.lit(capacity) - F.col("used"))
        before = n
        n, smallest, middle = now.filter(gap > 0).agg(F.count(F.lit(1)), F.coalesce(F.min("length"), F.lit(0)), F.coalesce(F.percentile_approx("gap", 0.5), F.lit(0))).first()
        last, reach = groups == 1 or n == 0, 0
        if not last and n > 0.9 * before:
            # Few came out full. No item fits into gaps below the smallest; at least the fuller half of the items is settled.
            reach = max(smallest - 1, middle)
            n = now.filter(gap > reach).count()
            last = n == 0
        left = now.filter(gap > reach).select("item", "length")
        done = (now if last else now.filter(gap <= reach)).select("item", "bin", "at")
        placed = done if placed is None else placed.unionByName(done)
        if last:
            return placed
        level, tag, first = left, tag + 1, first + groups


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """A row for each piece with sequence_id and offset; see the module's text."""
    prepare(docs.sparkSession)
    pieces = materialize(cut(docs, capacity, vocabulary).withColumn("item", F.monotonically_increasing_id()))
    short = pieces.filter(F.col("length") < capacity).select("item", "length")
    places = pack_items(short, capacity, group)
    full = pieces.filter(F.col("length") >= capacity).withColumns({"bin": -1 - F.col("item"), "at": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < capacity).join(places, "item")
    return full.unionByName(rest).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
