"""Operator 6, chat formatting by token-level assembly.

A conversation's turns, in the order of (turn, role, and among equal ones their encoded bytes), become

    BOS  ( TURN role BODY text END )*

where the capitals are reserved ids above the vocabulary, so no text can produce them. Roles and
texts are encoded separately, segment by segment, and the reserved ids are spliced in between. In
rendered form the reserved ids show as control strings (``CONTROL``); such strings inside a text are
escaped first: a backslash goes in behind their first character, one more than stood there already.
Escaping is reversible and leaves no control string in a text, in ids and in rendered form alike.

The loss mask is 1 on the body of assistant turns: +1 where a body starts, -1 where it ends, and the
prefix sum of these. A turn's place in its conversation is a prefix sum of lengths over the turns.

The output has one row for each turn, so that a conversation of any length never has to fit into
one row or one task's memory; its ids are its rows' ids in order. ``read_back`` streams over these,
a conversation in one task: its digest is sequential (about 4 MB of text a second).

Null texts count as empty, null roles as the empty role; a null conv_id is one conversation. Rows
that are alike are turns of their own. Other columns aren't read. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalmia.llm._common import portions, prepare
from kalmia.llm.tokens import byte_batches, tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: What the reserved ids, from the size of the vocabulary on, show as in rendered form.
CONTROL = ("<s>", "<|turn|>", "<|body|>", "</s>")
BOS, TURN, BODY, END = range(4)
#: Strings that content may not hold unescaped: our own and other templates'.
RESERVED = (*CONTROL, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>")
LEARNT = "assistant"

_heads = "|".join(re.escape(x[0]) + r"\\*" + re.escape(x[1:]) for x in sorted(RESERVED, key=len, reverse=True))
_HIT = re.compile(_heads)


def escape(text: str) -> str:
    return _HIT.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _HIT.sub(lambda m: m[0][0] + (m[0][2:] if m[0][1] == "\\" else m[0][1:]), text)


def _size(vocabulary: str) -> int:
    return tokenizer(vocabulary).get_vocab_size(with_added_tokens=True)


def encode_segments(texts: list[str], vocabulary: str = VOCABULARY) -> list[list[int]]:
    """Ids of each text on its own, in batches balanced by length."""
    out: list[list[int]] = [[] for _ in texts]
    for batch in byte_batches(texts):
        found = tokenizer(vocabulary).encode_batch_fast([texts[i] for i in batch], add_special_tokens=False)
        for i, e in zip(batch, found, strict=True):
            out[i] = e.ids
    return out


def assemble(role: list[int], body: list[int], learnt: bool, first: bool, base: int) -> tuple[np.ndarray, np.ndarray]:
    """A turn's ids and loss mask."""
    head = [base + BOS] * first + [base + TURN]
    ids = np.array([*head, *role, base + BODY, *body, base + END], dtype=np.int32)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    start = len(head) + len(role) + 1
    change[start] += learnt
    change[start + len(body)] -= learnt
    return ids, np.cumsum(change)[:-1].astype(np.int8)


def disassemble(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """A turn's role ids and body ids, found by the reserved ids."""
    turn, body = int(np.flatnonzero(ids == base + TURN)[0]), int(np.flatnonzero(ids == base + BODY)[0])
    if ids[-1] != base + END:
        raise ValueError("a turn has no end")
    return ids[turn + 1 : body], ids[body + 1 : -1]


def format_chat(turns: DataFrame, vocabulary: str = VOCABULARY, learnt: str = LEARNT) -> DataFrame:
    """conv_id, place (of the turn, from 0), start (of its ids in the conversation), ids, mask."""
    prepare(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("turn", turns.schema["turn"].dataType), T.StructField("role", T.StringType()), T.StructField("encoded", T.BinaryType()), T.StructField("n_role", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            found = encode_segments([escape(x) for x in [*roles, *texts]], vocabulary)
            ids = [np.array(r + t, dtype="<i4").tobytes() for r, t in zip(found[: len(roles)], found[len(roles) :], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(ids, pa.binary()), pa.array([len(x) for x in found[: len(roles)]], pa.int32())], names=schema.names)

    encoded = clean.mapInArrow(encode, schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "encoded")
    placed = encoded.withColumn("place", F.row_number().over(order) - 1)
    length = F.octet_length("encoded") / 4 + 3 + F.when(F.col("place") == 0, 1).otherwise(0)
    ended = F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("start", ended - length.cast("long"))
    out = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("mask", T.ArrayType(T.ByteType(), False))])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _size(vocabulary)
        for batch in portions(batches, "encoded"):
            ids, masks, sizes = [], [], [0]
            columns = (batch.column(c).to_pylist() for c in ("role", "encoded", "n_role", "place"))
            for role, raw, n, place in zip(*columns, strict=True):
                both = np.frombuffer(raw, dtype="<i4").tolist()
                i, m = assemble(both[:n], both[n:], role == learnt, place == 0, base)
                ids.append(i)
                masks.append(m)
                sizes.append(sizes[-1] + len(i))
            at = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((ids, np.int32), (masks, np.int8))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("place"), batch.column("start"), *lists], names=out.names)

    return placed.select("conv_id", "place", "start", "role", "encoded", "n_role").mapInArrow(splice, out)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a conversation from ``format_chat``'s rows: what its ids and masks say, in digests.

    Streams over each conversation's rows in order; holds a batch and two running digests.
    """
    kind = formatted.schema["conv_id"].dataType
    rows = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base = tokenizer(vocabulary), _size(vocabulary)
        text = lambda ids: tok.decode(ids.tolist(), skip_special_tokens=False)
        state: list | None = None
        done: list[list] = []

        def close() -> None:
            if state is not None:
                done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (conv_type[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=schema.names)
            done.clear()
            return batch

        conv_type: list = []
        for batch in batches:
            conv_type[:] = [batch.schema.field("conv_id").type]
            convs, starts = batch.column("conv_id").to_pylist(), batch.column("start").to_pylist()
            lists = [batch.column(c) for c in ("ids", "mask")]
            for i, conv in enumerate(convs):
                ids, mask = (np.asarray(x[i].values) for x in lists)
                if state is None or starts[i] == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if starts[i] != state[6] or len(ids) != len(mask):
                    raise ValueError("a conversation's ids have a gap")
                role, body = (text(x) for x in disassemble(ids, base))
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                if mask.any():
                    at = np.flatnonzero(mask)
                    learnt = unescape(text(ids[at[0] : at[-1] + 1]))
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                control = sum(len(CONTROL[x - base]) for x in ids[ids >= base].tolist())
                state[5] += control + len(role) + len(body)
                state[6] += len(ids)
            yield flush()
        close()
        if done:
            yield flush()

    return rows.mapInArrow(work, schema)


#: A conversation of control strings that the query adds to the table.
SPECIMEN = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(turns: DataFrame) -> DataFrame:
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    specimen = turns.sparkSession.createDataFrame(SPECIMEN, turns.schema)
    return read_back(format_chat(turns.unionByName(specimen)))
