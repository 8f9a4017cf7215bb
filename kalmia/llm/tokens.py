"""Operator 2, token counts: whole texts encoded in Arrow batches, lengths only.

Batches are balanced by UTF-8 bytes, not rows: a worker takes portions of bounded bytes of an Arrow
batch and encodes their parts in groups of about equal bytes. Long texts are split at places where
no merge and no pre-token can cross, so that the parts' ids, put together, are the ids of the whole
text. A stretch without any such place is encoded whole, however long.

Nulls count as the empty text (0 bytes, 0 tokens); repeated rows give repeated results; an empty table
gives an empty result. Columns that the result names are replaced, other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kalmia.llm._common import map_arrow, portions, prepare, without

#: The vocabulary of the production queries.
VOCABULARY = "byte_bpe_50k.json"
#: UTF-8 bytes (about) that are encoded at once.
CHUNK_BYTES = 1 << 18
#: Texts longer than so many characters are split.
SPLIT_CHARS = 1 << 14
#: A pre-token never goes on over these places: from a letter or digit to white space, or from an ASCII letter to a digit.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])")

_loaded: dict = {}


def tokenizer(vocabulary: str):
    """The library's tokenizer, loaded once a worker."""
    if vocabulary not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _loaded[vocabulary] = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return _loaded[vocabulary]


def safe_parts(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """The text in parts of about ``size`` characters, cut only where encoding can't notice.

    A stretch without any such place stays whole, however long.
    """
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def byte_batches(parts: list[str], size: int = CHUNK_BYTES) -> Iterator[list[int]]:
    """Indexes of parts in batches of about ``size`` UTF-8 bytes; like lengths meet."""
    batch, held = [], 0
    sizes = [n_bytes(p) for p in parts]
    for i in sorted(range(len(parts)), key=sizes.__getitem__):
        if batch and held + sizes[i] > size:
            yield batch
            batch, held = [], 0
        batch.append(i)
        held += sizes[i]
    if batch:
        yield batch


def count_texts(texts: list[str], vocabulary: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        for part in safe_parts(text):
            parts.append(part)
            owner.append(i)
    counts, own = np.zeros(len(texts), dtype=np.int64), np.array(owner, dtype=np.int64)
    tok = tokenizer(vocabulary)
    for batch in byte_batches(parts):
        found = tok.encode_batch_fast([parts[i] for i in batch], add_special_tokens=False)
        np.add.at(counts, own[batch], [len(x) for x in found])
    return counts


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    prepare(docs.sparkSession)
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            n = count_texts(texts, vocabulary)
            size = [n_bytes(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[*names, "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs, count, schema)


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
