"""Operator 13, harmonic packing.

Class k holds the pieces longer than C/(k+1) and at most C/k tokens, C being the capacity, so that k of
them fill one sequence. Documents may be cut: a document's tail is cut into a piece of a class's full
size, floor(C/k), and a rest, until padding it to its own class's size takes at most ``SLACK`` tokens.
Every bin of class k is then closed with k pieces and hardly any padding, whatever comes next, and no
worker has to know of another one's bins.

Each task fills bins of its own (the sequence's number starts with the task's partition), so nothing is
shuffled and nothing grows with a source or a group of copies: a task holds one open bin for each class,
less than ``capacity`` tokens each, some 90 classes. At its end the pieces of open bins, cut once more
where a sequence ends, fill sequences of the full size and then one for each binary digit of what is
left: a sequence at a power of two isn't padded.

The pieces are written once to the shared folder, so that later stages never see one task's bins filled
twice in different orders.

A document is its ids and the separator: null and empty texts are one separator. Repeated rows, equal
doc_ids and ties are packed row by row. Very long texts are encoded chunk by chunk. Columns other than
doc_id and text aren't read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kalmia.llm._common import materialize, portions, prepare
from kalmia.llm.tokens import tokenizer

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 1
#: Tokens of padding at most that a piece may cost in its class instead of being cut.
SLACK = 1.0
#: Chunks of text whose ids a worker remembers, and characters of the longest one.
REMEMBERED, SHORT = 600_000, 48

#: Between these, neither a pre-token, nor a merge, nor a normalization, nor a special string can cross.
_SPACE = re.compile(r"[ \t\n\r]+")
#: Characters over which lower case, normal form and classes are alike here and in the vocabulary's library.
_OTHER = re.compile(r"[^\x21-\x7e¡-±´-¸º»¿-įı-ɏΑ-ΡΤ-ωА-я–-…€]|<\|")
#: Marks that stand for the end of a word and the end of a chunk; texts that hold them aren't plain.
_END, _CHUNK = "\x01", "\x02"
#: The vocabulary's own pre-token rule, over plain characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|\x02|(?:[^\s\w\x02]|_)+")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words:
    """The vocabulary's ids of texts, with the ids of frequent chunks remembered.

    Merges are by rank in both libraries, so the quicker one gives the same ids once a word's end is a
    byte of its own that merges before all else; a merge whose parts come later than itself would break
    this, and the constructor refuses such a vocabulary. Chunks that aren't plain go through the
    vocabulary's own library.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            model = json.load(f)["model"]
        number, letters, suffix = model["vocab"], _byte_letters(), model["end_of_word_suffix"]
        end = _END.encode()

        def spelt(token: str) -> bytes:
            return bytes(letters[c] for c in token.removesuffix(suffix)) + end * token.endswith(suffix)

        tokens = [*sorted(letters, key=letters.__getitem__), *(c + suffix for c in letters)]
        ranks = {spelt(t): i for i, t in enumerate(tokens)}
        for pair in model["merges"]:
            first, second = pair.split(" ") if isinstance(pair, str) else pair
            if spelt(first) not in ranks or spelt(second) not in ranks or spelt(first + second) in ranks:
                raise ValueError("the vocabulary's merges aren't in order")
            ranks[spelt(first + second)] = len(tokens)
            tokens.append(first + second)
        self.numbers = np.array([number[t] for t in tokens], dtype="<u4")
        self.boundary = number[tokens[ord(_CHUNK)] + suffix]
        self.quick = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
        self.own = tokenizer(vocabulary)
        self.known: dict[str, bytes] = {}

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of plain chunks, all at once."""
        words = _WORD.findall(_CHUNK.join(chunks).lower())
        ids = self.numbers[self.quick.encode_to_numpy(_END.join(words) + _END)]
        ends = np.flatnonzero(ids == self.boundary)
        raw, starts, stops = ids.tobytes(), [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(starts, stops, strict=True)]

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of different chunks, as bytes."""
        plain, other = [], []
        for c in chunks:
            (other if _OTHER.search(c) else plain).append(c)
        found = dict(zip(plain, self._plain(plain), strict=True)) if plain else {}
        for c, e in zip(other, self.own.encode_batch_fast(other, add_special_tokens=False), strict=True):
            found[c] = np.array(e.ids, dtype="<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [_SPACE.split(t.strip(" \t\n\r")) for t in texts]
        new = {c for chunks in cut for c in chunks}.difference(self.known)
        new.discard("")
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, {c for chunks in cut for c in chunks if c}
        self.known |= self.learn(list(new)) | {"": b""}
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), dtype="<u4") for chunks in cut]
        for c in new:
            if len(c) > SHORT:
                del self.known[c]
        return out


@lru_cache(maxsize=4)
def words(vocabulary: str) -> Words:
    return Words(vocabulary)


@lru_cache(maxsize=4)
def cuts(capacity: int, slack: float) -> list[list[int]]:
    """The pieces of each rest that is shorter than the capacity."""
    out: list[list[int]] = [[]]
    for n in range(1, capacity):
        k = capacity // n
        head = n if capacity - k * n <= slack * k else capacity // (k + 1)
        out.append([head, *out[n - head]])
    return out


def pieces_of(n: int, capacity: int, slack: float = SLACK) -> list[int]:
    """Lengths of a document's pieces, from its start on."""
    return [capacity] * (n // capacity) + cuts(capacity, slack)[n % capacity]


def closing(total: int, capacity: int) -> list[int]:
    """Sizes of the sequences that ``total`` tokens of open bins fill: full ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Bins:
    """One task's bins. Pieces are (document, start, ids, tokens of the document)."""

    def __init__(self, task: int, capacity: int) -> None:
        self.capacity, self.next = capacity, task << 32
        self.open: defaultdict[int, list[tuple]] = defaultdict(list)

    def _rows(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, tokens in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """The rows of the bin that the piece fills, if it fills one."""
        k = self.capacity // len(piece[2])
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            yield from self._rows(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """Rows of what the open bins hold."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        left.reverse()
        for size in closing(sum(len(p[2]) for p in left), self.capacity):
            held: list[tuple] = []
            while size:
                doc, start, ids, tokens = left.pop()
                held.append((doc, start, ids[:size], tokens))
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], tokens))
                size -= len(held[-1][2])
            yield from self._rows(held)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, slack: float = SLACK) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in longs)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, coder, of_id = Bins(TaskContext.get().partitionId(), capacity), words(vocabulary), None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema.names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of_id), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        for batch in portions(batches, "text"):
            of_id = batch.schema.field("doc_id").type
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                ids, start = np.append(ids, np.uint32(separator)).astype("<u4"), 0
                for size in pieces_of(len(ids), capacity, slack):
                    # A copy: a waiting piece must not keep its whole document.
                    rows.extend(bins.add((doc, start, ids[start : start + size].copy(), len(ids))))
                    start += size
            yield batch_of(rows)
        if of_id is not None:
            yield batch_of(list(bins.close()))

    return materialize(docs.select("doc_id", "text").mapInArrow(work, schema))
