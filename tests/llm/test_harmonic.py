import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kalmia.llm import harmonic

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ids_of = lambda text: PLAIN.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return harmonic.Words()


mixed = st.text(alphabet=st.one_of(st.sampled_from(list("abSΣσİıǅ²½ª 1\n\t'sdlLreé́.,!<|>_٣ー字\x85\xa0\x0b\x1c\x01\x02 ")), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(st.lists(mixed, max_size=4))
def test_ids_are_the_librarys(words, texts):
    texts = [*texts, "<|endoftext|>".join(texts), "Don't they're I'M we'll <|startoftext|>a"]
    assert [x.tolist() for x in words.encode(texts)] == [ids_of(t) for t in texts]


def test_every_character_of_the_plain_class(words):
    plain = [chr(c) for c in range(0x2100) if not harmonic._OTHER.search(chr(c)) and not chr(c).isspace()]
    texts = [f"{a}{b}x {b}{a}" for a in plain[:94:5] for b in plain]
    assert [x.tolist() for x in words.encode(texts)] == [ids_of(t) for t in texts]


def test_every_word_of_the_vocabulary(words):
    found = [t.removesuffix("</w>") for t in PLAIN.get_vocab() if t.endswith("</w>") and t.isascii()]
    assert [x.tolist() for x in words.encode(found)] == [e.ids for e in PLAIN.encode_batch(found, add_special_tokens=False)]


def test_memory_of_chunks_is_bounded(words, monkeypatch):
    monkeypatch.setattr(harmonic, "REMEMBERED", 100)
    for i in range(20):
        texts = [f"w{i}x{j} long{'y' * 60}{j}" for j in range(20)]
        assert [x.tolist() for x in words.encode(texts)] == [ids_of(t) for t in texts]
        assert len(words.known) <= 141 and max(map(len, words.known)) <= harmonic.SHORT


def check(table, partitions=None, **how):
    """Every id in exactly one piece, sequences without gaps; tokens of padding and of all, and pieces."""
    capacity = how.get("capacity", 2048)
    got = harmonic.pack(table.repartition(partitions) if partitions else table, **how).collect()
    want, have = defaultdict(int), defaultdict(list)
    texts = [np.array([*ids_of(r["text"]), 1], dtype="<u4") for r in table.collect()]
    keys = [str(r["doc_id"]) for r in table.collect()]
    for key, ids in zip(keys, texts, strict=True):
        want[key] += len(ids)
    by_start = defaultdict(set)
    for key, ids in zip(keys, texts, strict=True):
        by_start[key].add(ids.tobytes())
    sequences = defaultdict(list)
    for r in got:
        key = str(r["doc_id"])
        assert any(len(x) // 4 == r["doc_tokens"] and zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for x in by_start[key])
        want[key] -= r["length"]
        have[key].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(want.values())
    for key, ids in zip(keys, texts, strict=True):
        covered = np.zeros(max(len(x) for x in by_start[key]) // 4, dtype=int)
        for s, n in have[key]:
            covered[s : s + n] += 1
        assert covered.all() and (keys.count(key) > 1 or (covered == 1).all())
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(map(len, texts)), len(got)


def test_packing(docs, odd, none):
    for partitions in (None, 7):
        padding, tokens, pieces = check(docs, partitions)
        assert padding <= 0.002 * tokens and pieces <= 4 * docs.count() + tokens / 2048
    check(odd)
    check(odd, capacity=8)
    check(odd, 40, capacity=100, slack=3.0)
    assert harmonic.pack(none).count() == 0


def test_ids_of_any_type(odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert harmonic.pack(named).schema["doc_id"].dataType == named.schema["doc_id"].dataType
    check(named)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 300), st.floats(0, 9))
def test_classes_take_a_fixed_number(capacity, slack):
    for n in range(3 * capacity):
        pieces = harmonic.pieces_of(n, capacity, slack)
        assert sum(pieces) == n
        for p in pieces:
            k = capacity // p
            assert capacity // (k + 1) < p and k * p <= capacity and (p == capacity // k or capacity - k * p <= slack * k)


def test_bins_by_brute_force():
    rng = np.random.default_rng(3)
    bins, rows, ids = harmonic.Bins(5, 64), [], []
    for doc in range(200):
        n = int(rng.integers(1, 200))
        ids.append(rng.integers(0, 9, n).astype("<u4"))
        start = 0
        for size in harmonic.pieces_of(n, 64):
            k = 64 // size
            held = len(bins.open[k])
            out = list(bins.add((doc, start, ids[doc][start : start + size], n)))
            assert (len(out) == k) == (held + 1 == k) and len(bins.open[k]) < k
            rows += out
            start += size
    rows += bins.close()
    used = defaultdict(int)
    for doc, start, size, crc, n, sequence, offset in rows:
        assert crc == zlib.crc32(ids[doc][start : start + size].tobytes()) and n == len(ids[doc]) and sequence >> 32 == 5
        assert used[sequence] == offset
        used[sequence] += size
    assert sum(used.values()) == sum(map(len, ids)) and max(used.values()) <= 64
    last = [u for u in used.values() if 64 - u > 7]
    assert all(u & (u - 1) == 0 for u in last)


def test_closing():
    assert harmonic.closing(0, 64) == []
    assert harmonic.closing(64 * 3 + 13, 64) == [64, 64, 64, 8, 4, 1]
