import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kalmia.llm import exact_dedup, mixing, ngram_join, sharding
from kalmia.llm.components import components


def brute_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            want[i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("least", [64, 1, 2])
def test_exact_dedup(monkeypatch, docs, odd, none, least):
    monkeypatch.setattr(exact_dedup, "LEAST", least)
    for table in (docs, odd, none, odd.union(odd).union(odd)):
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.query(table).collect())
        assert got == brute_dedup(table.collect())
    assert exact_dedup.exact_dedup(odd).columns[-4:] == ["keep_id", "group_size", "kept", "text_sha256"]


def test_heavy_digests_are_found(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.heavy(rows.select("doc_id", exact_dedup.digest().alias("text_sha256"), F.col("doc_id").alias("n")), "n").collect()
    assert [(r["first"]["id"], r["group_size"]) for r in found] == [(0, 1667)]


def test_sharding(docs, odd, none):
    for table in (docs, odd):
        got = sharding.query(table).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots, where = defaultdict(list), {}
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert where.setdefault(r["doc_id"], r["shard"]) == r["shard"]
            assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.query(none).count() == 0
    assert sharding.shard(odd).count() == odd.count()


def test_shards_by_a_plain_rendezvous(spark):
    """Spark's xxhash64 of (text, int) is XXH64 of the int's four bytes, seeded with XXH64 of the text (seed 42)."""
    keys, weights = [*range(400), None], [1.0, 0.0, 2.5, 1.0, 4.0]

    def best(key, weights):
        def score(i):
            seed = xxhash.xxh64_intdigest(("\x00null" if key is None else str(key)).encode(), seed=42)
            bits = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=seed) >> 11
            return -weights[i] / math.log((bits + 0.5) / 2**53)

        return max((i for i, w in enumerate(weights) if w), key=lambda i: (score(i), i))

    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard(rows, weights=weights, grown=2.0).collect()}
    assert got == {k: (best(k, weights), best(k, [*weights, 2.0])) for k in keys}


def test_shard_weights(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = {r["shard"]: r["count"] for r in sharding.shard(rows, weights=(1, 0, 3)).groupBy("shard").count().collect()}
    assert set(got) == {0, 2} and 0.72 < got[2] / 20_000 < 0.78
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), (0, 0))


def test_a_hot_key_is_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", 8)
    rows = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.hash("id").alias("h"))
    got = sharding.shard(rows, order=("h",)).collect()
    hot = [r for r in got if r["doc_id"] == 7]
    assert len({r["shard"] for r in hot}) == 1 and len(hot) >= 1_000
    inside = sorted((r["slot"], r["doc_id"], r["h"]) for r in got if r["shard"] == hot[0]["shard"])
    assert [x[0] for x in inside] == list(range(len(inside)))
    order = [h for _, key, h in inside if key == 7]
    assert sum(b < a for a, b in zip(order, order[1:], strict=False)) == 7  # h rises within each of the 8 buckets


def brute_copies(doc_id, source, rate, seed=17):
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for i in range(1, parts + 1):
        digest = hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{source or ''}|{i}".encode()).hexdigest()
        u, k = (int(digest[:13], 16) + 0.5) / 2**52, 0
        p = c = math.exp(-rate / parts)
        while c < u:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total


def test_mixing(docs, odd, none):
    for table, weights in ((docs, None), (odd, None), (docs, {"src0": 3.0, "src1": 1.0, "nowhere": 2.0}), (odd, {None: 500.0, "big": 1.0})):
        rows, size = table.collect(), defaultdict(int)
        for r in rows:
            size[r["source"]] += len((r["text"] or "").encode())
        w = {s: (n**mixing.TEMPERATURE if weights is None else weights.get(s, 0.0)) for s, n in size.items() if n}
        rate = {s: sum(size.values()) / sum(w.values()) * w[s] / size[s] for s in w}
        got = mixing.mix(table, weights).collect()
        want = Counter()
        for r in rows:
            for k in range(brute_copies(r["doc_id"], r["source"], rate.get(r["source"], 0.0))):
                want[r["doc_id"], r["text"], k] += 1
        assert Counter((r["doc_id"], r["text"], r["replica"]) for r in got) == want
        assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert mixing.mix(none).count() == 0


def test_mixing_hits_its_rates(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(rows, {"small": 1.0, "large": 1.0}).groupBy("source").count().collect()}
    assert abs(got["small"] - 10_000) < 400 and abs(got["large"] - 10_000) < 400  # mean rates 50 and 0.505


def brute_join(rows, t=0.8):
    words = [tuple((r["text"] or "").lower().split()) for r in rows]
    sets = {w: ({w[i : i + 5] for i in range(len(w) - 4)} or {w}) for w in words if w}
    names, parent = sorted(sets), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    n = Counter()
    for i, a in enumerate(names):
        for b in names[:i]:
            if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for w, r in zip(words, rows, strict=True):
        if w and r["doc_id"] is not None:
            least[find(w)] = min(least.get(find(w), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], least.get(find(w)) if w else r["doc_id"], n[w]) for w, r in zip(words, rows, strict=True))


@pytest.fixture(scope="module")
def near(spark):
    """A text with many near copies, another with few, exact copies of both, and others."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    other = [f"o{i}" for i in range(60)]
    texts += [" ".join(other), " ".join(other[:-2]), " ".join(other).upper(), " ".join(other), texts[0], texts[0]]
    texts += [" ".join(f"z{rng.randrange(50)}" for _ in range(30)) for _ in range(30)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_ngram_join(docs, odd, none, near):
    for table in (near, odd, docs, none):
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.query(table).collect())
        assert got == brute_join(table.collect())


def test_blocks_find_what_pairs_find(monkeypatch, near):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.query(near).collect())
    assert got == brute_join(near.collect())


@pytest.fixture(scope="module")
def family(spark):
    """Copies of one text with one or two words changed, as in a large group, some of a second one, and texts between both."""
    import random

    rng = random.Random(7)
    base, second = [f"w{i}" for i in range(120)], [f"v{i}" for i in range(120)]

    def copy(of, changes):
        words = list(of)
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    texts = [copy(base, 1 + (i % 5 == 0)) for i in range(120)] + [copy(base, 4) for _ in range(12)] + [copy(second, 1) for _ in range(40)] + [copy(base[:100] + second[:12], 1) for _ in range(10)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")


@pytest.mark.parametrize("threshold", [0.8, 0.8333])
def test_families_are_counted_as_pairs_are(spark, monkeypatch, family, threshold):
    want = brute_join(family.collect(), threshold)
    results = []
    for small, block in ((3, 16), (10_000, 256)):
        monkeypatch.setattr(ngram_join, "SMALL", small)
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
        monkeypatch.setattr(ngram_join, "CENTRE_ROWS", 32)
        rows = ngram_join.join(family, threshold).select("doc_id", "class_id", "n_links").collect()
        results.append(Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows))
    assert results == [want] * 2


def test_a_family_makes_no_blocks(spark, monkeypatch, family):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    found = []
    real = ngram_join._families
    monkeypatch.setattr(ngram_join, "_families", lambda *a: found.append(real(*a)) or found[0])
    ngram_join.links(family.filter("doc_id < 120"))
    assert found[0].count() > 60  # most texts are near their centre


def test_the_test_of_a_pair_is_the_same_at_the_threshold():
    assert ngram_join.enough(4164, 4581, 4580, 0.8333) == ngram_join.enough(np.float64(4164), np.array([4581.0]), np.array([4580.0]), 0.8333)[0]
    a, b = [np.arange(10, dtype=np.uint64), np.zeros(0, np.uint64)], [np.arange(5, 15, dtype=np.uint64), np.arange(100, 103, dtype=np.uint64)]
    assert ngram_join.shared_counts(a, b).tolist() == [[5, 0], [0, 0]] and ngram_join.shared_counts(a[1:], b).tolist() == [[0, 0]]


def test_keep_one(docs, odd, near, none):
    for table in (near, odd, docs, none):
        rows = table.collect()
        classes = Counter(c for _, c, _ in brute_join([r for r in rows if (r["text"] or "").split()]).elements())
        got = ngram_join.keep_one(table).collect()
        with_words = [r for r in got if (r["text"] or "").split()]
        assert Counter(r["doc_id"] for r in with_words) == Counter(dict.fromkeys(classes, 1))
        assert len(got) - len(with_words) == sum(not (r["text"] or "").split() for r in rows)
        assert ngram_join.keep_one(table).columns == table.columns


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = ngram_join.choose_bands(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= 128
    bands, rows = ngram_join.choose_bands(0.02, 0.9999)  # takes more hashes rather than less recall
    assert rows == 1 and 1 - (1 - 0.02) ** bands >= 0.9999
    for wrong in ((0.0, 0.9), (0.8, 1.0), (1.5, 0.5)):
        with pytest.raises(ValueError):
            ngram_join.choose_bands(*wrong)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
