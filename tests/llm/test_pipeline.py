"""Every stage of the pipeline against brute force on what the stage before kept, and the chain."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_dedup_shard_mix import brute_copies, brute_dedup, brute_join

import corpus_pipeline as P
from kalmia.llm import mixing, packing, tokens, toxicity

SF = "/root/testdata/sf0.001"


def as_rows(table):
    return Counter(tuple(r) for r in table.collect())


def drop_toxic(rows, model):
    cache: dict = {}
    kept = Counter()
    for r in rows:
        margin = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(toxicity.features(r["text"] or "").tolist()))
        assert abs(model.scores([r["text"] or ""], cache)[0] - toxicity._sigmoid(margin)) < 1e-9
        kept[tuple(r)] += margin < 0
    return +kept


def drop_copies(rows):
    stays = Counter((i, sha) for i, _, _, kept, sha in brute_dedup(rows).elements() if kept)
    return stays


def mixed(rows):
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode())
    w = {s: n**mixing.TEMPERATURE for s, n in size.items() if n}
    out = Counter()
    for r in rows:
        rate = sum(size.values()) / sum(w.values()) * w[r["source"]] / size[r["source"]] if r["source"] in w else 0.0
        out[tuple(r)] += brute_copies(r["doc_id"], r["source"], rate)
    return +out


def packed(rows, got):
    ids = Counter((r["doc_id"], len(tokens.tokenizer(packing.VOCABULARY).encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in rows)
    length, places = defaultdict(int), defaultdict(list)
    for r in got:
        assert 0 < r["length"] <= 2048
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        length[r["doc_id"]] += r["length"]
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = defaultdict(int)
    for (i, n), k in ids.items():
        total[i] += n * k
    assert dict(length) == dict(total)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_stages(request, spark, which, tmp_path):
    docs = request.getfixturevalue(which)
    for k, (name, stage) in enumerate(P.STAGES):
        rows, out = docs.collect(), stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(path := str(tmp_path / f"{k}"))
        out = spark.read.parquet(path)
        got = out.collect()
        if name == "toxicity":
            assert as_rows(out) == drop_toxic(rows, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
        elif name == "exact_dedup":
            have = as_rows(out)
            assert all(have[x] <= n for x, n in as_rows(docs).items() if x in have)
            assert Counter((i, sha) for i, _, _, _, sha in brute_dedup(got).elements()) == drop_copies(rows)
        elif name == "near_dedup":
            words = [r for r in rows if (r["text"] or "").split()]
            classes = {c for _, c, _ in brute_join(words).elements()}
            kept = [r for r in got if (r["text"] or "").split()]
            assert Counter(r["doc_id"] for r in kept) == Counter(dict.fromkeys(classes, 1))
            assert len(got) - len(kept) == len(rows) - len(words)
        elif name == "mix":
            assert as_rows(out) == mixed(rows)
        else:
            packed(rows, got)
        docs = out


def test_chain(spark, docs, odd, none):
    for table in (docs, odd):
        direct = table
        for _, stage in P.STAGES[:-1]:
            direct = stage(spark, direct, SF)
        want = Counter({r["doc_id"]: r["n"] for r in direct.groupBy("doc_id").agg(F.count("*").alias("n")).collect()})
        got = P.run_on(spark, table, SF)
        starts = got.filter("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
        assert Counter({r["doc_id"]: r["n"] for r in starts}) == want
    assert P.run_on(spark, none, SF).count() == 0
    assert P.run(spark, SF).count() == P.run_on(spark, docs, SF).count()
