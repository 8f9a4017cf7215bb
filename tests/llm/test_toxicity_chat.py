import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalmia.llm import chat, toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        rank[s == v] = np.mean(np.flatnonzero(s[order] == v))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    y, p = held["toxic"].to_numpy(), held["predicted"].to_numpy()
    assert auc(y, held["score"].to_numpy()) > 0.95
    assert ((p == 1) & (y == 1)).sum() > 0.85 * y.sum() and ((p == 1) & (y == 0)).sum() <= 0.05 * (p == 1).sum() + 1


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(12)] + [(3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for table, marks in ((odd, labels), (odd, labels.limit(0)), (none, labels), (odd, labels.filter("toxic = 1")), (odd, labels.filter("toxic = 0"))):
        got = toxicity.query(table, marks).collect()
        assert len(got) == table.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_the_smallest_shares_still_pick_rows(spark):
    rows = spark.range(40_000_000)
    assert 5 <= rows.filter(toxicity._thin(F.col("id"), 3, 4e-7)).count() <= 32
    assert rows.limit(1_000).filter(toxicity._thin(F.col("id"), 3, 1.0)).count() == 1_000


def test_the_correction_never_goes_negative():
    rng = np.random.default_rng(0)
    p = [np.array([0, 2], dtype=np.uint32) if rng.random() < 0.9 else np.array([2], dtype=np.uint32) for _ in range(200)]
    u = [*p[:60], *[np.array([1, 2], dtype=np.uint32)] * 340]
    vocabulary = np.array([0, 1, 2], dtype=np.uint32)
    w, b = toxicity.train_nnpu(toxicity._Rows(p, vocabulary), toxicity._Rows(u, vocabulary), 0.15, 1)
    assert w[0] + w[2] + b > 0 > w[1] + w[2] + b


def plain_training(p, u, width, prior, seed, steps):
    """The risk from its definition, sums over rows in plain loops; its slope by central differences."""
    rng = np.random.default_rng(seed)
    cp, cu = rng.poisson(1, len(p)) + 1e-3, rng.poisson(1, len(u)) + 1e-3
    cp, cu = [x / sum(cp) for x in cp], [x / sum(cu) for x in cu]
    loss = lambda z: 1 / (1 + math.exp(z))

    def mean(rows, share, at, sign):
        return sum(c * loss(sign * (at[-1] + sum(at[f] for f in row))) for row, c in zip(rows, share, strict=True))

    def goal(at, against):
        rest = mean(u, cu, at, -1) - prior * mean(p, cp, at, -1)
        return -rest if against else prior * mean(p, cp, at, 1) + rest

    at = [0.0] * width + [math.log(prior / (1 - prior))]
    first, second = [0.0] * (width + 1), [0.0] * (width + 1)
    turned = 0
    for step in range(1, steps + 1):
        against = mean(u, cu, at, -1) < prior * mean(p, cp, at, -1)
        turned += against
        slope = []
        for i in range(width + 1):
            up, down = at[:], at[:]
            up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
            slope.append((goal(up, against) - goal(down, against)) / 2e-5 + (1e-4 * at[i] if i < width else 0))
        for i, g in enumerate(slope):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            at[i] -= 0.05 * (first[i] / (1 - 0.9**step)) / (math.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            if i < width:
                at[i] = max(at[i], 0.0)
    return at, turned


def test_training_equals_plain_training():
    rng = np.random.default_rng(3)
    draw = lambda n, odds: [sorted(i for i in range(5) if rng.random() < odds[i]) for _ in range(n)]
    dirty, clean = (0.9, 0.7, 0.4, 0.5, 0.1), (0.05, 0.1, 0.4, 0.5, 0.6)
    p, u = draw(20, dirty), draw(12, dirty) + draw(40, clean)
    turns = 0
    for seed, prior in ((0, 0.25), (1, 0.4), (2, 0.6)):
        rows = [toxicity._Rows([np.array(r, dtype=np.uint32) for r in x], np.arange(5, dtype=np.uint32)) for x in (p, u)]
        w, b = toxicity.train_nnpu(*rows, prior, seed, steps=80)
        want, turned = plain_training(p, u, 5, prior, seed, 80)
        turns += turned
        assert np.allclose([*w, b], want, atol=1e-3), (w, b, want)
    assert turns  # the correction was met


def test_selection_equals_plain_counts():
    rng = np.random.default_rng(5)
    p = [np.flatnonzero(rng.random(40) < np.linspace(0.9, 0.05, 40)).astype(np.uint32) for _ in range(60)]
    u = [np.flatnonzero(rng.random(40) < 0.15).astype(np.uint32) for _ in range(200)]
    prior, want = 0.1, []
    for f in range(40):
        n, m = sum(f in r for r in p), sum(f in r for r in u)
        a, one = n / len(p), 1 / len(u)
        clean = max(0.0, m / len(u) - prior * a) / (1 - prior)
        deviation = math.sqrt(a * (1 - a) / len(p) + (clean + one) / len(u))
        if n >= 3 and a > 3 * (clean + one) and (a - clean) / deviation > 2.5:
            want.append(f)
    assert want and toxicity.select(p, u, prior).tolist() == want


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" again"))))  # repeated ids go over the bounds
    few = {"max_positive": 20, "max_unlabelled": 60, "max_calibration": 20}
    one = toxicity.train(docs.repartition(7, "text"), labels.repartition(3), **few)
    other = toxicity.train(docs.orderBy(F.desc("text")), labels.orderBy("doc_id"), **few)
    assert one == other and one.weights


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", "<|", "|turn|>", "|body|>", "|endoftext|>", "a", " ", "</s>", "[INST]"]), max_size=14).map("".join))
def test_escaping_is_reversible_and_complete(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.RESERVED)


def brute_chat(rows):
    want = {}
    for conv in {r["conv_id"] for r in rows}:
        turns = sorted((r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or "") for r in rows if r["conv_id"] == conv)
        learnt = "".join(t for *_, role, t in turns if role == "assistant")
        chars = len("<s>") + sum(len("<|turn|><|body|></s>") + len(chat.escape(r)) + len(chat.escape(t)) for *_, r, t in turns)
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), chars)
    return want


def rows_of(table):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in table.collect()}


def test_chat(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    specimen = spark.createDataFrame(chat.SPECIMEN, turns.schema)
    assert rows_of(chat.query(turns)) == brute_chat(turns.union(specimen).collect())


def test_odd_conversations(spark):
    from tests_llm_texts import TEXTS

    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(TEXTS)]
    rows += [(2, 0, None, None, "x"), (None, 0, "assistant", "a", "x"), (None, None, "assistant", "b", "x"), (3, 1, "system", "same", "x"), (3, 1, "system", "same", "x"), (4, 0, "<s>", "</s>", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = rows_of(chat.read_back(chat.format_chat(table.repartition(5))))
    assert got == brute_chat(table.collect())
    assert chat.read_back(chat.format_chat(table.limit(0))).count() == 0


def test_masks_and_places(spark):
    table = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "well, hello"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    rows = chat.format_chat(table).orderBy("place").collect()
    assert [r["start"] for r in rows] == [0, len(rows[0]["ids"]), len(rows[0]["ids"]) + len(rows[1]["ids"])]
    tok = chat.tokenizer(chat.VOCABULARY)
    assert [tok.decode([i for i, m in zip(r["ids"], r["mask"], strict=True) if m]) for r in rows] == ["", "well, hello", ""]
    assert all(len(r["ids"]) == len(r["mask"]) for r in rows)


@pytest.fixture(autouse=True)
def _texts(monkeypatch):
    import sys
    import types

    import conftest as _  # noqa: F401

    module = types.ModuleType("tests_llm_texts")
    from importlib import util
    from pathlib import Path

    spec = util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
    found = util.module_from_spec(spec)
    spec.loader.exec_module(found)
    module.TEXTS = found.TEXTS
    monkeypatch.setitem(sys.modules, "tests_llm_texts", module)
