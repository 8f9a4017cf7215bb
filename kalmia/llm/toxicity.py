"""Operator 3, toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Linear numpy classifiers are trained from texts confirmed as toxic (P) and from texts of unknown
class (U, a sample of everything) with the class-prior-corrected risk

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),

l being the sigmoid loss and pi the share of toxic rows among the labelled ones. Whenever the
corrected part falls below zero, the step goes against it, so that the classifiers can't fit U as
all clean. Their averaged margin is put on a probability scale with labelled training rows.

Features are a text's distinct words and their first 4, 5 and 6 letters, over whole texts. Language,
source, ids and labels are never inputs of a score.

Training reads at most ``max_positive`` + ``max_unlabelled`` + ``max_calibration`` texts, picked by
a hash of doc_id: the driver holds their features, 32 bits each. Where the pick exceeds its bound, the rows with the
smallest hashes stay, so it doesn't depend on the order of rows. Scores cover every row.

Null texts count as empty; they and texts without words get the score of a text without features.
Repeated labels of a doc_id: toxic if one says so; null labels are ignored. Without any confirmed
row, or with none but those, every score is the share of toxic rows (0 without labels). Repeated
rows get equal scores; ids may be of any type. Very long texts count whole: their features are a set.
An empty table gives an empty result. Result columns replace input columns of the same names.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalmia.llm._common import map_arrow, portions, prepare, without

#: Bounds of the samples that training reads.
MAX_POSITIVE, MAX_UNLABELLED, MAX_CALIBRATION = 3_000, 9_000, 3_000
#: Rows whose crc32(doc_id as text) leaves 0 modulo this are held out of training.
FOLDS = 5
_WORD = re.compile(r"\w+")
#: Words in a worker's cache.
_CACHE = 1_000_000


def held_out(doc_id: Column) -> Column:
    """A null doc_id counts as the empty text; its crc32 is 0, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def word_features(word: str) -> list[int]:
    names = [f"w{word}"] + [f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names]


def features(text: str) -> np.ndarray:
    """Sorted distinct 32-bit feature hashes of a whole text."""
    found: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        found.update(word_features(word))
    return np.array(sorted(found), dtype=np.uint32)


@dataclasses.dataclass
class Model:
    weights: dict[int, float]
    bias: float
    prior: float

    def scores(self, texts: list[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            hit: set[int] = set()
            for word in set(_WORD.findall(text.lower())):
                known = cache.get(word)
                if known is None:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    known = cache[word] = tuple(f for f in word_features(word) if f in self.weights)
                if known:
                    hit.update(known)
            out[i] = self.bias + sum(self.weights[f] for f in sorted(hit))
        return _sigmoid(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Rows:
    """Sparse rows of 0/1 features."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray):
        kept = []
        for row in rows:
            at = np.searchsorted(vocabulary, row)
            at[at == len(vocabulary)] = 0
            kept.append(at[vocabulary[at] == row] if len(vocabulary) else at[:0])
        self.n, self.width = len(rows), len(vocabulary)
        self.index = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(x) for x in kept])

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.owner, weights=w[self.index], minlength=self.n)

    def pull(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.owner], minlength=self.width)


def train_nnpu(p: _Rows, u: _Rows, prior: float, seed: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that make the non-negative risk small (Adam, a bootstrap of the rows per seed)."""
    rng = np.random.default_rng(seed)
    cp, cu = rng.poisson(1, p.n) + 1e-3, rng.poisson(1, u.n) + 1e-3
    cp, cu = cp / cp.sum(), cu / cu.sum()
    w, b = np.zeros(p.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(p.width + 1), np.zeros(p.width + 1)
    for step in range(1, steps + 1):
        sp, su = _sigmoid(p.margins(w, b)), _sigmoid(u.margins(w, b))
        dp, du = sp * (1 - sp) * cp, su * (1 - su) * cu
        # l(z) = sigmoid(-z): E[l(g)] falls by dp, E[l(-g)] rises by it.
        rest = su @ cu - prior * (sp @ cp)
        if rest >= 0:
            gp, gu = -2 * prior * dp, du
        else:
            gp, gu = prior * dp, -du
        grad = np.append(p.pull(gp) + u.pull(gu) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]  # the features are signs of P
    return w, b


def select(p: list[np.ndarray], u: list[np.ndarray], prior: float, most: int = 8_192) -> np.ndarray:
    """Features clearly more frequent in P than, by the class prior, in the clean part of U."""
    np_, nu = len(p), len(u)
    ids, n = np.unique(np.concatenate(p), return_counts=True)
    uid, un = np.unique(np.concatenate(u), return_counts=True) if u else (ids[:0], n[:0])
    at = np.clip(np.searchsorted(uid, ids), 0, max(len(uid) - 1, 0))
    both = np.where(uid[at] == ids, un[at], 0) if len(uid) else np.zeros(len(ids))
    a = n / np_
    clean = np.maximum(0, both / max(nu, 1) - prior * a) / (1 - prior)
    spread = np.sqrt(a * (1 - a) / np_ + (clean + 1 / max(nu, 1)) / max(nu, 1))
    z = (a - clean) / np.maximum(spread, 1e-9)
    ok = np.flatnonzero((n >= 3) & (z > 2.5) & (a > 3 * (clean + 1 / max(nu, 1))))
    return np.sort(ids[ok[np.argsort(-z[ok], kind="stable")[:most]]])


def fit(p: list[np.ndarray], u: list[np.ndarray], prior: float, labelled: list[np.ndarray], y: np.ndarray, models: int = 3) -> Model:
    """The averaged classifiers with a slope and an offset from the labelled training rows."""
    if not p or not u or not 0 < prior < 1:
        odds = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (40.0 if prior else -40.0)
        return Model({}, odds, prior)
    vocabulary = select(p, u, prior)
    rows_p, rows_u = _Rows(p, vocabulary), _Rows(u, vocabulary)
    fits = [train_nnpu(rows_p, rows_u, prior, seed) for seed in range(models)]
    w, b = np.mean([x for x, _ in fits], axis=0), float(np.mean([x for _, x in fits]))
    slope, offset = 1.0, 0.0
    if len(set(y.tolist())) == 2:
        z = _Rows(labelled, vocabulary).margins(w, b)
        scale = max(float(np.std(z)), 1e-6)
        z = z / scale
        for _ in range(2_000):
            e = _sigmoid(slope * z + offset) - y
            slope, offset = slope - 0.5 * float(np.mean(e * z) + 1e-3 * (slope - 1)), offset - 0.5 * float(np.mean(e))
        slope = max(slope, 0.1) / scale
    return Model(dict(zip(vocabulary.tolist(), (slope * w).tolist(), strict=True)), slope * b + offset, prior)


def _thin(doc_id: Column, salt: int, share: float) -> Column:
    """A fixed pick of about that share of the doc_ids, fine enough for the smallest shares."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(salt)), 2) < F.lit(int(share * 2**62))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_calibration: int = MAX_CALIBRATION) -> Model:
    """Reads the bounded samples (see the module's text) from rows that aren't held out."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    toxic, n = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    total = docs.count()
    prior = toxic / n if n else 0.0
    share = lambda most, of: min(1.0, 0.95 * most / max(of, 1))
    picked = known.filter(((F.col("toxic") == 1) & _thin(F.col("doc_id"), 1, share(max_positive, toxic))) | _thin(F.col("doc_id"), 2, share(max_calibration, n)))
    # The pick's size varies around its bound; this holds it, and drops the same rows whatever order they come in.
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(max_positive + max_calibration)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("u", T.BooleanType()), T.StructField("c", T.BooleanType()), T.StructField("f", T.BinaryType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found = [features(x or "").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "u", "c")), pa.array(found, pa.binary())], names=schema.names)

    unlabelled = ~held_out(F.col("doc_id")) & _thin(F.col("doc_id"), 3, share(max_unlabelled, total))
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left").withColumn("u", F.coalesce(unlabelled, F.lit(False)))
        .filter(F.col("u") | F.col("toxic").isNotNull())
        .withColumn("c", F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % 2 == 1)
        .select("doc_id", "text", "toxic", "u", "c").mapInArrow(extract, schema)
        .orderBy(F.xxhash64("doc_id", "f"), "doc_id", "f").limit(2 * (max_positive + max_unlabelled + max_calibration))
    )
    p, u, c, y = [], [], [], []
    for row in sorted(rows.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], bytes(r["f"]))):
        f = np.frombuffer(row["f"], dtype=np.uint32)
        if row["u"]:
            u.append(f)
        if row["toxic"] == 1:
            p.append(f)
        if row["toxic"] is not None and row["c"]:
            c.append(f)
            y.append(row["toxic"])
    # The picked rows hold more toxic ones than the labels do: weigh by repetition of the clean ones' share.
    if p and not u:
        u = p + c
    keep = np.array(y, dtype=float)
    if len(keep) and 0 < keep.mean() < 1 and 0 < prior < 1:
        spare = np.flatnonzero(keep == 1)
        most = int(round((keep == 0).sum() * prior / (1 - prior)))
        gone = set(spare[max(most, 1):].tolist())
        c, keep = [x for i, x in enumerate(c) if i not in gone], np.array([x for i, x in enumerate(keep) if i not in gone])
    return fit(p, u, prior, c, keep)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on) from their whole texts."""
    prepare(docs.sparkSession)
    docs = without(docs, "score", "predicted")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(model.weights), dtype=np.uint32), np.array(list(model.weights.values())), model.bias, model.prior))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, w, bias, prior = shared.value
        own, cache = Model(dict(zip(ids.tolist(), w.tolist(), strict=True)), bias, prior), {}
        for batch in portions(batches, "text"):
            s = own.scores([x or "" for x in batch.column("text").to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return map_arrow(docs, work, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
