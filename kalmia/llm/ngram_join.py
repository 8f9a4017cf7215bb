"""Operator 5, n-gram Jaccard join by MinHash banding.

Words are the stretches between white space of the lower-cased text; a text's set holds its n-grams
of five words (the whole text where there are fewer). Texts whose words are the same are one vertex
from the start, represented once. Two different texts are linked when the Jaccard similarity of
their full n-gram sets is at least the threshold.

Candidates are pairs that share a band of MinHash values. ``choose_bands`` takes the numbers of
bands and rows from the threshold and a target recall (probability, for a pair exactly at the
threshold, to share a band). Every candidate pair is verified on full sets, once, in the first band
that it shares:

* Bands with up to ``SMALL`` texts make pairs, which fetch both sets.
* Larger ones are dealt into blocks of bounded rows and bytes. A task gets two blocks and compares
  them as matrices; it returns, for each text, its number of links and one edge of a spanning
  forest. So no task holds a group, and no pairs of a group are written out.
* Many close copies of one text don't come to that. A text's family is its largest band bucket; a
  family of more than a block gets a centre, the n-grams that most of its texts have (seen on a few
  of them: any centre is right, a good one decides more). A set that shares i of its n n-grams with
  a centre of c shares at least i + i' - c with another one. Where i is so large that half of the
  threshold's demand is met from each side, all pairs are links, and counting the texts is enough:
  the work is linear in their number. Only pairs with a text further away are compared in blocks.

All ways accept a pair by the same test, so a band's size doesn't change the result; links are
counted exactly and classes are whole. Exact copies add nothing. What stays quadratic is the number
of pairs in one band between texts of which one is too far from the centre to be sure.

Null texts count as empty; texts without words have no n-grams and link to nothing, each a class of
its own. Repeated rows share a class. Very long texts count whole: a text's n-grams and their hashes
are held by one task. An empty table gives an empty result. ``keep_one`` keeps one row of a class
whose smallest doc_id is null or repeated, too: ids that are there come first, and of rows with the
same id and text any one. Columns that the result names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.llm._common import fresh, materialize, portions, prepare, ref, text_or_empty, without
from kalmia.llm.components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Texts in a band up to which pairs are made; rows and n-grams (about) in a block beyond.
SMALL, BLOCK_ROWS, BLOCK_GRAMS = 12, 256, 1 << 16
#: Texts of a family that its centre is taken from, and rows of it that meet one copy of the centre.
CENTRE_TEXTS, CENTRE_ROWS = 65, 4_096

_MASK = (1 << 64) - 1


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for few false candidates, that reach ``recall`` with so many hashes; single rows, as many as it takes, where none does."""
    if not (0 < threshold <= 1 and 0 <= recall < 1):
        raise ValueError("threshold must be in (0, 1], recall in [0, 1)")
    for rows in range(12, 0, -1):
        bands = 1 if threshold == 1 else max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows)))))
        if bands * rows <= most_hashes or rows == 1:
            return bands, rows
    raise AssertionError


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(words: list[str], n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        return np.unique(mixed(out + np.uint64(width)))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit hash for each band of the set's MinHash values."""
    a, b = _coefficients(bands * rows)
    low = np.full(bands * rows, _MASK, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for s in range(0, len(grams), 2048):
            block = grams[s : s + 2048]
            x = a[:, None] * block[None, :] + b[:, None]
            low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=1))
        out = np.zeros(bands, dtype=np.uint64)
        for k in range(rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + low.reshape(bands, rows)[:, k])
        out = mixed(out + np.arange(bands, dtype=np.uint64))
    return out.view(np.int64)


def words_of(text: str = "text") -> Column:
    """The text's words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"\s+", " "))


def rid_of(words: Column) -> Column:
    """What stands for a text; null without words."""
    return F.when(words != "", F.unhex(F.md5(words.cast("binary"))))


def _signatures(bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "words"):
            sets = [gram_set(w.split(" ")) for w in batch.column("words").to_pylist()]
            keys = np.array([band_hashes(s, bands, rows) for s in sets], dtype=np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), pa.array(keys)), pa.array([len(s) for s in sets], pa.int32())],
                names=["rid", "bands", "grams"],
            )

    return work


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "words"):
        sets = [gram_set(w.split(" ")).tobytes() for w in batch.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sets, pa.binary())], names=["rid", "grams"])


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of band hashes a against b (broadcast): the first band in common, or the number of bands."""
    same = a == b
    return np.where(same.any(axis=-1), same.argmax(axis=-1), a.shape[-1])


def enough(both, a, b, threshold: float):
    """Whether sets of a and b elements that share ``both`` are linked: the one test of all ways."""
    return both >= threshold * (a + b - both) - 1e-9


def _verify_pairs(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "grams_a"):
            c = {k: batch.column(k).to_pylist() for k in ("a", "b", "band", "bands_a", "bands_b", "grams_a", "grams_b", "near_a", "near_b")}
            out: tuple[list, list] = ([], [])
            for i in range(batch.num_rows):
                if c["near_a"][i] is not None and c["near_a"][i] == c["near_b"][i]:
                    continue  # counted with their family
                if int(first_shared(np.array(c["bands_a"][i]), np.array(c["bands_b"][i]))) != c["band"][i]:
                    continue  # the pair belongs to a larger bucket of an earlier band
                x, y = np.frombuffer(c["grams_a"][i], np.uint64), np.frombuffer(c["grams_b"][i], np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                    continue
                if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold):
                    out[0].append(c["a"][i])
                    out[1].append(c["b"][i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])

    return work


def shared_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of a shares with each of b."""
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets_a, sets_b))
    all_a, all_b = (np.concatenate([*x, np.zeros(0, np.uint64)]).astype(np.uint64) for x in (sets_a, sets_b))
    known = np.intersect1d(all_a, all_b)  # what only one side has is shared by no pair
    both, step = np.zeros((len(sets_a), len(sets_b))), 4096
    found = []
    for rows, values in ((rows_a, all_a), (rows_b, all_b)):
        at = np.searchsorted(known, values)
        at[at == len(known)] = 0
        ok = known[at] == values if len(known) else np.zeros(len(values), bool)
        order = np.argsort(at[ok], kind="stable")
        found.append((rows[ok][order], at[ok][order]))
    for k in range(0, len(known), step):
        dense = []
        for (rows, at), n in zip(found, both.shape, strict=True):
            part = slice(*np.searchsorted(at, [k, k + step]))
            block = np.zeros((n, step), dtype=np.float32)
            block[rows[part], at[part] - k] = 1
            dense.append(block)
        both += dense[0] @ dense[1].T
    return both


def _verify_blocks(threshold: float):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        i, j, band = (int(group[c].iloc[0]) for c in ("i", "j", "band"))
        a, b = group[group["blk"] == i], group[group["blk"] == j]
        none = pd.DataFrame({"id": pd.Series([], dtype=object), "peer": pd.Series([], dtype=object), "n": pd.Series([], dtype=np.int64)})
        if a.empty or b.empty:
            return none
        keys = [np.array(part["bands"].tolist(), dtype=np.int64) for part in (a, b)]
        near = [part["near"].map(lambda x: b"" if x is None else bytes(x)).to_numpy() for part in (a, b)]
        mask = np.zeros((len(a), len(b)), dtype=bool)
        for r in range(len(a)):  # only pairs whose first band in common is this one, and not those counted with their family
            mask[r] = (first_shared(keys[0][r][None, :], keys[1]) == band) & ~((near[1] == near[0][r]) & (near[0][r] != b""))
        if i == j:
            np.fill_diagonal(mask, False)
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        if not len(rows):
            return none
        sets = [[np.frombuffer(part["grams"].iloc[k], np.uint64) for k in at] for part, at in ((a, rows), (b, columns))]
        size_a, size_b = (np.array([len(x) for x in part], dtype=np.float64) for part in sets)
        linked = np.zeros(mask.shape, dtype=bool)
        linked[np.ix_(rows, columns)] = enough(shared_counts(*sets), size_a[:, None], size_b[None, :], threshold)
        linked &= mask
        ids = [*a["rid"], *b["rid"]]
        m, n = linked.shape
        counts = np.concatenate([linked.sum(axis=1), np.zeros(n, int) if i == j else linked.sum(axis=0)])
        # Labels settle on the smallest place in each connected part: one edge each to that place.
        left, right = np.arange(m), (np.arange(n) if i == j else np.arange(m, m + n))
        while True:
            new_left = np.minimum(left, np.where(linked, right[None, :], m + n).min(axis=1))
            new_right = new_left if i == j else np.minimum(right, np.where(linked, new_left[:, None], m + n).min(axis=0))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        root = np.concatenate([left, right])
        at = np.flatnonzero(counts > 0)
        return pd.DataFrame({"id": [ids[k] for k in at], "peer": [ids[root[k]] for k in at], "n": counts[at].astype(np.int64)})

    return work


def _centre(group: pd.DataFrame) -> pd.DataFrame:
    """The n-grams that most of some texts of a family have."""
    grams, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group["grams"]]), return_counts=True)
    return pd.DataFrame({"family": [group["family"].iloc[0]], "centre": [grams[2 * n > len(group)].tobytes()]})


def _near_centre(threshold: float):
    """Rows whose set is so close to the centre that any two of them are linked."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "grams"):
            keep = []
            for grams, centre in zip(batch.column("grams"), batch.column("centre"), strict=True):
                x, c = np.frombuffer(grams.as_buffer(), np.uint64), np.frombuffer(centre.as_buffer(), np.uint64)
                i = len(np.intersect1d(x, c, assume_unique=True))
                # Two such sets share at least i + i' - c: enough(i + i' - c, n, n') is the sum of two such demands.
                keep.append((1 + threshold) * (i - len(c) / 2) - threshold * len(x) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in ("rid", "family")], names=["rid", "near"])

    return work


def _families(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """(rid, near): texts whose pairs within ``near`` (the smallest rid of a family) are all links. None without families."""
    chosen = large.groupBy("rid").agg(F.max(F.struct("m", "band", "key")).alias("f")).select("rid", F.col("f.band").alias("band"), F.col("f.key").alias("key"))
    sizes = materialize(chosen.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("rid").alias("family")).filter(F.col("members") > BLOCK_ROWS))
    if sizes.isEmpty():
        return None
    own = materialize(chosen.join(sizes, ["band", "key"]).select("rid", "family", "members"))
    some = Window.partitionBy("family").orderBy(F.xxhash64("rid"), "rid")
    few = own.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= CENTRE_TEXTS)
    centres = materialize(few.join(sets.select("rid", "grams"), "rid").groupBy("family").applyInPandas(_centre, "family binary, centre binary"))
    # A centre meets bounded numbers of rows in as many copies as that takes.
    copies = F.ceil(F.col("members") / CENTRE_ROWS).cast("int")
    dealt = centres.join(sizes.select("family", "members"), "family").select("family", "centre", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    rows = own.join(sets.select("rid", "grams"), "rid").withColumn("copy", F.pmod(F.xxhash64("rid"), copies).cast("int"))
    return materialize(rows.join(dealt, ["family", "copy"]).select("rid", "family", "grams", "centre").mapInArrow(_near_centre(threshold), "rid binary, near binary"))


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text") -> DataFrame:
    """(id, peer, n): n links of a text to others, and an edge to one of its class; several rows an id."""
    prepare(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    named = docs.select(words_of(text).alias("words")).select("words", rid_of(F.col("words")).alias("rid")).filter("rid IS NOT NULL")
    signed = named.mapInArrow(_signatures(bands, rows), "rid binary, bands array<bigint>, grams int")
    signed = materialize(signed.dropDuplicates(["rid"]))
    buckets = signed.select("rid", "grams", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("total")).filter("m > 1")
    members = materialize(buckets.join(shared, ["band", "key"]).select("rid", "band", "key", "m", "grams"))
    wanted = members.select("rid").distinct()
    sets = named.join(wanted, "rid", "left_semi").mapInArrow(_sets, "rid binary, grams binary").dropDuplicates(["rid"])
    sets = materialize(sets.join(signed.select("rid", "bands"), "rid"))
    large = members.filter(F.col("m") > SMALL)
    near, sure = _families(large, sets, threshold), None
    if near is None:
        sets, placed = (x.withColumn("near", F.lit(None).cast("binary")) for x in (sets, large))
    else:
        # Pairs of two texts near the same centre are links: count them, and tie them to the family's first.
        families = materialize(near.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("peer")).filter("n > 1"))
        sure = near.join(families, "near").select(F.col("rid").alias("id"), "peer", (F.col("n") - 1).alias("n"))
        sets, placed = materialize(sets.join(near, "rid", "left")), materialize(large.join(near, "rid", "left"))

    one, two = (members.filter(F.col("m") <= SMALL).select("band", "key", F.col("rid").alias(x)) for x in "ab")
    pairs = one.join(two, ["band", "key"]).filter("a < b").groupBy("a", "b").agg(F.min("band").alias("band"))
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rid").alias(side), F.col("bands").alias(f"bands_{side}"), F.col("grams").alias(f"grams_{side}"), F.col("near").alias(f"near_{side}")), side)
    found = materialize(pairs.mapInArrow(_verify_pairs(threshold), "a binary, b binary"))
    small = found.select(F.col("a").alias("id"), F.col("b").alias("peer"), F.lit(1).cast("long").alias("n"))
    small = small.unionByName(found.select(F.col("b").alias("id"), F.col("a").alias("peer"), F.lit(1).cast("long").alias("n")))

    # In a larger bucket the texts near its commonest centre needn't meet each other, only the rest, in blocks.
    counts = placed.groupBy("band", "key", "near").agg(F.count(F.lit(1)).alias("texts"), F.sum("grams").alias("size"))
    both = F.struct(F.col("near").isNotNull().alias("known"), F.when(F.col("near").isNotNull(), F.col("texts")).alias("t"), "near")
    blocks_of = lambda texts, size: F.greatest(F.ceil(texts / BLOCK_ROWS), F.ceil(size / BLOCK_GRAMS)).cast("int")
    main = counts.groupBy("band", "key").agg(F.max(both)["near"].alias("main"), F.sum("texts").alias("all_texts"), F.sum("size").alias("all_size"))
    main = main.join(counts.select("band", "key", F.col("near").alias("main"), "texts", "size"), ["band", "key", "main"], "left").na.fill(0, ["texts", "size"])
    main = main.select("band", "key", "main", blocks_of(F.col("all_texts") - F.col("texts"), F.col("all_size") - F.col("size")).alias("rest"), blocks_of(F.col("texts"), F.col("size")).alias("close"))
    dealt = placed.join(main.filter("rest > 0"), ["band", "key"]).withColumn("apart", ~F.col("near").eqNullSafe(F.col("main")) | F.col("main").isNull())
    own = F.when(F.col("apart"), F.pmod(F.xxhash64("rid"), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("rid"), F.greatest("close", F.lit(1))))
    others = F.sequence(F.lit(0), F.when(F.col("apart"), F.col("rest") + F.col("close") - 1).otherwise(F.col("rest") - 1))
    dealt = dealt.withColumn("blk", own.cast("int")).select("rid", "band", "key", "blk", F.explode(others).alias("other"))
    dealt = dealt.join(sets, "rid").select("rid", "band", "key", "bands", "grams", "near", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    blocks = dealt.groupBy("band", "key", "i", "j").applyInPandas(_verify_blocks(threshold), "id binary, peer binary, n bigint")
    found = small.unionByName(materialize(blocks))
    return found if sure is None else found.unionByName(sure)


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text") -> DataFrame:
    """(rid, class_key, n_links) for texts with links to different ones."""
    found = links(docs, threshold, recall, text)
    roots = components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    return materialize(roots.join(counts, "id").select(F.col("id").alias("rid"), F.col("root").alias("class_key"), "n_links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text") -> DataFrame:
    """``docs`` with class_id (the smallest doc_id of its class) and n_links (links to different texts)."""
    docs = without(docs, "class_id", "n_links")
    rid, key, least = fresh(docs, "rid", "key", "least")
    table = classes(docs, threshold, recall, text).select(F.col("rid").alias(rid), F.col("class_key").alias(key), "n_links")
    rows = docs.withColumn(rid, rid_of(words_of(text)))
    keyed = rows.join(table, rid, "left").withColumn(key, F.coalesce(ref(key), ref(rid)))
    ids = rows.select("doc_id", rid).join(table.select(rid, key), rid, "left").select("doc_id", F.coalesce(ref(key), ref(rid)).alias(key))
    # Written first, so that the join below may split a large class's rows.
    smallest = materialize(ids.filter(ref(key).isNotNull()).groupBy(key).agg(F.min("doc_id").alias(least)))
    out = keyed.join(smallest, key, "left")
    return out.select(*map(ref, docs.columns), F.coalesce(ref(least), F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text") -> DataFrame:
    """One row of each class, that with the smallest doc_id; texts without words all stay.

    Which text stays is decided on ids alone; the rows themselves are shuffled once, by text.
    """
    rid, key = fresh(docs, "rid", "key")
    table = classes(docs, threshold, recall, text).select(F.col("rid").alias(rid), F.col("class_key").alias(key))
    rows = docs.withColumn(rid, rid_of(words_of(text)))
    ids = rows.select("doc_id", rid).filter(ref(rid).isNotNull())
    best = ids.groupBy(rid).agg(F.min("doc_id").alias("doc_id")).join(table, rid, "left")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), ref(rid).alias("r"))
    winners = materialize(best.groupBy(F.coalesce(ref(key), ref(rid)).alias(key)).agg(F.min(order).alias("w")).select(F.col("w.r").alias(rid), F.col("w.d").alias(key)))
    stay = rows.join(winners, rid).filter(F.col("doc_id").eqNullSafe(ref(key))).dropDuplicates([rid])
    empty = rows.filter(ref(rid).isNull())
    return stay.select(*map(ref, docs.columns)).unionByName(empty.select(*map(ref, docs.columns)))


def query(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links")
