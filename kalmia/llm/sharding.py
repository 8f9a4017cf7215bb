"""Operator 8, sharding by rendezvous hashing.

Every shard gets, for each record key, a score -weight / ln(u), u being a hash of key and shard in
(0, 1); the record goes to the shard with the highest one. Key and number of shards alone decide,
and one more shard takes rows only into itself. Shards' shares follow their weights.

A row's slot in its shard is gapless from 0. Rows are ranked within (shard, bucket), and a bucket
starts where the counts of the buckets before it end: no task sorts a whole shard. Buckets come from
a hash of the key and of the columns in ``order``, so the different rows of a hot key fall into all
of its shard's buckets. The start table has shards x buckets rows, whatever the input.

A null key counts as a key of its own. Equal keys, and so repeated rows, share a shard. An empty
table gives an empty result. Columns named shard, slot and grown_shard are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.llm._common import fresh, ref, without

SHARDS = 24
BUCKETS = 256


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The index of the shard that ``key`` goes to; a shard of weight 0 gets none."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def score(i: int, w: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(i)), 11).cast("double")
        return F.struct((F.lit(-float(w)) / F.log((bits + 0.5) / float(2**53))).alias("score"), F.lit(i).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0, order: Sequence[str] = ()) -> DataFrame:
    """``docs`` with shard, slot, and grown_shard (with one more shard of weight ``grown``).

    ``order``: columns that order rows of equal keys among themselves and spread them over buckets.
    """
    docs = without(docs, "shard", "slot", "grown_shard")
    bucket, rank, start, n = fresh(docs, "bucket", "rank", "start", "n")
    rows = docs.withColumns({
        "shard": rendezvous(ref(key), weights),
        "grown_shard": rendezvous(ref(key), [*weights, grown]),
        bucket: F.pmod(F.xxhash64(F.coalesce(ref(key).cast("string"), F.lit("\x00null")), F.lit("slot"), *map(ref, order)), F.lit(BUCKETS)).cast("int"),
    })
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(n))
    starts = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy("shard", bucket).orderBy(ref(key).asc_nulls_last(), *[ref(c) for c in order])
    ranked = rows.withColumn(rank, F.row_number().over(within) - 1)
    out = ranked.join(F.broadcast(starts), ["shard", bucket])  # at most shards x buckets rows
    return out.withColumn("slot", (F.col(rank) + F.col(start)).cast("long")).drop(rank, start, bucket)


def query(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, order=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
