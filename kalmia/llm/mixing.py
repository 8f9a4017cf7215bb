"""Operator 4, mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the epoch over its share of the corpus, in
UTF-8 bytes. Each row draws its number of copies from the Poisson distribution of that mean by
inverting it at a uniform number made from a hash of seed, doc_id and source; it is then exploded
into that many rows. All rows are ordered by another hash: a global shuffle that is the same in
every run.

Large means are split into equal parts of at most ``PART`` that are drawn with hashes of their own
(a sum of independent Poisson numbers is one), so that exp(-mean) never underflows. A source's
cumulated probabilities are computed once and stand in the broadcast table; a draw is a binary search
in them, cheap enough for the global sort to make it again when it samples its input.

Only the per-source sums are aggregated (partial sums first), and they are joined by broadcast while
there are at most ``MAX_BROADCAST_SOURCES`` of them, else by a join that splits hot sources.

A null source is a source of its own; null texts weigh nothing; a source without a byte has no rate
and gives no rows, nor does one with target weight 0. Rows that are alike draw alike. Very long texts
are only measured and moved. An empty table gives an empty result. Columns named replica, rate and
shuffle_key are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalmia.llm._common import fresh, materialize, ref, without

PART = 16.0
MAX_BROADCAST_SOURCES = 10_000
#: Production mix: a source's weight is its size to this power.
TEMPERATURE = 0.7


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5, in (0, 1); the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: The largest number that a part's draw gives.
MOST = int(PART + 12 * PART**0.5 + 20)


def cumulated(mean: Column) -> Column:
    """The probabilities of at most 0, 1, ... ``MOST`` - 1; ``mean`` up to ``PART``."""
    one = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
    start = F.struct(one.alias("s"), F.array(one["c"]).alias("all"))

    def step(a: Column, i: Column) -> Column:
        p = a["s"]["p"] * mean / i.cast("double")
        return F.struct(F.struct(p.alias("p"), (a["s"]["c"] + p).alias("c")).alias("s"), F.concat(a["all"], F.array(a["s"]["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST - 1)), start, step, lambda a: a["all"])


def poisson_quantile(probabilities: Column, u: Column) -> Column:
    """How many of the rising ``probabilities`` are below u: the smallest k whose cumulated probability is at least u."""
    halves = [1 << k for k in reversed(range(MOST.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda n, h: F.when(F.coalesce(F.get(probabilities, n + h - 1) < u, F.lit(False)), n + h).otherwise(n))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, epochs: float) -> DataFrame:
    """source, rate. ``weights`` None: sizes to the power ``TEMPERATURE``."""
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    sizes = materialize(sizes.filter("size > 0"))
    if weights is None:
        weighted = sizes.withColumn("w", F.pow("size", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, w double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").na.fill({"w": 0.0})
    all_size, all_w = weighted.agg(F.sum("size"), F.sum("w")).first()  # two numbers
    scale = epochs * all_size / all_w if all_w else 0.0
    return weighted.select("source", F.round(F.lit(float(scale)) * F.col("w") / F.col("size"), 9).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The replicated rows of ``docs`` in their global order, with rate, replica (from 0) and shuffle_key."""
    docs = without(docs, "rate", "replica", "shuffle_key")
    key, copies, parts, chances = fresh(docs, "source_key", "copies", "parts", "chances")
    table = rates(docs, weights, epochs).withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    table = materialize(table.withColumn(chances, cumulated(F.col("rate") / ref(parts)))).withColumnRenamed("source", key)
    on = F.col("source").eqNullSafe(F.col(key))
    side = F.broadcast(table) if table.count() <= MAX_BROADCAST_SOURCES else table
    id_, source = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))
    uniforms = F.transform(F.sequence(F.lit(1), ref(parts)), lambda i: _uniform(F.lit(str(seed)), id_, source, i.cast("string")))
    draw = F.aggregate(uniforms, F.lit(0), lambda n, u: n + poisson_quantile(ref(chances), u))
    rows = docs.join(side, on, "inner").drop(key).withColumn(copies, draw).drop(parts, chances).filter(ref(copies) > 0)
    rows = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), ref(copies) - 1))).drop(copies)
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), id_, source, F.col("replica").cast("string")).cast("binary")))
    return rows.orderBy("shuffle_key", F.col("doc_id").asc_nulls_last(), "replica")


def query(docs: DataFrame) -> DataFrame:
    rows = mix(docs.select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", "rate", "replica", "shuffle_key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


#: The same rows by DuckDB.
SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source HAVING sum(strlen(coalesce(text, ''))) > 0
), weighted AS (SELECT source, size, pow(size, {TEMPERATURE}) AS w FROM sizes
), rates AS (
  SELECT source, round((SELECT sum(size) / sum(w) FROM weighted) * w / size, 9) AS rate FROM weighted
), parts AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS n FROM rates
), cdf(source, i, k, p, c) AS (
  SELECT source, n, 0, exp(-(rate / n)), exp(-(rate / n)) FROM parts
  UNION ALL
  SELECT cdf.source, i, k + 1, p * (rate / n) / (k + 1), c + p * (rate / n) / (k + 1)
  FROM cdf JOIN parts ON cdf.source IS NOT DISTINCT FROM parts.source WHERE k < {int(PART + 12 * PART**0.5 + 20)}
), draws AS (
  SELECT d.doc_id, d.source, d.text, r.rate, t.i,
    (CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || coalesce(d.source, '') || '|' || t.i), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(2**52)} AS u
  FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(1, r.n + 1)) AS t(i)
), counted AS (
  SELECT doc_id, source, text, rate, i, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND cdf.c < draws.u) AS k FROM draws
), copies AS (SELECT doc_id, source, any_value(text) AS text, any_value(rate) AS rate, CAST(sum(k) AS BIGINT) AS n FROM counted GROUP BY doc_id, source)
SELECT doc_id, source, rate, CAST(t.replica AS INTEGER) AS replica,
  md5('order17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || t.replica) AS shuffle_key,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes
FROM copies, unnest(range(0, n)) AS t(replica)
"""
