"""Operator 7, exact deduplication with heavy hitters split off.

Texts are equal when identical after each run of ASCII white space became one space; the SHA-256 of
the normalised text stands for it. Of equal texts the row with the smallest doc_id stays.

Each text is normalised and hashed once; a table with the digest and a number for each row is written,
and all that follows reads of it what it needs (the query keeps no texts at all).

1. A Misra-Gries type summary (Spark's approx_top_k, the DataSketches frequent-items sketch: a fixed
   number of counters, merged over tasks) names candidates for frequent digests.
2. One exact aggregation over the candidates' rows verifies them: group size and the row that stays.
   At most ``FREQUENT`` such winners are broadcast, and each of their rows is decided where it is read,
   without a shuffle.
3. The other digests are aggregated, partial results first, and joined back by digest. No window holds
   a group, so a digest that the summary missed costs a skewed join at worst, which Spark splits.

Null texts count as empty, and empty texts equal each other. A null doc_id is larger than any other.
Of repeated rows with the smallest doc_id exactly one stays. Very long texts count whole. Columns that
the result names are replaced; all other columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalmia.llm._common import fresh, materialize, ref, text_or_empty, without

#: Digests that the summary reports, and counters that it keeps.
FREQUENT, TRACKED = 512, 4_096
#: A digest with fewer rows than this in the summary isn't worth a place in the broadcast.
LEAST = 64


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _place(row: str) -> Column:
    """What orders the rows of a group: the smallest stays."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), ref(row).alias("row"))


def heavy(rows: DataFrame, row: str) -> DataFrame:
    """Verified frequent digests of rows (text_sha256, doc_id, ``row``: a number): text_sha256, first (the place that stays), group_size; at most ``FREQUENT`` rows."""
    summary = rows.agg(F.expr(f"approx_top_k(text_sha256, {FREQUENT}, {TRACKED})").alias("top"))
    found = summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"), F.col("t.count").alias("about"))
    candidates = materialize(found.filter(F.col("text_sha256").isNotNull() & (F.col("about") >= LEAST)).select("text_sha256"))
    own = rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
    return materialize(own.groupBy("text_sha256").agg(F.min(_place(row)).alias("first"), F.count(F.lit(1)).alias("group_size")))


def exact_dedup(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text column, if asked) with keep_id, group_size, kept and text_sha256, one row for each row."""
    docs = without(docs, "keep_id", "group_size", "kept", "text_sha256")
    row, first, size = fresh(docs, "row", "first", "size")
    names = [c for c in docs.columns if keep_text or c != text]
    rows = materialize(docs.select(*map(ref, names), digest(text).alias("text_sha256"), F.monotonically_increasing_id().alias(row)))
    winners = heavy(rows.select("text_sha256", "doc_id", ref(row)), row)
    of = lambda table: table.select("text_sha256", F.col("first").alias(first), F.col("group_size").alias(size))
    decided = rows.join(F.broadcast(of(winners)), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # Written first, so that the join may split the rows of a large group.
    groups = materialize(rest.groupBy("text_sha256").agg(F.min(_place(row)).alias("first"), F.count(F.lit(1)).alias("group_size")))
    out = decided.unionByName(rest.join(of(groups), "text_sha256"))
    shown = {"keep_id": F.col(f"{first}.id"), "group_size": ref(size), "kept": F.col(f"{first}.row") == ref(row)}
    return out.select(*map(ref, names), *[c.alias(n) for n, c in shown.items()], "text_sha256")


def query(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text"), keep_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
