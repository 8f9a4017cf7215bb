"""Operator 12, filter interaction audit: what each filter removes in each order of the filters.

Five filters fail a text: A short, B repetitive, C capitals, D symbols, E a copy of a smaller doc_id's
text (anywhere in the table, removed or not). ``audit`` is columns and SQL functions all through:

1. A text becomes a digest and four flags where it is read; only those, ids and parts are shuffled.
2. Equal rows become one row with a count; the smallest id of each (digest, part, labels) comes from
   partial aggregates, the smallest one of a digest from these, so that no group of copies, however
   large, is ever held or sorted. What follows has a few rows a part.
3. CUBE over the five flags and the part. A grouping set selects filters, its row with only passed flags
   counts what survives them: 32 survivor counts a part, and as many for all parts together.
4. Each step of each order is a pair of subsets, before and after its filter, joined with the survivors.

``shapley`` is the sum of a filter's removals over the 120 orders.

Null texts are empty (no words: fails A alone, and E with other empty ones); null parts are the empty
part; a row without a doc_id is never a copy and makes none. Repeated rows count each; of rows with one
doc_id and text none is a copy of the other. A document has a label if any of its label rows says so.
Very long texts count whole. Columns other than doc_id, text and the part's aren't read, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.llm._common import materialize, ref, text_or_empty

FILTERS = "ABCDE"
#: Words below which A fails, and percent of B and C.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_SPACE = r"[\x20\x09-\x0D]+"


def flags(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that isn't null."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "a": F.size(words) < LEAST_WORDS,
        "b": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "c": 100 * capitals > MOST_CAPITALS * F.length(text),
        "d": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, a to e, quality and toxic (booleans), n: how many documents of a part fail so and are labelled so."""
    text, keys = text_or_empty(), ["digest", "part", "a", "b", "c", "d", "quality", "toxic"]
    rows = docs.select(ref("doc_id").alias("doc_id"), F.coalesce(ref(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in flags(text).items()])
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")])
    known = rows.join(said, "doc_id", "left").fillna(False, ["quality", "toxic"])
    alike = known.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = alike.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(own).alias("least"))
    placed = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    stays = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = placed.select("part", "a", "b", "c", "d", "quality", "toxic", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), n.alias("n")) for e, n in ((False, stays), (True, F.col("n") - stays))])).alias("x"))
    return both.select("part", "a", "b", "c", "d", F.col("x.e").alias("e"), "quality", "toxic", F.col("x.n").alias("n")).filter("n > 0").groupBy("part", "a", "b", "c", "d", "e", "quality", "toxic").agg(F.sum("n").alias("n"))


def survivors(counts: DataFrame) -> DataFrame:
    """part (null: all parts), chosen (bit i: the filter i is applied), kept, good, toxic, one row for each part and each of the 32 choices."""
    names = [f.lower() for f in FILTERS]
    cubed = counts.cube("part", *names).agg(
        *[F.grouping(c).alias(f"g_{c}") for c in names], F.sum("n").alias("kept"),
        F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    passed = cubed.filter(" AND ".join(f"(g_{c} = 1 OR NOT {c})" for c in names))
    chosen = sum(((F.lit(1) - F.col(f"g_{c}")) * (1 << i) for i, c in enumerate(names)), F.lit(0)).cast("int")
    sums = ("kept", "good", "toxic")
    found = passed.filter("kept IS NOT NULL").select("part", chosen.alias("chosen"), *sums)
    # What no document survives has no row: every part gets its 32.
    zeros = found.filter("chosen = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("chosen"), *[F.lit(0).cast("long").alias(c) for c in sums])
    return found.unionByName(zeros).groupBy("part", "chosen").agg(*[F.sum(c).alias(c) for c in sums])


def steps() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, chosen before, chosen after) of all orders: 600 rows."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            after = before | 1 << FILTERS.index(name)
            out.append((order, step, name, before, after))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", whole: bool = True) -> DataFrame:
    """A row for each part, filter_order and step; with ``whole`` also for all documents together, as part null."""
    found = survivors(materialize(failures(docs, labels, part)))
    found = materialize(found if whole else found.filter(F.col("part").isNotNull()))
    plan = F.broadcast(docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int"))
    was, now = found.alias("was").join(plan, F.col("was.chosen") == F.col("before")), found.alias("now")
    pairs = was.join(now, F.col("was.part").eqNullSafe(F.col("now.part")) & (F.col("after") == F.col("now.chosen"))).select(
        "was.part", "filter_order", "step", "filter", "before", "after", "now.kept", (F.col("was.kept") - F.col("now.kept")).alias("removed"),
        (F.col("was.good") - F.col("now.good")).alias("good_lost"), (F.col("was.toxic") - F.col("now.toxic")).alias("toxic_lost"),
    )
    # A filter's 120 steps in a part: the first of an order removes all that fail it, the last those that fail nothing else.
    of = Window.partitionBy("part", "filter")
    fails, alone = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(of), F.max(F.when(F.col("after") == (1 << len(FILTERS)) - 1, F.col("removed"))).over(of)
    return pairs.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(of).alias("shapley"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels, whole=False)


#: The contract in DuckDB's SQL, document by document and order by order instead of through subsets.
SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(words) < 50,
    'B': 100 * list_unique(words) < 65 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(split.doc_id > min(split.doc_id) OVER (PARTITION BY text), false)
  } AS f
  FROM split LEFT JOIN said ON split.doc_id = said.doc_id
), lists AS (
  SELECT part, good, toxic, CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END
    || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END AS failed
  FROM failing
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), per_order AS (
  SELECT part, failed, good, toxic, filter_order,
    (SELECT coalesce(min(instr(filter_order, l)), 6) FROM letters WHERE contains(failed, l)) AS gone
  FROM lists, orders
), counted AS (
  SELECT part, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS filter,
    count(*) FILTER (gone > s.step) AS kept,
    count(*) FILTER (gone = s.step) AS removed,
    count(*) FILTER (gone < s.step AND contains(failed, substr(s.filter_order, s.step, 1))) AS redundant,
    count(*) FILTER (failed = substr(s.filter_order, s.step, 1)) AS unique_fails,
    count(*) FILTER (gone = s.step AND good = 1) AS good_lost,
    count(*) FILTER (gone = s.step AND toxic = 1) AS toxic_lost
  FROM per_order p JOIN steps s ON p.filter_order = s.filter_order
  GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
