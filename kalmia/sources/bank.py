"""The problem bank: CSV in, checks and profiles out; versioned writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalmia.functions.taxonomy import EXTRA
from kalmia.operators import ordering
from kalmia.sources import relational

# The CSV's columns and ours.
CSV_COLUMNS = {
    "ID": "id", "Title": "title", "Difficulty": "difficulty", "Topics": "topics", "pattern": "pattern", "Example Test Cases": "test_cases", "Link": "link",
    "Acceptance Rate (%)": "acceptance_rate", "Premium Only": "premium_only", "Category": "category", "Likes": "likes", "Dislikes": "dislikes", "Similar Questions": "similar_questions",
}


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank from a CSV with a header; empty or bad numbers are null."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in CSV_COLUMNS), multiLine=True, escape='"')
    named = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in CSV_COLUMNS.items()])
    numbers = {"id": "bigint", "acceptance_rate": "double", "likes": "int", "dislikes": "int"}
    return named.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")).try_cast(t) for c, t in numbers.items()}).withColumn("premium_only", F.coalesce(F.col("premium_only") == "TRUE", F.lit(False)))


def lookup(wanted: DataFrame, bank: DataFrame) -> DataFrame:
    """wanted (k, name) to (k, title): by id, else by title, else null."""
    by_id = bank.select(F.col("id").alias("k"), F.col("title").alias("a"))
    by_name = bank.select(F.col("title").alias("name"), F.col("title").alias("b")).distinct()
    return wanted.join(by_id, "k", "left").join(by_name, "name", "left").select("k", F.coalesce("a", "b").alias("title"))


def validate(bank: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, error): a row for each id outside the taxonomy and each pattern list that can't be read."""
    parsed = bank.select("id", F.from_json("pattern", "array<string>").alias("p"))
    bad = parsed.filter("p IS NULL").select("id", F.lit("unparsable pattern").alias("error"))
    unknown = parsed.select("id", F.explode("p").alias("pattern_id")).join(F.broadcast(patterns), "pattern_id", "left_anti")
    return bad.unionByName(unknown.select("id", F.concat(F.lit("unknown pattern: "), "pattern_id").alias("error")))


def primary(pattern: str = "pattern") -> Column:
    return F.get_json_object(pattern, "$[0]")


def profile(bank: DataFrame) -> DataFrame:
    return bank.groupBy(primary().alias("primary_pattern"), "difficulty").agg(F.count("*").alias("problems"))


def zero_patterns(bank: DataFrame, patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern_id").join(bank.select(primary().alias("pattern_id")).distinct(), "pattern_id", "left_anti")


def sample_ids(bank: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("primary_pattern", "difficulty").orderBy("id")
    first = bank.withColumn("primary_pattern", primary()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return first.groupBy("primary_pattern", "difficulty").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """The next version of a keyed table: new rows win, except in columns ``keep`` of rows that exist."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("_old")), new.select(*keys, F.struct(*rest).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.lit(c in keep) & F.col("_old").isNotNull()), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def read_through(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``wanted`` that the cache has, with its columns; the distinct keys that are still to be fetched)."""
    return wanted.join(cache, list(keys)), wanted.select(*keys).distinct().join(cache, list(keys), "left_anti")


def with_ids(rows: DataFrame, after: int, order: Sequence[str]) -> DataFrame:
    """Ids that follow ``after`` in a natural order, without gaps; no task sees all rows."""
    return ordering.numbered(rows, order, "id", after)


def point_update(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, partitions: int, tie: str | None = None, **options: str) -> DataFrame:
    """A relational table in ranges of equal numbers of rows, one connection each."""
    return relational.read_ranges(relational.Source(spark, url, table, options), key, partitions, tie)


def missing_tables(spark: SparkSession, required: Sequence[str]) -> list[str]:
    return sorted(t for t in required if not spark.catalog.tableExists(t))


def in_taxonomy(pattern: Column) -> Column:
    return ~pattern.isin(*EXTRA)
