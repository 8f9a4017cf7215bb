"""LIKE between two tables by an index of short substrings.

A text's grams are its different substrings of up to ``GRAM`` code points, the empty one too. A pattern's
longest stretch without a wildcard has to be in a text that it matches, so the rarest of that stretch's grams
is looked up, and LIKE itself judges the texts found there. Each pattern has such a gram (if only the empty
one), so there is no pair of tables to be tried row by row, and nothing is lost.

Texts are indexed once each, however many rows have them. Nulls match nothing. Patterns have SQL's wildcards
and the backslash as escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: Column | int) -> Column:
    """Substrings of n code points; none in a shorter text."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, n))


def index(texts: DataFrame) -> DataFrame:
    """(gram, text) of the different values of the only column of ``texts``."""
    different = texts.toDF("text").dropna().distinct()
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    return different.select("text", F.explode(every).alias("gram"))


def like(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) of the different values of two one-column tables where ``text LIKE pattern``."""
    found = index(texts)
    counts = found.groupBy("gram").agg(F.count("*").alias("texts"))
    wanted = patterns.toDF("pattern").dropna().distinct()
    # An escaped character ends a stretch too: fewer code points to look for, never a wrong one.
    stretches = F.split(F.regexp_replace("pattern", r"\\.", "%"), "[%_]")
    longest = F.reduce(stretches, F.lit(""), lambda a, s: F.when(F.char_length(s) > F.char_length(a), s).otherwise(a))
    held = wanted.withColumn("longest", longest).withColumn("size", F.least(F.char_length("longest"), F.lit(GRAM)))
    grams = F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("longest"), F.greatest("size", F.lit(1))))
    each = held.select("pattern", F.explode(F.array_distinct(grams)).alias("gram"))
    # A gram that no text has rules its pattern out.
    rare = each.join(counts, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    return rare.join(found, "gram").filter(F.expr("text LIKE pattern")).select("text", "pattern")
