"""Pages, constraint checks and evaluation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalmia.sources.schemas import DIFFICULTIES, VERDICTS


def filtered(problems: DataFrame, difficulty: str | None = None, topic: str | None = None, search: str | None = None, exclude: int | None = None) -> DataFrame:
    """Problems by whichever filters are given."""
    parts = [F.col("difficulty") == difficulty] if difficulty else []
    parts += [F.col("topics").like(f"%{topic}%")] if topic else []
    parts += [F.col("title").like(f"%{search}%")] if search else []
    parts += [F.col("id") != exclude] if exclude is not None else []
    return problems.filter(reduce(lambda a, b: a & b, parts, F.lit(True)))


def page(problems: DataFrame, number: int, size: int, **filters) -> DataFrame:
    """A page in order of id; page at least 1, size within 1 to 100."""
    number, size = max(number, 1), min(max(size, 1), 100)
    return filtered(problems, **filters).orderBy("id").offset((number - 1) * size).limit(size)


def confusion(rows: DataFrame) -> DataFrame:
    """rows (detector, label, predicted, confidence if known) to counts, precision, recall and F1 per detector and overall;
    with confidences also the mean and least one of the true positives (0 without any)."""
    hit = F.col("label") & F.col("predicted")
    tp, fn, fp, tn = (F.count_if(hit), F.count_if(F.col("label") & ~F.col("predicted")), F.count_if(~F.col("label") & F.col("predicted")), F.count_if(~F.col("label") & ~F.col("predicted")))
    sure = F.when(hit, F.col("confidence")) if "confidence" in rows.columns else None
    extra = [] if sure is None else [F.coalesce(F.round(F.avg(sure), 6), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.round(F.min(sure), 6), F.lit(0.0)).alias("least_confidence")]
    counted = rows.rollup("detector").agg(F.grouping("detector").alias("all"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"), *extra)
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))
    named = F.when(F.col("all") == 1, "overall").otherwise(F.col("detector"))
    right, found, wanted = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    rest = [c for c in ("mean_confidence", "least_confidence") if extra]
    return counted.select(named.alias("detector"), "tp", "fn", "fp", "tn", ratio(right, found).alias("precision"), ratio(right, wanted).alias("recall"), ratio(2 * right, found + wanted).alias("f1"), *rest)


def overlap(rows: DataFrame) -> DataFrame:
    """rows (case, detector) to how often two detectors share a case, and as a share of the first's cases; a row for each pair, shared or not."""
    one = rows.distinct()
    n = one.groupBy("detector").agg(F.count("*").alias("n")).withColumnRenamed("detector", "d1")
    everyone = n.agg(F.collect_set("d1").alias("all"))  # detectors: as many as there are patterns
    grid = n.join(F.broadcast(everyone), F.lit(True)).select("d1", "n", F.explode("all").alias("d2")).filter("d1 <> d2")
    shared = one.select("case", F.col("detector").alias("d1")).join(one.select("case", F.col("detector").alias("d2")), "case").filter("d1 <> d2").groupBy("d1", "d2").agg(F.count("*").alias("both"))
    both = F.coalesce("both", F.lit(0).cast("bigint"))
    return grid.join(shared, ["d1", "d2"], "left").select("d1", "d2", both.alias("both"), F.round(both / F.col("n"), 6).alias("share"))


def serving_violations(profiles: DataFrame, found: DataFrame, attempts: DataFrame, users: DataFrame) -> DataFrame:
    """check_, violations for profiles, gap signals, attempt numbers and rows of users that are gone."""
    checks = {
        "elo_floor": profiles.filter("elo_rating < 400"), "accuracy_range": profiles.filter(~F.col("accuracy").between(0, 1)), "duplicate_profile": profiles.groupBy("user_id", "topic").count().filter("count > 1"),
        "gap_range": found.filter(~F.col("gap_strength").between(0, 1)), "gap_frequency": found.filter("frequency < 0"), "duplicate_gap": found.groupBy("user_id", "pattern_id").count().filter("count > 1"),
        "attempt_number": attempts.filter("attempt_number < 1"), "cascade": profiles.join(users, "user_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("check_"), F.count("*").alias("violations")) for name, rows in checks.items()])


def cascade(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is deleted."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def set_null(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``key`` null where it is deleted."""
    gone = deleted.select(F.col(key), F.lit(True).alias("_gone")).distinct()
    return rows.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*rows.columns)


def violations(submissions: DataFrame, problems: DataFrame) -> DataFrame:
    """check_, violations: one row for each constraint."""
    checks = {
        "orphan_problem": submissions.join(problems.select(F.col("id").alias("problem_id")), "problem_id", "left_anti"),
        "bad_verdict": submissions.filter(~F.col("verdict").isin(*VERDICTS)), "bad_difficulty": problems.filter(~F.col("difficulty").isin(*DIFFICULTIES)),
        "confidence_range": submissions.filter(~F.col("detected_confidence").between(0, 1)), "duplicate_id": submissions.groupBy("id").count().filter("count > 1"),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("check_"), F.count("*").alias("violations")) for name, rows in checks.items()])
