"""Mergeable summaries of runs against windows over whole histories."""

import random

import pytest
from pyspark.sql import functions as F

from kalmia.operators import runs, windows


def table(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(40), rng.choice(["a", "a", "a", "b", None]) if seed % 2 else rng.choice(["a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, id long, t long, v string").withColumn("submitted_at", F.timestamp_seconds("t"))


def plain(rows):
    """(longest run, changes, rows, how many of the newest are "a") by user."""
    out = {}
    for user in {r["user_id"] for r in rows}:
        v = [r["v"] for r in sorted((r for r in rows if r["user_id"] == user), key=lambda r: (r["t"], r["id"]))]
        best = run = 1
        for a, b in zip(v, v[1:], strict=False):
            run = run + 1 if a == b else 1
            best = max(best, run)
        end = next((i for i, x in enumerate(reversed(v)) if x != "a"), len(v))
        out[user] = best, sum(a != b for a, b in zip(v, v[1:], strict=False)), len(v), end
    return out


def results(whole, holds):
    held = {r["user_id"]: r["run"] for r in runs.leading_run(holds).collect()}
    changes = {r["user_id"]: (r["switches"], r["steps"]) for r in runs.switches(whole).collect()}
    return {r["user_id"]: (r["longest_run"], *changes[r["user_id"]], held[r["user_id"]]) for r in runs.longest_runs(whole).collect()}


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 6), (3, 15)])
def test_by_plain_loop(spark, seed, ranges):
    rows = table(spark, seed)
    of = lambda v: runs.merged(runs.summaries(rows, v, ranges=ranges))
    assert results(of(F.col("v")), of(F.coalesce(F.col("v") == "a", F.lit(False)))) == plain(rows.collect())


def test_new_rows_are_one_more_summary(spark):
    rows = table(spark, 5)
    parts = [rows.filter("t < 15"), rows.filter("t >= 15 AND t < 16"), rows.filter("t >= 16")]

    def of(v):
        held = None
        for p in parts:
            held = runs.merged(runs.summaries(p, v, ranges=4), held)
        return held

    assert results(of(F.col("v")), of(F.coalesce(F.col("v") == "a", F.lit(False)))) == plain(rows.collect())
    assert runs.merged(runs.summaries(rows.limit(0), F.col("v"))).count() == 0


def test_same_as_windows_and_a_hot_user_is_cut(spark):
    rows = table(spark, 4).filter("user_id IS NOT NULL")
    found = runs.summaries(rows, F.col("v"), ranges=12)
    whole = runs.merged(found)
    assert {tuple(r) for r in runs.longest_runs(whole).collect()} == {tuple(r) for r in windows.longest_runs(rows, "v").collect()}
    assert {tuple(r) for r in runs.switches(whole).collect()} == {tuple(r) for r in windows.switches(rows, "v").collect()}
    sizes = sorted(r["n"] for r in found.groupBy("slice").agg(F.sum("n").alias("n")).collect())
    hot = found.filter("user_id = 1")
    assert hot.count() > 4 and hot.agg(F.sum("n")).first()[0] > rows.count() / 2 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
