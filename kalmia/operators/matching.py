"""Matching detections with the accepted solution groups of a problem: row-local, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRA_PENALTY = 0.1


def best_confidences(detections: Column) -> Column:
    """map<pattern, confidence> of an array<struct<pattern_id, confidence>>: the highest of each; empty ids
    and confidences up to 0 don't count."""
    ok = F.filter(detections, lambda d: (F.coalesce(d["pattern_id"], F.lit("")) != "") & (d["confidence"] > 0))
    ids = F.array_distinct(F.transform(ok, lambda d: d["pattern_id"]))
    best = F.transform(ids, lambda p: F.array_max(F.transform(F.filter(ok, lambda d: d["pattern_id"] == p), lambda d: d["confidence"])))
    return F.map_from_arrays(ids, best)


def clean_groups(groups: Column) -> Column:
    """Groups of distinct trimmed ids without blanks; empty groups go, so places count the others."""
    cleaned = F.transform(groups, lambda g: F.array_distinct(F.filter(F.transform(g, lambda p: F.trim(p)), lambda p: p != "")))
    return F.filter(F.coalesce(cleaned, F.array().cast("array<array<string>>")), lambda g: F.size(g) > 0)


def match(rows: DataFrame, detections: str = "detections", groups: str = "accepted_solution_groups", places: int = 4) -> DataFrame:
    """``rows`` with match_result, matched_groups, unmatched_patterns, confidence_score and reasoning_signals."""
    base = rows.withColumns({"_known": best_confidences(F.coalesce(F.transform(detections, lambda d: F.struct(d["pattern_id"].alias("pattern_id"), d["confidence"].cast("double").alias("confidence"))), F.array().cast("array<struct<pattern_id:string,confidence:double>>"))), "_groups": clean_groups(F.col(groups))})
    ids = F.map_keys("_known")
    # A group's ids are few; sums run in id order, so they don't depend on the order of detections.
    total = lambda ps: F.aggregate(F.array_sort(ps), F.lit(0.0), lambda a, p: a + F.coalesce(F.element_at(F.col("_known"), p), F.lit(0.0)))
    per = F.transform("_groups", lambda g: F.struct(
        F.size(F.array_intersect(g, ids)).alias("overlap"), F.size(g).alias("size"), (total(F.array_intersect(g, ids)) / F.size(g)).alias("conf"),
    ))
    base = base.withColumns({"_per": per, "_ids": ids, "_wanted": F.array_sort(F.array_distinct(F.flatten("_groups")))})
    full = F.exists("_per", lambda m: m["overlap"] == m["size"])
    some = F.exists("_per", lambda m: m["overlap"] > 0)
    best = F.coalesce(F.array_max(F.transform("_per", lambda m: m["conf"])), F.lit(0.0))
    extra = F.array_except("_ids", "_wanted")
    lowered = F.when((F.size(extra) > 0) & (best > 0) & ~full, F.greatest(F.lit(0.0), best - total(extra) * EXTRA_PENALTY)).otherwise(best)
    result = F.when((F.size("_per") == 0) | (F.size("_ids") == 0), "NO_MATCH").when(full, "FULL_MATCH").when(some, "PARTIAL_MATCH").otherwise("NO_MATCH")
    base = base.withColumns({"match_result": result, "_conf": F.when((F.size("_ids") == 0) | (F.size("_wanted") == 0), 0.0).otherwise(F.least(lowered, F.lit(1.0)))})
    said = F.transform("_per", lambda m, i: (
        F.when(m["overlap"] == m["size"], F.format_string("group_%d_full_match", i))
        .when(m["overlap"] > 0, F.format_string("group_%d_partial(%d/%d)", i, m["overlap"], m["size"]))
        .otherwise(F.format_string("group_%d_no_match", i))
    ))
    covered = F.aggregate("_per", F.lit(0), lambda a, m: a + m["overlap"]) / F.nullif(F.size("_wanted"), F.lit(0))
    head = F.array(
        F.concat(F.lit("match_result="), F.col("match_result")), F.format_string("confidence=%.4f", "_conf"),
        F.format_string("ast_patterns_detected=%d", F.size("_ids")), F.format_string("llm_patterns_expected=%d", F.size("_wanted")),
    )
    tail = F.when(F.size("_wanted") > 0, F.array(F.format_string("llm_coverage=%.4f", covered))).otherwise(F.array().cast("array<string>"))
    done = base.withColumns({
        "matched_groups": F.filter(F.transform("_per", lambda m, i: F.when(m["overlap"] == m["size"], i)), lambda i: i.isNotNull()),
        "unmatched_patterns": F.array_except("_wanted", "_ids"),
        "confidence_score": F.round("_conf", places),
        "reasoning_signals": F.concat(head, said, tail),
    })
    return done.drop("_known", "_groups", "_per", "_ids", "_wanted", "_conf")
