"""Running the detectors over rows of code: one parse for all of them, each code once."""

from __future__ import annotations

import ast
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalmia.functions import text as T
from kalmia.operators.detect.evidence import EVIDENCE
from kalmia.operators.detect.rules import DETECTORS
from kalmia.runtime import ship_package

RESULT = "error string, detections array<struct<pattern_id:string,confidence:double,evidence:array<struct<type:string,description:string,location:string,weight:double>>>>"


def refused(code: str) -> str | None:
    """The same refusals as the column expression ``functions.text.unsafe``."""
    text = code.strip()
    if not text:
        return "Code string cannot be empty"
    for b in T.BANNED:
        if b in text:
            return f"Unsafe construct detected: {b}"
    for d in T.DANGEROUS:
        if f"import {d}" in text or f"from {d}" in text:
            return f"Dangerous import detected: {d}"
    return None


def _evidence(pattern_id: str, key: str, node: ast.AST | None, *words) -> dict:
    weight, words_of = EVIDENCE[pattern_id][key]
    place = f"{node.lineno}:{node.col_offset}" if hasattr(node, "lineno") else None
    return {"type": key.split("/")[0], "description": words_of.format(*words), "location": place, "weight": weight}


def analyze(code: str | None) -> tuple[str | None, list[dict]]:
    """(error, detections): the most confident first, ties in the detectors' order. An error in one detector
    means that it doesn't detect."""
    text = (code or "").strip()
    if error := refused(text):
        return error, []
    # Plain comment lines at the end change nothing in a text that is whole without them: no place, no node.
    whole = text
    while "\n" in whole and (cut := whole.rpartition("\n"))[2].lstrip(" ").startswith("#") and cut[2].isprintable():
        whole = cut[0].rstrip()
    if whole and whole != text:
        error, found = _parsed(whole)
        if error is None:
            return None, found
    return _parsed(text)


@functools.lru_cache(maxsize=2048)
def _parsed(text: str) -> tuple[str | None, list[dict]]:
    """As ``analyze``, of a text that isn't refused; a worker remembers its newest texts. The result is shared: callers leave it as it is."""
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        return f"Invalid Python syntax: {e.msg}", []
    except (ValueError, RecursionError, MemoryError) as e:
        return f"Failed to parse Python code: {type(e).__name__}", []
    found = []
    for d in DETECTORS:
        try:
            items = list(d.find(tree))
        except Exception:  # noqa: BLE001
            continue
        if not items or not d.gate({key.split("/")[0] for key, *_ in items}):
            continue
        evidence = [_evidence(d.pattern_id, *item) for item in items]
        found.append({"pattern_id": d.pattern_id, "confidence": min(sum(e["weight"] for e in evidence), 1.0), "evidence": evidence})
    return None, sorted(found, key=lambda x: -x["confidence"])


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        results = [analyze(c) for c in batch["code"]]
        yield pd.DataFrame({"code": batch["code"], "error": [e for e, _ in results], "detections": [d for _, d in results]})


def analyze_codes(rows: DataFrame, code: str = "code") -> DataFrame:
    """``rows`` with error and detections. Unsafe code is refused in the JVM; each different text is parsed once."""
    ship_package(rows.sparkSession)
    checked = rows.withColumn("_refused", T.unsafe(F.col(code)))
    distinct = checked.filter("_refused IS NULL").select(F.col(code).alias("code")).distinct()
    parsed = distinct.mapInPandas(_batches, f"code string, {RESULT}").withColumnRenamed("code", code)
    empty = F.array().cast("array<struct<pattern_id:string,confidence:double,evidence:array<struct<type:string,description:string,location:string,weight:double>>>>")
    joined = checked.join(parsed, code, "left")
    return joined.select(*rows.columns, F.coalesce("_refused", "error").alias("error"), F.coalesce("detections", empty).alias("detections"))


def detections(rows: DataFrame, code: str = "code") -> DataFrame:
    """One row for each detection."""
    flat = analyze_codes(rows, code).select(*[c for c in rows.columns if c != code], F.posexplode("detections").alias("place", "d"))
    return flat.select("*", "d.pattern_id", F.round("d.confidence", 4).alias("confidence"), F.size("d.evidence").alias("items")).drop("d")


def register_udtf(spark: SparkSession, name: str = "analyze_code") -> None:
    """``SELECT * FROM codes, LATERAL analyze_code(code)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pattern_id string, confidence double")
    class AnalyzeCode:
        def eval(self, code: str):
            for d in analyze(code)[1]:
                yield d["pattern_id"], d["confidence"]

    ship_package(spark)
    spark.udtf.register(name, AnalyzeCode)
