"""A training corpus from ``documents``: toxic texts out, copies out, sources mixed, packed.

STAGES: (name, function of (spark, docs, sf_dir)) in order; each works on all that the one before
kept, and all but the last return the columns of documents. ``run`` writes each stage's rows to the
shared folder and deletes the stage's input from there once its output is written; the last output
goes when the driver ends.

Null and empty texts are documents: none is toxic, their exact copies go, they have no near copies,
weigh nothing when sources are mixed and pack as one separator. Null sources are a source. Null and
repeated doc_ids: rows are told apart by row, except that near copies with one id and text keep one.
Very long texts count whole. An empty table gives an empty result. Extra columns stay, whatever their
names, up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalmia.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from kalmia.llm._common import documents
from kalmia.runtime import forget, forget_at_exit, shared_dir


#: Columns that operators read; others are set aside by place, as their names may be an operator's results.
READ = ("doc_id", "text", "source")


def _on(docs: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``kept`` makes of ``docs``, with the columns of ``docs`` unchanged."""
    plain = [c if c in READ else f"c{i}" for i, c in enumerate(docs.columns)]
    return kept(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _on(docs, lambda rows: toxicity.score(rows, model).filter(F.col("predicted") == 0))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _on(docs, lambda rows: exact_dedup.exact_dedup(rows).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _on(docs, mixing.mix)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Trained scores, MinHash and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on ``docs``."""
    where, before = f"{shared_dir(spark)}/kalmia/pipeline-{uuid.uuid4().hex}", None
    forget_at_exit(spark, where)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{where}/{k}-{name}")
        if before:
            forget(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, documents(spark, sf_dir), sf_dir)
