"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalmia.runtime import forget_at_exit, shared_dir, ship_package

#: Bytes of text (about) that a worker takes on at once.
PORTION_BYTES = 1 << 22


def prepare(spark: SparkSession) -> None:
    """Workers that find the package."""
    ship_package(spark)


def portions(batches: Iterable[pa.RecordBatch], column: str, size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows that hold about ``size`` bytes of a column, or one longer row.

    Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch); this bounds what a worker
    makes of it, so that no setting of the session has to change.
    """
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(held[start - 1]) if start else 0
            end = max(int(np.searchsorted(held, before + size, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    Cuts the lineage and survives the loss of any executor. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kalmia/{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that the operator is about to add: its results replace them."""
    gone = {n.lower() for n in names}
    return df.select(*[ref(c) for c in df.columns if c.lower() not in gone])


def ref(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(ref(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for any column names, dots included."""
    names, out = df.columns, schema.names

    def renamed(batches):
        for batch in work(x.rename_columns(names) for x in batches):
            yield batch.rename_columns([f"c{i}" for i in range(len(out))])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*out)
