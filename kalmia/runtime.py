"""What operators with Python workers or intermediate tables need from a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes up to which a join's side goes to all tasks: as estimated before anything runs, and as measured once its shuffle is written.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver stands.

    Workers are processes of their own, on a local master too, and don't see the driver's ``sys.path``.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    into = tempfile.mkdtemp(prefix="kalmia-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/kalmia", "zip", str(Path(__file__).resolve().parent.parent), "kalmia"))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local one is made only where both are one process."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kalmia-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter does
        pass


def forget_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(forget, spark, path)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run in here send a side to all tasks by its measured size only, or where a hint says so; the session's settings come back.

    A side is estimated by its files' compressed bytes, a fraction of what the driver must hold to send it: 10 MB of ids
    and names are a relation of some 250 MB.
    """
    before = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    if before[MEASURED] is None:
        spark.conf.set(MEASURED, spark.conf.get(ESTIMATED))
    spark.conf.set(ESTIMATED, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read from there; it goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/kalmia/{uuid.uuid4().hex}"
    forget_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
