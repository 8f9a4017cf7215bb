"""Keyed tables that are published batch by batch, as versioned files in hash buckets.

A batch writes only the rows that it changes, dealt to the buckets of their owner (``user_id`` where a table
has one, else its keys), then one manifest: the list of all tables' live folders, bucket by bucket, renamed
into place at the end. Readers take the newest manifest, so they see all of a batch's tables or none, and what
fails before the rename leaves the version before as it was. A batch that runs again takes its own manifest's
place.

Readers that want some owners read their buckets only. When ``FAN`` folders of a level have come together in a
bucket they are merged into one of the next level (a key's newest row stays), so a bucket has a few folders a
level, and a row is written again as often as there are levels, however many batches there are. Deleted rows
are tombstones, which win over older rows and go when a merge reaches the bucket's oldest folder. ``vacuum``
deletes folders that no manifest in use names. One writer at a time.

A null owner is an owner. Columns that only later batches have are null in older rows.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalmia.runtime import measured_broadcasts, written

#: The tables of the learning service and their keys.
KEYS = {
    "submissions": ["id"], "topic_profiles": ["user_id", "topic"], "gap_signals": ["user_id", "pattern_id"], "user_pattern_elo": ["user_id", "pattern_id"],
    "streaks": ["user_id"], "recommendations": ["id"], "attempts": ["user_id", "problem_id"], "states": ["user_id"],
    "snapshots": ["user_id", "upto_at", "upto_id"],
    "quarantine": ["table_name", "row"],
}
OWNER = "user_id"
#: Buckets of a new table: enough that one is a task's work. A table keeps the number it began with.
BUCKETS = 16
#: Folders of a level that are merged.
FAN = 4
#: Tables that are written at a time.
AT_ONCE = 4


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    fs, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = _fs(spark, path)[1]
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"can't publish {path}")


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published batches."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, before: int | None = None) -> dict | None:
    """What the newest batch (before ``before``) published: tables to keys, owner, buckets, schema and live folders [path, level] by bucket."""
    known = [b for b in batches(spark, root) if before is None or b < before]
    if not known:
        return None
    lines = spark.read.option("wholetext", "true").text(f"{root}/manifests/{known[-1]}.json").collect()
    return json.loads(lines[0][0])


def _bucket(by: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def _files(spark: SparkSession, root: str, table: dict, paths: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(table["schema"])).add("_batch", T.LongType()).add("_gone", T.BooleanType())
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths])


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's newest row; of one batch's rows a tombstone. Partial aggregates: a key of every batch is one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_batch", "_gone")).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _write(spark: SparkSession, rows: DataFrame, root: str, name: str, table: dict) -> dict[str, str]:
    """Writes rows by bucket; the folders that came, by bucket."""
    folder = f"data/{name}/{uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(table["by"], table["buckets"])).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    return {n.removeprefix("bucket="): f"{folder}/{n}" for n in _names(spark, f"{root}/{folder}") if n.startswith("bucket=")}


def _compact(spark: SparkSession, root: str, name: str, table: dict) -> None:
    """Merges full levels, all buckets' in one job, until no level is full."""
    while True:
        full = {b: live[-FAN:] for b, live in table["live"].items() if len(live) >= FAN and len({level for _, level in live[-FAN:]}) == 1}
        if not full:
            return
        paths = [p for parts in full.values() for p, _ in parts]
        merged = _newest(_files(spark, root, table, paths), table["keys"])
        whole = [int(b) for b in full if len(table["live"][b]) == FAN]  # nothing older is left in these
        kept = merged.filter(~(F.col("_gone") & _bucket(table["by"], table["buckets"]).isin(whole))) if whole else merged
        made = _write(spark, kept, root, name, table)
        for b, parts in full.items():
            table["live"][b] = table["live"][b][:-FAN] + ([[made[b], parts[0][1] + 1]] if b in made else [])


def publish(tables: dict[str, DataFrame], root: str, batch: int, gone: dict[str, DataFrame] | None = None, keys: dict[str, Sequence[str]] | None = None) -> None:
    """One batch: changed rows of ``tables`` and tombstones of the rows in ``gone`` (their keys and owner), then the manifest.

    ``batch`` isn't older than the newest. ``keys``: those of tables that ``KEYS`` doesn't have.
    """
    gone = gone or {}
    some = next(iter([*tables.values(), *gone.values()]), None)
    if some is None:
        return
    spark = some.sparkSession
    if any(b > batch for b in batches(spark, root)):
        raise ValueError(f"batch {batch} is older than what is published")
    now = manifest(spark, root, before=batch) or {"tables": {}}
    now["batch"] = batch

    def changed(name: str) -> dict:
        """The table's entry once its rows are written and its full levels merged."""
        rows, lost, table = tables.get(name), gone.get(name), now["tables"].get(name)
        own = (rows if rows is not None else lost).columns
        if table is None:
            key = list((keys or {}).get(name) or KEYS[name])
            table = {"keys": key, "by": [OWNER] if OWNER in own else key, "buckets": BUCKETS, "schema": T.StructType([]).json(), "live": {}}
        known = T.StructType.fromJson(json.loads(table["schema"]))
        parts = []
        if rows is not None:
            if other := [f.name for f in rows.schema.fields if f.name in known.names and known[f.name].dataType != f.dataType]:
                raise ValueError(f"{name} has other types in {', '.join(other)}")
            table["schema"] = T.StructType([*known.fields, *(T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in known.names)]).json()
            parts.append(rows.select("*", F.lit(batch).cast("long").alias("_batch"), F.lit(False).alias("_gone")))
        if lost is not None:
            parts.append(lost.select(*dict.fromkeys([*table["keys"], *table["by"]]), F.lit(batch).cast("long").alias("_batch"), F.lit(True).alias("_gone")))
        whole = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        for b, path in _write(spark, whole, root, name, table).items():
            table["live"].setdefault(b, []).append([path, 0])
        _compact(spark, root, name, table)
        return table

    names = list(dict.fromkeys([*tables, *gone]))
    with measured_broadcasts(spark), ThreadPoolExecutor(AT_ONCE) as pool:  # small tables don't wait for large ones
        now["tables"] |= dict(zip(names, pool.map(changed, names), strict=True))
    put(spark, f"{root}/manifests/{batch}.json", json.dumps(now))


def published(spark: SparkSession, root: str, name: str, keys: Sequence[str] | None = None, before: int | None = None, only: DataFrame | None = None, fixed: Column | None = None) -> DataFrame | None:
    """A table as the published batches (those before ``before``) leave it; None before its first rows.

    ``only``: rows of these owners (a table with the owner's columns); other buckets aren't opened.
    ``fixed``: a condition on columns that a key never changes; it's put to the files, before versions are compared.
    """
    now = manifest(spark, root, before)
    table = None if now is None else now["tables"].get(name)
    if table is None:
        return None
    live = table["live"]
    if only is not None:
        wanted = {str(r[0]) for r in only.select(_bucket(table["by"], table["buckets"])).distinct().collect()}
        live = {b: v for b, v in live.items() if b in wanted}
    paths = [p for parts in live.values() for p, _ in parts]
    schema = T.StructType.fromJson(json.loads(table["schema"]))
    if not paths:
        return spark.createDataFrame([], schema)
    rows = _files(spark, root, table, paths)
    if fixed is not None:
        rows = rows.filter(fixed | F.col("_gone"))
    if only is not None:
        owners = only.select(*table["by"]).distinct()
        same = [rows[c].eqNullSafe(owners[c]) for c in table["by"]]
        rows = rows.join(owners, same, "left_semi")
    return _newest(rows, table["keys"]).filter("NOT _gone").select(*schema.names)


def bytes_of(spark: SparkSession, root: str, name: str, only: DataFrame | None = None) -> int:
    """Bytes of the live files that a read (of ``only``) opens."""
    now = manifest(spark, root)
    table = now["tables"][name]
    wanted = None if only is None else {str(r[0]) for r in only.select(_bucket(table["by"], table["buckets"])).distinct().collect()}
    total = 0
    for b, parts in table["live"].items():
        if wanted is None or b in wanted:
            for p, _ in parts:
                fs, where = _fs(spark, f"{root}/{p}")
                total += fs.getContentSummary(where).getLength()
    return total


def delete_owners(spark: SparkSession, owners: DataFrame, root: str, batch: int) -> None:
    """Deletes owners (a table with ``OWNER``) from all tables that have them, in one batch."""
    now = manifest(spark, root, before=batch)
    gone = {}
    with measured_broadcasts(spark):
        lost = written(owners.select(OWNER).distinct())  # every table looks them up
        for name, table in (now or {"tables": {}})["tables"].items():
            if table["by"] == [OWNER]:
                gone[name] = published(spark, root, name, before=batch, only=lost).select(*dict.fromkeys([*table["keys"], OWNER]))
        publish({}, root, batch, gone)


def delete_problems(spark: SparkSession, problems: DataFrame, root: str, batch: int, cascade: bool = True) -> None:
    """Deletes problems' rows (problem_id) from all tables that name them; without ``cascade`` the rows stay, with no problem."""
    now, gone, kept = manifest(spark, root, before=batch), {}, {}
    lost = problems.select("problem_id").distinct()
    for name, table in (now or {"tables": {}})["tables"].items():
        columns = T.StructType.fromJson(json.loads(table["schema"])).names
        if "problem_id" in columns:
            rows = published(spark, root, name, before=batch).join(lost, "problem_id", "left_semi")
            if cascade or "problem_id" in table["keys"]:
                gone[name] = rows.select(*dict.fromkeys([*table["keys"], *table["by"]]))
            else:
                kept[name] = rows.withColumn("problem_id", F.lit(None).cast(rows.schema["problem_id"].dataType)).select(*columns)
    publish(kept, root, batch, gone)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest ``keep`` manifests, and folders that none of those names."""
    known = batches(spark, root)
    held, old = known[-keep:], known[:-keep]
    used = {p.rsplit("/", 1)[0] for b in held for t in manifest(spark, root, before=b + 1)["tables"].values() for parts in t["live"].values() for p, _ in parts}
    for b in old:
        _delete(spark, f"{root}/manifests/{b}.json")
    for name in _names(spark, f"{root}/data"):
        for folder in _names(spark, f"{root}/data/{name}"):
            if f"data/{name}/{folder}" not in used:
                _delete(spark, f"{root}/data/{name}/{folder}")


def serve(out: DataFrame, mode: str, root: str, name: str, checkpoint: str) -> None:
    """Upserts a stream's rows into a published table, a batch for each micro-batch, over all that is there."""
    query = (
        out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda rows, batch: publish({name: rows}, root, batch)).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
