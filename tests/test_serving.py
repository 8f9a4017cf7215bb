"""Published tables: versions, merges, crashes, deletes."""

import random

import pytest
from pyspark.sql import functions as F

from kalmia.sources import serving

SHAPE = "user_id long, topic string, elo double"
KEYS = {"t": ["user_id", "topic"], "u": ["user_id"]}


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def contents(spark, root, name="t", **how):
    found = serving.published(spark, root, name, **how)
    return None if found is None else {(r["user_id"], r["topic"]): r["elo"] for r in found.collect()}


def test_batches_merges_and_deletes_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(serving, "BUCKETS", 3)
    monkeypatch.setattr(serving, "FAN", 2)
    root, rng, want = str(tmp_path), random.Random(5), {}
    for batch in range(9):
        changed = {(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice("ab")): float(batch) for _ in range(4)}
        lost = [k for k in want if rng.random() < 0.2 and k not in changed]
        serving.publish({"t": table(spark, [(*k, v) for k, v in changed.items()])}, root, batch, {"t": table(spark, [(*k, None) for k in lost])}, KEYS)
        want = {k: v for k, v in (want | changed).items() if k not in lost}
        assert contents(spark, root) == want
        if batch == 4:
            middle = dict(want)
    assert contents(spark, root, before=5) == middle
    live = serving.manifest(spark, root)["tables"]["t"]["live"]
    assert max(len(parts) for parts in live.values()) <= 4 and any(level >= 2 for parts in live.values() for _, level in parts)
    only = table(spark, [(1, "", 0.0), (None, "", 0.0)])
    assert contents(spark, root, only=only) == {k: v for k, v in want.items() if k[0] in (1, None)}
    serving.vacuum(spark, root, keep=1)
    assert contents(spark, root) == want and serving.batches(spark, root) == [8]
    with pytest.raises(ValueError, match="older"):
        serving.publish({"t": table(spark, [])}, root, 7, keys=KEYS)


def test_tombstones_vanish_at_the_oldest_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(serving, "BUCKETS", 1)
    monkeypatch.setattr(serving, "FAN", 2)
    root = str(tmp_path)
    serving.publish({"t": table(spark, [(1, "a", 1.0), (2, "a", 1.0)])}, root, 0, keys=KEYS)
    serving.publish({}, root, 1, {"t": table(spark, [(1, "a", None)])})
    now = serving.manifest(spark, root)["tables"]["t"]
    assert [level for _, level in now["live"]["0"]] == [1]
    assert serving._files(spark, root, now, [now["live"]["0"][0][0]]).count() == 1
    serving.publish({}, root, 2, {"t": table(spark, [(2, "a", None)])})
    serving.publish({}, root, 3, {"t": table(spark, [(9, "a", None)])})
    assert serving.manifest(spark, root)["tables"]["t"]["live"] == {"0": []} and contents(spark, root) == {}


@pytest.mark.parametrize("step", range(5))
def test_a_crash_between_any_two_writes(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(serving, "BUCKETS", 1)
    monkeypatch.setattr(serving, "FAN", 2)
    root, calls = str(tmp_path), [0]
    both = lambda v: {"t": table(spark, [(1, "a", v)]), "u": table(spark, [(1, "b", v)])}
    serving.publish(both(1.0), root, 0, keys=KEYS)

    def failing(f):
        def run(*a):
            calls[0] += 1
            if calls[0] == step + 1:
                raise OSError("lost")
            return f(*a)

        return run

    with monkeypatch.context() as m:  # two writes and two merges, then the manifest
        m.setattr(serving, "_write", failing(serving._write))
        m.setattr(serving, "put", failing(serving.put))
        with pytest.raises(OSError, match="lost"):
            serving.publish(both(2.0), root, 1, keys=KEYS)
    assert contents(spark, root) == {(1, "a"): 1.0} and contents(spark, root, "u") == {(1, "b"): 1.0}
    for _ in range(2):  # and again
        serving.publish(both(2.0), root, 1, keys=KEYS)
    assert contents(spark, root) == {(1, "a"): 2.0} and contents(spark, root, "u") == {(1, "b"): 2.0}
    serving.vacuum(spark, root)
    assert contents(spark, root) == {(1, "a"): 2.0} and contents(spark, root, before=1) == {(1, "a"): 1.0}


def test_what_a_batch_reads_does_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(serving, "BUCKETS", 8)
    root, few = str(tmp_path), table(spark, [(1, "", 0.0)])
    users = spark.range(400).select(F.col("id").alias("user_id"), F.lit("a").alias("topic"), F.lit(0.0).alias("elo"))
    serving.publish({"t": users}, root, 0, keys=KEYS)
    opened, sizes = [], []
    for batch in range(1, 20):
        serving.publish({"t": table(spark, [(u, "a", float(batch)) for u in range(batch % 5, 400, 40)])}, root, batch, keys=KEYS)
        files = serving.published(spark, root, "t", only=few).inputFiles()
        assert len({f.rsplit("bucket=")[1].split("/")[0] for f in files}) == 1
        opened.append(len(files))
        sizes.append(serving.bytes_of(spark, root, "t", few))
    levels = 3  # of 4, 16 and 64 batches
    # Files a level are bounded, so a read grows with the levels (the logarithm of the batches), not with the batches: these are mostly footers here.
    assert max(opened) <= (serving.FAN - 1) * levels and max(sizes) < 2 * max(sizes[:6]) + 100 and sizes[-1] < serving.bytes_of(spark, root, "t") / 3


def test_owners_and_problems_are_deleted_everywhere(spark, tmp_path):
    root = str(tmp_path)
    subs = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 5), (4, 3, None)], "id long, user_id long, problem_id long")
    tables = {"submissions": subs, "topic_profiles": table(spark, [(1, "a", 1.0), (2, "a", 2.0)]), "attempts": subs.filter("problem_id IS NOT NULL").select("user_id", "problem_id", F.lit(1).alias("attempts"))}
    serving.publish(tables, root, 0)
    serving.delete_owners(spark, spark.createDataFrame([(1,), (77,)], "user_id long"), root, 1)
    ids = lambda name, c: sorted(r[c] for r in serving.published(spark, root, name).collect())
    assert ids("submissions", "id") == [3, 4] and ids("topic_profiles", "user_id") == [2] and ids("attempts", "user_id") == [2]
    assert serving.published(spark, root, "submissions", before=1).count() == 4
    serving.delete_problems(spark, spark.createDataFrame([(5,)], "problem_id long"), root, 2, cascade=False)
    assert ids("submissions", "id") == [3, 4] and serving.published(spark, root, "submissions").filter("problem_id = 5").count() == 0 and ids("attempts", "user_id") == []
    serving.publish({"submissions": spark.createDataFrame([(5, 4, 9)], "id long, user_id long, problem_id long")}, root, 3)
    serving.delete_problems(spark, spark.createDataFrame([(9,)], "problem_id long"), root, 4)
    assert ids("submissions", "id") == [3, 4]
