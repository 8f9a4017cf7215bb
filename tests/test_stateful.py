"""State of several parts: streams in any cut and order against batches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kalmia.operators import interleaved, ratings, windows
from kalmia.plans import catalogue
from kalmia.sources.adapter import Tables
from kalmia.streaming import stateful

SF = "/root/testdata/sf0.001"


def live(spark, batches, schema, path):
    """A stream of the batches, a micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def shuffled(rows, n, lateness, seed=1):
    """The rows in n batches, out of order by less than ``lateness`` (a timedelta)."""
    rng = random.Random(seed)
    moved = sorted(rows, key=lambda r: r["submitted_at"] + lateness * rng.random() * 0.9)
    size = -(-len(moved) // n)
    return [moved[i : i + size] for i in range(0, len(moved), size)]


def closing(rows):
    """Rows of nobody, much later, so that the watermark passes all others."""
    last = max(r["submitted_at"] for r in rows)
    return [[{**rows[0].asDict(), "user_id": 999, "id": -1 - i, "submitted_at": last.replace(year=last.year + 1 + i)}] for i in range(2)]


def final(spark, path, keys):
    out = {}
    for r in spark.read.parquet(str(path)).orderBy("batch").collect():
        out[tuple(r[k] for k in keys)] = r
    return {k: r for k, r in out.items() if k[0] != 999}


@pytest.fixture(scope="module")
def rows(spark):
    found = catalogue.leveled(Tables(spark, SF)).filter("user_id <= 3").withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    return found, sorted(found.collect(), key=lambda r: (r["submitted_at"], r["id"]))


def test_profiles_out_of_order(spark, rows, tmp_path):
    import datetime

    table, held = rows
    batches = shuffled(held, 5, datetime.timedelta(days=3)) + closing(held)
    out = stateful.topic_profiles(live(spark, batches, table.schema, tmp_path / "in"), late="3 days")
    stateful.drain(out, "update", str(tmp_path / "out"), str(tmp_path / "state"))
    got = final(spark, tmp_path / "out", ("user_id", "topic"))
    want = ratings.topic_profiles(table, places=None).collect()
    assert set(got) == {(r["user_id"], r["topic"]) for r in want} and len(want) > 10
    for r in want:
        s = got[r["user_id"], r["topic"]]
        assert abs(s["elo_rating"] - r["elo_rating"]) < 1e-9 and (s["attempt_count"], s["pass_count"], s["recent_failures"]) == (r["attempt_count"], r["pass_count"], r["recent_failures"])


@pytest.mark.parametrize("late", [None, "3 days"])
def test_ratings_and_gaps(spark, rows, tmp_path, late):
    import datetime

    table, held = rows
    batches = shuffled(held, 4, datetime.timedelta(days=3)) + closing(held) if late else [held[i : i + 40] for i in range(0, len(held), 40)]
    stateful.drain(stateful.pattern_ratings(live(spark, batches, table.schema, tmp_path / "in"), late=late), "update", str(tmp_path / "out"), str(tmp_path / "state"))
    got = final(spark, tmp_path / "out", ("user_id", "pattern_id"))
    after = interleaved.states(interleaved.replay(interleaved.analysed(table)))
    elos = {(r["user_id"], r["pattern_id"]): (r["elo"], r["updates"]) for r in interleaved.pattern_elos(after).collect()}
    signals = {(r["user_id"], r["pattern_id"]): (r["gap_strength"], r["frequency"], r["last_seen"]) for r in interleaved.gap_signals(after).collect()}
    assert {k: (r["elo"], r["updates"]) for k, r in got.items()} == elos
    assert {k: (r["gap_strength"], r["frequency"], r["last_seen"]) for k, r in got.items() if r["gap_strength"] is not None} == signals


def test_days_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(u, f"2024-01-{d:02} {rng.randrange(24):02}:00:00") for u in range(4) for d in rng.sample(range(1, 31), 22) for _ in range(rng.randrange(1, 3))] + [(9, "2024-01-02 00:00:00"), (9, "2024-01-01 00:00:00")]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("submitted_at"))
    held = table.collect()
    out = stateful.daily_streaks(live(spark, [held[i : i + 9] for i in range(0, len(held), 9)], table.schema, tmp_path / "in"))
    stateful.drain(out, "update", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {k[0]: (r["last_submission_date"], r["current_streak"]) for k, r in final(spark, tmp_path / "out", ("user_id",)).items()}
    assert got == {r["user_id"]: (r["last_submission_date"], r["current_streak"]) for r in windows.daily_streak(table).collect()}


class Map(dict):
    containsKey = dict.__contains__  # noqa: N815
    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = dict.__delitem__  # noqa: N815

    def iterator(self):
        return iter(self.items())


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_runs_of_days_stay_whole_and_small():
    for seed in range(300):
        rng, days = random.Random(seed), set()
        s = stateful._Streaks(None)
        s.last_of, s.first_of, s.newest = Map(), Map(), Value()
        for _ in range(rng.randrange(1, 40)):
            days.add(day := rng.randrange(30))
            s.add(day)
            runs = defaultdict(set)
            for d in sorted(days):
                runs[next((k for k in runs if d - 1 in runs[k]), d)].add(d)
            assert dict(s.last_of) == {(min(r),): (max(r),) for r in runs.values()} and dict(s.first_of) == {(max(r),): (min(r),) for r in runs.values()} and s.newest.get() == (max(days),)
