"""What passes the driver on its way to all tasks is bounded by measured bytes."""

import pytest
from pyspark.sql import functions as F

from kalmia.operators import submissions
from kalmia.plans.catalogue import Tables
from kalmia.runtime import ESTIMATED, MEASURED
from kalmia.sources import serving


def plans_of(spark, action):
    """The plans, as run, of all that an action ran."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    shown = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    bus.waitUntilEmpty(30_000)
    before = set(shown())
    action()
    bus.waitUntilEmpty(30_000)
    return [p for i, p in shown().items() if i not in before]


@pytest.fixture
def limits(spark):
    def put(estimated, measured=None):
        spark.conf.set(ESTIMATED, estimated)
        spark.conf.set(MEASURED, measured) if measured else spark.conf.unset(MEASURED)

    yield put
    spark.conf.unset(ESTIMATED)
    spark.conf.unset(MEASURED)


def test_owners_in_small_files_are_not_sent_to_all_tasks(spark, tmp_path, limits):
    n, root, where = 200_000, str(tmp_path / "root"), str(tmp_path / "owners")
    spark.range(n).select(F.col("id").alias("user_id")).write.parquet(where)
    owners = spark.read.parquet(where)
    users = spark.range(n + 5).select(F.col("id").alias("user_id"), F.lit("a").alias("topic"))
    serving.publish({"t": users}, root, 0, keys={"t": ["user_id", "topic"]})
    limits("2m")  # the files have 1 MB, the shuffled rows 3.2
    ran = plans_of(spark, lambda: serving.delete_owners(spark, owners, root, 1))
    assert ran and not [p for p in ran if "BroadcastHashJoin" in p]
    assert sorted(r.user_id for r in serving.published(spark, root, "t").collect()) == [*range(n, n + 5)]
    assert spark.conf.get(ESTIMATED) == "2m" and spark.conf.get(MEASURED, None) is None


def test_a_batch_sends_nothing_by_its_files_sizes(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(serving, "BUCKETS", 2)
    none = spark.createDataFrame([], "user_id long, problem_id long, topic string, difficulty string, reason string")
    monkeypatch.setattr(submissions, "_advice", lambda *_: none)  # has hints, for relations of the taxonomy's size
    t, root = Tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "root")
    rows = t.submissions.filter("user_id <= 2")
    limits("10m", "1")  # measured, nothing is small enough
    for batch, part in enumerate((rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"))):
        ran = plans_of(spark, lambda batch=batch, part=part: submissions.persist(part, t.problems, root, batch))
        assert ran and not [p for p in ran if "BroadcastHashJoin" in p]
    assert serving.published(spark, root, "submissions").count() == rows.count()
    assert (spark.conf.get(ESTIMATED), spark.conf.get(MEASURED)) == ("10m", "1")
