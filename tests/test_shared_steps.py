"""Steps that several branches of a query read are worked out once."""

from kalmia.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_gated_recommendation_reads_events_once(spark):
    got = catalogue.QUERIES["gated_recommendation"](spark, SF)
    assert not [f for f in got.inputFiles() if "events.parquet" in f]
    rows = got.collect()
    assert len(rows) == len({r["user_id"] for r in rows}) == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
