"""The substring index against LIKE on all pairs."""

import random

from pyspark.sql import functions as F

from kalmia.operators import recommend, substrings


def test_like_by_all_pairs(spark):
    rng = random.Random(2)
    alphabet = "abé_%\\ 日"
    texts = [None, "", "abc", "aabbcc", "100%", "a_b", "a\\b", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(150))]
    made = ("".join(rng.choice("ab%_é日") for _ in range(rng.randrange(7))) for _ in range(120))
    patterns = [None, "", "%", "_", "%abc%", "a\\%b", "%\\%%", "%\\_%", "%zzz%", "a\\\\b", *made]
    t, p = spark.createDataFrame([(x,) for x in [*texts, "abc"]], "t string"), spark.createDataFrame([(x,) for x in [*patterns, "%"]], "p string")
    want = t.crossJoin(p).filter(F.expr("t LIKE p")).distinct()
    assert sorted(map(tuple, substrings.like(t, p).collect())) == sorted(map(tuple, want.collect()))


def test_topics_of_problems(spark):
    bank = spark.createDataFrame([(1, "a,heap_top_k", "x"), (2, "heapXtopZk", "heap_top_k"), (3, None, "heap_top_k"), (4, "nothing", None), (5, "nothing", "dp")], "id long, topics string, primary_pattern string")
    topics = spark.createDataFrame([("heap_top_k",), ("heap_top_k",), ("dp",), ("no",), (None,)], "topic string")
    found = recommend.topic_problems(bank, topics)
    assert sorted((r["id"], r["topic"]) for r in found.collect()) == [(1, "heap_top_k"), (2, "heap_top_k"), (3, "heap_top_k"), (4, "no"), (5, "dp"), (5, "no")]
    assert found.columns == [*bank.columns, "topic"] and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
