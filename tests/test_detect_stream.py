import pytest
from pyspark.sql import functions as F

from kalmia.operators import interleaved, quality, submissions, windows
from kalmia.operators import ratings as folds
from kalmia.operators.detect import DETECTORS, analyze, analyze_codes, register_udtf
from kalmia.operators.detect import weighted
from kalmia.operators.detect.evidence import EVIDENCE
from kalmia.operators.detect.rules import detector
from kalmia.plans import catalogue, labelled, samples
from kalmia.sources import serving
from kalmia.sources.adapter import Tables
from kalmia.streaming import folds as streams


@pytest.mark.parametrize("pattern", [d.pattern_id for d in DETECTORS])
def test_each_pattern_has_a_sample_that_shows_it(pattern):
    error, found = analyze(samples.POSITIVE[pattern])
    assert error is None and pattern in {d["pattern_id"] for d in found}
    assert all(0 < d["confidence"] <= 1 and d["evidence"] for d in found)


@pytest.mark.parametrize("name", sorted(samples.PLAIN))
def test_nothing_is_found_in_plain_or_broken_code(name):
    error, found = analyze(samples.PLAIN[name])
    assert found == [] and (error is None) == (name in ("constant", "formula"))


def test_near_misses():
    found = lambda code: {d["pattern_id"] for d in analyze(code)[1]}
    assert "hash_map_lookup" not in found("d = {}\nfor x in y:\n    d[x] = 1")  # no membership test
    assert "union_find" not in found("def find(p, x):\n    while p[x] != x:\n        x = p[x]\n    return x")  # no class
    assert "topological_sort" not in found("def f(n):\n    indegree = [0] * n\n    return indegree")  # no queue
    assert "dp_2d_grid" not in found(samples.POSITIVE["dp_2d_string"])  # compares strings
    assert "bfs_level_order" not in found(samples.POSITIVE["bfs_shortest_path"])  # keeps distances
    assert "dp_interval" not in found("def f(a):\n    for i, j in zip(a, a):\n        pass\n    for k in range(2, 5):\n        for i in range(3):\n            a[i][k] = a[i][k - 1]")  # a tuple target


def test_long_code_counts_whole():
    code = "x = 1\n" * 160_000 + samples.POSITIVE["sorting"]
    error, found = analyze(code)
    assert len(code) > 900_000 and error is None and "sorting" in {d["pattern_id"] for d in found}


def test_order_and_errors():
    found = analyze(samples.POSITIVE["dp_knapsack"])[1]
    assert [d["confidence"] for d in found] == sorted((d["confidence"] for d in found), reverse=True)
    places = [d.pattern_id for d in DETECTORS]
    for a, b in zip(found, found[1:], strict=False):
        assert a["confidence"] > b["confidence"] or places.index(a["pattern_id"]) < places.index(b["pattern_id"])
    assert analyze(None)[0] == "Code string cannot be empty" and analyze("x = '\0'")[0] and analyze("(" * 5_000)[0]
    assert len(DETECTORS) == 36 and set(EVIDENCE) == {d.pattern_id for d in DETECTORS}
    with pytest.raises(ValueError):
        detector("sorting")(lambda tree: iter(()))


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_keep_their_results(spark, parts):
    codes = [*samples.POSITIVE.values(), *samples.PLAIN.values(), None]
    table = spark.createDataFrame([(i, c) for i, c in enumerate([*codes, *codes])], "id int, code string").repartition(parts)
    got = {r["id"]: ([d["pattern_id"] for d in r["detections"]], r["error"]) for r in analyze_codes(table).collect()}
    assert len(got) == 2 * len(codes)
    for i, c in enumerate([*codes, *codes]):
        error, found = analyze(c)
        assert got[i][0] == [d["pattern_id"] for d in found] and (got[i][1] is None) == (error is None)


def test_udtf(spark):
    register_udtf(spark)
    spark.createDataFrame([(samples.POSITIVE["sorting"],)], "code string").createOrReplaceTempView("codes")
    assert "sorting" in {r["pattern_id"] for r in spark.sql("SELECT d.* FROM codes, LATERAL analyze_code(code) d").collect()}


def batches_of(spark, rows, path, n):
    """The rows in n files, in order of time."""
    w = rows.orderBy("submitted_at", "id").collect()
    size = -(-len(w) // n)
    for i in range(n):
        spark.createDataFrame(w[i * size : (i + 1) * size], rows.schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_batch_equals_stream(spark, tmp_path):
    rows = catalogue.leveled(Tables(spark, "/root/testdata/sf0.001")).filter("user_id <= 4")
    live = batches_of(spark, rows, tmp_path / "in", 3)
    streams.drain(streams.topic_profiles(live), "update", str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3
    last = {(r["user_id"], r["topic"]): r for r in out.orderBy("batch").collect()}
    for r in folds.topic_profiles(rows, places=None).collect():
        s = last[r["user_id"], r["topic"]]
        assert abs(s["elo_rating"] - r["elo_rating"]) < 1e-9 and s["attempt_count"] == r["attempt_count"] and s["recent_failures"] == r["recent_failures"]
    live = batches_of(spark, rows, tmp_path / "in2", 2)
    streams.drain(streams.daily_streaks(live), "update", str(tmp_path / "out2"), str(tmp_path / "state2"))
    last = {r["user_id"]: r["current_streak"] for r in spark.read.parquet(str(tmp_path / "out2")).orderBy("batch").collect()}
    assert last == {r["user_id"]: r["current_streak"] for r in windows.daily_streak(rows).collect()}


def test_pattern_ratings_batch_equals_stream(spark, tmp_path):
    result = F.when(~F.col("gap_identified"), "FULL_MATCH").when(F.col("verdict") == "pass", "PARTIAL_MATCH").otherwise("NO_MATCH")
    rows = Tables(spark, "/root/testdata/sf0.001").submissions.filter("user_id <= 4").select("user_id", "id", "submitted_at", F.col("detected_pattern").alias("pattern_id"), result.alias("match_result"), F.lit(0.0).alias("gap_strength"), F.col("detected_confidence").alias("confidence"))
    live = batches_of(spark, rows, tmp_path / "in", 2)
    streams.drain(streams.pattern_ratings(live), "update", str(tmp_path / "out"), str(tmp_path / "state"))
    last = {(r["user_id"], r["pattern_id"]): (r["elo"], r["updates"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()}
    assert last == {(r["user_id"], r["pattern_id"]): (r["elo"], r["updates"]) for r in folds.pattern_replay(rows).collect()}


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    assert sorted((r["user_id"], r["n"]) for r in streams.sessions(rows).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_weighted_rules_score_their_own_samples(spark):
    rows = spark.createDataFrame(list(samples.POSITIVE.items()), "name string, code string")
    got = weighted.scores(weighted.with_features(rows).drop("code", "error")).collect()
    score = {(r["name"], r["pattern_id"]): r["score"] for r in got}
    assert len(got) == len(samples.POSITIVE) * 33 and all(0 <= s <= 1 for s in score.values())
    for name in ("heap_top_k", "union_find", "hash_map_frequency", "dp_2d_grid", "binary_search_standard", "topological_sort", "prefix_sum", "two_pointers_opposite", "bfs_shortest_path"):
        assert score[name, name] >= weighted.MATCH, (name, score[name, name])
    assert score["sorting", "heap_top_k"] == 0.0


def test_older_sanitizer_and_gap(spark):
    assert weighted.sanitize("import os.path\nfrom sys import x\neval(y)")[0] == ["Disallowed import of module 'os.path'.", "Disallowed import from module 'sys'.", "Disallowed access to name 'eval'."]
    assert weighted.sanitize("public class A {}")[0] == ["language_not_supported"] and weighted.sanitize("x = 1")[0] == [] and weighted.sanitize("f(")[0][0].startswith("SyntaxError")
    scores = F.create_map(F.lit("a"), F.lit(0.6), F.lit("b"), F.lit(0.6), F.lit("c"), F.lit(0.2))
    gap = lambda *e: tuple(spark.range(1).select(weighted.gap(F.array(*map(F.lit, e)).cast("array<string>"), scores).alias("g")).select("g.*").first())
    assert gap("b", "a") == (False, 0.6, "b", None) and gap("c", "z") == (True, 0.2, None, "c") and gap() == (True, 0.0, None, None)


def test_labelled_code():
    for pattern, expected, code in labelled.ROWS:
        error, found = analyze(code)
        got = {d["pattern_id"]: round(d["confidence"], 4) for d in found}
        assert error is None and got.get(pattern, 0.0) == expected, (pattern, expected, got, code)


def test_evidence_is_what_the_table_says():
    found = {d["pattern_id"]: d for d in analyze(samples.POSITIVE["two_pointers_opposite"])[1]}
    assert [(e["type"], e["weight"], e["location"], e["description"]) for e in found["two_pointers_opposite"]["evidence"]] == [
        ("left_pointer_increment", 0.25, "4:4", "Left pointer 'i' increments toward center"), ("right_pointer_decrement", 0.25, "4:4", "Right pointer 'j' decrements toward center"),
        ("convergence_loop", 0.4, "4:4", "While loop converging i < j"),
    ]
    lists = {d["pattern_id"]: d for d in analyze(samples.POSITIVE["fast_slow_pointers"])[1]}["fast_slow_pointers"]["evidence"]
    assert [e["type"] for e in lists] == ["pointer_names", "floyd_traversal", "cycle_check"] and lists[0]["location"] is None


def test_late_rows_wait_for_the_watermark(spark, tmp_path):
    rows = catalogue.leveled(Tables(spark, "/root/testdata/sf0.001")).filter("user_id <= 3").withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    w = rows.orderBy(F.xxhash64("id")).collect()  # any order
    last = max(r["submitted_at"] for r in w)
    closing = [rows.columns, [{**r.asDict(), "user_id": 99, "id": -1, "submitted_at": last.replace(year=2025)} for r in w[:1]]]
    parts = [w[: len(w) // 2], w[len(w) // 2 :], [tuple(closing[1][0][c] for c in closing[0])]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    streams.drain(streams.topic_profiles(live, late="60 days"), "update", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["user_id"], r["topic"]): r for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()}
    want = folds.topic_profiles(rows, places=None).collect()
    assert len(want) > 10 and set(got) == {(r["user_id"], r["topic"]) for r in want}
    for r in want:
        s = got[r["user_id"], r["topic"]]
        assert abs(s["elo_rating"] - r["elo_rating"]) < 1e-9 and s["attempt_count"] == r["attempt_count"] and s["recent_failures"] == r["recent_failures"]


def test_windows_drop_repeats_and_late_rows(spark, tmp_path):
    batches = [[(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 23:00:00")], [(3, "2024-01-05 00:00:00")], [(4, "2024-01-01 12:00:00"), (5, "2024-01-09 00:00:00")]]
    schema = "event_id long, event_type string, value double, ts timestamp"
    for i, rows in enumerate(batches):
        table = spark.createDataFrame([(e, "view", 1.0, t) for e, t in rows], "event_id long, event_type string, value double, t string")
        table.select("event_id", "event_type", "value", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    streams.drain(streams.event_windows(live, once="event_id"), "append", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 2, "2024-01-05": 1}  # the repeat counts once, row 4 came too late, the newest window is open


def test_older_days_leave_streaks(spark, tmp_path):
    for i, day in enumerate(("2024-01-01", "2024-01-02", "2023-12-01", "2024-01-03")):
        spark.createDataFrame([(7, day)], "user_id long, d string").select("user_id", F.col("d").cast("timestamp").alias("submitted_at")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    live = spark.readStream.schema("user_id long, submitted_at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    serving.serve(streams.daily_streaks(live), "update", str(tmp_path / "out"), "streaks", str(tmp_path / "state"))
    assert [tuple(r) for r in serving.published(spark, str(tmp_path / "out"), "streaks", ["user_id"]).select("user_id", "current_streak").collect()] == [(7, 3)]


def test_submissions_are_published_together(spark, tmp_path):
    t, root = Tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "serving")
    rows = t.submissions.filter("user_id <= 3")
    first, second = rows.filter("submitted_at < '2024-01-16'"), rows.filter("submitted_at >= '2024-01-16'")
    read = lambda name: serving.published(spark, root, name, submissions.KEYS[name])
    assert read("submissions") is None
    submissions.persist(first, t.problems, root, 0)
    with pytest.raises(Exception, match="nothing"):  # fails after other tables are written
        broken = second.withColumn("verdict", F.raise_error(F.lit("nothing")).cast("string"))
        submissions.persist(broken, t.problems, root, 1)
    assert read("submissions").count() == first.count()  # nothing of the failed batch shows
    advised = {r["user_id"]: (r["id"], r["acted_on"]) for r in read("recommendations").collect()}
    assert {u: i for u, (i, _) in advised.items()} == {r["user_id"]: r["id"] for r in windows.latest(first, ["user_id"], 1).collect()} and not any(a for _, a in advised.values())
    for _ in range(2):  # a batch may run again
        submissions.persist(second, t.problems, root, 3)
    assert read("submissions").count() == rows.count()
    want = {(r["id"]): r["attempt_number"] for r in windows.attempts(rows).collect()}
    assert {r["id"]: r["attempt_number"] for r in read("submissions").collect()} == want
    profiles = {(r["user_id"], r["topic"]): r["elo_rating"] for r in folds.topic_profiles(catalogue.leveled(t).filter("user_id <= 3")).collect()}
    assert {(r["user_id"], r["topic"]): r["elo_rating"] for r in read("topic_profiles").collect()} == profiles
    assert {r["user_id"]: r["current_streak"] for r in read("streaks").collect()} == {r["user_id"]: r["current_streak"] for r in windows.daily_streak(rows).collect()}
    acted = {r["id"]: r["acted_on"] for r in read("recommendations").collect()}
    assert acted == {i: True for i, _ in advised.values()} | {r["id"]: False for r in windows.latest(second, ["user_id"], 1).collect()}
    after = interleaved.states(interleaved.replay(interleaved.analysed(rows)))
    for name, want in (("gap_signals", interleaved.gap_signals(after)), ("user_pattern_elo", interleaved.pattern_elos(after))):
        assert sorted(map(tuple, read(name).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_any_cut_and_late_rows_leave_the_same_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(serving, "BUCKETS", 2)
    none = spark.createDataFrame([], "user_id long, problem_id long, topic string, difficulty string, reason string")
    monkeypatch.setattr(submissions, "_advice", lambda *_: none)  # recommendations are a batch's own; not compared here
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = t.submissions.filter("user_id <= 3")
    days = F.dayofmonth("submitted_at")
    cuts = {
        "one": [F.lit(True)], "two": [days < 12, days >= 12],
        "late": [(days < 20) & (F.col("id") % 7 != 0), (days >= 20) | (F.col("id") % 7 == 0)],  # the second brings rows from before the first's newest
    }
    seen = {}
    for cut, parts in cuts.items():
        root = str(tmp_path / cut)
        for batch, part in enumerate(parts):
            submissions.persist(rows.filter(part), t.problems, root, batch)
        if cut == "late":
            again = rows.filter(parts[-1]).unionByName(rows.filter(parts[-1]).limit(20))  # repeated ids, and the batch runs again
            submissions.persist(again, t.problems, root, len(parts) - 1)
        tables = ("submissions", "topic_profiles", "gap_signals", "user_pattern_elo", "streaks", "attempts")
        read = {n: serving.published(spark, root, n) for n in tables}
        seen[cut] = {n: sorted(map(str, (r.select(*sorted(r.columns)).collect()))) for n, r in read.items()}
    assert len(seen["one"]["submissions"]) == rows.count() and seen["one"] == seen["two"] == seen["late"]
    assert {r["user_id"]: r["current_streak"] for r in read["streaks"].collect()} == {r["user_id"]: r["current_streak"] for r in windows.daily_streak(rows).collect()}


def test_cascade_and_set_null(spark):
    rows, gone = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, problem_id long"), spark.createDataFrame([(5,), (5,)], "problem_id long")
    assert sorted(r["id"] for r in quality.cascade(rows, gone, "problem_id").collect()) == [2, 3]
    assert sorted((r["id"], r["problem_id"]) for r in quality.set_null(rows, gone, "problem_id").filter("problem_id IS NOT NULL").collect()) == [(3, 6)]
