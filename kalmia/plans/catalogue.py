"""All queries over the driver's tables, by name, and their SQL for DuckDB.

A name's query and its SQL have the same columns; floats leave both rounded to 6 digits, lists as
joined strings. Queries without SQL say why.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalmia.functions import ratings as R
from kalmia.functions import text as T
from kalmia.functions.taxonomy import ORDER
from kalmia.operators import gaps, gate, matching, ordering, quality, recommend, runs, submissions, windows
from kalmia.operators.detect import engine as detect
from kalmia.operators.detect import weighted
from kalmia.operators import interleaved
from kalmia.operators import ratings as folds
from kalmia.sources import adapter, bank, serving
from kalmia.plans import labelled, samples
from kalmia.runtime import forget_at_exit, shared_dir, ship_package, written
from kalmia.sources.adapter import Tables
from kalmia.streaming import folds as streams
from kalmia.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The moment that ages are measured from: nothing asks the clock.
AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None, plain: bool = False):
    """Registers a query of (Tables); ``sql`` follows the adapter's relations unless ``plain``."""
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql if plain else f"{adapter.SQL}{sql}"
        return f

    return add


r6 = lambda c: F.round(c, 6)
joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
bank_of = lambda t: t.problems.select("id", "difficulty", "topics", "acceptance_rate", "primary_pattern", "pattern")

# ---- serving: profiles, pages, histories


@query("""
SELECT s.user_id, count(*) AS total_submissions, count(DISTINCT CASE WHEN verdict = 'pass' AND NOT gap_identified THEN problem_id END) AS total_solved,
  coalesce(round(avg(CASE WHEN p.difficulty = 'Easy' THEN CAST(verdict = 'pass' AS DOUBLE) END), 2), 0.0) AS pass_rate_easy,
  coalesce(round(avg(CASE WHEN p.difficulty = 'Medium' THEN CAST(verdict = 'pass' AS DOUBLE) END), 2), 0.0) AS pass_rate_medium,
  coalesce(round(avg(CASE WHEN p.difficulty = 'Hard' THEN CAST(verdict = 'pass' AS DOUBLE) END), 2), 0.0) AS pass_rate_hard
FROM submissions s JOIN problems p ON p.id = s.problem_id GROUP BY s.user_id""")
def profile_stats(t: Tables) -> DataFrame:
    rows = t.submissions.join(t.problems.select(F.col("id").alias("problem_id"), "difficulty"), "problem_id")
    won = F.when(F.col("verdict") == "pass", 1.0).otherwise(0.0)
    rate = lambda d: F.coalesce(F.round(F.avg(F.when(F.col("difficulty") == d, won)), 2), F.lit(0.0)).alias(f"pass_rate_{d.lower()}")
    solved = F.count_distinct(F.when((F.col("verdict") == "pass") & ~F.col("gap_identified"), F.col("problem_id")))
    return rows.groupBy("user_id").agg(F.count("*").alias("total_submissions"), solved.alias("total_solved"), *map(rate, ("Easy", "Medium", "Hard")))


@query("""
SELECT p.difficulty, round(avg(CAST(s.verdict = 'pass' AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM submissions s JOIN problems p ON p.id = s.problem_id GROUP BY 1""")
def accuracy_by_difficulty(t: Tables) -> DataFrame:
    rows = t.submissions.join(t.problems.select(F.col("id").alias("problem_id"), "difficulty"), "problem_id")
    return rows.groupBy("difficulty").agg(r6(F.avg((F.col("verdict") == "pass").cast("double"))).alias("accuracy"), F.count("*").alias("n"))


@query("""
SELECT user_id, coalesce(round(max(CASE WHEN difficulty = 'Easy' THEN a END), 2), 0) AS easy, coalesce(round(max(CASE WHEN difficulty = 'Medium' THEN a END), 2), 0) AS medium,
  coalesce(round(max(CASE WHEN difficulty = 'Hard' THEN a END), 2), 0) AS hard
FROM (SELECT s.user_id, p.difficulty, avg(CAST(s.verdict = 'pass' AS DOUBLE)) AS a FROM submissions s JOIN problems p ON p.id = s.problem_id GROUP BY 1, 2) GROUP BY 1""")
def pass_rate_pivot(t: Tables) -> DataFrame:
    rows = t.submissions.join(t.problems.select(F.col("id").alias("problem_id"), "difficulty"), "problem_id")
    wide = rows.groupBy("user_id").pivot("difficulty", ["Easy", "Medium", "Hard"]).agg(F.avg((F.col("verdict") == "pass").cast("double")))
    return wide.select("user_id", *[F.coalesce(F.round(d, 2), F.lit(0.0)).alias(d.lower()) for d in ("Easy", "Medium", "Hard")])


@query("""
SELECT user_id, rn, id, problem_id, title, verdict, detected_pattern, expected_pattern, gap_identified, submitted_at FROM (
  SELECT s.*, coalesce(p.title, s.topic) AS title, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, s.id DESC) AS rn
  FROM submissions s LEFT JOIN problems p ON p.id = s.problem_id) WHERE rn <= 10""")
def recent_submissions(t: Tables) -> DataFrame:
    rows = windows.latest(t.submissions, ["user_id"], 10)
    titled = rows.join(t.problems.select(F.col("id").alias("problem_id"), "title"), "problem_id", "left")
    return titled.select("user_id", F.col("rn").cast("bigint").alias("rn"), "id", "problem_id", F.coalesce("title", "topic").alias("title"), "verdict", "detected_pattern", "expected_pattern", "gap_identified", "submitted_at")


@query("""
SELECT id, user_id, problem_id, row_number() OVER (PARTITION BY user_id, problem_id ORDER BY submitted_at, id) AS attempt_number FROM submissions""")
def attempt_numbers(t: Tables) -> DataFrame:
    return windows.attempts(t.submissions).select("id", "user_id", "problem_id", F.col("attempt_number").cast("bigint").alias("attempt_number"))


@query("""
SELECT id, title, difficulty, topics, pattern, acceptance_rate FROM problems WHERE difficulty = 'Medium' AND topics LIKE '%STANDARD%' ORDER BY id LIMIT 20 OFFSET 20""")
def problems_page(t: Tables) -> DataFrame:
    return quality.page(t.problems, 2, 20, difficulty="Medium", topic="STANDARD").select("id", "title", "difficulty", "topics", "pattern", "acceptance_rate")


@query(" SELECT count(*) AS total FROM problems WHERE difficulty = 'Medium' AND topics LIKE '%STANDARD%'")
def problems_count(t: Tables) -> DataFrame:
    return quality.filtered(t.problems, difficulty="Medium", topic="STANDARD").agg(F.count("*").alias("total"))


@query(" SELECT id, title FROM problems WHERE title LIKE '%e%' AND id <> 7")
def problems_search(t: Tables) -> DataFrame:
    return quality.filtered(t.problems, search="e", exclude=7).select("id", "title")


@query(" SELECT id, difficulty, CAST(json_array_length(pattern) AS BIGINT) AS test_case_count FROM problems")
def problem_detail(t: Tables) -> DataFrame:
    return t.problems.select("id", "difficulty", F.coalesce(F.json_array_length("pattern"), F.lit(0)).cast("bigint").alias("test_case_count"))


@query("""
SELECT id, topics FROM problems WHERE topics LIKE '%S_A%' OR primary_pattern = 'hash_map_lookup'""")
def topic_or_primary(t: Tables) -> DataFrame:
    return t.problems.filter(F.col("topics").like("%S_A%") | (F.col("primary_pattern") == "hash_map_lookup")).select("id", "topics")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR lower(c_mktsegment) = lower('BUILDING')", plain=True)
def login_lookup(t: Tables) -> DataFrame:
    return t.read("customer").filter((F.col("c_name") == "Customer#000000007") | (F.lower("c_mktsegment") == "building")).select("c_custkey", "c_name")


# ---- the bank


@query(" SELECT primary_pattern, difficulty, count(*) AS problems FROM problems GROUP BY 1, 2")
def bank_profile(t: Tables) -> DataFrame:
    return bank.profile(t.problems.drop("primary_pattern"))


@query(" SELECT pattern_id FROM pattern_dim d WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.primary_pattern = d.pattern_id)")
def bank_zero_patterns(t: Tables) -> DataFrame:
    return bank.zero_patterns(t.problems, t.pattern_dim)


@query("""
SELECT primary_pattern, difficulty, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_pattern, difficulty ORDER BY id) AS rn FROM problems) WHERE rn <= 3 GROUP BY 1, 2""")
def bank_sample_ids(t: Tables) -> DataFrame:
    return bank.sample_ids(t.problems)


@query("""
SELECT id, 'unknown pattern: ' || replace(p, 'dp_', 'DP-') AS error FROM (
  SELECT id, unnest(CAST(json_extract_string(pattern, '$[*]') AS VARCHAR[])) AS p FROM problems) WHERE p LIKE 'dp!_%' ESCAPE '!'""")
def bank_invalid_patterns(t: Tables) -> DataFrame:
    return bank.validate(t.problems.withColumn("pattern", F.replace("pattern", F.lit("dp_"), F.lit("DP-"))), t.pattern_dim)


@query("""
SELECT q.p AS pattern_id, count(*) AS problems, min(id) AS first_id FROM (
  SELECT id, unnest(CAST(json_extract_string(pattern, '$[*]') AS VARCHAR[])) AS p FROM problems) q GROUP BY 1""")
def pattern_index(t: Tables) -> DataFrame:
    return t.problems.select("id", F.explode(T.string_list(F.col("pattern"))).alias("pattern_id")).groupBy("pattern_id").agg(F.count("*").alias("problems"), F.min("id").alias("first_id"))


@query("""
SELECT k, coalesce(a.title, b.title) AS title FROM (SELECT p_partkey AS k, p_name AS name FROM part) w
LEFT JOIN problems a ON a.id = w.k LEFT JOIN (SELECT title, min(id) AS id FROM problems GROUP BY 1) b ON b.title = w.name""")
def priority_lookup(t: Tables) -> DataFrame:
    return bank.lookup(t.read("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), t.problems)


# ---- solved, unsolved, streaks


@query(" SELECT user_id, count(DISTINCT problem_id) AS solved FROM submissions WHERE verdict = 'pass' AND NOT gap_identified GROUP BY 1")
def solved_distinct(t: Tables) -> DataFrame:
    return t.submissions.filter((F.col("verdict") == "pass") & ~F.col("gap_identified")).groupBy("user_id").agg(F.count_distinct("problem_id").alias("solved"))


@query("""
SELECT u.user_id, count(*) AS unsolved FROM (SELECT DISTINCT user_id FROM submissions) u, problems p
WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.user_id = u.user_id AND s.problem_id = p.id AND s.verdict = 'pass') GROUP BY 1""")
def unsolved_per_user(t: Tables) -> DataFrame:
    # Counts need no pairs: all problems less the user's distinct passed ones that are in the bank.
    passed = t.submissions.filter("verdict = 'pass'").select("user_id", F.col("problem_id").alias("id")).distinct().join(t.problems.select("id"), "id", "left_semi")
    n = t.problems.count()
    return t.users.join(passed.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", (F.lit(n) - F.coalesce("n", F.lit(0))).alias("unsolved")).filter("unsolved > 0")


@query("""
SELECT user_id, id AS problem_id, difficulty FROM (SELECT u.user_id, p.id, p.difficulty, row_number() OVER (PARTITION BY u.user_id ORDER BY p.difficulty, coalesce(p.acceptance_rate, 0) DESC, p.id) AS rn
  FROM (SELECT DISTINCT user_id FROM submissions) u, problems p
  WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.user_id = u.user_id AND s.problem_id = p.id AND s.verdict = 'pass')) WHERE rn = 1""")
def first_unsolved(t: Tables) -> DataFrame:
    return recommend.first_unsolved(t.users, bank_of(t), t.submissions)


@query("""
SELECT user_id, topic, difficulty, id AS problem_id FROM (
  SELECT w.user_id, w.topic, p.difficulty, p.id, row_number() OVER (PARTITION BY w.user_id, w.topic, p.difficulty ORDER BY coalesce(p.acceptance_rate, 0) DESC, p.id) AS rn
  FROM (SELECT DISTINCT user_id, topic FROM submissions) w JOIN problems p ON p.primary_pattern = w.topic OR p.topics LIKE '%' || w.topic || '%'
  WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.user_id = w.user_id AND s.problem_id = p.id AND s.verdict = 'pass')) WHERE rn = 1""")
def best_unsolved(t: Tables) -> DataFrame:
    topics = t.submissions.select("user_id", "topic").distinct()
    levels = F.explode(F.array(*[F.lit(d) for d in ("Easy", "Medium", "Hard")])).alias("difficulty")
    return recommend.ranked_unsolved(topics.select("user_id", "topic", levels), recommend.topic_problems(bank_of(t), topics), t.submissions).drop("primary_pattern")


@query("""
, days AS (SELECT DISTINCT user_id, CAST(submitted_at AS DATE) AS d FROM submissions),
islands AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM days),
runs AS (SELECT user_id, max(d) AS last_submission_date, count(*) AS current_streak FROM islands GROUP BY user_id, g)
SELECT user_id, max(last_submission_date) AS last_submission_date, arg_max(current_streak, last_submission_date) AS current_streak FROM runs GROUP BY 1""")
def daily_streak(t: Tables) -> DataFrame:
    return windows.daily_streak(t.submissions)


RUN_SQL = """
, o AS (SELECT {keys}, submitted_at, id, sum(CASE WHEN {holds} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY submitted_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM {rows})
SELECT {keys}, count(*) FILTER (broken = 0) AS run FROM o GROUP BY {keys}"""


@query(RUN_SQL.format(keys="user_id, topic", holds="verdict = 'pass'", rows="submissions"))
def pass_run_length(t: Tables) -> DataFrame:
    return windows.leading_run(t.submissions, ["user_id", "topic"], F.col("verdict") == "pass")


@query(RUN_SQL.format(keys="user_id", holds="verdict = 'pass' AND NOT gap_identified", rows="(SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) <= 50)"))
def clean_pass_streak(t: Tables) -> DataFrame:
    return windows.leading_run(windows.latest(t.submissions, ["user_id"], 50), ["user_id"], (F.col("verdict") == "pass") & ~F.col("gap_identified"))


@query("""
SELECT user_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY submitted_at DESC, id DESC) AS rn FROM submissions) WHERE rn <= 3
GROUP BY 1, 2 HAVING count(*) = 3 AND bool_and(verdict = 'pass')""")
def pattern_lock_pass(t: Tables) -> DataFrame:
    last = windows.latest(t.submissions, ["user_id", "topic"], 3)
    return last.groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.bool_and(F.col("verdict") == "pass").alias("won")).filter("n = 3 AND won").select("user_id", "topic")


@query("""
, s AS (SELECT user_id, CASE WHEN lag(topic) OVER (PARTITION BY user_id ORDER BY submitted_at, id) <> topic THEN 1 ELSE 0 END AS c FROM submissions)
SELECT user_id, CAST(sum(c) AS BIGINT) AS switches, count(*) AS steps, round(sum(c) / greatest(count(*) - 1, 1), 6) AS switch_rate FROM s GROUP BY 1""")
def topic_switches(t: Tables) -> DataFrame:
    return windows.switches(t.submissions, "topic")


@query("""
, i AS (SELECT user_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at, id) - row_number() OVER (PARTITION BY user_id, topic ORDER BY submitted_at, id) AS g FROM submissions),
r AS (SELECT user_id, count(*) AS n FROM i GROUP BY user_id, topic, g) SELECT user_id, max(n) AS longest_run FROM r GROUP BY 1""")
def longest_topic_run(t: Tables) -> DataFrame:
    return windows.longest_runs(t.submissions, "topic")


@query("""
, r AS (SELECT user_id, detected_confidence AS v, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) AS rn FROM submissions)
SELECT user_id, round(max(v) - min(v), 6) AS spread, max(v) - min(v) < 0.2 AS stagnant FROM r WHERE rn <= 5 GROUP BY 1 HAVING count(*) >= 5""")
def range_last5(t: Tables) -> DataFrame:
    v = F.max("detected_confidence") - F.min("detected_confidence")
    last = windows.latest(t.submissions, ["user_id"], 5).groupBy("user_id").agg(F.count("*").alias("n"), r6(v).alias("spread"), (v < 0.2).alias("stagnant"))
    return last.filter("n >= 5").drop("n")


@query("""
, c AS (SELECT s.user_id, p.difficulty, count(*) AS n FROM submissions s JOIN problems p ON p.id = s.problem_id GROUP BY 1, 2)
SELECT user_id, difficulty, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c QUALIFY n / sum(n) OVER (PARTITION BY user_id) >= 0.6""")
def difficulty_lock_in(t: Tables) -> DataFrame:
    rows = t.submissions.join(t.problems.select(F.col("id").alias("problem_id"), "difficulty"), "problem_id").groupBy("user_id", "difficulty").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).filter("share >= 0.6").select("user_id", "difficulty", r6("share").alias("share"))


@query(" SELECT verdict, gap_identified, count(*) AS n FROM submissions GROUP BY 1, 2")
def verdict_status_counts(t: Tables) -> DataFrame:
    return t.submissions.groupBy("verdict", "gap_identified").agg(F.count("*").alias("n"))


# ---- ratings

FOLD_SQL = """
, ordered AS (SELECT {topic} AS topic, s.user_id, s.verdict, {difficulty} AS difficulty, s.detected_pattern, s.expected_pattern,
    row_number() OVER (PARTITION BY s.user_id, {topic} ORDER BY s.submitted_at, s.id) AS rn FROM submissions s {how} JOIN problems p ON p.id = s.problem_id),
steps AS (SELECT *, CASE WHEN verdict = 'pass' THEN CASE WHEN detected_pattern IS NOT DISTINCT FROM expected_pattern THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS won,
    CASE difficulty WHEN 'Easy' THEN 900.0 WHEN 'Medium' THEN 1200.0 ELSE 1500.0 END::DOUBLE AS opp, CASE difficulty WHEN 'Easy' THEN 32.0 WHEN 'Medium' THEN 24.0 ELSE 16.0 END::DOUBLE AS k FROM ordered),
fold(user_id, topic, rn, elo, attempts, passes, matched, failures) AS (
  SELECT user_id, topic, CAST(0 AS BIGINT), CAST(800.0 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id, topic FROM steps)
  UNION ALL
  SELECT f.user_id, f.topic, s.rn, greatest(400.0, elo + k * (won - 1 / (1 + pow(10.0, (opp - elo) / 400)))), attempts + 1, passes + CAST(verdict = 'pass' AS INT),
    matched + CAST({matched} AS INT), {failures}
  FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.topic = f.topic AND s.rn = f.rn + 1),
profiles AS (SELECT user_id, topic, arg_max(elo, rn) AS elo_rating, max(attempts) AS attempt_count, arg_max(passes, rn) AS pass_count, arg_max(matched, rn) AS pattern_match_count,
  arg_max(passes, rn) / max(attempts) AS accuracy, arg_max(failures, rn) AS recent_failures FROM fold GROUP BY 1, 2)"""
LIVE_SQL = FOLD_SQL.format(
    how="INNER",
    topic="s.topic", difficulty="p.difficulty", matched="verdict = 'pass' AND detected_pattern IS NOT DISTINCT FROM expected_pattern",
    failures="CASE WHEN verdict = 'fail' THEN failures + 1 ELSE greatest(0, failures - 1) END",
)
BACKFILL_SQL = FOLD_SQL.format(
    how="LEFT",
    topic="coalesce(nullif(s.detected_pattern, ''), nullif(s.expected_pattern, ''), s.topic)", difficulty="coalesce(p.difficulty, 'Easy')", matched="false",
    failures="failures + CASE WHEN won < 1 THEN 1 ELSE greatest(0, failures - 1) END",
)
PROFILE_SQL = " SELECT user_id, topic, round(elo_rating, 6) AS elo_rating, attempt_count, pass_count, pattern_match_count, round(accuracy, 6) AS accuracy, recent_failures FROM profiles"


def leveled(t: Tables, how: str = "inner") -> DataFrame:
    return t.submissions.join(t.problems.select(F.col("id").alias("problem_id"), "difficulty"), "problem_id", how)


def profiles(t: Tables) -> DataFrame:
    return folds.topic_profiles(leveled(t), places=None)


def shown(rows: DataFrame) -> DataFrame:
    counts = [F.col(c).cast("bigint").alias(c) for c in ("attempt_count", "pass_count", "pattern_match_count")]
    return rows.select("user_id", "topic", r6("elo_rating").alias("elo_rating"), *counts, r6("accuracy").alias("accuracy"), "recent_failures")


@query(LIVE_SQL + PROFILE_SQL)
def topic_profile_fold(t: Tables) -> DataFrame:
    return shown(profiles(t))


@query(BACKFILL_SQL + PROFILE_SQL)
def profile_backfill_fold(t: Tables) -> DataFrame:
    return shown(folds.backfilled_profiles(leveled(t, "left"), places=None))


@query(LIVE_SQL + " SELECT user_id, coalesce(round(avg(elo_rating), 2), 800) AS overall_elo FROM profiles GROUP BY 1")
def overall_elo(t: Tables) -> DataFrame:
    return profiles(t).groupBy("user_id").agg(F.coalesce(F.round(F.avg("elo_rating"), 2), F.lit(800.0)).alias("overall_elo"))


@query(LIVE_SQL + """
, r AS (SELECT user_id, topic, elo_rating, row_number() OVER (PARTITION BY user_id ORDER BY round(elo_rating, 6), topic) AS lo, row_number() OVER (PARTITION BY user_id ORDER BY round(elo_rating, 6) DESC, topic DESC) AS hi FROM profiles)
SELECT user_id, round(avg(elo_rating), 6) AS mean_elo, string_agg(topic, ',' ORDER BY lo) FILTER (lo <= 5) AS weakest, string_agg(topic, ',' ORDER BY lo) FILTER (hi <= 5) AS strongest FROM r GROUP BY 1""")
def elo_summary(t: Tables) -> DataFrame:
    low = Window.partitionBy("user_id").orderBy(r6("elo_rating"), "topic")
    high = Window.partitionBy("user_id").orderBy(r6("elo_rating").desc(), F.desc("topic"))
    rows = profiles(t).withColumns({"lo": F.row_number().over(low), "hi": F.row_number().over(high)})
    pick = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("lo", "topic")))), lambda x: x["topic"]), ",")
    return rows.groupBy("user_id").agg(r6(F.avg("elo_rating")).alias("mean_elo"), pick(F.col("lo") <= 5).alias("weakest"), pick(F.col("hi") <= 5).alias("strongest"))


@query(LIVE_SQL + """
SELECT user_id, count(*) FILTER (elo_rating >= 1800) AS strong, count(*) FILTER (elo_rating < 1650) AS weak, round(avg(elo_rating), 6) AS mean_elo, round(sum(accuracy), 6) AS total_accuracy FROM profiles GROUP BY 1""")
def ui_kpis(t: Tables) -> DataFrame:
    return profiles(t).groupBy("user_id").agg(
        F.count_if(F.col("elo_rating") >= 1800).alias("strong"), F.count_if(F.col("elo_rating") < 1650).alias("weak"),
        r6(F.avg("elo_rating")).alias("mean_elo"), r6(F.sum("accuracy")).alias("total_accuracy"),
    )


SEED_USERS = """, seeds AS (SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 700.0 WHEN 1 THEN 900.0 ELSE 1100.0 END AS base, CASE c_custkey % 2 WHEN 0 THEN 'dp' ELSE 'arrays' END AS area FROM customer)"""


@query(SEED_USERS + " SELECT user_id, pattern_id AS topic, CAST(base + CASE WHEN category = area THEN 150 ELSE 0 END AS DOUBLE) AS elo_rating FROM seeds, pattern_dim")
def seed_profiles(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    level = F.when(key % 3 == 0, " Beginner").when(key % 3 == 1, "intermediate").otherwise("ADVANCED")
    users = t.read("customer").select(key.alias("user_id"), level.alias("experience_level"), F.array(F.when(key % 2 == 0, "dp").otherwise("arrays")).alias("confident_areas"))
    return folds.seeded(users, t.pattern_dim)


SINGLE_SQL = """
, c AS (SELECT id, detected_pattern AS pattern_id, CASE WHEN NOT gap_identified THEN 'FULL_MATCH' WHEN verdict = 'pass' THEN 'PARTIAL_MATCH' ELSE 'NO_MATCH' END AS m, CAST(problem_id % 10 AS DOUBLE) / 10 AS gap, detected_confidence AS conf,
    CAST(1000 + user_id % 400 AS DOUBLE) AS old_elo, id % 6 AS h FROM submissions),
s AS (SELECT *, CASE m WHEN 'FULL_MATCH' THEN 1.0 WHEN 'PARTIAL_MATCH' THEN 0.5 ELSE 0.0 END::DOUBLE AS base FROM c),
q AS (SELECT *, CASE WHEN gap > 0.6 THEN greatest(0, base - 0.3) WHEN gap > 0.3 THEN greatest(0, base - 0.15) ELSE base END::DOUBLE AS low FROM s),
z AS (SELECT *, CASE WHEN conf > 0 AND base < 0.5 THEN greatest(low, 0.2) ELSE low END * CASE WHEN m = 'FULL_MATCH' AND h >= 3 THEN greatest(1 - (h - 2) * 0.1, 0.5) WHEN m = 'NO_MATCH' AND h >= 3 THEN greatest(1 - (h - 2) * 0.15, 0.3) ELSE 1 END AS score,
    least(64, CASE WHEN h >= 3 THEN greatest(32 + CASE WHEN gap > 0.5 THEN 16 ELSE 0 END - 8, 8) ELSE 32 + CASE WHEN gap > 0.5 THEN 16 ELSE 0 END END) AS k, CASE WHEN conf >= 0.8 THEN 1400.0 ELSE 1200.0 END::DOUBLE AS opp FROM q)
SELECT id, pattern_id, round(greatest(400, old_elo + k * (score - 1 / (1 + pow(10.0, (opp - old_elo) / 400)))), 6) AS new_elo,
  round(greatest(0.1, least(1.0, CASE m WHEN 'NO_MATCH' THEN 0.4 WHEN 'PARTIAL_MATCH' THEN 0.7 ELSE 1.0 END - gap * 0.3 + conf * 0.2)), 6) AS confidence_weight FROM z"""


@query(SINGLE_SQL)
def elo_single_step(t: Tables) -> DataFrame:
    result = F.when(~F.col("gap_identified"), "FULL_MATCH").when(F.col("verdict") == "pass", "PARTIAL_MATCH").otherwise("NO_MATCH")
    h = (F.col("id") % 6).cast("int")
    rows = t.submissions.select(
        "id", F.col("detected_pattern").alias("pattern_id"), result.alias("match_result"), ((F.col("problem_id") % 10).cast("double") / 10).alias("gap_strength"),
        F.col("detected_confidence").alias("confidence"), (1000 + F.col("user_id") % 400).cast("double").alias("old_elo"), h.alias("history"), h.alias("full_count"), h.alias("none_count"),
    )
    return folds.pattern_updates(rows, places=None).select("id", "pattern_id", r6("new_elo").alias("new_elo"), r6("confidence_weight").alias("confidence_weight"))


STATS_SQL = f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, detected_pattern ORDER BY submitted_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY user_id, detected_pattern) AS n FROM submissions),
st AS (SELECT user_id, detected_pattern AS pattern_id, count(*) AS frequency,
  least(1.0, sum(CASE WHEN rn <= 5 THEN greatest(0.0, 1 - (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(submitted_at))) / 3600.0 / 720.0) * (least(n, 5) - rn + 1) / least(n, 5) END) / least(max(n), 5)) AS recency,
  stddev_pop(detected_confidence) AS spread, count(*) FILTER (rn <= 5 AND detected_confidence >= 0.6) = least(max(n), 5) AS all_confident FROM r GROUP BY 1, 2),
tot AS (SELECT user_id, count(*) AS total FROM submissions GROUP BY 1)"""
GAP_SQL = STATS_SQL + """
, last_ AS (SELECT user_id, detected_pattern AS pattern_id, detected_confidence AS confidence, gap_identified, expected_pattern FROM submissions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) = 1),
cand AS (SELECT user_id, pattern_id, confidence, false AS unmatched FROM last_ UNION ALL SELECT user_id, expected_pattern, NULL, true FROM last_ WHERE gap_identified),
full_users AS (SELECT user_id FROM last_ WHERE NOT gap_identified),
keys AS (SELECT user_id, pattern_id FROM cand UNION SELECT user_id, pattern_id FROM st JOIN tot USING (user_id) WHERE frequency >= 2 AND total >= 2 AND spread > 0.2),
x AS (SELECT k.user_id, k.pattern_id, c.confidence, coalesce(c.unmatched, false) AS unmatched, s.frequency >= 2 AND t.total >= 2 AND s.spread > 0.2 AS shaky, s.frequency, s.recency, s.all_confident, t.total
  FROM keys k LEFT JOIN cand c USING (user_id, pattern_id) LEFT JOIN st s USING (user_id, pattern_id) LEFT JOIN tot t USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM full_users)),
y AS (SELECT *, CASE WHEN confidence < 0.6 THEN (0.6 - confidence) / 0.6 WHEN shaky THEN 0.3 ELSE 0 END AS weak FROM x WHERE (unmatched OR coalesce(confidence < 0.6, false) OR coalesce(shaky, false)) AND NOT coalesce(all_confident, false)),
z AS (SELECT user_id, pattern_id, coalesce(frequency, 0) AS frequency, round(least(1, greatest(0, least(1, coalesce(frequency / greatest(total, 1), 0)) * 0.5 + coalesce(recency, 0) * 0.3 + CASE WHEN weak > 0 THEN weak WHEN unmatched THEN 0.5 ELSE 0 END * 0.2)), 4) AS gap_strength FROM y)
"""
UPDATES_SQL = """
, cand_ AS (SELECT user_id, pattern_id, 1 AS src, row_number() OVER (PARTITION BY user_id ORDER BY gap_strength DESC, pattern_id) AS o FROM z WHERE gap_strength >= 0.01
  UNION ALL SELECT user_id, pattern_id, 2, 1 FROM last_ UNION ALL SELECT user_id, expected_pattern, 3, 1 FROM last_ WHERE gap_identified),
placed AS (SELECT user_id, pattern_id, row_number() OVER (PARTITION BY user_id ORDER BY min((src, o))) - 1 AS place FROM cand_ GROUP BY 1, 2),
y1 AS (SELECT p.user_id, p.pattern_id, p.place, coalesce(e.elo_rating, 1200) AS old_elo, coalesce(g.gap_strength, 0) AS gap, CASE WHEN l.pattern_id = p.pattern_id THEN l.confidence ELSE 0 END AS conf,
    CASE WHEN NOT l.gap_identified THEN 'FULL_MATCH' ELSE 'PARTIAL_MATCH' END AS m
  FROM placed p JOIN last_ l USING (user_id) LEFT JOIN profiles e ON e.user_id = p.user_id AND e.topic = p.pattern_id
  LEFT JOIN (SELECT * FROM z WHERE gap_strength >= 0.01) g ON g.user_id = p.user_id AND g.pattern_id = p.pattern_id),
y2 AS (SELECT *, CASE m WHEN 'FULL_MATCH' THEN 1.0 ELSE 0.5 END::DOUBLE AS base FROM y1),
y3 AS (SELECT *, CASE WHEN gap > 0.6 THEN greatest(0, base - 0.3) WHEN gap > 0.3 THEN greatest(0, base - 0.15) ELSE base END::DOUBLE AS low FROM y2),
y4 AS (SELECT *, CASE WHEN conf > 0 AND base < 0.5 THEN greatest(low, 0.2) ELSE low END AS score, CASE WHEN gap > 0.5 THEN 48 ELSE 32 END AS k, CASE WHEN conf >= 0.8 THEN 1400.0 ELSE 1200.0 END::DOUBLE AS opp FROM y3),
upd AS (SELECT user_id, pattern_id, place, old_elo, greatest(400, old_elo + k * (score - 1 / (1 + pow(10.0, (opp - old_elo) / 400)))) AS new_elo,
  greatest(0.1, least(1.0, CASE m WHEN 'PARTIAL_MATCH' THEN 0.7 ELSE 1.0 END - gap * 0.3 + conf * 0.2)) AS weight FROM y4)"""


def elo_changes(t: Tables) -> DataFrame:
    """Rating changes by each user's latest submission; what its topic profiles say are the ratings before."""
    last = windows.latest(t.submissions, ["user_id"], 1)
    found = gap_rows(t).groupBy("user_id").agg(F.collect_list(F.struct("pattern_id", "gap_strength")).alias("gaps"))
    before = profiles(t).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "elo_rating"))).alias("elos"))
    rows = last.join(found, "user_id", "left").join(before, "user_id", "left").select(
        "user_id", F.when(F.col("gap_identified"), "PARTIAL_MATCH").otherwise("FULL_MATCH").alias("match_result"), "gaps", "elos",
        F.array(F.struct(F.col("detected_pattern").alias("pattern_id"), F.col("detected_confidence").alias("confidence"))).alias("detections"),
        F.when(F.col("gap_identified"), F.array("expected_pattern")).alias("unmatched"),
    )
    return folds.submission_updates(rows, places=None)


@query(LIVE_SQL + GAP_SQL + UPDATES_SQL + " SELECT user_id, pattern_id, place, round(old_elo, 6) AS old_elo, round(new_elo, 6) AS new_elo, round(weight, 6) AS confidence_weight FROM upd")
def elo_updates(t: Tables) -> DataFrame:
    return elo_changes(t).select("user_id", "pattern_id", F.col("place").cast("bigint").alias("place"), r6("old_elo").alias("old_elo"), r6("new_elo").alias("new_elo"), r6("confidence_weight").alias("confidence_weight"))


@query(LIVE_SQL + GAP_SQL + UPDATES_SQL + """
, dl AS (SELECT user_id, pattern_id, place, round(new_elo - old_elo, 6) AS delta FROM upd),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, place) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY delta, place DESC) AS lo FROM dl)
SELECT user_id, round(avg(delta), 5) AS average_elo_change, coalesce(string_agg(pattern_id, ',' ORDER BY hi) FILTER (hi <= 3 AND delta > 0), '') AS strongest,
  coalesce(string_agg(pattern_id, ',' ORDER BY lo) FILTER (lo <= 3 AND delta < 0), '') AS weakest FROM rk GROUP BY 1""")
def elo_global_summary(t: Tables) -> DataFrame:
    rows = folds.global_summary(elo_changes(t).withColumn("delta", r6("delta")), ["user_id"], places=5)
    return rows.select("user_id", "average_elo_change", F.array_join("strongest_improvement_patterns", ",").alias("strongest"), F.array_join("weakest_patterns", ",").alias("weakest"))


#: Every submission's gap signals and ratings, as of itself: detections before it by windows over (user, pattern), ratings by recursion over a pattern's own submissions.
REPLAY_SQL = """
, sub AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at, id) AS n,
    CASE WHEN NOT gap_identified THEN 'FULL_MATCH' WHEN verdict = 'pass' THEN 'PARTIAL_MATCH' ELSE 'NO_MATCH' END AS m FROM submissions),
seen AS (SELECT user_id, detected_pattern AS pattern_id, submitted_at AS at, detected_confidence AS c, row_number() OVER w AS k,
    list(submitted_at) OVER five AS ats, list(detected_confidence) OVER five AS confs
  FROM sub WINDOW w AS (PARTITION BY user_id, detected_pattern ORDER BY n), five AS (PARTITION BY user_id, detected_pattern ORDER BY n ROWS 4 PRECEDING)),
pats AS (SELECT DISTINCT user_id, detected_pattern AS pattern_id FROM sub UNION SELECT user_id, expected_pattern FROM sub WHERE gap_identified),
grid AS (SELECT s.user_id, s.n, s.id, s.submitted_at, s.m, p.pattern_id, s.detected_pattern = p.pattern_id AS hit, s.detected_confidence AS c, s.gap_identified AND s.expected_pattern = p.pattern_id AND NOT (s.detected_pattern = p.pattern_id AND s.detected_confidence > 0) AS missing,
    s.gap_identified AND s.expected_pattern = p.pattern_id AS unmatched,
    count(*) FILTER (s.detected_pattern = p.pattern_id) OVER w AS freq, sum(CASE WHEN s.detected_pattern = p.pattern_id THEN s.detected_confidence END) OVER w AS total,
    sum(CASE WHEN s.detected_pattern = p.pattern_id THEN s.detected_confidence * s.detected_confidence END) OVER w AS squares
  FROM sub s JOIN pats p USING (user_id) WINDOW w AS (PARTITION BY s.user_id, p.pattern_id ORDER BY s.n)),
asof_ AS (SELECT g.*, freq >= 2 AND n >= 2 AND sqrt(greatest(0, squares / freq - (total / freq) * (total / freq))) > 0.2 + 1e-9 AS shaky,
    coalesce(list_min(l.confs) >= 0.6, false) AS sure,
    least(1, coalesce(list_sum(list_transform(range(1, len(l.ats) + 1), lambda i: greatest(0, 1 - date_diff('microsecond', l.ats[i], g.submitted_at) / 3.6e9 / 720) * i / len(l.ats))) / len(l.ats), 0)) AS recency
  FROM grid g LEFT JOIN seen l ON l.user_id = g.user_id AND l.pattern_id = g.pattern_id AND l.k = g.freq),
weak AS (SELECT *, CASE WHEN hit AND c < 0.6 THEN (0.6 - c) / 0.6 WHEN shaky THEN 0.3 ELSE 0 END AS w FROM asof_),
raw AS (SELECT *, CASE WHEN m <> 'FULL_MATCH' AND NOT sure AND (missing OR (hit AND c < 0.6) OR shaky)
    THEN floor(least(1, greatest(0, least(1, freq / n) * 0.5 + recency * 0.3 + CASE WHEN w > 0 THEN w WHEN missing THEN 0.5 ELSE 0 END * 0.2)) * 10000 + 0.500001) / 10000 END AS s FROM weak),
cands AS (SELECT *, CASE WHEN s >= 0.01 THEN s ELSE 0 END AS gap, CASE WHEN hit THEN c ELSE 0 END AS conf, CASE m WHEN 'FULL_MATCH' THEN 1.0 WHEN 'PARTIAL_MATCH' THEN 0.5 ELSE 0.0 END::DOUBLE AS base,
    row_number() OVER w AS step, count(*) FILTER (m = 'FULL_MATCH') OVER five AS fulls, count(*) FILTER (m = 'NO_MATCH') OVER five AS nones
  FROM raw WHERE hit OR unmatched OR s >= 0.01 WINDOW w AS (PARTITION BY user_id, pattern_id ORDER BY n), five AS (PARTITION BY user_id, pattern_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
scored AS (SELECT *, CASE WHEN gap > 0.6 THEN greatest(0, base - 0.3) WHEN gap > 0.3 THEN greatest(0, base - 0.15) ELSE base END AS low, CASE WHEN conf >= 0.8 THEN 1400.0 ELSE 1200.0 END::DOUBLE AS opp,
    CASE WHEN m = 'FULL_MATCH' AND fulls >= 3 THEN greatest(1 - (fulls - 2) * 0.1, 0.5) WHEN m = 'NO_MATCH' AND nones >= 3 THEN greatest(1 - (nones - 2) * 0.15, 0.3) ELSE 1 END AS drift,
    CASE WHEN gap > 0.5 THEN 48 ELSE 32 END AS k FROM cands)"""
RATED_SQL = REPLAY_SQL + """
, ready AS (SELECT user_id, pattern_id, step, (CASE WHEN conf > 0 AND base < 0.5 THEN greatest(low, 0.2) ELSE low END) * {drift} AS score, {k} AS k, opp FROM scored),
fold AS (SELECT user_id, pattern_id, 0::BIGINT AS step, 1200.0::DOUBLE AS elo FROM (SELECT DISTINCT user_id, pattern_id FROM ready)
  UNION ALL SELECT f.user_id, f.pattern_id, r.step, greatest(400, f.elo + r.k * (r.score - 1 / (1 + pow(10.0, (r.opp - f.elo) / 400)))) FROM fold f JOIN ready r ON r.user_id = f.user_id AND r.pattern_id = f.pattern_id AND r.step = f.step + 1)
SELECT user_id, pattern_id, round(elo, 6) AS elo, step AS updates FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, pattern_id ORDER BY step DESC) = 1"""


def replayed(t: Tables, histories: bool = False) -> DataFrame:
    return interleaved.states(interleaved.replay(interleaved.analysed(t.submissions), places=None, histories=histories, told=False))


@query(RATED_SQL.format(drift="1", k="k"))
def pattern_elo_replay(t: Tables) -> DataFrame:
    return interleaved.pattern_elos(replayed(t)).withColumn("elo", r6("elo"))


@query(RATED_SQL.format(drift="drift", k="CASE WHEN step > 3 THEN k - 8 ELSE k END"))
def pattern_elo_histories(t: Tables) -> DataFrame:
    """The same with what earlier results take off scores and K factors."""
    return interleaved.pattern_elos(replayed(t, histories=True)).withColumn("elo", r6("elo"))


@query(REPLAY_SQL + """
SELECT user_id, pattern_id, s AS gap_strength, freq AS frequency, submitted_at AS last_seen FROM raw WHERE s >= 0.01
QUALIFY row_number() OVER (PARTITION BY user_id, pattern_id ORDER BY n DESC) = 1""")
def gap_signals_replay(t: Tables) -> DataFrame:
    """Each pattern's latest signal after all submissions, each signal as of its submission."""
    return interleaved.gap_signals(replayed(t)).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


# ---- matching and gaps

MATCH_SQL = """
, det AS (SELECT user_id, problem_id, detected_pattern AS p, max(detected_confidence) AS conf FROM submissions WHERE detected_confidence > 0 GROUP BY 1, 2, 3),
item AS (SELECT DISTINCT user_id, problem_id FROM submissions),
g AS (SELECT i.user_id, i.problem_id, x.gi, x.p FROM item i JOIN problems q ON q.id = i.problem_id, LATERAL (SELECT DISTINCT gi, p FROM (
  SELECT 0 AS gi, unnest(CAST(json_extract_string(q.pattern, '$[*]') AS VARCHAR[])) AS p UNION ALL SELECT 1, 'prefix_sum')) x),
per AS (SELECT g.user_id, g.problem_id, gi, count(*) AS size, count(d.p) AS overlap, coalesce(sum(d.conf), 0) / count(*) AS conf FROM g LEFT JOIN det d USING (user_id, problem_id, p) GROUP BY 1, 2, 3),
ext AS (SELECT d.user_id, d.problem_id, sum(conf) AS s FROM det d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = d.user_id AND g.problem_id = d.problem_id AND g.p = d.p) GROUP BY 1, 2),
nd AS (SELECT user_id, problem_id, count(*) AS n FROM det GROUP BY 1, 2),
um AS (SELECT g.user_id, g.problem_id, string_agg(DISTINCT g.p, ',' ORDER BY g.p) AS u FROM g LEFT JOIN det d USING (user_id, problem_id, p) WHERE d.p IS NULL GROUP BY 1, 2),
res AS (SELECT p.user_id, p.problem_id, bool_or(overlap = size) AS full_, bool_or(overlap > 0) AS some_, max(conf) AS best, string_agg(CASE WHEN overlap = size THEN CAST(gi AS VARCHAR) END, ',' ORDER BY gi) AS mg FROM per p GROUP BY 1, 2)
SELECT r.user_id, r.problem_id, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_MATCH' WHEN full_ THEN 'FULL_MATCH' WHEN some_ THEN 'PARTIAL_MATCH' ELSE 'NO_MATCH' END AS match_result,
  round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE least(1, CASE WHEN s IS NOT NULL AND best > 0 AND NOT full_ THEN greatest(0, best - s * 0.1) ELSE best END) END, 6) AS confidence,
  coalesce(mg, '') AS matched_groups, coalesce(u, '') AS unmatched_patterns
FROM res r LEFT JOIN ext USING (user_id, problem_id) LEFT JOIN nd USING (user_id, problem_id) LEFT JOIN um USING (user_id, problem_id)"""


def matched(t: Tables) -> DataFrame:
    found = t.submissions.groupBy("user_id", "problem_id").agg(F.collect_list(F.struct(F.col("detected_pattern").alias("pattern_id"), F.col("detected_confidence").alias("confidence"))).alias("detections"))
    groups = t.problems.select(F.col("id").alias("problem_id"), F.array(T.string_list(F.col("pattern")), F.array(F.lit(" prefix_sum ")), F.array(F.lit(" "))).alias("accepted_solution_groups"))
    return matching.match(found.join(groups, "problem_id"), places=6)


@query(MATCH_SQL)
def match_results(t: Tables) -> DataFrame:
    rows = matched(t)
    return rows.select("user_id", "problem_id", "match_result", F.col("confidence_score").alias("confidence"), F.array_join(F.col("matched_groups").cast("array<string>"), ",").alias("matched_groups"), F.array_join("unmatched_patterns", ",").alias("unmatched_patterns"))


@query()  # texts with formatted halves: tests hold them against a plain loop
def match_signals(t: Tables) -> DataFrame:
    return matched(t).select("user_id", "problem_id", F.array_join("reasoning_signals", ";").alias("signals"))


@query(STATS_SQL + " SELECT user_id, pattern_id, frequency, round(recency, 6) AS recency, round(spread, 6) AS spread, all_confident FROM st")
def gap_history(t: Tables) -> DataFrame:
    return gaps.history_stats(t.submissions, F.lit(AS_OF).cast("timestamp")).select("user_id", "pattern_id", "frequency", R.rounded(F.col("recency"), 6).alias("recency"), r6("spread").alias("spread"), "all_confident")


@query(STATS_SQL + " SELECT user_id, pattern_id, round(spread, 6) AS spread FROM st JOIN tot USING (user_id) WHERE frequency >= 2 AND total >= 2 AND spread > 0.2")
def gap_inconsistent(t: Tables) -> DataFrame:
    stats = gaps.history_stats(t.submissions, F.lit(AS_OF).cast("timestamp"))
    return gaps.inconsistent(stats, t.submissions.groupBy("user_id").agg(F.count("*").alias("total"))).select("user_id", "pattern_id", r6("spread").alias("spread"))


def gap_rows(t: Tables) -> DataFrame:
    return gaps.current(t.submissions, F.lit(AS_OF).cast("timestamp"))


@query(GAP_SQL + "SELECT user_id, pattern_id, frequency, gap_strength FROM z WHERE gap_strength >= 0.01")
def gap_strength(t: Tables) -> DataFrame:
    return gap_rows(t).select("user_id", "pattern_id", "frequency", "gap_strength")


@query(GAP_SQL + """SELECT user_id, coalesce(string_agg(CASE WHEN gap_strength >= 0.7 THEN pattern_id END, ',' ORDER BY pattern_id), '') AS strong_gaps,
  coalesce(string_agg(CASE WHEN gap_strength >= 0.4 AND gap_strength < 0.7 THEN pattern_id END, ',' ORDER BY pattern_id), '') AS moderate_gaps,
  coalesce(string_agg(CASE WHEN gap_strength < 0.4 THEN pattern_id END, ',' ORDER BY pattern_id), '') AS weak_gaps FROM z WHERE gap_strength >= 0.01 GROUP BY 1""")
def gap_summary(t: Tables) -> DataFrame:
    return gaps.summary(gap_rows(t))


@query(GAP_SQL + "SELECT user_id, string_agg(pattern_id, ',' ORDER BY gap_strength DESC, pattern_id) AS patterns FROM z WHERE gap_strength >= 0.01 GROUP BY 1")
def gaps_by_strength(t: Tables) -> DataFrame:
    return gaps.by_strength(gap_rows(t)).select("user_id", F.array_join("patterns", ",").alias("patterns"))


@query(""" SELECT user_id, arg_max(detected_pattern, (detected_confidence, -id)) AS primary_pattern, max(detected_confidence) AS confidence FROM submissions WHERE detected_confidence > 0 GROUP BY 1""")
def primary_detection(t: Tables) -> DataFrame:
    return t.submissions.filter("detected_confidence > 0").groupBy("user_id").agg(F.max_by("detected_pattern", F.struct("detected_confidence", -F.col("id"))).alias("primary_pattern"), F.max("detected_confidence").alias("confidence"))


@query(""" SELECT CASE WHEN detected_confidence >= 0.8 THEN 'high' WHEN detected_confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(detected_confidence), 6) AS mean FROM submissions GROUP BY 1""")
def confidence_bands(t: Tables) -> DataFrame:
    band = F.when(F.col("detected_confidence") >= 0.8, "high").when(F.col("detected_confidence") >= 0.4, "medium").otherwise("low")
    return t.submissions.groupBy(band.alias("band")).agg(F.count("*").alias("n"), r6(F.avg("detected_confidence")).alias("mean"))


# ---- evaluation and quality


@query("""
SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE source END AS detector, count(*) FILTER (q = 1 AND x = 1) AS tp, count(*) FILTER (q = 1 AND x = 0) AS fn, count(*) FILTER (q = 0 AND x = 1) AS fp, count(*) FILTER (q = 0 AND x = 0) AS tn,
  coalesce(round(count(*) FILTER (q = 1 AND x = 1) / nullif(count(*) FILTER (x = 1), 0), 6), 0) AS precision, coalesce(round(count(*) FILTER (q = 1 AND x = 1) / nullif(count(*) FILTER (q = 1), 0), 6), 0) AS recall,
  coalesce(round(2 * count(*) FILTER (q = 1 AND x = 1) / nullif(count(*) FILTER (x = 1) + count(*) FILTER (q = 1), 0), 6), 0) AS f1
FROM (SELECT d.source, l.quality AS q, l.toxic AS x FROM labels l JOIN documents d USING (doc_id)) GROUP BY ROLLUP (source)""", plain=True)
def confusion_metrics(t: Tables) -> DataFrame:
    rows = t.read("labels").join(t.read("documents").select("doc_id", "source"), "doc_id")
    return quality.confusion(rows.select(F.col("source").alias("detector"), (F.col("quality") == 1).alias("label"), (F.col("toxic") == 1).alias("predicted")))


@query(" SELECT detected_pattern, round(detected_confidence, 1) AS bucket, count(*) AS n FROM submissions GROUP BY 1, 2")
def confidence_histogram(t: Tables) -> DataFrame:
    return t.submissions.groupBy("detected_pattern", F.round("detected_confidence", 1).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
, d AS (SELECT DISTINCT problem_id, detected_pattern AS p FROM submissions), c AS (SELECT p, count(*) AS n FROM d GROUP BY 1)
SELECT a.p AS d1, b.p AS d2, coalesce(s.n, 0) AS both, round(coalesce(s.n, 0) / a.n, 6) AS share FROM c a JOIN c b ON a.p <> b.p
LEFT JOIN (SELECT x.p AS p, y.p AS q, count(*) AS n FROM d x JOIN d y USING (problem_id) GROUP BY 1, 2) s ON s.p = a.p AND s.q = b.p""")
def overlap_matrix(t: Tables) -> DataFrame:
    return quality.overlap(t.submissions.select(F.col("problem_id").alias("case"), F.col("detected_pattern").alias("detector")))


@query("""
SELECT 'orphan_problem' AS check_, count(*) AS violations FROM raw_submissions s WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.id = s.problem_id)
UNION ALL SELECT 'bad_verdict', count(*) FROM submissions WHERE verdict NOT IN ('pass', 'fail', 'error', 'tle')
UNION ALL SELECT 'bad_difficulty', count(*) FROM problems WHERE difficulty NOT IN ('Easy', 'Medium', 'Hard')
UNION ALL SELECT 'confidence_range', count(*) FROM submissions WHERE NOT detected_confidence BETWEEN 0 AND 1
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM submissions GROUP BY 1 HAVING count(*) > 1)""")
def constraint_checks(t: Tables) -> DataFrame:
    return quality.violations(t.submissions, t.problems)


@query(LIVE_SQL + GAP_SQL + """
SELECT 'elo_floor' AS check_, count(*) AS violations FROM profiles WHERE elo_rating < 400
UNION ALL SELECT 'accuracy_range', count(*) FROM profiles WHERE NOT accuracy BETWEEN 0 AND 1
UNION ALL SELECT 'duplicate_profile', count(*) FROM (SELECT 1 FROM profiles GROUP BY user_id, topic HAVING count(*) > 1)
UNION ALL SELECT 'gap_range', count(*) FROM z WHERE gap_strength >= 0.01 AND NOT gap_strength BETWEEN 0 AND 1
UNION ALL SELECT 'gap_frequency', count(*) FROM z WHERE gap_strength >= 0.01 AND frequency < 0
UNION ALL SELECT 'duplicate_gap', count(*) FROM (SELECT 1 FROM z WHERE gap_strength >= 0.01 GROUP BY user_id, pattern_id HAVING count(*) > 1)
UNION ALL SELECT 'attempt_number', 0 UNION ALL SELECT 'cascade', count(*) FROM profiles WHERE user_id NOT IN (SELECT user_id FROM submissions)""")
def serving_checks(t: Tables) -> DataFrame:
    return quality.serving_violations(profiles(t), gap_rows(t), windows.attempts(t.submissions), t.submissions.select("user_id").distinct())


@query(""", o AS (SELECT user_id, id, submitted_at, verdict, row_number() OVER w - row_number() OVER (PARTITION BY user_id, verdict ORDER BY submitted_at, id) AS island, lag(verdict) OVER w <> verdict AS changed,
  count(*) FILTER (verdict <> 'pass') OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM submissions WINDOW w AS (PARTITION BY user_id ORDER BY submitted_at, id)),
isl AS (SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, count(*) AS n FROM o GROUP BY user_id, verdict, island) GROUP BY 1)
SELECT user_id, any_value(longest_run) AS longest_run, count(*) FILTER (changed) AS switches, count(*) FILTER (broken = 0) AS pass_run FROM o JOIN isl USING (user_id) GROUP BY 1""")
def run_summaries(t: Tables) -> DataFrame:
    """Verdicts' longest run, changes, and passes at the end: summaries of the first half of the month, merged with the rest's."""
    late = F.col("submitted_at") >= F.lit("2024-01-16").cast("timestamp")

    def of(value):
        before = runs.merged(runs.summaries(t.submissions.filter(~late), value))
        return written(runs.merged(runs.summaries(t.submissions.filter(late), value), before))

    whole, passes = of(F.col("verdict")), of(F.col("verdict") == "pass")
    both = runs.longest_runs(whole).join(runs.switches(whole).select("user_id", "switches"), "user_id")
    return both.join(runs.leading_run(passes).withColumnRenamed("run", "pass_run"), "user_id")


DIRTY_SQL = """, dirty AS (SELECT id, user_id, CASE WHEN id % 31 = 5 THEN problem_id + 1000000000 ELSE problem_id END AS problem_id, CASE WHEN id % 19 = 3 THEN 'maybe' ELSE verdict END AS verdict,
    CASE WHEN id % 23 = 7 THEN NULL ELSE topic END AS topic, CASE WHEN id % 17 = 2 THEN detected_confidence + 1.5 ELSE detected_confidence END AS detected_confidence, submitted_at, gap_identified, 0 AS copy FROM submissions),
batch AS (SELECT * FROM dirty UNION ALL SELECT * REPLACE ('error' AS verdict, 1 AS copy) FROM dirty WHERE id % 29 = 4),
ruled AS (SELECT *, detected_confidence > 1 AS r1, verdict NOT IN ('pass', 'fail', 'error', 'tle') AS r2, topic IS NULL AS r3, problem_id > 1000000000 AS r4, id % 13 = 6 AS r5,
  row_number() OVER (PARTITION BY id ORDER BY CASE WHEN detected_confidence > 1 OR verdict NOT IN ('pass', 'fail', 'error', 'tle') OR topic IS NULL THEN 1 ELSE 0 END, verdict <> 'error') > 1 AS r6 FROM batch)"""


@query(DIRTY_SQL + """
SELECT 'detected_confidence_range' AS rule, count(*) FILTER (r1) AS n FROM ruled UNION ALL SELECT 'verdict_known', count(*) FILTER (r2) FROM ruled UNION ALL SELECT 'topic_missing', count(*) FILTER (r3) FROM ruled
UNION ALL SELECT 'problem_id_unknown', count(*) FILTER (r4) FROM ruled UNION ALL SELECT 'key_exists', count(*) FILTER (r5) FROM ruled UNION ALL SELECT 'repeated_key', count(*) FILTER (r6) FROM ruled
UNION ALL SELECT 'passed', count(*) FILTER (NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6)) FROM ruled""")
def gate_violations(t: Tables) -> DataFrame:
    """A batch with planted violations of each rule at the gate: rows by broken rule, and those that passed."""
    rows = t.submissions.select("id", "user_id", "problem_id", "verdict", "topic", "detected_confidence", "submitted_at", "gap_identified")
    spoilt = lambda k, n, c, bad: F.when(F.col("id") % k == n, bad).otherwise(F.col(c)).alias(c)
    dirty = rows.select(
        "id", "user_id", spoilt(31, 5, "problem_id", F.col("problem_id") + 1_000_000_000), spoilt(19, 3, "verdict", F.lit("maybe")), spoilt(23, 7, "topic", F.lit(None)),
        spoilt(17, 2, "detected_confidence", F.col("detected_confidence") + 1.5), "submitted_at", "gap_identified",
    )
    batch = dirty.unionByName(dirty.filter("id % 29 = 4").withColumn("verdict", F.lit("error")))
    found = written(gate.judged(batch, gate.TABLES["submissions"], rows.filter("id % 13 = 6"), {"problem_id": t.problems.select("id")}))
    broken = found.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return broken.unionByName(found.filter(F.size("broken") == 0).agg(F.lit("passed").alias("rule"), F.count("*").alias("n")))


#: Folders of serving tables by application and input: the queries below read the same ones.
_SERVED: dict[tuple[str, str], str] = {}


def _persisted(t: Tables) -> str:
    """Two batches of submissions through all serving tables: their folder."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _SERVED:
        root = f"{shared_dir(t.spark)}/kalmia/serving-{uuid.uuid4().hex}"
        forget_at_exit(t.spark, root)
        late = F.col("submitted_at") >= F.lit("2024-01-16").cast("timestamp")
        for batch, part in enumerate((t.submissions.filter(~late), t.submissions.filter(late))):
            submissions.persist(part, t.problems, root, batch, places=None)
        _SERVED[key] = root
    return _SERVED[key]


@query(LIVE_SQL + PROFILE_SQL)
def persisted_profiles(t: Tables) -> DataFrame:
    """Two batches of submissions through all serving tables; the profiles as readers see them."""
    return shown(serving.published(t.spark, _persisted(t), "topic_profiles", before=2))


@query(RATED_SQL.format(drift="1", k="k"))
def persisted_elos(t: Tables) -> DataFrame:
    """The pattern ratings that the same batches publish."""
    return serving.published(t.spark, _persisted(t), "user_pattern_elo", before=2).select("user_id", "pattern_id", r6("elo").alias("elo"), "updates")


@query(REPLAY_SQL + """, gone AS (SELECT user_id FROM submissions WHERE user_id % 3 = 0),
kept AS (SELECT * FROM submissions WHERE user_id NOT IN (SELECT user_id FROM gone))
SELECT 'submissions' AS name, count(*) AS n, count(DISTINCT user_id) AS users FROM kept
UNION ALL SELECT 'topic_profiles', count(*), count(DISTINCT user_id) FROM (SELECT DISTINCT user_id, topic FROM kept)
UNION ALL SELECT 'gap_signals', count(*), count(DISTINCT user_id) FROM (SELECT DISTINCT user_id, pattern_id FROM raw WHERE s >= 0.01 AND user_id NOT IN (SELECT user_id FROM gone))
UNION ALL SELECT 'user_pattern_elo', count(*), count(DISTINCT user_id) FROM (SELECT DISTINCT user_id, pattern_id FROM scored WHERE user_id NOT IN (SELECT user_id FROM gone))
UNION ALL SELECT 'streaks', count(DISTINCT user_id), count(DISTINCT user_id) FROM kept
UNION ALL SELECT 'attempts', count(*), count(DISTINCT user_id) FROM (SELECT DISTINCT user_id, problem_id FROM kept)
UNION ALL SELECT 'states', count(DISTINCT user_id), count(DISTINCT user_id) FROM kept
UNION ALL SELECT 'recommendations', count(*), count(DISTINCT user_id) FROM (SELECT user_id FROM kept GROUP BY user_id, submitted_at < TIMESTAMP '2024-01-16')""")
def deleted_users(t: Tables) -> DataFrame:
    """Rows of each serving table once a third batch has deleted every third user."""
    root = _persisted(t)
    serving.delete_owners(t.spark, t.users.filter("user_id % 3 = 0"), root, 2)
    counts = [serving.published(t.spark, root, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users")) for n in submissions.KEYS if n not in ("quarantine", "snapshots")]
    return functools.reduce(DataFrame.unionByName, counts)


@query("""SELECT CAST(40 + row_number() OVER (ORDER BY p_brand, p_type, p_partkey) AS BIGINT) AS id, p_partkey AS part FROM part""", plain=True)
def dense_ids(t: Tables) -> DataFrame:
    """Ids for new rows in a natural order."""
    return ordering.numbered(t.read("part").select(F.col("p_partkey").alias("part"), "p_brand", "p_type"), ["p_brand", "p_type", "part"], after=40).select("id", "part")


@query(""", placed AS (SELECT id, title, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM problems WHERE difficulty <> 'Hard')
SELECT 1 AS page, id, title FROM placed WHERE pos < 20 UNION ALL SELECT 2, id, title FROM placed WHERE pos // 20 = n // 40 UNION ALL SELECT 3, id, title FROM placed WHERE pos // 20 = (n - 1) // 20""")
def deep_pages(t: Tables) -> DataFrame:
    """The first, a middle and the last page of a filtered bank, each read from its own range."""
    where = f"{shared_dir(t.spark)}/kalmia/pages-{uuid.uuid4().hex}"
    forget_at_exit(t.spark, where)
    pages = ordering.paged(t.problems.filter("difficulty <> 'Hard'").select("id", "title"), ["id"], where, ranges=16)
    numbers = (1, pages.total // 40 + 1, (pages.total - 1) // 20 + 1)
    return functools.reduce(DataFrame.unionByName, [pages.page(n, 20).select(F.lit(i).alias("page"), "id", "title") for i, n in enumerate(numbers, 1)])


# ---- recommendations

WEAK_SQL = LIVE_SQL + """
, weak AS (SELECT user_id, topic, elo_rating, accuracy, recent_failures, round((1600 - elo_rating) / 1200 + (1 - accuracy) + least(recent_failures, 5) / 3, 6) AS weakness FROM profiles WHERE topic IN (SELECT primary_pattern FROM problems)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weakness DESC, round(elo_rating, 6), accuracy, topic) AS rn, CASE WHEN elo_rating < 1000 THEN 'Easy' WHEN elo_rating <= 1300 THEN 'Medium' ELSE 'Hard' END AS level FROM weak),
best AS (SELECT r.user_id, r.topic, r.rn, r.level, p.id AS problem_id, p.primary_pattern, row_number() OVER (PARTITION BY r.user_id, r.topic ORDER BY coalesce(p.acceptance_rate, 0) DESC, p.id) AS pick
  FROM ranked r JOIN problems p ON p.difficulty = r.level AND (p.primary_pattern = r.topic OR p.topics LIKE '%' || r.topic || '%')
  WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.user_id = r.user_id AND s.problem_id = p.id AND s.verdict = 'pass')),
options AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS place FROM best WHERE pick = 1)"""


def weak(t: Tables, k: int = 33, known: DataFrame | None = None) -> DataFrame:
    return recommend.weakest_topics(profiles(t) if known is None else known, t.problems.select(F.col("primary_pattern").alias("topic")).distinct(), k)


def options(t: Tables) -> DataFrame:
    rows = weak(t)
    return recommend.rotation(rows, recommend.topic_problems(bank_of(t), rows), t.submissions)


@query(WEAK_SQL + " SELECT user_id, topic, rn, weakness FROM ranked WHERE rn <= 5")
def weakest_topics(t: Tables) -> DataFrame:
    return weak(t, 5).select("user_id", "topic", F.col("rn").cast("bigint").alias("rn"), "weakness")


@query(LIVE_SQL + " SELECT DISTINCT topic FROM profiles WHERE topic IN (SELECT primary_pattern FROM problems)")
def recommendable_topics(t: Tables) -> DataFrame:
    return profiles(t).join(t.problems.select(F.col("primary_pattern").alias("topic")), "topic", "left_semi").select("topic").distinct()


@query(LIVE_SQL + " SELECT user_id, topic, CASE WHEN elo_rating < 1000 THEN 'Easy' WHEN elo_rating <= 1300 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM profiles")
def difficulty_for_user(t: Tables) -> DataFrame:
    return profiles(t).select("user_id", "topic", R.difficulty_for(F.col("elo_rating")).alias("difficulty"))


ROTATE_SQL = WEAK_SQL + """
, cur AS (SELECT user_id, topic AS current_topic FROM submissions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) = 1),
rot AS (SELECT c.user_id, c.current_topic, coalesce((SELECT arg_min(primary_pattern, place) FROM options o WHERE o.user_id = c.user_id AND o.topic <> c.current_topic), c.current_topic) AS new_topic FROM cur c)"""


@query(ROTATE_SQL + " SELECT user_id, current_topic, new_topic FROM rot")
def rotate_topic(t: Tables) -> DataFrame:
    current = windows.latest(t.submissions, ["user_id"], 1).select("user_id", F.col("topic").alias("current_topic"))
    return recommend.rotate_topic(current, options(t)).select("user_id", "current_topic", "new_topic")


@query("""
, l AS (SELECT user_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) AS rn FROM submissions)
SELECT user_id, count(*) = 2 AND count(DISTINCT topic) = 1 AS same_twice FROM l WHERE rn <= 2 GROUP BY 1""")
def diversity_check(t: Tables) -> DataFrame:
    return windows.latest(t.submissions, ["user_id"], 2).groupBy("user_id").agg(((F.count("*") == 2) & (F.count_distinct("topic") == 1)).alias("same_twice"))


CHAIN_SQL = WEAK_SQL + """
, u AS (SELECT DISTINCT user_id FROM submissions), passed AS (SELECT DISTINCT user_id, problem_id FROM submissions WHERE verdict = 'pass'),
scan AS (SELECT user_id, arg_min(primary_pattern, place) AS topic, arg_min(level, place) AS difficulty, arg_min(problem_id, place) AS problem_id FROM options GROUP BY 1),
any_ AS (SELECT r.user_id, p.primary_pattern AS topic, p.difficulty, p.id AS problem_id FROM ranked r JOIN problems p ON p.primary_pattern = r.topic OR p.topics LIKE '%' || r.topic || '%'
  WHERE r.rn = 1 AND NOT EXISTS (SELECT 1 FROM passed s WHERE s.user_id = r.user_id AND s.problem_id = p.id)
  QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY CASE p.difficulty WHEN 'Easy' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, coalesce(p.acceptance_rate, 0) DESC, p.id) = 1),
first_ AS (SELECT u.user_id, p.primary_pattern AS topic, p.difficulty, p.id AS problem_id FROM u, problems p WHERE NOT EXISTS (SELECT 1 FROM passed s WHERE s.user_id = u.user_id AND s.problem_id = p.id)
  QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY p.difficulty, coalesce(p.acceptance_rate, 0) DESC, p.id) = 1),
chain AS (SELECT user_id, 1 AS step, topic, difficulty, problem_id FROM scan UNION ALL SELECT user_id, 2, topic, difficulty, problem_id FROM any_ UNION ALL SELECT user_id, 3, topic, difficulty, problem_id FROM first_)"""
NEXT_SQL = "SELECT user_id, arg_min(topic, step) AS topic, arg_min(difficulty, step) AS difficulty, arg_min(problem_id, step) AS problem_id FROM chain GROUP BY 1"


@query(f"{CHAIN_SQL} {NEXT_SQL}")
def standalone_recommendation(t: Tables) -> DataFrame:
    """Asked for a fresh one: an active recommendation doesn't count."""
    rows, bank_ = weak(t), bank_of(t)
    return recommend.standalone(t.users, rows, recommend.topic_problems(bank_, rows), bank_, t.submissions)


@query(CHAIN_SQL.removesuffix(")") + """ UNION ALL SELECT s.user_id, 0, s.topic, coalesce(p.difficulty, 'Easy'), s.problem_id
  FROM (SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) = 1) s LEFT JOIN problems p ON p.id = s.problem_id WHERE s.verdict <> 'pass') """ + NEXT_SQL)
def next_recommendation(t: Tables) -> DataFrame:
    """An active recommendation, where there is one (its stand-in: the latest submission that wasn't passed), else the chain."""
    rows, bank_ = weak(t), bank_of(t)
    active = recommend.active(t.submissions, t.users, t.problems).withColumn("difficulty", F.coalesce("difficulty", F.lit("Easy")))
    return recommend.standalone(t.users, rows, recommend.topic_problems(bank_, rows), bank_, t.submissions, active)


#: Every pattern of the bank for every user, with gap signals and the default Elo.
SCORES_SQL = LIVE_SQL + GAP_SQL + """
, bank AS (SELECT DISTINCT id, acceptance_rate, unnest(CAST(json_extract_string(pattern, '$[*]') AS VARCHAR[])) AS pattern_id FROM problems),
solved AS (SELECT DISTINCT user_id, coalesce(nullif(detected_pattern, ''), topic) AS pattern_id FROM submissions WHERE verdict = 'pass'),
sc AS (SELECT u.user_id, b.pattern_id, coalesce(p.elo_rating, 1200) AS elo,
  round((coalesce(g.gap_strength, 0) * 0.5 + greatest(0, (1200 - coalesce(p.elo_rating, 1200)) / 1200) * 0.5) * CASE WHEN s.user_id IS NULL THEN 1.0 ELSE 0.5 END, 6) AS score
  FROM (SELECT DISTINCT user_id FROM submissions) u CROSS JOIN (SELECT DISTINCT pattern_id FROM bank) b LEFT JOIN profiles p ON p.user_id = u.user_id AND p.topic = b.pattern_id
  LEFT JOIN (SELECT * FROM z WHERE gap_strength >= 0.01) g ON g.user_id = u.user_id AND g.pattern_id = b.pattern_id LEFT JOIN solved s ON s.user_id = u.user_id AND s.pattern_id = b.pattern_id)"""
TOP_SQL = SCORES_SQL + """,
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pattern_id) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pattern_id) <= 5),
opt AS (SELECT t.*, b.id, NOT EXISTS (SELECT 1 FROM submissions s WHERE s.user_id = t.user_id AND s.problem_id = b.id AND s.verdict = 'pass') AS open, b.acceptance_rate FROM top t JOIN bank b USING (pattern_id)),
pk AS (SELECT *, row_number() OVER (PARTITION BY user_id, pattern_id ORDER BY open DESC, coalesce(acceptance_rate, 0) DESC, id) AS pick FROM opt)
SELECT user_id, rank, pattern_id, id AS problem_id, score, CASE WHEN elo < 1000 THEN 0.0 WHEN elo <= 1300 THEN 0.5 ELSE 1.0 END::DOUBLE AS difficulty_score, round(least(1, score * 0.7 + CASE WHEN open THEN 0.2 ELSE 0 END), 4) AS expected_learning_gain,
  CASE WHEN score >= 0.7 THEN 'Significant weakness detected in ' || replace(pattern_id, '_', ' ') || '. High priority for improvement.' WHEN score >= 0.4 THEN 'Moderate gap identified in ' || replace(pattern_id, '_', ' ') || '. Regular practice recommended.'
    WHEN open THEN 'Unfamiliar territory: ' || replace(pattern_id, '_', ' ') || '. Start building foundational skills.' ELSE 'Balanced practice opportunity in ' || replace(pattern_id, '_', ' ') || '.' END AS reason FROM pk WHERE pick = 1"""


def patterned(t: Tables) -> DataFrame:
    return t.problems.select("id", "acceptance_rate", F.explode(T.string_list(F.col("pattern"))).alias("pattern_id")).distinct()


def scored(t: Tables, bank_: DataFrame) -> DataFrame:
    return recommend.pattern_scores(t.users, bank_, profiles(t), gap_rows(t))


@query(TOP_SQL)
def top5_recommendation(t: Tables) -> DataFrame:
    bank_ = patterned(t)
    return recommend.top_recommendations(scored(t, bank_), bank_, t.submissions).withColumn("rank", F.col("rank").cast("bigint"))


@query(SCORES_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pattern_id) AS rank FROM sc)
SELECT user_id, CASE WHEN count(*) FILTER (score >= 0.7) >= 2 OR count(*) FILTER (score >= 0.4) >= 3 THEN 'reinforce_weakest' WHEN bool_and(rank > 5 OR elo >= 1200) THEN 'broaden_coverage' ELSE 'balanced_maintenance' END AS strategy,
  'Focus on ' || max(area) FILTER (rank = 1) || CASE WHEN max(area) FILTER (rank = 2) <> max(area) FILTER (rank = 1) THEN ', ' || max(area) FILTER (rank = 2)
    WHEN max(area) FILTER (rank = 3) <> max(area) FILTER (rank = 1) THEN ', ' || max(area) FILTER (rank = 3) ELSE '' END AS focus_area,
  string_agg(pattern_id, ',' ORDER BY rank) FILTER (rank <= 3) AS primary_weak_patterns
FROM rk JOIN (SELECT pattern_id, CASE category WHEN 'arrays' THEN 'Arrays' WHEN 'trees_graphs' THEN 'Trees Graphs' WHEN 'dp' THEN 'Dp' WHEN 'linked_lists' THEN 'Linked Lists'
  WHEN 'binary_search' THEN 'Binary Search' ELSE 'Greedy Backtracking' END AS area FROM pattern_dim) USING (pattern_id) GROUP BY 1""")
def recommendation_strategy(t: Tables) -> DataFrame:
    bank_ = patterned(t)
    ranked = recommend.weak_patterns(scored(t, bank_), bank_, t.submissions)
    return recommend.strategy(ranked, t.submissions.groupBy("user_id").agg(F.count("*").alias("total")))


class _Once(Tables):
    """Tables for queries that read submissions many times: joined with the bank once, then written."""

    @functools.cached_property
    def submissions(self) -> DataFrame:
        return written(super().submissions)


@query()  # ten exits with texts: tests hold it against a plain decision ladder
def gated_recommendation(t: Tables) -> DataFrame:
    """What several branches read is written once: submissions, profiles, the topics' problems and the rows (one a user) so far."""
    t = _Once(t.spark, t.sf_dir)
    subs, bank_ = t.submissions, bank_of(t)
    last = leveled(t).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("submitted_at"), F.desc("id")))).filter("rn = 1")
    last = last.select("user_id", F.col("problem_id").alias("current_id"), "verdict", F.col("gap_identified").alias("gap_detected"), F.col("detected_confidence").alias("confidence"), F.coalesce("detected_pattern", "topic").alias("topic"), "difficulty")
    known = written(profiles(t))
    prof = known.select("user_id", "topic", "elo_rating", "recent_failures")
    locks = windows.latest(subs, ["user_id", "topic"], 3).groupBy("user_id", "topic").agg(((F.count("*") == 3) & F.bool_and(F.col("verdict") == "pass")).alias("locked_pass"))
    runs = windows.leading_run(subs, ["user_id", "topic"], F.col("verdict") == "pass")
    rows = last.join(prof, ["user_id", "topic"], "left").join(locks, ["user_id", "topic"], "left").join(runs, ["user_id", "topic"], "left").join(diversity_check(t), "user_id", "left")
    rows = written(rows.withColumn("user_difficulty", R.difficulty_for(F.coalesce("elo_rating", F.lit(R.START)))))
    # Profiles' topics are patterns of this dimension too, so the turn below picks from the same problems.
    open_topics = written(recommend.topic_problems(bank_, t.pattern_dim.select(F.col("pattern_id").alias("topic"))))
    current = rows.select("user_id", F.col("current_id").alias("id"))
    levels = ("Easy", "Medium", "Hard")
    wanted = rows.select("user_id", "topic", F.explode(F.array(*map(F.lit, levels))).alias("difficulty"))
    best = recommend.ranked_unsolved(wanted, open_topics, subs, current).groupBy("user_id", "topic").agg(*[F.max(F.when(F.col("difficulty") == d, F.col("problem_id"))).alias(f"best_{d}") for d in levels])
    rows = rows.join(best, ["user_id", "topic"], "left")
    at = lambda level: F.when(level == "Easy", F.col("best_Easy")).when(level == "Medium", F.col("best_Medium")).otherwise(F.col("best_Hard"))
    rows = rows.withColumns({
        "problem_pass": at(R.moved(F.col("difficulty"), F.lit(1))), "problem_fail": at(R.moved(F.col("difficulty"), F.lit(-1))), "problem_user": at(F.col("user_difficulty")),
    })
    choices = recommend.rotation(weak(t, known=known), open_topics, subs)
    turn = recommend.rotate_topic(rows.select("user_id", F.col("topic").alias("current_topic")), choices).select("user_id", "new_topic")
    rows = rows.join(turn, "user_id", "left")
    new_level = prof.select("user_id", F.col("topic").alias("new_topic"), R.difficulty_for(F.col("elo_rating")).alias("new_difficulty"))
    rows = written(rows.join(new_level, ["user_id", "new_topic"], "left").withColumn("new_difficulty", F.coalesce("new_difficulty", F.lit("Easy"))))
    new_problem = recommend.ranked_unsolved(rows.select("user_id", F.col("new_topic").alias("topic"), F.col("new_difficulty").alias("difficulty")), open_topics, subs).select("user_id", F.col("topic").alias("new_topic"), F.col("problem_id").alias("new_problem_id"))
    rows = rows.join(new_problem, ["user_id", "new_topic"], "left")
    no = F.lit(False)
    done = recommend.gated(rows.withColumns({
        "companion": no, "locked_pass": F.coalesce("locked_pass", no), "locked_fail": F.coalesce(F.col("recent_failures") >= 3, no), "same_twice": F.coalesce("same_twice", no),
    }))
    words = recommend.explanation(F.col("tier"), F.col("branch"), F.col("chosen_topic"), F.col("topic"), F.col("verdict"), F.col("gap_detected"), F.col("chosen_problem_id"), F.col("difficulty"), F.col("chosen_difficulty"), F.coalesce("run", F.lit(0)))
    return done.select("user_id", "branch", "tier", F.round("confidence", 2).alias("confidence"), F.col("chosen_topic").alias("topic"), F.col("chosen_difficulty").alias("difficulty"), F.col("chosen_problem_id").alias("problem_id"), words.alias("explanation"), recommend.problem_url(F.col("chosen_topic"), F.col("chosen_difficulty")).alias("url"))


@query("""
SELECT s.user_id, s.id, s.topic, p.difficulty FROM (SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, id DESC) = 1) s
JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = s.user_id LEFT JOIN problems p ON p.id = s.problem_id WHERE s.verdict <> 'pass'""")
def active_recommendations(t: Tables) -> DataFrame:
    return recommend.active(t.submissions, t.read("events").select("user_id").distinct(), t.problems).drop("problem_id")


@query(" SELECT pattern_id, label, 'https://leetcode.com/problemset/?topicSlugs=' || tag || '&difficulty=MEDIUM' AS url FROM pattern_dim")
def pattern_links(t: Tables) -> DataFrame:
    return t.pattern_dim.select("pattern_id", T.humanised(F.col("pattern_id")).alias("label"), recommend.problem_url(F.col("pattern_id"), F.lit("Medium")).alias("url"))


# ---- text, JSON, times


def html_sql() -> str:
    out = "coalesce(html, '')"
    for p, to in T.HTML_STEPS:
        out = f"regexp_replace({out}, '{p.removeprefix('(?s)')}', E'{to.encode('unicode_escape').decode()}', '{'gs' if p.startswith('(?s)') else 'g'}')"
    return f"SELECT page_id, regexp_replace({out}, '^\\s+|\\s+$', '', 'g') AS text FROM pages"


@query(html_sql(), plain=True)
def html_to_text(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("SELECT page_id, coalesce(regexp_extract(replace(url, '/', '/problems/'), '/problems/([^/]*)', 1), '') AS slug, coalesce(regexp_extract(url, '([^/]+)/*$', 1), '') AS last FROM pages", plain=True)
def url_slug(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", T.url_slug(F.replace("url", F.lit("/"), F.lit("/problems/"))).alias("slug"), T.last_segment(F.col("url")).alias("last"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", plain=True)
def event_props(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(" SELECT id, array_to_string(list_sort([lower(replace(trim(x), ' ', '_')) FOR x IN string_split(topics, ' ') IF trim(x) <> '']), ',') AS topics FROM problems")
def topics_parse(t: Tables) -> DataFrame:
    return t.problems.select("id", F.array_join(F.array_sort(F.transform(T.topics_list(F.replace("topics", F.lit(" "), F.lit(", "))), T.normalised)), ",").alias("topics"))


@query(" SELECT p.id, p.primary_pattern AS patterns, round(CAST(least(1.0, p.id / 1000.0) AS DOUBLE), 6) AS confidence FROM problems p")
def llm_reply_parse(t: Tables) -> DataFrame:
    spoken = F.concat(F.lit('```json\n{"patterns": ["'), F.upper(F.translate("primary_pattern", "_", "-")), F.lit('", "no such thing"], "confidence": {"x": '), (F.col("id") / 1000.0).cast("string"), F.lit("}}\n```"))
    rows = t.problems.select("id", T.model_reply(spoken).alias("r"))
    return rows.select("id", F.array_join(T.known_patterns(F.col("r.patterns")), ",").alias("patterns"), r6(T.clamped(F.array_max(F.map_values("r.confidence")))).alias("confidence"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END, TIMESTAMP '2000-01-01') AS at FROM events", plain=True)
def iso_parse(t: Tables) -> DataFrame:
    iso = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.read("events").select("event_id", T.parsed_time(iso).cast("timestamp_ntz").alias("at"))


@query("""
, codes AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'x = eval(y)' WHEN 1 THEN 'import subprocess' WHEN 2 THEN '  ' WHEN 3 THEN 'reopen(f)' ELSE 'x = 1' END AS code FROM part)
SELECT id, CASE id % 5 WHEN 0 THEN 'Unsafe construct detected: eval(' WHEN 1 THEN 'Dangerous import detected: subprocess' WHEN 2 THEN 'Code string cannot be empty' WHEN 3 THEN 'Unsafe construct detected: open(' END AS error FROM codes""")
def unsafe_code_filter(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, "x = eval(y)").when(k == 1, "import subprocess").when(k == 2, "  ").when(k == 3, "reopen(f)").otherwise("x = 1")
    return t.read("part").select(F.col("p_partkey").alias("id"), T.unsafe(code).alias("error"))


# ---- versioned writes


@query("""
, new AS (SELECT c_custkey + 500 AS k, 'new' AS v, 2 AS created FROM customer), old AS (SELECT c_custkey AS k, 'old' AS v, 1 AS created FROM customer)
SELECT coalesce(old.k, new.k) AS k, coalesce(new.v, old.v) AS v, coalesce(old.created, new.created) AS created_at FROM old FULL JOIN new ON old.k = new.k""")
def upsert_rows(t: Tables) -> DataFrame:
    old = t.read("customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("created_at"))
    new = t.read("customer").select((F.col("c_custkey") + 500).alias("k"), F.lit("new").alias("v"), F.lit(2).alias("created_at"))
    return bank.upsert(old, new, ["k"])


@query("""
SELECT c_custkey AS k, 'old' AS v FROM customer UNION ALL SELECT c_custkey + 500, 'new' FROM customer WHERE c_custkey + 500 NOT IN (SELECT c_custkey FROM customer)""", plain=True)
def insert_or_ignore(t: Tables) -> DataFrame:
    old = t.read("customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return bank.insert_or_ignore(old, t.read("customer").select((F.col("c_custkey") + 500).alias("k"), F.lit("new").alias("v")), ["k"])


@query("SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN true ELSE false END AS acted_on FROM events", plain=True)
def mark_acted_on(t: Tables) -> DataFrame:
    rows = t.read("events").select("event_id", "user_id", "event_type", F.lit(False).alias("acted_on"))
    return bank.point_update(rows, F.col("event_type") == "view", {"acted_on": F.lit(True)}).drop("event_type")


# ---- code analysis (no SQL parses Python: tests hold it against labelled samples)


def corpus(t: Tables) -> DataFrame:
    rows = [(f"{kind}:{name}", code) for kind, codes in (("positive", samples.POSITIVE), ("plain", samples.PLAIN)) for name, code in codes.items()]
    return t.spark.createDataFrame(rows, "name string, code string")


@query()
def detect_corpus(t: Tables) -> DataFrame:
    return detect.detections(corpus(t)).drop("place")


LABEL_SQL = "SELECT p.p_partkey AS id, l.detector, l.confidence FROM part p JOIN (VALUES " + ", ".join(f"({i}, '{p}', {c}::DOUBLE)" for i, (p, c, _) in enumerate(labelled.ROWS)) + f") l(ix, detector, confidence) ON p.p_partkey % {len(labelled.ROWS)} = l.ix"


def labelled_rows(t: Tables) -> DataFrame:
    """id, detector, expected, code: each part's labelled code; no two texts are equal."""
    cases = t.spark.createDataFrame([(i, *row) for i, row in enumerate(labelled.ROWS)], "ix bigint, detector string, expected double, code string")
    rows = t.read("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(labelled.ROWS)).cast("bigint").alias("ix"))
    return rows.join(F.broadcast(cases), "ix").select("id", "detector", "expected", F.concat("code", F.lit("\n# "), F.col("id").cast("string")).alias("code"))


def labelled_results(t: Tables) -> DataFrame:
    done = detect.analyze_codes(labelled_rows(t))
    mine = F.get(F.filter("detections", lambda d: d["pattern_id"] == F.col("detector")), 0)["confidence"]
    return done.select("id", "detector", "expected", F.coalesce(F.round(mine, 4), F.lit(0.0)).alias("confidence"))


@query(LABEL_SQL, plain=True)
def detect_labels(t: Tables) -> DataFrame:
    """What each detector finds in labelled code, one text for each part."""
    return labelled_results(t).select("id", "detector", "confidence")


@query(f"""
WITH x AS ({LABEL_SQL}) SELECT CASE WHEN grouping(detector) = 1 THEN 'overall' ELSE detector END AS detector, count(*) FILTER (confidence > 0) AS tp, 0::BIGINT AS fn, 0::BIGINT AS fp, count(*) FILTER (confidence = 0) AS tn,
  CASE WHEN count(*) FILTER (confidence > 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN count(*) FILTER (confidence > 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall,
  CASE WHEN count(*) FILTER (confidence > 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS f1, coalesce(round(avg(confidence) FILTER (confidence > 0), 6), 0.0) AS mean_confidence,
  coalesce(round(min(confidence) FILTER (confidence > 0), 6), 0.0) AS least_confidence FROM x GROUP BY ROLLUP (detector)""", plain=True)
def detect_label_quality(t: Tables) -> DataFrame:
    rows = labelled_results(t)
    return quality.confusion(rows.select("detector", (F.col("expected") > 0).alias("label"), (F.col("confidence") > 0).alias("predicted"), "confidence"))


@query()
def detect_errors(t: Tables) -> DataFrame:
    return detect.analyze_codes(corpus(t)).select("name", "error", F.size("detections").alias("n"))


@query()
def detect_and_match(t: Tables) -> DataFrame:
    rows = detect.analyze_codes(corpus(t)).withColumn("accepted_solution_groups", F.array(F.array(F.element_at(F.split("name", ":"), 2))))
    return matching.match(rows).select("name", "match_result", "confidence_score", F.array_join("unmatched_patterns", ",").alias("unmatched_patterns"))


@query()
def detect_quality(t: Tables) -> DataFrame:
    found = detect.detections(corpus(t)).select("name", F.col("pattern_id").alias("detector")).distinct().withColumn("predicted", F.lit(True))
    grid = corpus(t).select("name").join(F.broadcast(t.spark.createDataFrame([(d.pattern_id,) for d in detect.DETECTORS], "detector string")), F.lit(True))
    rows = grid.join(found, ["name", "detector"], "left").select("detector", (F.element_at(F.split("name", ":"), 2) == F.col("detector")).alias("label"), F.coalesce("predicted", F.lit(False)).alias("predicted"))
    return quality.confusion(rows)


@query()
def legacy_features(t: Tables) -> DataFrame:
    return weighted.with_features(corpus(t)).drop("code")


def _made_features(t: Tables) -> DataFrame:
    """Features from keys: every rule's condition is met by some rows and not by others."""
    flags = [(F.col("p_partkey").bitwiseXOR(F.col("p_partkey") * (i + 3)) % 5 < 2).alias(f) for i, f in enumerate(weighted.FLAGS)]
    return t.read("part").select(F.col("p_partkey").alias("id"), *flags, (F.col("p_partkey") % 3).cast("int").alias("has_return"), (F.col("p_partkey") % 4).cast("int").alias("max_loop_depth"))


FEATURE_SQL = "WITH f AS (SELECT p_partkey AS id, " + ", ".join(f"xor(p_partkey, p_partkey * {i + 3}) % 5 < 2 AS {f}" for i, f in enumerate(weighted.FLAGS)) + ", p_partkey % 3 AS has_return, p_partkey % 4 AS max_loop_depth FROM part) "


@query(FEATURE_SQL + " UNION ALL ".join(f"SELECT id, '{p}' AS pattern_id, {weighted.score_sql(p)} AS score FROM f" for p in weighted.RULES), plain=True)
def legacy_scores(t: Tables) -> DataFrame:
    return weighted.scores(_made_features(t))


@query()
def legacy_gap(t: Tables) -> DataFrame:
    wanted = F.element_at(F.split("name", ":"), 2)
    rows = weighted.scores(weighted.with_features(corpus(t)).filter("error IS NULL").drop("error", "code")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("pattern_id", "score"))).alias("scores"))
    return rows.select("name", weighted.gap(F.array(wanted), F.col("scores")).alias("g")).select("name", "g.*")


# ---- the read-through cache, the simulated learner, replies


@query("""
, wanted AS (SELECT DISTINCT problem_id AS id FROM submissions), cache AS (SELECT id, title FROM problems WHERE id % 3 <> 0)
SELECT w.id, c.title, c.id IS NOT NULL AS hit FROM wanted w LEFT JOIN cache c USING (id)""")
def cache_read_through(t: Tables) -> DataFrame:
    hits, misses = bank.read_through(t.submissions.select(F.col("problem_id").alias("id")).distinct(), t.problems.filter("id % 3 <> 0").select("id", "title"), ["id"])
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumns({"title": F.lit(None).cast("string"), "hit": F.lit(False)}))


@query(LIVE_SQL + """
, easy AS (SELECT * FROM problems WHERE difficulty = 'Easy'),
best AS (SELECT primary_pattern AS topic, id FROM easy QUALIFY row_number() OVER (PARTITION BY primary_pattern ORDER BY coalesce(acceptance_rate, 0) DESC, id) = 1),
pick AS (SELECT user_id, topic, id FROM profiles JOIN best USING (topic) QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY round((1600 - elo_rating) / 1200 + (1 - accuracy) + least(recent_failures, 5) / 3, 6) DESC, round(elo_rating, 6), accuracy, topic) = 1)
SELECT u.user_id, p.topic, coalesce(p.id, (SELECT min(id) FROM easy)) AS problem_id FROM (SELECT DISTINCT user_id FROM profiles) u LEFT JOIN pick p USING (user_id)""")
def starting_problem(t: Tables) -> DataFrame:
    return recommend.starting_problem(profiles(t), t.problems)


#: A learner for the query below.
RATES, FACTORS = {"Easy": 0.85, "Medium": 0.6}, {"prefix_sum": 1.3, "dp_2d_grid": 0.3}


@query("""
SELECT difficulty, primary_pattern AS topic, round(CASE difficulty WHEN 'Easy' THEN 0.85 WHEN 'Medium' THEN 0.6 ELSE 0.5 END * CASE primary_pattern WHEN 'prefix_sum' THEN 1.3 WHEN 'dp_2d_grid' THEN 0.3 ELSE 1.0 END, 6)::DOUBLE AS probability,
  count(*) AS problems FROM problems GROUP BY 1, 2, 3""")
def pass_probability(t: Tables) -> DataFrame:
    chance = r6(recommend.pass_probability(F.col("difficulty"), F.col("primary_pattern"), RATES, FACTORS))
    return t.problems.groupBy("difficulty", F.col("primary_pattern").alias("topic"), chance.alias("probability")).agg(F.count("*").alias("problems"))


@query(""" SELECT user_id, detected_pattern AS pattern_id, detected_confidence AS confidence FROM submissions QUALIFY row_number() OVER (PARTITION BY user_id, detected_pattern ORDER BY id) = 1""")
def resolved_overlaps(t: Tables) -> DataFrame:
    rows = windows.first_n(t.submissions, ["user_id", "detected_pattern"], [F.col("id")], 1)
    return rows.select("user_id", F.col("detected_pattern").alias("pattern_id"), F.col("detected_confidence").alias("confidence"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'u' || c_custkey END AS display_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'Arrays' ELSE 'Graphs' END AS first_topic, CASE WHEN c_custkey % 2 = 0 THEN '1;2 3' ELSE '' END AS test_cases, length(left(repeat(c_name, 100), 1000)) AS code_chars,
  '{"success":true,"data":{"id":' || c_custkey || '}}' AS reply FROM customer""", plain=True)
def reply_fields(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    name = T.display_name(F.when(key % 3 == 0, F.col("c_name")), F.when(key % 3 == 1, F.col("c_mktsegment")).otherwise(""), F.concat(F.lit("u"), key.cast("string"), F.lit("@mail.example")))
    cases = T.test_case_lines(F.when(key % 2 == 0, F.lit(" 1 \n\n2 3\n")))
    return t.read("customer").select(
        "c_custkey", name.alias("display_name"), T.first_topic(F.when(key % 2 == 0, F.lit(" Arrays, Sorting")).otherwise("Graphs")).alias("first_topic"), F.array_join(cases, ";").alias("test_cases"),
        F.char_length(T.stored_code(F.repeat("c_name", 100))).cast("bigint").alias("code_chars"), T.envelope(F.struct(key.alias("id"))).alias("reply"),
    )


# ---- streams, drained over the same tables


def _events(t: Tables) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{t.sf_dir}/event[s].parquet")


class _Live(Tables):
    def read(self, name: str) -> DataFrame:
        return _events(self) if name == "events" else super().read(name)


def _drained(t: Tables, out: DataFrame, mode: str) -> DataFrame:
    ship_package(t.spark)
    where = f"{shared_dir(t.spark)}/kalmia/stream-{uuid.uuid4().hex}"
    forget_at_exit(t.spark, where)
    stateful.drain(out, mode, f"{where}/out", f"{where}/checkpoint")
    return t.spark.read.parquet(f"{where}/out")


@query(LIVE_SQL + " SELECT user_id, topic, round(elo_rating, 6) AS elo_rating, attempt_count, pass_count, recent_failures FROM profiles")
def stream_topic_elo(t: Tables) -> DataFrame:
    out = _drained(t, stateful.topic_profiles(leveled(_Live(t.spark, t.sf_dir))), "update")
    last = Window.partitionBy("user_id", "topic").orderBy(F.desc("batch"))
    return out.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("user_id", "topic", r6("elo_rating").alias("elo_rating"), "attempt_count", "pass_count", "recent_failures")


@query(ORACLE_SQL["daily_streak"].removeprefix(adapter.SQL))
def stream_daily_streak(t: Tables) -> DataFrame:
    out = _drained(t, stateful.daily_streaks(_Live(t.spark, t.sf_dir).submissions), "update")
    last = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    return out.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("user_id", "last_submission_date", "current_streak")


@query("""SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""", plain=True)
def stream_event_windows(t: Tables) -> DataFrame:
    """Each window once, when the watermark has passed it: the newest are still open."""
    out = _drained(t, streams.event_windows(_events(t).withColumn("ts", F.col("ts").cast("timestamp")), once="event_id"), "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(RATED_SQL.format(drift="1", k="k"))
def stream_pattern_elo(t: Tables) -> DataFrame:
    out = _drained(t, stateful.pattern_ratings(_Live(t.spark, t.sf_dir).submissions, places=None), "update")
    last = Window.partitionBy("user_id", "pattern_id").orderBy(F.desc("batch"))
    return out.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("user_id", "pattern_id", r6("elo").alias("elo"), "updates")
