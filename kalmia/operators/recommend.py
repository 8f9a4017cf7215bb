"""What to practise next, as set operations: no query per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.functions import ratings as R
from kalmia.functions.taxonomy import CATEGORY_OF, TAGS
from kalmia.operators import substrings, windows
from kalmia.runtime import written

SPECIFIC, HINT = 0.75, 0.55
MOST = 5


def weakness(elo: Column, accuracy: Column, failures: Column) -> Column:
    return (1600 - elo) / 1200 + (1 - accuracy) + F.least(failures, F.lit(5)) / 3


def weakest_topics(profiles: DataFrame, recommendable: DataFrame, k: int) -> DataFrame:
    """Each user's ``k`` weakest topics that have a primary problem, with rn (1: the weakest)."""
    ranked = profiles.join(F.broadcast(recommendable), "topic", "left_semi")  # at most the taxonomy's size
    ranked = ranked.withColumn("weakness", F.round(weakness(F.col("elo_rating"), F.col("accuracy"), F.col("recent_failures")), 6))
    w = Window.partitionBy("user_id").orderBy(F.desc("weakness"), F.round("elo_rating", 6), "accuracy", "topic")
    return ranked.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def starting_problem(profiles: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, topic, problem_id): the best Easy problem of the weakest topic that has one, else the first Easy problem.

    One problem a topic is left before users join it, so the join's side is at most the taxonomy's size.
    """
    easy = problems.filter("difficulty = 'Easy'")
    order = F.struct((-F.coalesce("acceptance_rate", F.lit(0.0))).alias("a"), F.col("id").alias("i"))
    best = easy.groupBy(F.col("primary_pattern").alias("topic")).agg(F.min(order)["i"].alias("problem_id"))
    fallback = easy.agg(F.min("id").alias("first"))
    score = F.round(weakness(F.col("elo_rating"), F.col("accuracy"), F.col("recent_failures")), 6)
    place = F.struct((-score).alias("w"), F.round("elo_rating", 6).alias("e"), F.col("accuracy"), F.col("topic").alias("t"))
    known = profiles.join(F.broadcast(best), "topic", "left").groupBy("user_id")
    found = known.agg(F.min(F.when(F.col("problem_id").isNotNull(), F.struct(place.alias("p"), F.col("problem_id").alias("id")))).alias("x"))
    return found.join(F.broadcast(fallback), F.lit(True)).select("user_id", F.col("x.p.t").alias("topic"), F.coalesce("x.id", "first").alias("problem_id"))


def pass_probability(difficulty: Column, topic: Column, rates: dict[str, float], multipliers: dict[str, float]) -> Column:
    """A simulated learner's chance to pass: the rate of the difficulty (else 0.5) times the topic's factor (else 1)."""
    return F.coalesce(R.of(rates, difficulty), F.lit(0.5)) * F.coalesce(R.of(multipliers, topic), F.lit(1.0))


def topic_problems(problems: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, problem) where the topic's text is in the problem's topics (with SQL's wildcards) or is its primary pattern."""
    different = topics.select("topic").dropna().distinct()
    # Pairs of different texts and topics, few; written, as callers use the result several times.
    found = written(substrings.like(problems.select("topics"), different.select(F.concat(F.lit("%"), "topic", F.lit("%")))))
    named = found.withColumn("topic", F.expr("substring(pattern, 2, char_length(pattern) - 2)"))
    by_text = problems.join(named.select(F.col("text").alias("topics"), "topic"), "topics").filter(~F.col("primary_pattern").eqNullSafe(F.col("topic")))
    by_pattern = problems.join(different, F.col("primary_pattern") == F.col("topic"))
    columns = [*problems.columns, "topic"]
    return by_pattern.select(*columns).unionByName(by_text.select(*columns))


def ranked_unsolved(wanted: DataFrame, bank: DataFrame, submissions: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Best unsolved problem for each wanted (user_id, topic, difficulty): by acceptance, then id.

    bank: ``topic_problems``. exclude: (user_id, id) that don't count for that user either.

    A topic's problems are ranked once for all users. Where a user's solved ranks run 1, 2, ... k without a gap, the
    answer is rank k + 1: work grows with what users have solved, not with users x problems.
    """
    order = Window.partitionBy("topic", "difficulty").orderBy(F.coalesce("acceptance_rate", F.lit(0.0)).desc(), "id")
    ranked = bank.select("topic", "difficulty", "id", "acceptance_rate", "primary_pattern").distinct().withColumn("place_", F.row_number().over(order))
    gone = submissions.filter(F.col("verdict") == "pass").select("user_id", F.col("problem_id").alias("id"))
    gone = (gone if exclude is None else gone.unionByName(exclude.select("user_id", "id"))).distinct()
    mine = Window.partitionBy("user_id", "topic", "difficulty").orderBy("place_")
    run = gone.join(ranked.select("topic", "difficulty", "id", "place_"), "id").withColumn("n_", F.row_number().over(mine))
    run = run.groupBy("user_id", "topic", "difficulty").agg(F.count_if(F.col("place_") == F.col("n_")).alias("run_"))
    keys = ["user_id", "topic", "difficulty"]
    next_ = wanted.select(*keys).distinct().join(run, keys, "left").withColumn("place_", (F.coalesce("run_", F.lit(0)) + 1).cast("int"))
    return next_.join(ranked, ["topic", "difficulty", "place_"]).select(*keys, F.col("id").alias("problem_id"), "primary_pattern")


def first_unsolved(users: DataFrame, problems: DataFrame, submissions: DataFrame) -> DataFrame:
    """(user_id, difficulty, problem_id): each user's first unsolved problem of the whole bank by difficulty (lexical), acceptance, id."""
    bank = problems.select(F.lit("").alias("topic"), "difficulty", "id", "acceptance_rate", F.lit("").alias("primary_pattern"))
    wanted = users.join(F.broadcast(bank.select("topic", "difficulty").distinct()), F.lit(True))  # a row for each user and difficulty
    found = ranked_unsolved(wanted, bank, submissions)
    return found.groupBy("user_id").agg(F.min(F.struct("difficulty", "problem_id")).alias("x")).select("user_id", "x.*")


def active(submissions: DataFrame, users: DataFrame, problems: DataFrame) -> DataFrame:
    """Each known user's latest submission if it wasn't passed, with the difficulty of its problem (null: not in the bank)."""
    last = windows.latest(submissions, ["user_id"], 1).filter("verdict <> 'pass'")
    known = problems.select(F.col("id").alias("problem_id"), "difficulty")
    return last.join(users, "user_id", "left_semi").join(known, "problem_id", "left").select("user_id", "id", "problem_id", "topic", "difficulty")


def rotation(weakest: DataFrame, bank: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each user's weak topics with an unsolved problem at the level of the topic's rating, weakest first (place)."""
    wanted = weakest.select("user_id", "topic", "rn", R.difficulty_for(F.col("elo_rating")).alias("difficulty"))
    found = ranked_unsolved(wanted.select("user_id", "topic", "difficulty"), bank, submissions)
    return wanted.join(found, ["user_id", "topic", "difficulty"]).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("rn")))


def standalone(users: DataFrame, weakest: DataFrame, bank: DataFrame, problems: DataFrame, submissions: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(user_id, topic, difficulty, problem_id) while any problem is unsolved: an ``active`` recommendation (the same columns,
    a row a user), else the first of a user's ``rotation``, else the weakest topic's best at the easiest level that has one,
    else the bank's first unsolved problem."""
    levels = F.array(*map(F.lit, ("Easy", "Medium", "Hard")))
    row = lambda step: ["user_id", step.alias("step"), F.struct(F.col("primary_pattern").alias("topic"), "difficulty", "problem_id").alias("x")]
    scan = rotation(weakest, bank, submissions).filter("place = 1").select(*row(F.lit(0).cast("bigint")))
    weakest_one = weakest.filter("rn = 1").select("user_id", "topic", F.explode(levels).alias("difficulty"))
    any_level = ranked_unsolved(weakest_one, bank, submissions).select(*row(F.array_position(levels, F.col("difficulty"))))
    first = first_unsolved(users, problems, submissions).join(problems.select(F.col("id").alias("problem_id"), "primary_pattern"), "problem_id")
    if active is not None:
        kept = active.join(users.select("user_id"), "user_id", "left_semi").select(F.col("topic").alias("primary_pattern"), "user_id", "difficulty", "problem_id")
        scan = scan.unionByName(kept.select(*row(F.lit(-1).cast("bigint"))))
    all_ = scan.unionByName(any_level).unionByName(first.select(*row(F.lit(9).cast("bigint"))))
    return all_.groupBy("user_id").agg(F.min_by("x", "step").alias("x")).select("user_id", "x.*")


def rotate_topic(current: DataFrame, options: DataFrame) -> DataFrame:
    """current (user_id, current_topic) to new_topic: the primary pattern of the first option with another topic, else the same."""
    other = current.join(options.filter("place <= 2"), "user_id", "left").filter(F.col("topic").isNull() | (F.col("topic") != F.col("current_topic")))
    best = other.groupBy("user_id").agg(F.min_by("primary_pattern", "place").alias("new_topic"))
    return current.join(best, "user_id", "left").withColumn("new_topic", F.coalesce("new_topic", "current_topic"))


def learning_gain(score: Column, unsolved_: Column) -> Column:
    return R.rounded(F.least(F.lit(1.0), score * 0.7 + F.when(unsolved_, 0.2).otherwise(0.0)), 4)


def weak_score(gap: Column, elo: Column) -> Column:
    return gap * 0.5 + F.greatest(F.lit(0.0), (1200 - elo) / 1200) * 0.5


# The sentences below.
def reason(pattern: Column, score: Column, unsolved_: Column) -> Column:
    label = F.translate(pattern, "_", " ")
    return (
        F.when(score >= 0.7, F.concat(F.lit("Significant weakness detected in "), label, F.lit(". High priority for improvement.")))
        .when(score >= 0.4, F.concat(F.lit("Moderate gap identified in "), label, F.lit(". Regular practice recommended.")))
        .when(unsolved_, F.concat(F.lit("Unfamiliar territory: "), label, F.lit(". Start building foundational skills.")))
        .otherwise(F.concat(F.lit("Balanced practice opportunity in "), label, F.lit(".")))
    )


def pattern_scores(users: DataFrame, patterns: DataFrame, profiles: DataFrame, signals: DataFrame) -> DataFrame:
    """(user_id, pattern_id, elo, gap_strength) for each user and each pattern of the bank; null where nothing is known. At most the taxonomy's size a user."""
    every = users.select("user_id").join(F.broadcast(patterns.select("pattern_id").distinct()), F.lit(True))
    elo = profiles.select("user_id", F.col("topic").alias("pattern_id"), F.col("elo_rating").alias("elo"))
    return every.join(elo, ["user_id", "pattern_id"], "left").join(signals.select("user_id", "pattern_id", "gap_strength"), ["user_id", "pattern_id"], "left")


def weak_patterns(scores: DataFrame, patterns: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each user's patterns by weak score (rank 1: the weakest), the Elo's default filled in.

    scores: user_id, pattern_id, elo, gap_strength. Patterns solved before (a passed submission's detected pattern, else its
    topic) count half; patterns without a problem don't count.
    """
    shown = F.coalesce(F.nullif("detected_pattern", F.lit("")), "topic") if "topic" in submissions.columns else F.col("detected_pattern")
    solved = submissions.filter("verdict = 'pass'").select("user_id", shown.alias("pattern_id")).distinct().withColumn("solved", F.lit(True))
    ready = scores.join(F.broadcast(patterns.select("pattern_id").distinct()), "pattern_id", "left_semi").join(solved, ["user_id", "pattern_id"], "left")
    ready = ready.withColumn("elo", F.coalesce("elo", F.lit(R.PATTERN_START)))
    ready = ready.withColumn("score", F.round(weak_score(F.coalesce("gap_strength", F.lit(0.0)), F.col("elo")) * F.when(F.col("solved"), 0.5).otherwise(1.0), 6))
    return ready.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "pattern_id")))


def top_recommendations(scores: DataFrame, bank: DataFrame, submissions: DataFrame, k: int = MOST) -> DataFrame:
    """Each user's top ``k`` patterns by weak score with their best problem.

    scores: as for ``weak_patterns``. bank: pattern_id, id, acceptance_rate (a row for each of a problem's patterns).
    Unsolved problems come before solved ones, then by acceptance and id. No step for a second category or for a cold start
    is needed: with fewer than ``k`` patterns all of the bank's are here, so no further category is left, and the list is
    empty only if the bank is.
    """
    top = weak_patterns(scores, bank, submissions).filter(F.col("rank") <= k)
    # A pattern's first problem is the answer for those who have solved all of them: a row for each pattern.
    first = bank.groupBy("pattern_id").agg(F.min(F.struct((-F.coalesce("acceptance_rate", F.lit(0.0))).alias("a"), "id"))["id"].alias("first"))
    all_ = bank.select(F.col("pattern_id").alias("topic"), F.lit("").alias("difficulty"), "id", "acceptance_rate", F.col("pattern_id").alias("primary_pattern"))
    wanted = top.select("user_id", F.col("pattern_id").alias("topic"), F.lit("").alias("difficulty"))
    next_ = ranked_unsolved(wanted, all_, submissions).select("user_id", F.col("topic").alias("pattern_id"), "problem_id")
    picked = top.join(F.broadcast(first), "pattern_id").join(next_, ["user_id", "pattern_id"], "left")
    picked = picked.withColumns({"open": F.col("problem_id").isNotNull(), "id": F.coalesce("problem_id", "first")})
    level = F.array_position(F.array(F.lit("Easy"), F.lit("Medium"), F.lit("Hard")), R.difficulty_for(F.col("elo")))
    return picked.select(
        "user_id", "rank", "pattern_id", F.col("id").alias("problem_id"), "score", ((level - 1) / 2.0).alias("difficulty_score"),
        learning_gain(F.col("score"), F.col("open")).alias("expected_learning_gain"), reason(F.col("pattern_id"), F.col("score"), F.col("open")).alias("reason"),
    )


def strategy(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """Each user's strategy and focus from weak scores with rank (user_id, pattern_id, score, rank, elo) and submission counts."""
    names = F.create_map(*[F.lit(x) for p, c in CATEGORY_OF.items() for x in (p, c)])
    top3 = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "pattern_id")))), lambda x: x["pattern_id"])
    agg = scores.groupBy("user_id").agg(
        F.count_if(F.col("score") >= 0.7).alias("high"), F.count_if(F.col("score") >= 0.4).alias("moderate"),
        F.coalesce(F.bool_and(F.when(F.col("rank") <= 5, F.col("elo") >= R.PATTERN_START)), F.lit(True)).alias("settled"), top3.alias("top3"),
    )
    chosen = (
        F.when(F.coalesce("total", F.lit(0)) == 0, "cold_start_exploration").when((F.col("high") >= 2) | (F.col("moderate") >= 3), "reinforce_weakest")
        .when(F.col("settled"), "broaden_coverage").otherwise("balanced_maintenance")
    )
    areas = F.slice(F.array_distinct(F.transform("top3", lambda p: F.initcap(F.translate(F.coalesce(F.element_at(names, p), F.lit("general")), "_", " ")))), 1, 2)
    focus = (
        F.when(F.col("strategy") == "cold_start_exploration", "Exploration — building initial skill profile")
        .when(F.size("top3") == 0, "Maintenance — all patterns at adequate level").otherwise(F.concat(F.lit("Focus on "), F.array_join(areas, ", ")))
    )
    return agg.join(totals, "user_id", "left").withColumn("strategy", chosen).select("user_id", "strategy", focus.alias("focus_area"), F.array_join("top3", ",").alias("primary_weak_patterns"))


def problem_url(pattern: Column, difficulty: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.concat(F.lit("https://leetcode.com/problemset/?topicSlugs="), F.coalesce(F.try_element_at(tags, pattern), F.lit("algorithms")), F.lit("&difficulty="), F.upper(difficulty))


def gated(rows: DataFrame) -> DataFrame:
    """The confidence-gated decision, one row for each submission with all its candidates joined.

    rows: verdict, gap_detected, confidence, topic, difficulty, companion (no problem known), locked_pass, locked_fail,
    same_twice (the last two recommendations had this topic), user_difficulty, new_topic, new_difficulty, new_problem_id,
    and problem_pass / problem_fail / problem_user: the best unsolved other problem at the difficulty moved up / down /
    at the user's level. Adds tier, branch, chosen_topic, chosen_difficulty, chosen_problem_id.
    """
    passed, gap, conf = F.col("verdict") == "pass", F.col("gap_detected"), F.col("confidence")
    moves = F.col("new_topic") != F.col("topic")
    here = F.when(gap, F.col("problem_user")).when(passed, F.col("problem_pass")).otherwise(F.col("problem_fail"))
    branch = (
        F.when(F.col("companion"), "companion")
        .when(~gap & passed & F.col("locked_pass"), "locked").when(~gap & ~passed & F.col("locked_fail"), "locked")
        .when(gap & (conf < HINT), "general_hint").when(gap & (conf < SPECIFIC), "topic_hint")
        .when(here.isNull() & moves, F.when(gap, "fallback").otherwise("rotate")).when(here.isNotNull() & F.col("same_twice") & moves, "diversity").otherwise("stay")
    )
    out = rows.withColumns({"branch": branch, "_here": here})
    turned, plain = F.col("branch").isin("locked", "rotate", "fallback", "diversity"), F.col("branch").isin("companion", "general_hint", "topic_hint")
    level = F.when(plain | gap, F.col("user_difficulty")).when(passed, R.moved(F.col("difficulty"), F.lit(1))).otherwise(R.moved(F.col("difficulty"), F.lit(-1)))
    out = out.withColumns({
        "chosen_topic": F.when(turned, F.col("new_topic")).otherwise(F.col("topic")),
        "chosen_difficulty": F.when(turned, F.col("new_difficulty")).otherwise(level),
        "chosen_problem_id": F.when(turned, F.col("new_problem_id")).when(plain, F.lit(None)).otherwise(F.col("_here")),
    })
    tier = F.when(F.col("branch") == "general_hint", "general_hint").when(F.col("chosen_problem_id").isNotNull(), "specific").otherwise("topic_hint")
    return out.withColumn("tier", tier).drop("_here")


# The sentences below.
def explanation(tier: Column, branch: Column, topic: Column, old_topic: Column, verdict: Column, gap: Column, problem: Column, old: Column, new: Column, run: Column) -> Column:
    """Why a recommendation was made, in words."""
    t, o = F.translate(topic, "_", " "), F.translate(old_topic, "_", " ")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    capital = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000))
    changed = problem.isNotNull() & (old != new)
    return (
        F.when((branch.isin("locked", "rotate") & (verdict != "pass")) | ((branch == "diversity") & (verdict == "fail")), say("You've been struggling with ", o, " recently. Let's strengthen ", t, " before returning."))
        .when((branch == "locked") & (run > 1), say("You solved ", run.cast("string"), " consecutive ", o, " problems. ", capital, " is one of your lowest-rated topics, so we're broadening your coverage."))
        .when(branch.isin("locked", "rotate", "diversity"), say("Good work on ", o, ". Let's switch to ", t, ", one of your lowest-rated topics, to broaden your coverage."))
        .when(~gap & (verdict == "pass") & changed, say("You handled the ", old, " ", t, " problem correctly. Let's try a ", new, " problem."))
        .when(~gap & (verdict == "pass") & problem.isNotNull(), say("Good progress on ", t, ". Let's continue with another problem."))
        .when(~gap & (verdict == "pass"), say("Good progress on ", t, ". We're finding the right next challenge."))
        .when(~gap & changed, say("The ", old, " ", t, " problem was challenging. Let's try an easier ", new, " problem."))
        .when(~gap & problem.isNotNull(), say("Let's try another ", t, " problem to build confidence."))
        .when(~gap, say("Keep practicing ", t, " fundamentals."))
        .when((tier == "specific") & problem.isNotNull(), say("Let's target ", t, ", which was identified as an area to work on."))
        .when(tier == "topic_hint", say("Your last result points to ", t, ". Review problems in this area before your next attempt."))
        .otherwise(say("Focus on building a strong foundation in ", t, "."))
    )
