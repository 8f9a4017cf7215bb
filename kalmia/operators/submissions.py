"""Submissions into all tables that depend on them, published together.

Folds go on from what the tables hold: a user's interleaved state, topic profiles, attempts by problem and
streak. A user with a row that isn't newer than the newest so far is rewound to the last snapshot before that
row, and folded anew from the rows since. Snapshots are taken at the end of a batch whenever a user has got
another ``EVERY`` submissions; those after a late row go, as they lack it. So a batch reads its users' small
states and no histories but the rows since those snapshots, and any cut of the submissions into batches leaves
the same tables; only recommendations depend on it, as a batch makes one for each user, after the newest row.

Attempts aren't rewound: what a problem had before the snapshot is what it has now less the rows since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalmia.operators import gate, interleaved, ratings, recommend, windows
from kalmia.runtime import measured_broadcasts, written
from kalmia.sources import serving

KEYS = serving.KEYS
#: Submissions of a user between two snapshots, at least.
EVERY = 64


def _place() -> Column:
    """Where a submission stands in its user's history."""
    return F.struct(F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"))


def _rewound(late: DataFrame, snapshots: DataFrame | None, empty: str) -> tuple[DataFrame, DataFrame | None]:
    """late (user_id, first): (the same with ``base``, the last snapshot before the first late row or null; keys of the snapshots after it)."""
    if snapshots is None:
        return late.withColumn("base", F.lit(None).cast(empty)), None
    at = F.struct(F.col("upto_at").alias("at"), F.col("upto_id").alias("id"))
    theirs = snapshots.join(late, "user_id").withColumn("_at", at)
    base = theirs.filter(F.col("_at") < F.col("first")).groupBy("user_id").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "user_id"]), "_at").alias("base"))
    return late.join(base, "user_id", "left"), theirs.filter(F.col("_at") >= F.col("first")).select("user_id", "upto_at", "upto_id")


def _snapshots(after: DataFrame, before: DataFrame | None, profiles: DataFrame, streaks: DataFrame) -> DataFrame:
    """Snapshots of the users who have got another ``EVERY`` submissions: user_id, upto_at, upto_id, state, profiles, streak."""
    full = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / EVERY)
    had = after.withColumn("_had", F.lit(0)) if before is None else after.join(before.select("user_id", F.col("state.submissions").alias("_had")), "user_id", "left")
    due = had.filter(full("state.submissions") > full("_had")).select("user_id", F.col("state.last_at").alias("upto_at"), F.col("state.last_id").alias("upto_id"), "state")
    kept = profiles.groupBy("user_id").agg(F.collect_list(F.struct(*[c for c in profiles.columns if c != "user_id"])).alias("profiles"))
    return due.join(kept, "user_id", "left").join(streaks.select("user_id", F.struct("last_submission_date", "current_streak").alias("streak")), "user_id", "left")


def once(rows: DataFrame) -> DataFrame:
    """One row of each id: the one with the least hash, so that a batch that runs again takes the same."""
    own = [F.col(c) for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(F.xxhash64(*own).alias("h"), F.struct(*own).alias("row"))).alias("x")).select("id", "x.row.*").select(*rows.columns)


def _rejoined(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Streaks of users' new days, joined to the streak so far where they go on from it."""
    fresh = windows.daily_streak(new if old is None else new.select("user_id", "submitted_at").unionByName(old.select("user_id", F.col("last_submission_date").cast("timestamp").alias("submitted_at"))))
    if old is None:
        return fresh
    before = old.select("user_id", F.col("last_submission_date").alias("_last"), F.col("current_streak").alias("_run"))
    goes_on = F.date_sub("last_submission_date", F.col("current_streak").cast("int") - 1) == F.col("_last")
    run = F.col("current_streak") + F.when(goes_on, F.col("_run") - 1).otherwise(0)
    return fresh.join(before, "user_id", "left").select("user_id", "last_submission_date", F.coalesce(run, "current_streak").alias("current_streak"))


def _advice(users: DataFrame, profiles: DataFrame, attempts: DataFrame, problems: DataFrame) -> DataFrame:
    """user_id, problem_id, topic, difficulty, reason: what to practise next."""
    bank = problems.select("id", "difficulty", "topics", "acceptance_rate", "primary_pattern")
    weakest = recommend.weakest_topics(profiles, bank.select(F.col("primary_pattern").alias("topic")).distinct(), 5)
    solved = attempts.filter("passed").select("user_id", "problem_id", F.lit("pass").alias("verdict"))
    found = recommend.standalone(users, weakest, recommend.topic_problems(bank, weakest), bank, solved)
    return found.withColumn("reason", F.concat(F.lit("Next in "), F.translate("topic", "_", " "), F.lit(": an unsolved problem at level "), F.col("difficulty"), F.lit(".")))


def persist(new: DataFrame, problems: DataFrame, root: str, batch: int, places: int | None = 2) -> None:
    """One batch of analysed submissions: themselves with attempt numbers, and their users' states, profiles, gaps, pattern ratings, attempts, streaks and next recommendations; last recommendations become acted on.

    new: id, user_id, problem_id, verdict, detected_pattern, detected_confidence, expected_pattern, gap_identified, topic,
    submitted_at, and what else ``interleaved.analysed`` takes. Rows that break a constraint (``gate.TABLES``) go to the
    quarantine table instead. Ids that are there already are left out. If anything
    fails nothing is published; a batch may run again.
    """
    with measured_broadcasts(new.sparkSession):
        _persist(new, problems, root, batch, places)


def _persist(new: DataFrame, problems: DataFrame, root: str, batch: int, places: int | None) -> None:
    spark = new.sparkSession
    came, held = gate.gate(once(new), "submissions", parents={"problem_id": problems.select("id")})
    users = came.select("user_id").distinct()
    read = lambda name: serving.published(spark, root, name, before=batch, only=users)
    stored = read("submissions")
    if stored is not None:
        low, high = came.agg(F.min("id"), F.max("id")).first()
        came = written(came.join(stored.filter(F.col("id").between(low, high)).select("id"), "id", "left_anti"))
    states, fresh = read("states"), came
    profiles = attempts = streaks = stale = None
    if states is not None:
        newest = F.struct(F.col("state.last_at").alias("at"), F.col("state.last_id").alias("id"))
        first = came.groupBy("user_id").agg(F.min(_place()).alias("first"))
        late = first.join(states.select("user_id", newest.alias("newest")), "user_id").filter(F.col("first") <= F.col("newest")).select("user_id", "first")
        late, stale = _rewound(late, read("snapshots"), "struct<upto_at:bigint,upto_id:bigint>")
        late = written(late)
        based = late.filter("base IS NOT NULL")
        # A late user's rows since the base; no row of theirs from before the earliest base is read.
        n, rewound, oldest = late.agg(F.count("*"), F.count("base.upto_at"), F.min("base.upto_at")).first()
        since = late.select("user_id", F.struct(F.col("base.upto_at").alias("at"), F.col("base.upto_id").alias("id")).alias("_upto"))
        again = None
        if n:
            fixed = F.col("submitted_at").cast("timestamp") >= F.timestamp_micros(F.lit(oldest)) if n == rewound else None
            kept = serving.published(spark, root, "submissions", before=batch, only=late.select("user_id"), fixed=fixed)
            again = written(kept.join(since, "user_id").filter(F.col("_upto.at").isNull() | (_place() > F.col("_upto"))).select(*came.columns))
            came = written(came.unionByName(again))
        known = lambda name: read(name).join(late, "user_id", "left_anti")
        states, profiles, streaks, attempts = known("states"), known("topic_profiles"), known("streaks"), read("attempts")
        if "state" in based.schema["base"].dataType.names:
            states = states.unionByName(based.select("user_id", "base.state"))
            profiles = profiles.unionByName(based.select("user_id", F.explode("base.profiles").alias("p")).select("user_id", "p.*"))
            streaks = streaks.unionByName(based.select("user_id", "base.streak.*"))
    after = written(interleaved.states(interleaved.replay(interleaved.analysed(came), states, places, told=False)).join(users, "user_id", "left_semi"))
    numbered = windows.attempts(came)
    if attempts is not None:
        before = attempts.select("user_id", "problem_id", F.col("attempts").alias("_before"))
        if again is not None:
            taken = again.groupBy("user_id", "problem_id").agg(F.count("*").alias("_taken"))
            before = before.join(taken, ["user_id", "problem_id"], "left").select("user_id", "problem_id", (F.col("_before") - F.coalesce("_taken", F.lit(0))).alias("_before"))
        numbered = numbered.join(before, ["user_id", "problem_id"], "left")
        numbered = numbered.withColumn("attempt_number", F.when(F.col("problem_id").isNull(), 1).otherwise(F.col("attempt_number") + F.coalesce("_before", F.lit(0)))).drop("_before")
    counted = fresh.filter("problem_id IS NOT NULL").groupBy("user_id", "problem_id").agg(F.count("*").alias("attempts"), F.bool_or(F.col("verdict") == "pass").alias("passed"))
    tried = counted if attempts is None else counted.unionByName(attempts).groupBy("user_id", "problem_id").agg(F.sum("attempts").alias("attempts"), F.bool_or("passed").alias("passed"))
    leveled = came.join(problems.select(F.col("id").alias("problem_id"), "difficulty"), "problem_id")
    folded = ratings.topic_profiles(leveled, places, profiles)
    all_profiles = folded if profiles is None else folded.unionByName(profiles.join(folded, ["user_id", "topic"], "left_anti"))
    tried, all_profiles, runs = written(tried), written(all_profiles), written(_rejoined(came, streaks))
    taken_now = written(_snapshots(after, states, all_profiles, runs))
    gone = None if stale is None else {"snapshots": stale.join(taken_now, ["user_id", "upto_at", "upto_id"], "left_anti")}
    newest = windows.latest(came, ["user_id"], 1).select("user_id", "id", F.col("submitted_at").alias("created_at"))
    advice = _advice(newest.select("user_id"), all_profiles, tried, problems)
    made = newest.join(advice, "user_id").select("id", "user_id", "problem_id", "topic", "difficulty", "reason", "created_at", F.lit(False).alias("acted_on"))
    given = read("recommendations")
    if given is not None:
        last = windows.latest(given.join(newest.select("user_id"), "user_id", "left_semi"), ["user_id"], 1, at="created_at").drop("rn").withColumn("acted_on", F.lit(True))
        made = made.unionByName(last.join(made.select("id"), "id", "left_anti"), allowMissingColumns=True)
    serving.publish({
        "submissions": numbered.select(*came.columns, F.col("attempt_number").cast("long").alias("attempt_number")), "topic_profiles": all_profiles, "gap_signals": interleaved.gap_signals(after), "user_pattern_elo": interleaved.pattern_elos(after),
        "streaks": runs, "attempts": tried, "states": after, "snapshots": taken_now, "recommendations": made, "quarantine": held,
    }, root, batch, gone)
