"""Gap signals and pattern ratings, submission by submission.

A submission changes more than its own pattern: its gap signals depend on all that its user has submitted
so far, also on patterns that it doesn't touch (those whose confidences scatter), and they set scores and
K factors of all candidate patterns. So a user's submissions are one fold, whose state is a map: pattern to
rating, detections, their spread, the last five of them, and the last five results.

Rows are dealt by user, sorted in time, and stream through the fold; a task holds one user's map, which the
taxonomy bounds, however long the history is. ``replay`` goes on from states that an earlier one returned, so
any cut of the submissions into batches gives the same states; streams run the same step.

Confidences scatter if their population deviation is over 0.2 by more than rounding. Null and empty patterns
are none; a null confidence counts as a detection, not in the deviation, and isn't a confident one. Rows of
one moment are in order of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kalmia.functions import ratings as R
from kalmia.operators import gaps
from kalmia.runtime import ship_package

SPREAD, NOISE = 0.2, 1e-9
PATTERN = (
    "pattern_id string, seen long, known long, total double, squares double, at array<long>, conf array<double>, "
    "elo double, rated long, results array<string>, strength double, frequency long, last_seen long"
)
STATE = f"submissions long, last_at long, last_id long, patterns array<struct<{PATTERN.replace(' ', ':').replace(',:', ',')}>>"
UPDATE = "place int, pattern_id string, gap_strength double, frequency long, recency_score double, confidence_penalty double, old_elo double, new_elo double, delta double, confidence_weight double"
#: What a submission brings.
INPUT = ("id", "at", "detected_pattern", "detected_confidence", "detections", "unmatched", "match_result")


@dataclass
class Known:
    """What a user's history says of a pattern."""

    seen: int = 0
    known: int = 0
    total: float = 0.0
    squares: float = 0.0
    at: list = field(default_factory=list)
    conf: list = field(default_factory=list)
    elo: float | None = None
    rated: int = 0
    results: list = field(default_factory=list)
    strength: float | None = None
    frequency: int | None = None
    last_seen: int | None = None

    def detected(self, at: int, conf: float | None) -> None:
        self.seen += 1
        if conf is not None:
            self.known, self.total, self.squares = self.known + 1, self.total + conf, self.squares + conf * conf
        self.at, self.conf = [*self.at, at][-gaps.RECENT :], [*self.conf, conf][-gaps.RECENT :]

    def scattered(self) -> bool:
        if self.seen < 2 or not self.known:
            return False
        mean = self.total / self.known
        return math.sqrt(max(0.0, self.squares / self.known - mean * mean)) > SPREAD + NOISE

    def confident(self) -> bool:
        for c in self.conf:
            if c is None or c < gaps.LOW:
                return False
        return bool(self.conf)

    def recency(self, now: int) -> float:
        if not (n := len(self.at)):
            return 0.0
        weights = [1.0 - (now - t) / 3.6e9 / gaps.HORIZON_HOURS for t in self.at]
        return min(sum([w * i / n for i, w in enumerate(weights, 1) if w > 0.0]) / n, 1.0)


NAMES = tuple(f.name for f in fields(Known))


@dataclass
class User:
    submissions: int = 0
    last_at: int | None = None
    last_id: int | None = None
    patterns: dict[str, Known] = field(default_factory=dict)
    #: Patterns whose confidences scatter; only a detection changes that.
    scattered: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, state: dict | None) -> User:
        if not state:
            return cls()
        known = {p["pattern_id"]: Known(**{n: p[n] for n in NAMES}) for p in state["patterns"]}
        return cls(state["submissions"], state["last_at"], state["last_id"], known, {p for p, k in known.items() if k.scattered()})

    def known(self, pattern: str) -> Known:
        """What is known of a pattern, from now on at least nothing."""
        if (found := self.patterns.get(pattern)) is None:
            found = self.patterns[pattern] = Known()
        return found

    def detected(self, pattern: str, at: int, conf: float | None) -> None:
        known = self.known(pattern)
        known.detected(at, conf)
        self.scattered.add(pattern) if known.scattered() else self.scattered.discard(pattern)

    def state(self) -> dict:
        return {"submissions": self.submissions, "last_at": self.last_at, "last_id": self.last_id, "patterns": [{"pattern_id": p, **{n: getattr(k, n) for n in NAMES}} for p, k in sorted(self.patterns.items())]}


def strength(miss: float, recency: float, penalty: float, places: int | None) -> float:
    """A gap's strength to four places; with ``places`` None halves go up, as all engines can agree on."""
    raw = min(max(miss * gaps.MISS + recency * gaps.RECENCY + penalty * gaps.PENALTY, 0.0), 1.0)
    return round(raw, 4) if places is not None else math.floor(raw * 10_000 + 0.500001) / 10_000


def found_gaps(user: User, row: dict, strongest: dict[str, float], places: int | None) -> dict[str, dict]:
    """The submission's gap signals by pattern; the history counts the submission itself."""
    if row["match_result"] == "FULL_MATCH":
        return {}
    weak = {p: (gaps.LOW - c) / gaps.LOW for p, c in strongest.items() if c < gaps.LOW}
    if user.submissions >= 2:
        weak = dict.fromkeys(user.scattered, 0.3) | weak
    missing = {p for p in row["unmatched"] or [] if p and strongest.get(p, 0.0) <= 0.0}
    out, nothing, submissions = {}, Known(), max(user.submissions, 1)
    for p in sorted(missing | weak.keys()):
        k = user.patterns.get(p, nothing)
        if k.confident():
            continue
        miss, recency = min(k.seen / submissions, 1.0), k.recency(row["at"])
        penalty = weak.get(p, 0.0) or (0.5 if p in missing else 0.0)
        s = strength(miss, recency, penalty, places)
        if s >= gaps.LEAST:
            out[p] = {"gap_strength": s, "frequency": k.seen, "recency_score": recency, "confidence_penalty": penalty}
    return out


def k_factor(gap: float, rated: int) -> float:
    raised = 32.0 + (16.0 if gap > 0.5 else 0.0)
    return min(64.0, max(raised - 8.0, 8.0) if rated >= 3 else raised)


def drift(result: str, results: list[str]) -> float:
    n = results.count(result)
    if n >= 3 and result == "FULL_MATCH":
        return max(1.0 - (n - 2) * 0.1, 0.5)
    if n >= 3 and result == "NO_MATCH":
        return max(1.0 - (n - 2) * 0.15, 0.3)
    return 1.0


def submit(user: User, row: dict, places: int | None, histories: bool, told: bool = True) -> list[dict]:
    """Takes one submission into a user's state: the changes of its candidate patterns, in order (none unless ``told``)."""
    user.submissions, user.last_at, user.last_id = user.submissions + 1, row["at"], row["id"]
    if row["detected_pattern"]:
        user.detected(row["detected_pattern"], row["at"], row["detected_confidence"])
    strongest: dict[str, float] = {}
    last: dict[str, float] = {}
    for d in row["detections"] or []:
        if d["pattern_id"]:
            last[d["pattern_id"]] = d["confidence"] or 0.0
            strongest[d["pattern_id"]] = max(strongest.get(d["pattern_id"], 0.0), last[d["pattern_id"]])
    found = found_gaps(user, row, strongest, places)
    result = row["match_result"] or "NO_MATCH"
    base = {"FULL_MATCH": 1.0, "PARTIAL_MATCH": 0.5}.get(result, 0.0)
    weight = {"NO_MATCH": 0.4, "PARTIAL_MATCH": 0.7}.get(result, 1.0)
    shown = (lambda x, n: x) if places is None else round
    out = []
    for place, p in enumerate(dict.fromkeys(x for x in (*found, *last, *(row["unmatched"] or [])) if x) or ["default"]):
        k, gap, conf = user.known(p), found[p]["gap_strength"] if p in found else 0.0, last.get(p, 0.0)
        score = max(0.0, base - 0.3) if gap > 0.6 else max(0.0, base - 0.15) if gap > 0.3 else base
        score = max(score, 0.2) if conf > 0.0 and base < 0.5 else score
        if histories:
            score *= drift(result, k.results)
        old = R.PATTERN_START if k.elo is None else k.elo
        opponent = R.OPPONENT + 200.0 if conf >= 0.8 else R.OPPONENT
        change = k_factor(gap, k.rated if histories else 0) * (score - 1.0 / (1.0 + 10.0 ** ((opponent - old) / 400.0)))
        k.elo = shown(max(R.FLOOR, old + change), 2)
        k.rated, k.results = k.rated + 1, [*k.results, result][-5:]
        if p in found:
            k.strength, k.frequency, k.last_seen = gap, found[p]["frequency"], row["at"]
        if not told:
            continue
        none = {"gap_strength": None, "frequency": None, "recency_score": None, "confidence_penalty": None}
        out.append({
            "place": place, "pattern_id": p, **found.get(p, none), "old_elo": shown(old, 2), "new_elo": k.elo, "delta": shown(k.elo - old, 2),
            "confidence_weight": shown(max(0.1, min(1.0, weight - gap * 0.3 + conf * 0.2)), 4),
        })
    return out


def analysed(submissions: DataFrame) -> DataFrame:
    """Submissions as ``replay`` takes them: user_id and ``INPUT``.

    What the analysis found may be there as detections, unmatched and match_result; else the primary
    pattern is all that was detected, and the expected one is missing where a gap was identified.
    """
    has = set(submissions.columns)
    result = F.when(~F.col("gap_identified"), "FULL_MATCH").when(F.col("verdict") == "pass", "PARTIAL_MATCH").otherwise("NO_MATCH")
    seen = F.array(F.struct(F.col("detected_pattern").alias("pattern_id"), F.col("detected_confidence").cast("double").alias("confidence")))
    missing = F.when(F.col("gap_identified"), F.array("expected_pattern")).otherwise(F.array().cast("array<string>"))
    given = lambda c, other: (F.col(c) if c in has else other).alias(c)
    return submissions.select(
        "user_id", F.col("id").cast("long").alias("id"), F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("at"), "detected_pattern", F.col("detected_confidence").cast("double").alias("detected_confidence"),
        given("detections", seen).cast("array<struct<pattern_id:string,confidence:double>>"), given("unmatched", missing), given("match_result", result),
    )


def replay(rows: DataFrame, start: DataFrame | None = None, places: int | None = 2, histories: bool = False, told: bool = True) -> DataFrame:
    """A row for each submission (user_id, id, at, updates) and one for each user's state after all (id null; state); only the latter unless ``told``.

    rows: as ``analysed`` gives them. start: (user_id, state) to go on from; users without rows keep their state.
    ``histories``: K factors and scores heed how often and how a pattern was rated before, as the rating rules
    have it for callers that keep histories; the reference's own write path keeps none.
    """
    ship_package(rows.sparkSession)
    kind = rows.schema["user_id"].dataType
    inner = T.StructType.fromDDL(STATE)
    schema = T.StructType([T.StructField("user_id", kind), *T.StructType.fromDDL("id long, at long").fields, T.StructField("updates", T.ArrayType(T.StructType.fromDDL(UPDATE))), T.StructField("state", inner)])
    ready = rows.select("user_id", *INPUT)
    ready = ready.withColumn("state", F.lit(None).cast(inner)) if start is None else ready.unionByName(start.select("user_id", F.col("state").cast(inner).alias("state")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, held, key, user = to_arrow_schema(schema), [], None, None
        last = lambda: {"user_id": key[0], "id": None, "at": None, "updates": None, "state": user.state()}
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["user_id"],):
                    if user is not None:
                        held.append(last())
                    key, user = (row["user_id"],), User()
                if row["state"] is not None:
                    user = User.of(row["state"])
                elif told:
                    held.append({"user_id": key[0], "id": row["id"], "at": row["at"], "updates": submit(user, row, places, histories), "state": None})
                else:
                    submit(user, row, places, histories, told=False)
            yield pa.RecordBatch.from_pylist(held, shape)
            held = []
        if user is not None:
            yield pa.RecordBatch.from_pylist([last()], shape)

    order = ["user_id", F.col("state").isNull(), "at", "id"]
    return ready.repartition("user_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def states(replayed: DataFrame) -> DataFrame:
    return replayed.filter("state IS NOT NULL").select("user_id", "state")


def updates(replayed: DataFrame) -> DataFrame:
    """user_id, id, at and the columns of ``UPDATE``: a row for each candidate of each submission."""
    return replayed.filter("state IS NULL").select("user_id", "id", "at", F.explode("updates").alias("u")).select("user_id", "id", "at", "u.*")


def _patterns(found: DataFrame) -> DataFrame:
    return found.select("user_id", F.explode("state.patterns").alias("p"))


def _moment(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def pattern_elos(found: DataFrame) -> DataFrame:
    """user_id, pattern_id, elo, updates of ``states``."""
    return _patterns(found).filter("p.elo IS NOT NULL").select("user_id", "p.pattern_id", "p.elo", F.col("p.rated").alias("updates"))


def gap_signals(found: DataFrame) -> DataFrame:
    """user_id, pattern_id, gap_strength, frequency, last_seen of ``states``: each pattern's latest signal."""
    return _patterns(found).filter("p.strength IS NOT NULL").select("user_id", "p.pattern_id", F.col("p.strength").alias("gap_strength"), "p.frequency", _moment(F.col("p.last_seen")).alias("last_seen"))
