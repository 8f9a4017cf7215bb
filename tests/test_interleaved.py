"""The per-user fold against a plain version that looks at the whole history anew for each submission."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kalmia.operators import interleaved
from kalmia.sources.adapter import Tables

HOUR = 3_600_000_000
PLACES = ["a", "b", "c", "d"]


def plain(rows, histories=False):
    """Updates by submission id, last signals and ratings; rows in order."""
    elo, results, signals, out = {}, defaultdict(list), {}, {}
    past = []
    for r in rows:
        past.append(r)
        of = lambda p: [x for x in past if x["detected_pattern"] == p]
        ast = [(d["pattern_id"], d["confidence"] or 0.0) for d in r["detections"] or [] if d["pattern_id"]]
        best = {p: max(c for q, c in ast if q == p) for p, _ in ast}
        missing = [p for p in r["unmatched"] or [] if p and best.get(p, 0) <= 0]
        weak = {p: (0.6 - c) / 0.6 for p, c in best.items() if c < 0.6}
        if len(past) >= 2:
            for p in {x["detected_pattern"] for x in past if x["detected_pattern"]}:
                confs = [x["detected_confidence"] for x in of(p) if x["detected_confidence"] is not None]
                if len(of(p)) >= 2 and confs and statistics.pstdev(confs) > 0.2 + 1e-9 and p not in weak:
                    weak[p] = 0.3
        gaps = {}
        for p in sorted({*missing, *weak}):
            recent = of(p)[-5:]
            if r["match_result"] == "FULL_MATCH" or (recent and all((x["detected_confidence"] or 0.0) >= 0.6 for x in recent)):
                continue
            weights = [max(0.0, 1 - (r["at"] - x["at"]) / HOUR / 720) * (i + 1) / len(recent) for i, x in enumerate(recent)]
            penalty = weak.get(p, 0.0) or (0.5 if p in missing else 0.0)
            s = round(min(1.0, max(0.0, min(1.0, len(of(p)) / len(past)) * 0.5 + min(1.0, sum(weights) / max(len(recent), 1)) * 0.3 + penalty * 0.2)), 4)
            if s >= 0.01:
                gaps[p] = s
                signals[p] = (s, len(of(p)), r["at"])
        last = dict(ast)
        done = []
        for p in list(dict.fromkeys([*gaps, *last, *[u for u in r["unmatched"] or [] if u]])) or ["default"]:
            m, old, gap, conf = r["match_result"] or "NO_MATCH", elo.get(p, 1200.0), gaps.get(p, 0.0), last.get(p, 0.0)
            base = {"FULL_MATCH": 1.0, "PARTIAL_MATCH": 0.5}.get(m, 0.0)
            score = max(0.0, base - (0.3 if gap > 0.6 else 0.15 if gap > 0.3 else 0.0))
            if conf > 0 and base < 0.5:
                score = max(score, 0.2)
            k = 48 if gap > 0.5 else 32
            if histories:
                n = results[p][-5:].count(m)
                if n >= 3 and m == "FULL_MATCH":
                    score *= max(1 - (n - 2) * 0.1, 0.5)
                if n >= 3 and m == "NO_MATCH":
                    score *= max(1 - (n - 2) * 0.15, 0.3)
                k -= 8 if len(results[p]) >= 3 else 0
            new = round(max(400.0, old + k * (score - 1 / (1 + 10 ** (((1400 if conf >= 0.8 else 1200) - old) / 400)))), 2)
            done.append((p, gaps.get(p), round(old, 2), new, round(new - old, 2), round(max(0.1, min(1.0, {"NO_MATCH": 0.4, "PARTIAL_MATCH": 0.7}.get(m, 1.0) - gap * 0.3 + conf * 0.2)), 4)))
            elo[p] = new
            results[p].append(m)
        out[r["id"]] = done
    return out, signals, elo, {p: len(x) for p, x in results.items()}


def made(n=160, users=3, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        dets = [{"pattern_id": rng.choice([*PLACES, "", None]), "confidence": rng.choice([None, 0.0, 0.1, 0.35, 0.6, 0.85])} for _ in range(rng.randrange(4))]
        rows.append({
            "user_id": rng.choice([*range(users), 0, 0, None]), "id": i, "at": rng.randrange(40) * 20 * HOUR, "detected_pattern": rng.choice([*PLACES, "", None]), "detected_confidence": rng.choice([None, 0.05, 0.3, 0.55, 0.7, 0.9]),
            "detections": rng.choice([dets, dets, None]), "unmatched": rng.choice([None, [], ["b"], ["c", "e", ""], ["a", None]]), "match_result": rng.choice(["FULL_MATCH", "PARTIAL_MATCH", "NO_MATCH", "NO_MATCH", None]),
        })
    return rows


SCHEMA = "user_id long, id long, at long, detected_pattern string, detected_confidence double, detections array<struct<pattern_id:string,confidence:double>>, unmatched array<string>, match_result string"


def by_user(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        out[r["user_id"]].append(r)
    return out


@pytest.mark.parametrize("histories", [False, True])
def test_fold_by_brute_force(spark, histories):
    rows = made() + made(90, 1, 8)[:0]
    found = interleaved.replay(spark.createDataFrame(rows, SCHEMA), histories=histories)
    got = defaultdict(list)
    for u in sorted(interleaved.updates(found).collect(), key=lambda r: (r["id"], r["place"])):
        got[u["id"]].append((u["pattern_id"], u["gap_strength"], u["old_elo"], u["new_elo"], u["delta"], u["confidence_weight"]))
    after = interleaved.states(found)
    signals = {(r["user_id"], r["pattern_id"]): (r["gap_strength"], r["frequency"]) for r in interleaved.gap_signals(after).collect()}
    elos = {(r["user_id"], r["pattern_id"]): (r["elo"], r["updates"]) for r in interleaved.pattern_elos(after).collect()}
    for user, own in by_user(rows).items():
        out, said, elo, times = plain(own, histories)
        for i, want in out.items():
            assert got[i] == want
        assert {p: v for (u, p), v in signals.items() if u == user} == {p: v[:2] for p, v in said.items()}
        assert {p: v for (u, p), v in elos.items() if u == user} == {p: (e, times[p]) for p, e in elo.items()}


def test_every_user_of_the_given_table(spark):
    rows = interleaved.analysed(Tables(spark, "/root/testdata/sf0.01").submissions)
    elos = {(r["user_id"], r["pattern_id"]): r["elo"] for r in interleaved.pattern_elos(interleaved.states(interleaved.replay(rows))).collect()}
    for user, own in by_user([r.asDict(recursive=True) for r in rows.collect()]).items():
        assert {p: e for (u, p), e in elos.items() if u == user} == plain(own)[2]


def state_of(found):
    return {r["user_id"]: r["state"].asDict(recursive=True) for r in found.collect()}


@pytest.mark.parametrize("cuts", [[50], [1, 2, 100], [20, 40, 60, 80, 100, 120]])
def test_any_cut_into_batches(spark, cuts):
    rows = sorted(made(), key=lambda r: (r["at"], r["id"]))
    whole = state_of(interleaved.states(interleaved.replay(spark.createDataFrame(rows, SCHEMA))))
    held = None
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        held = interleaved.states(interleaved.replay(spark.createDataFrame(rows[a:b], SCHEMA), start=held))
        held = spark.createDataFrame(held.collect(), held.schema)
    assert state_of(held) == whole


def test_partitions_and_empty_tables(spark):
    rows = spark.createDataFrame(made(), SCHEMA)
    assert state_of(interleaved.states(interleaved.replay(rows.repartition(9)))) == state_of(interleaved.states(interleaved.replay(rows.coalesce(1))))
    assert interleaved.replay(rows.limit(0)).count() == 0
    assert interleaved.updates(interleaved.replay(rows.filter("id = 3").withColumn("detections", F.lit(None).cast("array<struct<pattern_id:string,confidence:double>>")))).count() >= 1


def test_states_alone(spark):
    rows = spark.createDataFrame([(u, i, i * 10**9, "ab"[i % 2], i % 7 / 10, None, ["c"], "NO_MATCH") for u in (1, 2) for i in range(20)], SCHEMA)
    alone = interleaved.replay(rows, told=False)
    assert alone.count() == 2 and interleaved.updates(alone).count() == 0
    assert sorted(interleaved.states(alone).collect()) == sorted(interleaved.states(interleaved.replay(rows)).collect())
