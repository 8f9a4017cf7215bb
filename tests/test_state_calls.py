"""Calls to the state store: each costs a round trip to the JVM, so they mustn't grow with a user's days or topics."""

import datetime
import json
import random

import pandas as pd

from kalmia.streaming import stateful


class Store:
    """Values and maps that count the calls to them."""

    def __init__(self, counted):
        self.counted, self.value, self.map = counted, None, {}

    def __getattribute__(self, name):
        if name not in ("counted", "value", "map"):
            self.counted[0] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802 - Spark's names
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.map[key]

    def iterator(self):
        return iter(list(self.map.items()))


class Handle:
    def __init__(self):
        self.counted = [0]

    def getValueState(self, *_):  # noqa: N802
        return Store(self.counted)

    getMapState = getValueState  # noqa: N815


def test_streaks_call_the_store_by_runs():
    handle, p, seen, rng = Handle(), stateful._Streaks(None), set(), random.Random(3)
    p.init(handle)
    for n in (400, 1, 25, 3):
        days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(90)) for _ in range(n)]
        seen |= set(days)
        handle.counted[0] = 0
        out = next(iter(p.handleInputRows((7,), iter([pd.DataFrame({"day": [*days, None]})]), None)))
        last = run = max(seen)
        while run - datetime.timedelta(days=1) in seen:
            run -= datetime.timedelta(days=1)
        assert tuple(out.iloc[0]) == (7, last, (last - run).days + 1)
        assert handle.counted[0] <= 12  # one run or few, of up to 90 days


def test_profiles_call_the_store_thrice():
    handle, p = Handle(), stateful._Profiles(False, None)
    p.init(handle)
    rows = [{"topic": t, "verdict": "pass", "difficulty": "Easy", "detected_pattern": "a", "expected_pattern": "a", "at_us": i, "id": i, "user_id": 7} for i, t in enumerate([*"abcdefghij", None] * 2)]
    for n in (1, 2):
        handle.counted[0] = 0
        out = pd.concat(p.handleInputRows((7,), iter([pd.DataFrame(rows)]), None))
        assert handle.counted[0] <= 3
        assert out["attempt_count"].tolist() == [2 * n] * 11


def test_ratings_call_the_store_thrice():
    handle, p = Handle(), stateful._Ratings(False, None, None, False)
    p.init(handle)
    for n in (1, 2):
        rows = [
            {"user_id": 7, "id": 100 * n + i, "at_us": 10**15 + n * 10**9 + i, "detected_pattern": t, "detected_confidence": 0.5, "detections": [{"pattern_id": t, "confidence": 0.5}], "unmatched": ["z"], "match_result": "NO_MATCH"}
            for i, t in enumerate("abcdefghij"[: 12 - 2 * n])
        ]
        handle.counted[0] = 0
        out = pd.concat(p.handleInputRows((7,), iter([pd.DataFrame({"body": [json.dumps(r) for r in rows]})]), None))
        assert handle.counted[0] <= 3
        assert dict(zip(out["pattern_id"], out["updates"], strict=True)) == {**dict.fromkeys("abcdefghij"[: 12 - 2 * n], n), "z": 10 if n == 1 else 18}
