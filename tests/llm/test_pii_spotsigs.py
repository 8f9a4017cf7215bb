import hashlib
import re
import time
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalmia.llm import pii, spotsigs

FORM = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(FORM[kind], text or "") if ok(kind, m[0]))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def hold(table):
    n = 0
    for r in pii.query(table).join(table.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).distinct().collect():
        want = brute(r["text"])
        if r["doc_id"] is not None:
            n += 1
            assert hashlib.sha256(joined(want).encode()).hexdigest() == r["base_sha256"]
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
            spans = [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
            assert spans == sorted(spans) and set(want) <= set(spans)
            for a, b in combinations(sorted(set(spans) - set(want)), 2):
                assert a[2] <= b[0] or b[2] <= a[0]
    return n


def test_base_spans(docs, odd, none):
    assert hold(docs) == docs.count()
    hold(odd)
    assert pii.query(none).count() == 0


bits = st.sampled_from(["a@b.co", "_x@y.zz", "@", ".", "1.2.3.4", "255.255.255.255", "256", "0000001", "+1 (988) 555-2485", "+", "(", "-", " ", "4337166598464399", "4337-1665-9846-4399", "9", "12", "é", "😀", "\n", "x%", "a.b"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(bits, max_size=14).map("".join), min_size=30, max_size=30))
def test_base_spans_of_any_mixture(spark, texts):
    assert hold(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == 30


def test_regular_long_texts(spark):
    texts = ["1" * 60_000, "1 " * 30_000, "a" * 60_000 + "@", "x@" + "a." * 30_000, "+1" + "(" * 60_000, "1.2." * 20_000, "a at b dot " * 5_000, "[at] " * 10_000]
    hold(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_loose_formats_are_added_and_look_alikes_are_not(spark):
    yes = ["please call (415) 555-0132 today", "mail jane.doe [at] example [dot] com soon", "host 10[.]0[.]12[.]7 is down", "contact bob at widgets dot org now"]
    no = ["order 415 555 0132 shipped", "look there at noon dot dot", "version 1.2.3 of the part 300[.]400[.]500[.]600", "Thor andou the inwh. Eror 12 of 2345"]
    table = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.query(table).collect()}
    assert all(got[i] for i in range(len(yes))) and not any(got[len(yes) + i] for i in range(len(no))), got
    text = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert text[0] == "please call <phone> today" and text[1] == "mail <email> soon" and text[4] == no[0]


def brute_added(text, model):
    """Every proposal of every generator, its features and score in plain Python, then all pairs."""
    trees, thresholds = model
    found = set()
    for g, (kind, pattern) in enumerate(pii.GENERATORS):
        k = pii.KINDS.index(kind)
        for m in re.finditer(pattern, text) if re.search(pii.ANY_HINT, text) else ():
            d, before = re.sub("[^0-9]+", "", m[0]), text[max(0, m.start() - pii.CONTEXT) : m.start()]
            low = lambda p, x: float(bool(re.search(p, x)))
            x = [
                float(g), float(len(m[0])), float(len(d)), float(len(set(d)) or 1), float(14 <= len(d) <= 19 and luhn(d)), float(all(int(o) <= 255 for o in re.findall("[0-9]+", m[0]))),
                low(pii.FOR[kind], before), low(pii.AGAINST, before), low(r"[\[({]", m[0]), float(len(set(re.sub("[A-Za-z0-9]+", "", m[0]))) or 1),
                low(r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk)$", m[0]), low(r"^\(?[01]", m[0]),
            ]
            z = 0.0
            for tree in trees:
                while len(tree) > 1:
                    tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
                z += tree[0]
            if z * pii.RATE >= thresholds[k]:
                found.add((m.start(), k, m.end(), z * pii.RATE))
    over = lambda a, b: a[0] < b[2] and b[0] < a[2]
    base = brute(text)
    free = [c for c in found if not any(over(c, b) for b in base)]
    best = [c for c in free if not any(over(c, o) and (-o[3], o[0], o[1]) < (-c[3], c[0], c[1]) for o in free)]
    return sorted([*base, *(c[:3] for c in best)])


def brute_redacted(text, spans):
    at, out = 0, ""
    for s, k, e in spans:
        out, at = out + text[at:s] + f"<{pii.KINDS[k]}>", max(at, e)
    return out + text[at:]


def held_added(spark, table):
    model, rows = pii.trained(spark), pii.find(table).withColumn("red", F.expr(pii.redacted("coalesce(text, '')", "spans"))).select("text", "spans", "red").collect()
    n = 0
    for r in rows:
        want = brute_added(r["text"] or "", model)
        assert [(x["s"], x["k"], x["e"]) for x in r["spans"]] == want
        assert r["red"] == brute_redacted(r["text"] or "", want)
        n += len(set(want) - set(brute(r["text"])))
    return n


def test_added_spans_and_redaction(spark, docs, odd):
    held_added(spark, docs)
    held_added(spark, odd)
    made = [(i, " ".join(t for _, _, t in pii.examples(400, seed)[i::40])) for seed in (11, 12) for i in range(40)]
    crowd = "😀 call (415) 555-0132 or a@b.co, x at y dot com a [at] b [dot] com 10[.]0[.]12[.]7 00442071234567 00 44 207 123 4567 4337.1665.9846.4399 "
    made += [(100, crowd * 120), (101, "contact a at b dot c at d dot e " * 200), (102, "é" * 511 + crowd + "é" * 1023 + crowd), (103, "+1 (988) 555-2485" * 300)]
    assert held_added(spark, spark.createDataFrame(made, "doc_id long, text string")) > 300


def test_work_grows_with_the_spans(spark, tmp_path):
    took = {}
    for n in (500_000, 1_000_000, 2_000_000):
        # A table: of a text made by literals the optimizer would work out every branch, those not taken too.
        spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("mail someone@example.org, "), n).alias("text")).write.parquet(str(tmp_path / str(n)))
        began = time.monotonic()
        got = pii.query(spark.read.parquet(str(tmp_path / str(n)))).select("n_email", F.length("spans").alias("size")).first()
        took[n] = time.monotonic() - began
        assert got["n_email"] == n
    assert took[1_000_000] < 60 and took[2_000_000] < 2.5 * took[1_000_000]


# ---- spot signatures


def brute_signatures(text, n=3):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, before = [], 0
    for w in words:
        if w in spotsigs.ANCHORS:
            out.append((w, *content[before : before + n]))
        else:
            before += 1
    out = [x for x in out if len(x) == n + 1]
    if not words:
        return set()
    if len(content) < n:
        return {tuple(words)}
    return set(out) or {("", *content[i : i + n]) for i in range(len(content) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def held(table):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.query(table).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]] if rows else [], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(brute_signatures, (text, edited, after))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 16 * len(a) and len(r["edited_fingerprint"]) == 16 * len(b)
        assert abs(r["near_edited"] - jaccard(a, b)) < 1e-9 and abs(r["near_next"] - jaccard(a, c)) < 1e-9


def test_spotsigs(docs, odd, none):
    held(docs)
    held(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    held(docs.limit(1))
    assert spotsigs.query(odd).count() == odd.count()
    assert spotsigs.query(none).count() == 0


def test_equal_texts_have_equal_fingerprints(odd):
    prints = {}
    for r in spotsigs.query(odd).join(odd.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).collect():
        assert prints.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]


def test_near_duplicates(docs):
    prints = docs.select(F.col("doc_id").alias("id"), spotsigs.signatures(F.col("text")).alias("hashes"))
    sets = {r["id"]: frozenset(r["hashes"]) for r in prints.collect()}
    got = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.near_duplicates(prints, 0.7).collect()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    want = {(least[s], i): 1.0 for i, s in sets.items() if s and least[s] != i}
    for (a, i), (b, j) in combinations([(s, i) for s, i in least.items() if s], 2):
        if (x := jaccard(a, b)) >= 0.7:
            want[min(i, j), max(i, j)] = x
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_neighbours_in_many_ranges(monkeypatch, spark, kind):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 5)
    ids = [*range(0, 2000, 7), 10**9, 10**12, -5, *[3] * 40, *[None] * 30]
    turn = {"long": lambda i: i, "string": lambda i: None if i is None else f"d'{i:x}", "double": lambda i: None if i is None else i / 3}[kind]
    rows = [(turn(i), n % 25 if i in (3, None) else n) for n, i in enumerate(ids)]
    table = spark.createDataFrame(rows, f"doc_id {kind}, t long")
    got = spotsigs.neighbours(table, "doc_id", F.col("t"), {"t": "n", "doc_id": "next"}).collect()
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])
    order = sorted(known, key=lambda r: r[0], reverse=True) + sorted(r for r in rows if r[0] is None)
    want = [(*x, *y) for x, y in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted(((r["doc_id"], r["t"], r["next"], r["n"]) for r in got), key=str) == sorted(want, key=str)


def test_query_of_any_ids(spark, odd):
    """Nulls, repeats and ids that aren't numbers: every row with the text that follows it."""
    rows = [(f"k{i % 9}" if i % 4 else None, r["text"]) for i, r in enumerate(odd.collect())]
    got = spotsigs.query(spark.createDataFrame([*rows, *rows[:3]], "doc_id string, text string")).collect()
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), seed=42), "big", signed=True)
    texts = sorted(((i, t or "") for i, t in [*rows, *rows[:3]]), key=lambda r: signed(r[1]))
    order = sorted((r for r in texts if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in texts if r[0] is None]
    want = []
    for (i, own), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        sets = [brute_signatures(x) for x in (own, edited, after)]
        want.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(sets[0], sets[1]), 9), round(jaccard(sets[0], sets[2]), 9)))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str) == sorted(want, key=str)
