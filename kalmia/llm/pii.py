"""Operator 9, personal data: pattern spans that always count, and candidates judged by boosted trees.

Base spans are the leftmost non-overlapping matches of a pattern per kind (email, ip, card, phone)
that pass its check. Beyond these, generators of high recall propose spans of looser formats (spelt
or bracketed addresses, national phone numbers, numbers with other separators); proposals of
different generators may overlap. Gradient-boosted trees score each by features of its format and
of the words before it; where the score reaches its kind's calibrated threshold, and no base span
and no better proposal overlaps it, it is a span too.

The trees are trained by numpy on the driver from invented sentences (``examples``, a fixed
number), whose features the same DataFrame expressions compute that judge the corpus. They become
CASE expressions: over the corpus everything runs in the JVM, in one pass without a shuffle.

Spans count code points, end exclusive. Patterns are written so that no text, however long or
regular, makes them backtrack or recurse: runs are possessive and start only where a run starts (or
where the match before ended). Work grows in proportion to a text's length and its spans: offsets and
overlaps come from folds over short slices (``_arrays``). Null texts count as empty and have no spans.
Repeated rows get repeated results; an empty table gives an empty result; result columns replace
input columns of the same names.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalmia.llm._arrays import BLOCK, between, blocks, fold, groups, keep, let, scan, some, transform
from kalmia.llm._common import fresh, ref, text_or_empty, without

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; each gives the matches of the plain form beside it.
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"[0-9](?:[\x20-]?[0-9])++",  # [0-9]([\x20-]?[0-9])+
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators: (kind, pattern).
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}[\x20.()-][0-9\x20.()-]{5,16}[0-9](?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{2,7}(?![0-9])"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[\[(](?:dot|\.)[\])]\x20?[0-9]{1,3}){3}(?![0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}){1,6}"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{1,63}){1,6}(?![A-Za-z0-9])"),
)
#: A text that no generator can match has nothing of this.
ANY_HINT = r"[0-9]{3}|[\[({]\x20?(?:at|AT|@|dot|\.)\x20?[\])}]|\x20(?:dot|DOT)\x20"
#: Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)mail|contact|write|reach|correo|courriel|kontakt|schreib|escrib|écri",
    "ip": r"(?i)\bip\b|host|server|address|login|adresse|servidor|serveur",
    "card": r"(?i)card|visa|master|amex|credit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|fax|mobile|cell|dial|whatsapp|sms|anruf|appel|llam",
}
AGAINST = r"(?i)isbn|order|invoice|version|build|part|item|serial|ref|sku|commit|page|chapter|look|meet|was|is|build"
CONTEXT = 32
#: No proposal is longer than so many code points, as the generators bound each part.
LONGEST = 1_024


_SPAN = "struct<s:int,k:int,e:int>"


def located(text: str, pattern: str, hint: str | None = None) -> str:
    """array<struct<s int, e int, m string>> of a pattern's non-overlapping matches, in code points."""
    none = "cast(array() AS array<struct<s:int,e:int,m:string>>)"

    def place(m: str) -> str:
        sizes = f"zip_with(slice(split({text}, r'{pattern}', -1), 1, size({m})), {m}, (p, q) -> named_struct('p', char_length(p), 'n', char_length(q), 'm', q))"

        def spans(z: str) -> str:
            ended = scan(transform(z, lambda x, _: f"{x}.p + {x}.n"), 0, lambda a, x: f"{a} + {x}")  # where the match before ended
            return let(ended, lambda at: transform(z, lambda x, i: f"named_struct('s', get({at}, {i}) + {x}.p, 'e', get({at}, {i}) + {x}.p + {x}.n, 'm', {x}.m)"))

        return f"CASE WHEN size({m}) > 0 THEN {let(sizes, spans)} ELSE {none} END"

    found = let(f"regexp_extract_all({text}, r'{pattern}', 0)", place)
    return found if hint is None else f"CASE WHEN contains({text}, '{hint}') THEN {found} ELSE {none} END"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]+', '')"


def luhn(d: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    values = transform(keep(f"split(reverse({d}), '')", lambda x, _: f"{x} <> ''"), lambda x, i: f"CASE WHEN {i} % 2 = 0 THEN cast({x} AS int) WHEN {x} > '4' THEN 2 * cast({x} AS int) - 9 ELSE 2 * cast({x} AS int) END")
    return f"{fold(values, '0', lambda a, x: f'{a} + {x}')} % 10 = 0"


def octets(m: str) -> str:
    """Whether every number in a string is at most 255."""
    return rf"NOT rlike({m}, r'(?<![0-9])0*+(?:[1-9][0-9]{{3}}|[3-9][0-9]{{2}}|2[6-9][0-9]|25[6-9])')"


def passes(kind: str, m: str) -> str:
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return f"(length({digits(m)}) BETWEEN 14 AND 19 AND {luhn(digits(m))})"
    if kind == "phone":
        return f"length({digits(m)}) BETWEEN 10 AND 15"
    return "true"


def base_spans(text: str) -> str:
    """array<struct<s, k, e>>: spans with their kind's number, by start, then kind."""
    def of(k: int, kind: str) -> str:
        ok = keep(located(text, BASE[kind], HINT[kind]), lambda x, _: passes(kind, f"{x}.m"))
        return transform(ok, lambda x, _: f"named_struct('s', {x}.s, 'k', {k}, 'e', {x}.e)")

    return f"array_sort(concat({', '.join(of(k, kind) for k, kind in enumerate(KINDS))}))"


FEATURES = ("generator", "length", "n_digits", "distinct", "luhn", "octets", "for", "against", "brackets", "separators", "plain_end", "zero_start")


def candidates(text: str) -> str:
    """array<struct<s, k, e, FEATURES...>>: proposals of all generators."""
    def featured(g: int, kind: str, pattern: str, pieces: str) -> str:
        def of(x: str, before: str, d: str) -> str:
            m = f"{x}.m"
            values = (
                f"{g}e0", f"char_length({m})", f"length({d})", f"size(array_distinct(split({d}, '')))", f"length({d}) BETWEEN 14 AND 19 AND {luhn(d)}", octets(m),
                f"rlike({before}, r'{FOR[kind]}')", f"rlike({before}, r'{AGAINST}')", rf"rlike({m}, r'[\[({{]')", f"size(array_distinct(split(regexp_replace({m}, '[A-Za-z0-9]+', ''), '')))",
                f"rlike({m}, r'(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk)$')", rf"rlike({m}, r'^\(?[01]')",
            )
            return f"named_struct('s', {x}.s, 'k', {KINDS.index(kind)}, 'e', {x}.e, {', '.join(f"'{n}', cast(({v}) AS double)" for v, n in zip(values, FEATURES, strict=True))})"

        before = lambda x: between(pieces, f"greatest(0, {x}.s - {CONTEXT})", f"least({x}.s, {CONTEXT})")
        return transform(located(text, pattern), lambda x, _: let(before(x), lambda b: let(digits(f"{x}.m"), lambda d: of(x, b, d))))

    every = let(blocks(text), lambda pieces: f"concat({', '.join(featured(g, kind, pattern, pieces) for g, (kind, pattern) in enumerate(GENERATORS))})")
    kind_of = f"array<struct<s:int,k:int,e:int,{','.join(f'`{n}`:double' for n in FEATURES)}>>"
    return f"CASE WHEN rlike({text}, r'{ANY_HINT}') THEN {every} ELSE cast(array() AS {kind_of}) END"


# ---- the trees


def examples(n: int = 2_400, seed: int = 5) -> list[tuple[int, int, str]]:
    """(id, label, sentence) with one proposal each: personal data in loose formats, and what merely looks like it."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def valid_card(k: int) -> str:
        while True:
            d = num(k)
            if sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
                return d

    def grouped(d: str, sep: str) -> str:
        return sep.join([d[:4], d[4:8], d[8:12], d[12:]])

    def one(positive: bool) -> str:
        pick = rng.randrange(5)
        if pick == 0:
            m = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(rng.choice("23456789") + num(2), num(3), num(4))
            return f"{rng.choice(['call', 'phone:', 'tel.', 'my mobile is', 'fax', 'dial'])} {m}" if positive else f"{rng.choice(['order', 'part', 'invoice no', 'isbn', word(), word(), word()])} {num(3)}{rng.choice(' .-')}{num(3)}{rng.choice(' .-')}{num(4)}"
        if pick == 1:
            return f"{rng.choice(['call', 'phone', 'tel', 'fax'])} 00{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}" if positive else f"{rng.choice(['serial', 'item', 'build', word(), word()])} 00{rng.randint(1, 9)}-{num(4)}-{num(3)}"
        if pick == 2:
            sep = rng.choice("./_")
            return f"{rng.choice(['card', 'visa', 'pay with', word(), word()])} {grouped(valid_card(16), sep)}" if positive else f"{rng.choice(['serial', 'card', 'build', word(), word()])} {sep.join([num(4), num(4), num(4), num(rng.choice([2, 4, 4]))])}"
        if pick == 3:
            dot = rng.choice(["[.]", "(.)", "[dot]", " [dot] "])
            parts = [str(rng.randint(0, 255)) for _ in range(4)] if positive else [str(rng.randint(0, 999)) for _ in range(3)] + [str(rng.randint(256, 999))]
            return f"{rng.choice(['host', 'server', 'ip', word()])} {dot.join(parts)}"
        if positive:
            at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", ".")])
            return f"{rng.choice(['mail', 'contact', 'write to', 'reach me:', word()])} {word()}{rng.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
        return f"{rng.choice(['look', 'meet', 'we were', word()])} {word()} at {word()} dot {word()}"

    def plain() -> str:
        return " ".join(word() for _ in range(rng.randint(2, 6)))

    return [(i, int(y), f"{plain()} {one(y)} {plain()}") for i in range(n) for y in [rng.random() < 0.5]]


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    """A regression tree on gradients g and curvatures h: (value,) or (feature, threshold, low, high)."""
    best = (1e-6, None, None)
    total = g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            cuts = (values[1:] + values[:-1]) / 2
            for cut in cuts[:: max(1, len(cuts) // 16)]:
                low = x[:, f] < cut
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - total
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] is None:
        return (float(-g.sum() / (h.sum() + 1)),)
    low = x[:, best[1]] < best[2]
    return (best[1], best[2], grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


def value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] < tree[1], value(tree[2], x), value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4) -> list[tuple]:
    """Trees whose sum, times ``rate``, is the log-odds of label 1."""
    trees, z = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(x, p - y, p * (1 - p), depth))
        z = z + rate * value(trees[-1], x)
    return trees


RATE, PRECISION = 0.4, 0.99


def calibrate(z: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> list[float]:
    """For each kind the lowest log-odds (at least even) from which on its proposals reach ``PRECISION``."""
    out = []
    for k in range(len(KINDS)):
        zk, yk = z[kinds == k], y[kinds == k]
        order = np.argsort(-zk)
        good = np.cumsum(yk[order]) / np.arange(1, len(yk) + 1)
        ends = np.append(zk[order][1:] != zk[order][:-1], True) if len(zk) else np.zeros(0, bool)
        ok = np.flatnonzero((good >= PRECISION) & ends & (zk[order] >= 0))
        out.append(float(zk[order][ok[-1]]) - 1e-6 if len(ok) else math.inf)
    return out


_trained: dict = {}


def trained(spark) -> tuple[list[tuple], list[float]]:
    """Trees and thresholds, trained once a driver; two thirds of the examples train, one calibrates."""
    if "model" not in _trained:
        rows = spark.createDataFrame(examples(), "id int, y int, text string").select("id", "y", F.explode(F.expr(candidates("text"))).alias("c")).select("id", "y", "c.*")
        found = sorted(rows.collect(), key=lambda r: (r["id"], r["s"], r["generator"]))
        x = np.array([[r[n] for n in FEATURES] for r in found])
        y, kinds, fold = (np.array(v) for v in zip(*((r["y"], r["k"], r["id"] % 3) for r in found), strict=True))
        trees = boost(x[fold > 0], y[fold > 0])
        held = fold == 0
        _trained["model"] = trees, calibrate(RATE * sum(value(t, x[held]) for t in trees), y[held], kinds[held])
    return _trained["model"]


def _case(tree: tuple, c: str) -> str:
    if len(tree) == 1:
        return f"cast('{tree[0]!r}' AS double)"
    return f"CASE WHEN {c}.`{FEATURES[tree[0]]}` < cast('{tree[1]!r}' AS double) THEN {_case(tree[2], c)} ELSE {_case(tree[3], c)} END"


def judged(proposals: str, model: tuple[list[tuple], list[float]]) -> str:
    """array<struct<s, k, e, z>>: proposals that reach their kind's threshold."""
    trees, thresholds = model
    total = lambda c: " + ".join(["0e0", *(_case(tree, c) for tree in trees)])
    scored = transform(proposals, lambda c, _: f"named_struct('s', {c}.s, 'k', {c}.k, 'e', {c}.e, 'z', ({total(c)}) * {RATE}e0)")
    least = ", ".join(f"cast('{min(t, 1e9)!r}' AS double)" for t in thresholds)
    return keep(scored, lambda c, _: f"{c}.z >= get(array({least}), {c}.k)")


def resolved(base: str, extra: str) -> str:
    """Base spans and the judged ones that overlap neither them nor a better one."""
    none = f"cast(null AS {_SPAN.removesuffix('>')},z:double>)"

    def free(events: str) -> str:
        """The judged ones behind whose start no base span reaches that begins before their end."""
        reach = scan(transform(events, lambda x, _: f"{x}.e"), -1, lambda a, x: f"greatest({a}, {x})")
        seen = let(reach, lambda r: transform(events, lambda x, i: f"CASE WHEN {x}.c IS NOT NULL AND get({r}, {i}) <= {x}.c.s THEN {x}.c END"))
        return f"array_sort({keep(seen, lambda c, _: f'{c} IS NOT NULL')})"

    def best(ordered: str) -> str:
        once = keep(ordered, lambda c, i: f"{i} = 0 OR {c} <> get({ordered}, {i} - 1)")
        part = lambda c: f"{c}.s DIV {LONGEST}"
        wins = lambda o, c: f"({o}.z > {c}.z OR ({o}.z = {c}.z AND ({o}.s < {c}.s OR ({o}.s = {c}.s AND {o}.k < {c}.k))))"
        beaten = lambda c, near: some(near, lambda o: f"{c}.s < {o}.e AND {o}.s < {c}.e AND {wins(o, c)}")

        def of(parts: str) -> str:
            def around(j: str, g: str) -> str:
                beside = lambda d: f"coalesce(CASE WHEN {part(f'get({parts}, {j} + {d})[0]')} = {part(f'{g}[0]')} + {d} THEN get({parts}, {j} + {d}) END, slice({g}, 1, 0))"
                return f"concat({beside(-1)}, {g}, {beside(1)})"

            return f"flatten({transform(parts, lambda g, j: let(around(j, g), lambda near: keep(g, lambda c, _: f'NOT {beaten(c, near)}')))})"

        return let(once, lambda x: f"CASE WHEN size({x}) <= 1 THEN {x} ELSE {let(groups(x, part), of)} END")

    def both(box: str) -> str:
        # Ends of judged spans come before base spans that start there.
        ends = transform(f"{box}.extra", lambda c, _: f"named_struct('at', {c}.e, 'q', 0, 'e', -1, 'c', {c})")
        starts = transform(f"{box}.base", lambda b, _: f"named_struct('at', {b}.s, 'q', 1, 'e', {b}.e, 'c', {none})")
        chosen = let(let(f"array_sort(concat({ends}, {starts}))", free), best)
        return f"array_sort(concat({box}.base, {transform(chosen, lambda c, _: f"named_struct('s', {c}.s, 'k', {c}.k, 'e', {c}.e)")}))"

    return f"CASE WHEN size({extra}) = 0 THEN {base} ELSE {let(f"named_struct('base', {base}, 'extra', {extra})", both)} END"


def written(spans: str) -> str:
    """``kind:start:end``, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join({transform(spans, lambda x, _: f"concat_ws(':', get(array({names}), {x}.k), {x}.s, {x}.e)")}, ',')"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans: array<struct<s int, k int, e int>>, k a place in ``KINDS``."""
    docs = without(docs, "base_spans", "spans")
    extra, whole = fresh(docs, "extra", "whole")
    model = trained(docs.sparkSession)
    rows = docs.withColumn(whole, text_or_empty(text)).withColumns({"base_spans": F.expr(base_spans(whole)), extra: F.expr(judged(candidates(whole), model))})
    return rows.withColumn("spans", F.expr(resolved("base_spans", extra))).drop(extra, whole)


def redacted(text: str, spans: str) -> str:
    """The text with its spans (by start) replaced by their kinds in angle brackets, block by block."""
    names = ", ".join(f"'<{k}>'" for k in KINDS)

    def of(box: str) -> str:
        # A block's own mark (k -1) comes before the spans that start in it.
        heads = transform(f"{box}.pieces", lambda _, j: f"named_struct('s', {j} * {BLOCK}, 'k', -1, 'e', -1)")

        def joined(events: str) -> str:
            ended = scan(transform(events, lambda x, _: f"{x}.e"), -1, lambda a, x: f"greatest({a}, {x})")
            numbered = lambda reach: transform(events, lambda x, i: f"named_struct('s', {x}.s, 'k', {x}.k, 'e', {x}.e, 'reach', get({reach}, {i}))")

            def block(part: str, j: str) -> str:
                piece = lambda start, size: f"substring(get({box}.pieces, {j}), {start} - {j} * {BLOCK} + 1, {size})"
                start = f"named_struct('at', greatest({j} * {BLOCK}, {part}[0].reach), 'out', '')"
                step = lambda a, x: (
                    f"named_struct('at', greatest({a}.at, {x}.e), 'out', concat({a}.out, CASE WHEN {x}.s > {a}.at THEN {piece(f'{a}.at', f'{x}.s - {a}.at')} ELSE '' END, get(array({names}), {x}.k)))"
                )
                rest = lambda a: f"concat({a}.out, CASE WHEN {a}.at < ({j} + 1) * {BLOCK} THEN {piece(f'{a}.at', str(BLOCK))} ELSE '' END)"
                return fold(keep(part, lambda x, _: f"{x}.k >= 0"), start, step, rest)

            # Slices begin with a block's mark: there are as many as blocks.
            cut = lambda o: groups(o, lambda x: f"{x}.s DIV {BLOCK}")
            return f"array_join({transform(let(let(ended, numbered), cut), block)}, '')"

        ordered = f"array_sort(concat({heads}, {transform(f'{box}.spans', lambda x, _: f"named_struct('s', {x}.s, 'k', {x}.k, 'e', {x}.e)")}))"
        return f"CASE WHEN size({box}.spans) = 0 THEN {box}.text ELSE {let(ordered, joined)} END"

    return let(f"named_struct('text', {text}, 'spans', {spans}, 'pieces', {blocks(text)})", of)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``find`` in the text replaced by its kind in angle brackets."""
    found = find(docs, text)
    (whole,) = fresh(found, "whole")
    return found.withColumn(whole, text_or_empty(text)).withColumn(text, F.expr(redacted(whole, "spans"))).drop("base_spans", "spans", whole)


def query(docs: DataFrame) -> DataFrame:
    rows = find(docs.select("doc_id", "text")).select("doc_id", "base_spans", "spans")
    count = lambda k: F.expr(f"size({keep('base_spans', lambda x, _: f'{x}.k = {k}')})").cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.expr(written("base_spans")).cast("binary"), 256).alias("base_sha256"), F.expr(written("spans")).alias("spans"),
    )
