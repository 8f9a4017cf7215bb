"""Operator 10, document fingerprints by spot signatures (SpotSigs, Theobald et al., 2008).

Wherever a common word (an anchor) stands in a text, the next ``CHAIN`` content words behind it,
other common words skipped, form with it one signature. A text's fingerprint is the sorted set of
its signatures' 64-bit hashes, written as hexadecimal digits. Two texts' likeness is the Jaccard
similarity of these sets. Texts without an anchor use every word as one; a text with too few content
words for a chain has one signature, its words. Texts without words have the empty fingerprint;
two empty ones are alike (1), an empty and another one are not (0).

``near_duplicates`` compares as SpotSigs does: sets are partitioned by length, only partitions whose
lengths allow the threshold meet, and only over each set's rarest signatures (as many as a pair at
the threshold must share one of); a bound on the lengths goes first, the exact Jaccard last.

``neighbours`` gives each row its next row in an order without one task ordering all rows: rows are
range partitioned at keys of a sample (only cuts come from it) with a bounded number of rows aimed at
between two cuts, equal ids cut by a hash of their text, and the first row of each range is also
dealt, as a ghost, to the range before it.

Null texts count as empty; null doc_ids come last in the order; ids may be of any type that orders.
Rows of one doc_id follow each other by a hash of their text, so repeated rows are neighbours. Very
long texts count whole. An empty table gives an empty result. Columns that ``neighbours`` adds are
replaced.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalmia.llm._common import fresh, materialize, ref, without

#: Content words in a signature.
CHAIN = 3
#: Rows that ``neighbours`` aims at between two cuts, the most cuts, and keys of the sample for each.
RANGE_ROWS, MOST_CUTS, SAMPLED = 4_000, 20_000, 20
#: Rows of one signature and length partition that ``near_duplicates`` compares in one task.
BLOCK = 2_000

# The commonest function words of four languages.
ENGLISH = "the of and a to in is that was it for on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each how them then she many some so these would other into has more her two him see could no make than been its who now my over down only way may said our out just about after also did any where most me back much before very through between under while because".split()
FRENCH = "le la les de des du un une et en est que qui dans pour pas par sur au aux avec ce cette ces il elle ils elles nous vous je tu se sa son ses ne plus ou mais comme si leur leurs on y été être avoir fait sont était ont".split()
GERMAN = "der die das und den dem des ein eine einer eines einem einen in zu von mit ist im für auf nicht sich als auch es an er sie wir ihr hat dass bei aus nach war werden wird sind oder aber wie so um am nur noch".split()
SPANISH = "el la los las de del y en un una que es por con para no se su al lo como más pero sus le ya o este esta sí porque entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros".split()
ANCHORS = tuple(sorted({*ENGLISH, *FRENCH, *GERMAN, *SPANISH}))


def words(text: Column) -> Column:
    """Lower-cased stretches of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def signatures(text: Column, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """Sorted distinct hashes of a text's spot signatures."""
    common = lambda w: w.isin(*anchors)

    def made(box: Column) -> Column:
        spots = F.filter(F.transform(box["w"], lambda w, i: F.when(common(w), i)), lambda p: p.isNotNull())

        def from_anchors(inner: Column) -> Column:
            # Before the j-th anchor at place p stand p - j content words.
            chains = F.transform(inner["spots"], lambda p, j: F.when(p - j + chain <= F.size(inner["content"]), F.concat(F.array(F.get(inner["w"], p)), F.slice(inner["content"], p - j + 1, chain))))
            every = F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(inner["content"]) - chain + 1)),
                lambda i: F.concat(F.array(F.lit("")), F.slice(inner["content"], i, chain)),
            )
            full = F.filter(chains, lambda c: c.isNotNull())
            chosen = (
                F.when(F.size(inner["w"]) == 0, F.array().cast("array<array<string>>"))
                .when(F.size(inner["content"]) < chain, F.array(inner["w"]))
                .when(F.size(inner["spots"]) == 0, every)
                .when(F.size(full) == 0, every)
                .otherwise(full)
            )
            return F.array_sort(F.array_distinct(F.transform(chosen, lambda c: F.xxhash64(c))))

        inner = F.struct(box["w"].alias("w"), spots.alias("spots"), F.filter(box["w"], lambda w: ~common(w)).alias("content"))
        return F.transform(F.array(inner), from_anchors)[0]

    return F.transform(F.array(F.struct(words(text).alias("w"))), made)[0]


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def near_duplicates(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """prints (id, hashes; ids distinct) to pairs (a, b, likeness), a < b, of at least the threshold.

    Equal fingerprints are one set: their ids meet only their smallest id. Empty ones link to none.
    """
    spread = prints.filter(F.size("hashes") > 0).withColumn("key", F.sha2(F.to_json("hashes"), 256))
    heads = materialize(spread.groupBy("key").agg(F.min("id").alias("id"), F.first("hashes").alias("hashes")).select("key", "id", "hashes", F.size("hashes").alias("n")))
    copies = spread.join(heads.select("key", F.col("id").alias("a")), "key").filter("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("likeness"))
    spots = heads.select("id", "n", F.explode("hashes").alias("h"))
    rarity = spots.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    # Partition k holds the lengths from (1/t)^k on: partners are in the same or in the next one.
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    rare = spots.join(rarity, "h").withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).withColumn("part", part)
    rare = materialize(rare.select("id", "n", "h", "part"))
    left = rare.select("h", F.col("id").alias("x"), F.col("n").alias("nx"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = rare.select("h", F.col("id").alias("y"), F.col("n").alias("ny"), "part")
    # Groups of more than BLOCK are cut into blocks (the left side holds the right one's rows too); each pair of blocks is dealt on its own; a pair of rows meets once.
    hot = materialize(left.groupBy("h", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"))
    blocked = lambda rows: rows.join(hot, ["h", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    all_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = blocked(left).withColumns({"i": F.pmod(F.xxhash64("x"), "blocks").cast("int"), "j": all_})
    right = blocked(right).withColumns({"j": F.pmod(F.xxhash64("y"), "blocks").cast("int"), "i": all_})
    lengths = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = left.join(right, ["h", "part", "i", "j"]).filter(lengths & (F.col("nx") >= F.col("ny") * threshold - 1e-9)).select("x", "y").distinct()
    sets = heads.select("id", "hashes")
    full = pairs.join(sets.select(F.col("id").alias("x"), F.col("hashes").alias("hx")), "x").join(sets.select(F.col("id").alias("y"), F.col("hashes").alias("hy")), "y")
    near = full.withColumn("likeness", likeness(F.col("hx"), F.col("hy"))).filter(F.col("likeness") >= threshold)
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness").unionByName(copies)


def _cuts(keys: DataFrame) -> list:
    """Rows (k, t) of a sample that cut the order (k descending, then t) into ranges of about ``RANGE_ROWS`` rows."""
    n = keys.count()
    wanted = min(math.ceil(n / RANGE_ROWS), MOST_CUTS)
    if wanted < 2:
        return []
    picked = keys.sample(min(1.0, SAMPLED * wanted / n), 11).orderBy(F.col("k").desc_nulls_last(), "t").collect()  # bounded by MOST_CUTS
    return [picked[i * len(picked) // wanted] for i in range(1, wanted)] if picked else []


def _range_of(key: Column, tie: Column, cuts: list, kind: str) -> Column:
    """How many cuts come at or before a row: found among every so-many-th cut, then among those behind it."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    # One literal, however many cuts: parsing it has no part that depends on a row, so it is done once.
    plain = lambda k: k if isinstance(k, int | float | str | None) else base64.b64encode(k).decode() if isinstance(k, bytes | bytearray) else str(k)
    text = json.dumps([[{"k": plain(c["k"]), "t": c["t"]} for c in part] for part in parts])
    nested = F.from_json(F.lit(text), f"array<array<struct<k:{kind},t:bigint>>>")
    passed = lambda c: F.coalesce((c["k"] > key) | (c["k"].eqNullSafe(key) & (c["t"] <= tie)) | (c["k"].isNotNull() & key.isNull()), F.lit(False))
    heads = F.size(F.filter(nested, lambda part: passed(part[0])))
    behind = F.size(F.filter(F.get(nested, F.greatest(heads - 1, F.lit(0))), passed))
    return F.when(heads == 0, F.lit(0)).otherwise((heads - 1) * step + behind)


def neighbours(rows: DataFrame, key: str, tie: Column, carried: dict[str, str], derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Each row with columns of the row that follows by descending ``key``; the first follows the last.

    carried: names of columns to take from the next row, and what to call them. ``tie``, a bigint, orders
    equal keys. ``derive`` adds columns once rows are dealt. A single row follows itself.
    """
    rows = without(rows, *carried.values())
    part, ghost, at, before, first = fresh(rows, "part", "ghost", "at", "before", "first")
    cuts = _cuts(rows.select(ref(key).alias("k"), tie.alias("t")))
    dealt = rows.withColumn(at, tie)
    dealt = dealt.withColumn(part, _range_of(ref(key), ref(at), cuts, rows.schema[key].dataType.simpleString()).cast("bigint"))
    # A row for each range: its first, as the largest key with the smallest tie.
    tops = materialize(dealt.groupBy(part).agg(F.max(F.struct(ref(key).alias("k"), F.bitwise_not(ref(at)).alias("t"))).alias(first)))
    last = tops.agg(F.max(part)).first()[0]
    tops = tops.select(ref(part).alias("_p"), F.col(f"{first}.k").alias("_k"), F.bitwise_not(F.col(f"{first}.t")).alias("_t"), F.coalesce(F.lag(part).over(Window.orderBy(part)), F.lit(last)).alias(before))
    ghosts = dealt.join(F.broadcast(tops), (ref(part) == F.col("_p")) & ref(key).eqNullSafe(F.col("_k")) & (ref(at) == F.col("_t")))
    ghosts = ghosts.select(*map(ref, rows.columns), ref(at), ref(before).alias(part), F.lit(True).alias(ghost))
    both = derive(dealt.withColumn(ghost, F.lit(False)).unionByName(ghosts))
    names = [c for c in both.columns if c not in (part, ghost, at)]
    w = Window.partitionBy(part).orderBy(ref(ghost), ref(key).desc_nulls_last(), ref(at))
    found = both.select("*", *[F.lead(ref(c)).over(w).alias(n) for c, n in carried.items()])
    return found.filter(~ref(ghost)).select(*map(ref, [*names, *carried.values()]))


def query(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    derive = lambda dealt: dealt.withColumns({"own": signatures(F.col("text")), "n_chars": F.char_length("text").cast("long")})
    rows = neighbours(rows, "doc_id", F.xxhash64("text"), {"text": "next_text", "own": "next_own"}, derive)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("changed"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
