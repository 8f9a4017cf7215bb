"""Text, JSON and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kalmia.functions.taxonomy import LABELS, ORDER

# Replacements in order, (pattern, replacement).
HTML_STEPS = (
    (r"(?s)<style[^>]*>.*?</style>", ""), (r"<pre[^>]*>", "\n"), (r"</pre>", "\n"), (r"<br\s*/?>", "\n"), (r"<li[^>]*>", "\n- "), (r"<code[^>]*>", ""),
    (r"</code>", ""), (r"<[^>]+>", ""), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&amp;", "&"), (r"\n\s*\n+", "\n\n"),
)
# Substrings and imports that make code unsafe.
BANNED = ("eval(", "exec(", "__import__(", "compile(", "open(", "file(", "input(", "raw_input(", "globals()", "locals()", "vars()", "dir()", "help(", "breakpoint(", "exit(", "quit(")
DANGEROUS = ("subprocess", "os.system", "os.popen", "os.exec", "os.spawn", "os.fork", "os.kill", "ctypes", "pickle", "shelve", "marshal")


def html_to_text(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, to in HTML_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def url_slug(url: Column) -> Column:
    """What stands between /problems/ and the next slash."""
    return F.coalesce(F.regexp_extract(url, "/problems/([^/]*)", 1), F.lit(""))


def last_segment(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "([^/]+)/*$", 1), F.lit(""))


def normalised(pattern: Column) -> Column:
    return F.lower(F.translate(pattern, "- ", "__"))


def humanised(pattern: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, pattern), F.initcap(F.translate(pattern, "_", " ")))


def string_list(json: Column) -> Column:
    """A JSON array of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def topics_list(raw: Column) -> Column:
    """A JSON list, else a comma list without blanks."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    return F.when(F.rlike(raw, F.lit(r"^\s*\[.*\]\s*$")), F.coalesce(F.from_json(raw, "array<string>"), parts)).otherwise(parts)


def model_reply(content: Column) -> Column:
    """struct<patterns array<string>, confidence map<string,double>> of a reply with or without a code fence; null if unusable."""
    trimmed = F.regexp_replace(content, r"^\s+|\s+$", "")
    body = F.when(F.startswith(trimmed, F.lit("```")), F.nullif(F.regexp_extract(trimmed, r"(?s)\{.*\}", 0), F.lit(""))).otherwise(trimmed)
    parsed = F.from_json(body, "patterns array<string>, confidence map<string,double>")
    return F.when(parsed["patterns"].isNotNull(), parsed)


def clamped(value: Column) -> Column:
    """A number within [0, 1]; 0.5 where there is none."""
    number = value.try_cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def known_patterns(patterns: Column) -> Column:
    """Normalised ids of the taxonomy, sorted."""
    return F.array_sort(F.array_distinct(F.array_intersect(F.transform(patterns, normalised), F.array(*[F.lit(p) for p in ORDER]))))


def parsed_time(text: Column) -> Column:
    """An ISO time, naive ones in UTC; 2000-01-01 where it isn't one."""
    return F.coalesce(F.try_to_timestamp(text), F.lit("2000-01-01 00:00:00").cast("timestamp"))


def unsafe(code: Column) -> Column:
    """Why code is refused, or null."""
    text = F.regexp_replace(F.coalesce(code, F.lit("")), r"^\s+|\s+$", "")
    banned = F.try_element_at(F.filter(F.array(*[F.lit(n) for n in BANNED]), lambda b: F.contains(text, b)), F.lit(1))
    imported = F.try_element_at(F.filter(F.array(*[F.lit(n) for n in DANGEROUS]), lambda d: F.contains(text, F.concat(F.lit("import "), d)) | F.contains(text, F.concat(F.lit("from "), d))), F.lit(1))
    return (
        F.when(text == "", "Code string cannot be empty").when(banned.isNotNull(), F.concat(F.lit("Unsafe construct detected: "), banned))
        .when(imported.isNotNull(), F.concat(F.lit("Dangerous import detected: "), imported))
    )


def first_topic(topics: Column) -> Column:
    """The first of a comma list, trimmed."""
    return F.trim(F.split_part(topics, F.lit(","), F.lit(1)))


def test_case_lines(raw: Column) -> Column:
    """Example test cases: trimmed lines without blank ones."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def display_name(full_name: Column, name: Column, email: Column) -> Column:
    """The first name that isn't empty, else what stands before the @."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(full_name), some(name), F.split_part(email, F.lit("@"), F.lit(1)))


def stored_code(code: Column) -> Column:
    """Code as submissions keep it: its first 1000 characters."""
    return F.substring(code, 1, 1000)


def envelope(data: Column) -> Column:
    """The JSON reply that carries a row."""
    return F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")))
