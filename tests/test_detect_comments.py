"""Texts that differ only in comment lines at their end are parsed once; what isn't a comment there still counts."""

from kalmia.operators.detect import engine
from kalmia.plans import labelled

ODD = ('x = """\n# a"""', 'x = """\n# a', "x = 1 + \\\n# a", "def f():\n    # a", "f(1,\n# a", "# a\n# b", "x = 1\n# eval(", "x = 1\n  # a\n# b", "x = 1\n# a\r# b", "x = 1\n# a\x0cy = 2", "x = 1\n# a\ry = 2", "x = 1\n# \0", "x = 1\n# \ud800", "x = 1\n# a\rd = {}\rfor i in [1, 2]:\r    d[i] = d.get(i, 0) + 1")


def plain(code):
    return (error, []) if (error := engine.refused(code.strip())) else engine._parsed.__wrapped__(code.strip())


def test_same_as_the_whole_text():
    for code in [*ODD, *(f"{c}\n# {i}" for i, (_, _, c) in enumerate(labelled.ROWS)), *(c for _, _, c in labelled.ROWS)]:
        assert engine.analyze(code) == plain(code), code


def test_parsed_once(monkeypatch):
    parsed = []
    parse = engine.ast.parse
    monkeypatch.setattr(engine.ast, "parse", lambda text: parsed.append(text) or parse(text))
    engine._parsed.cache_clear()
    for i in range(50):
        assert engine.analyze(f"seen = {{}}\nfor x in [1, 2]:\n    seen[x] = 1\n# {i}")[0] is None
    assert len(parsed) == 1
