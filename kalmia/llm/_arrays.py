"""Array expressions, as SQL text, whose work grows in proportion to an array's length.

Spark's higher-order functions copy an array that a fold appends to; so a fold over all of a long
array would be quadratic. Here folds run over slices of ``SLICE`` elements only. They are text, not
Columns, because one parse of a long expression takes far less than the calls that would build it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

#: Elements that one fold appends at most (beyond SLICE ** 3 elements, the topmost fold does more).
SLICE = 64
#: Code points in a block of ``blocks``.
BLOCK = 512

_numbers = itertools.count()


def fresh_names(n: int) -> list[str]:
    """Names for lambda variables that no other expression here uses."""
    return [f"v{next(_numbers)}" for _ in range(n)]


def let(value: str, use: Callable[[str], str]) -> str:
    """``use`` of a value that is computed once."""
    (v,) = fresh_names(1)
    return f"transform(array({value}), {v} -> {use(v)})[0]"


def transform(array: str, use: Callable[[str, str], str]) -> str:
    v, i = fresh_names(2)
    return f"transform({array}, ({v}, {i}) -> {use(v, i)})"


def keep(array: str, test: Callable[[str, str], str]) -> str:
    v, i = fresh_names(2)
    return f"filter({array}, ({v}, {i}) -> {test(v, i)})"


def some(array: str, test: Callable[[str], str]) -> str:
    (v,) = fresh_names(1)
    return f"exists({array}, {v} -> {test(v)})"


def fold(array: str, start: str, step: Callable[[str, str], str], end: Callable[[str], str] = lambda a: a) -> str:
    a, x, last = fresh_names(3)
    return f"aggregate({array}, {start}, ({a}, {x}) -> {step(a, x)}, {last} -> {end(last)})"


def scan(values: str, zero: int, op: Callable[[str, str], str], levels: int = 2) -> str:
    """For each int of an array what ``op``, associative with the neutral ``zero``, makes of all before it."""
    def slow(part: str, start: str) -> str:
        state = f"named_struct('at', {start}, 'out', cast(array() AS array<int>))"
        return fold(part, state, lambda a, x: f"named_struct('at', {op(f'{a}.at', x)}, 'out', concat({a}.out, array({a}.at)))", lambda a: f"{a}.out")

    def sliced(v: str) -> str:
        slices = transform(f"sequence(0, (size({v}) - 1) DIV {SLICE})", lambda i, _: f"slice({v}, cast({i} * {SLICE} + 1 AS int), {SLICE})")

        def joined(parts: str) -> str:
            totals = transform(parts, lambda p, _: fold(p, str(zero), op))
            return let(scan(totals, zero, op, levels - 1), lambda starts: f"flatten({transform(parts, lambda p, i: slow(p, f'get({starts}, {i})'))})")

        return let(slices, joined)

    if levels == 0:
        return slow(values, str(zero))
    return let(values, lambda v: f"CASE WHEN size({v}) <= {SLICE} THEN {slow(v, str(zero))} ELSE {sliced(v)} END")


def blocks(text: str) -> str:
    """A text in pieces of ``BLOCK`` code points: taking a substring from the middle of a long text counts from its start."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}+', 0)"


def between(pieces: str, start: str, size: str) -> str:
    """``size`` (up to ``BLOCK``) code points from ``start`` (from 0) of the text whose ``blocks`` are given."""
    first = f"cast({start} DIV {BLOCK} AS int)"
    return f"substring(concat(coalesce(get({pieces}, {first}), ''), coalesce(get({pieces}, {first} + 1), '')), {start} - {first} * {BLOCK} + 1, {size})"


def groups(ordered: str, of: Callable[[str], str]) -> str:
    """Slices of an ordered array that isn't empty, cut wherever ``of`` an element differs from ``of`` the one before."""
    heads = keep(f"sequence(0, size({ordered}) - 1)", lambda i, _: f"{i} = 0 OR {of(f'get({ordered}, {i})')} <> {of(f'get({ordered}, {i} - 1)')}")
    return let(heads, lambda h: transform(h, lambda at, j: f"slice({ordered}, {at} + 1, coalesce(get({h}, {j} + 1), size({ordered})) - {at})"))
