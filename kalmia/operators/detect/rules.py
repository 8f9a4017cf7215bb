"""The detectors, in the order that breaks ties.

Each yields (evidence, node, words) for everything that speaks for its pattern: a key of
``evidence.EVIDENCE``, the place (None: no place) and what the text names. Its gate decides, from the
types found in the whole code, whether the pattern counts.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from kalmia.operators.detect import syntax as S
from kalmia.operators.detect.syntax import LOOP, ORDER, every

Item = tuple


@dataclass(frozen=True)
class Detector:
    pattern_id: str
    find: Callable[[ast.AST], Iterator[Item]]
    gate: Callable[[set[str]], bool]
    #: Without the gate, confidence is 0 and there is no evidence.
    strict: bool


DETECTORS: list[Detector] = []


def detector(pattern_id: str, gate: Callable[[set[str]], bool] = bool, strict: bool = False):
    def add(find):
        if any(d.pattern_id == pattern_id for d in DETECTORS):
            raise ValueError(f"two detectors of {pattern_id}")
        DETECTORS.append(Detector(pattern_id, find, gate, strict))
        return find

    return add


def some(*wanted: str) -> Callable[[set[str]], bool]:
    return lambda got: bool(got & set(wanted))


@detector("brute_force", some("nested_loops", "recursive_branching"), strict=True)
def brute_force(tree):
    for loop in every(tree, *LOOP):
        if any(isinstance(s, LOOP) for s in loop.body):
            yield "nested_loops", loop
    for loop in every(tree, ast.For):
        if S.is_range(loop.iter):
            yield "range_enumeration", loop, ast.unparse(loop.iter)
    for test in every(tree, ast.If):
        if isinstance(test.test, ast.Compare) and any(isinstance(x, ast.Subscript) for x in S.sides(test.test)):
            yield "pair_wise_check", test, ast.unparse(test.test)
    for fn in S.functions(tree):
        calls = len(S.self_calls(fn))
        if calls >= 2:
            yield "recursive_branching/calls", fn, fn.name, calls
        elif calls and any(every(fn, *LOOP)):
            yield "recursive_branching/loop", fn, fn.name


@detector("array_traversal", lambda g: bool(g & {"for_loop_over_collection", "iterator_based_loop"}) and bool(g & {"subscript_access", "element_update", "element_usage"}), strict=True)
def array_traversal(tree):
    for loop in every(tree, ast.For):
        if S.name(loop.iter):
            yield "for_loop_over_collection", loop, loop.iter.id
        elif S.called(loop.iter) in ("range", "enumerate"):
            yield "iterator_based_loop", loop, ast.unparse(loop.iter)
    for sub in every(tree, ast.Subscript):
        if S.name(sub.value):
            yield "subscript_access", sub, ast.unparse(sub)
            break
    for a in every(tree, ast.Assign):
        if any(isinstance(t, ast.Subscript) and S.name(t.value) for t in a.targets):
            yield "element_update", a, ast.unparse(a)
    for loop in every(tree, ast.For):
        given = loop.target.elts if isinstance(loop.target, ast.Tuple) else [loop.target]
        used = {S.name(t) for t in given} & S.names(loop.body)
        if S.name(loop.iter) and used:
            yield "element_usage", loop, ", ".join(sorted(used))
            break


@detector("sorting")
def sorting(tree):
    calls = list(every(tree, ast.Call))
    for call in calls:
        if S.method(call) == "sort":
            yield "sort_method_call", call, ast.unparse(call)
    for call in calls:
        if S.called(call) == "sorted":
            yield "sorted_function_call", call, ast.unparse(call)
    for call in calls:
        if any(k.arg == "key" for k in call.keywords):
            yield "custom_sort_key", call, ast.unparse(call)


def _empty_dict(value) -> bool:
    return isinstance(value, ast.Dict) and not value.keys


@detector("hash_map_lookup", lambda g: bool(g & {"dict_creation", "set_creation", "dict_comp_creation"}) and "membership_check" in g and bool(g & {"loop_structure", "comprehension_iteration"}), strict=True)
def hash_map_lookup(tree):
    for a in every(tree, ast.Assign):
        for t in filter(S.name, a.targets):
            if _empty_dict(a.value):
                yield "dict_creation/empty", a, t.id
            elif S.called(a.value) in ("dict", "set"):
                yield f"{S.called(a.value)}_creation", a, ast.unparse(a)
            elif isinstance(a.value, ast.DictComp):
                yield "dict_comp_creation", a, ast.unparse(a)
    for c in every(tree, ast.Compare):
        if any(isinstance(o, (ast.In, ast.NotIn)) for o in c.ops):
            yield "membership_check", c, ast.unparse(c)
    for n in every(tree, *LOOP, *S.COMPREHENSION):
        yield "loop_structure" if isinstance(n, LOOP) else "comprehension_iteration", n


@detector("hash_map_frequency", lambda g: "frequency_increment" in g or ("counter_import" in g and bool(g & {"counting_loop", "counter_constructor"})), strict=True)
def hash_map_frequency(tree):
    for a in every(tree, ast.Assign):
        for t in filter(S.name, a.targets):
            if _empty_dict(a.value):
                yield "empty_dict_creation", a, t.id
            elif S.called(a.value) == "dict":
                yield "dict_constructor", a, t.id
    for a in every(tree, ast.Assign):
        if S.binary(a.value, ast.Add) and S.method(a.value.left) == "get":
            for t in a.targets:
                if isinstance(t, ast.Subscript) and S.name(t.value) and S.name(t.value) == S.receiver(a.value.left):
                    yield "frequency_increment", a, ast.unparse(a)
    for loop in every(tree, ast.For):
        yield "counting_loop", loop
        break
    for i in every(tree, ast.ImportFrom):
        for alias in i.names:
            if i.module == "collections" and alias.name in ("Counter", "defaultdict"):
                yield "counter_import", i, alias.name
    for c in every(tree, ast.Call):
        if S.called(c) in ("Counter", "defaultdict") and c.args:
            yield "counter_constructor", c


def _raises(body) -> dict[str, set]:
    """Constants, negative ones too, that ``+=`` adds to variables."""
    out: dict[str, set] = {}
    for s in S.statements(body):
        if isinstance(s, ast.AugAssign) and isinstance(s.op, ast.Add) and S.name(s.target):
            if isinstance(s.value, ast.Constant):
                out.setdefault(s.target.id, set()).add(s.value.value)
            elif isinstance(s.value, ast.UnaryOp) and isinstance(s.value.op, ast.USub) and isinstance(s.value.operand, ast.Constant):
                out.setdefault(s.target.id, set()).add(-s.value.operand.value)
    return out


@detector("two_pointers_same")
def two_pointers_same(tree):
    seen = False
    for loop in every(tree, ast.While):
        moves = _raises(loop.body)
        steps = set().union(*moves.values())
        if len(moves) >= 2 and len(steps) >= 2 and steps & {1, -1}:
            seen = True
            yield "slow_fast_differential", loop, len(moves), steps
    for loop in every(tree, ast.While):
        moved = {n for s in S.statements(loop.body) if isinstance(s, ast.Assign) for t in s.targets if (n := S.name(t))}
        asked = moved & S.names(loop.test)
        if asked and len(moved) >= 2 and (not seen or any(a.attr == "next" for a in every(loop, ast.Attribute))):
            seen = True
            yield "offset_pointer_assignment", loop, len(moved), len(asked)


def _branches(test: ast.If) -> Iterator[list[ast.stmt]]:
    """The bodies of if, elif and else."""
    yield test.body
    for s in test.orelse:
        if not isinstance(s, ast.If):
            yield test.orelse
            return
        yield from _branches(s)


@detector("two_pointers_opposite")
def two_pointers_opposite(tree):
    for loop in every(tree, ast.While):
        test = loop.test
        if not (isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Lt, ast.LtE)) and S.name(test.left) and isinstance(test.comparators[0], (ast.Name, ast.Call))):
            continue
        left, right = test.left.id, S.name(test.comparators[0])
        moved = [*loop.body, *(s for t in loop.body if isinstance(t, ast.If) for branch in _branches(t) for s in branch)]
        ones = [s.op for s in moved if isinstance(s, ast.AugAssign) and S.name(s.target) and S.is_literal(s.value, 1)]
        if any(isinstance(o, ast.Add) for o in ones) and any(isinstance(o, ast.Sub) for o in ones):
            yield "left_pointer_increment", loop, left
            if right:
                yield "right_pointer_decrement", loop, right
            yield "convergence_loop", loop, left, right


def _first_if(body) -> ast.If | None:
    """The first branch of a body or of a for loop in it."""
    for s in body:
        found = s if isinstance(s, ast.If) else _first_if(s.body) if isinstance(s, ast.For) else None
        if found:
            return found
    return None


@detector("sliding_window_fixed")
def sliding_window_fixed(tree):
    for loop in every(tree, ast.For):
        var, full = S.name(loop.target), _first_if(loop.body)
        if not var or not full or not isinstance(full.test, ast.Compare):
            continue
        if S.name(full.test.left) != var and var not in S.names(full.test.comparators):
            continue
        kept = [(S.name(s.target) or (S.name(s.target.value) if isinstance(s.target, ast.Subscript) else None), s) for s in full.body if isinstance(s, ast.AugAssign)]
        if any(n and isinstance(s.op, ast.Sub) for n, s in kept):
            moves = any(n and n != var and isinstance(s.op, ast.Add) and S.is_literal(s.value, 1) for n, s in kept)
            yield "window_size_check", loop, var
            yield "window_expand", loop, var
            yield "window_shrink_fixed", loop, "element removal" + " and left pointer advancement" * moves


def _judges_window(test) -> bool:
    """A call that looks something up or measures, or a comparison with another variable than left and right."""
    measured = any(S.method(c) in ("get", "__getitem__", "count") or S.called(c) in ("len", "sum") for c in every(test, ast.Call))
    return measured or any(S.names(c.comparators) - {"left", "right"} for c in every(test, ast.Compare))


def _assigned_in(body, var: str) -> bool:
    """Whether a body or its branches, but not its loops, assign to the variable."""
    for s in body:
        if isinstance(s, ast.Assign) and any(S.name(t) == var for t in s.targets):
            return True
        if isinstance(s, ast.If) and (_assigned_in(s.body, var) or _assigned_in(s.orelse, var)):
            return True
    return False


@detector("sliding_window_variable")
def sliding_window_variable(tree):
    for loop in every(tree, ast.For):
        paired = isinstance(loop.target, ast.Tuple)
        right = S.name(loop.target.elts[0]) if paired and loop.target.elts else S.name(loop.target)
        left = right and S.made_before(tree, loop, lambda v: S.is_literal(v, 0), ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)
        if not left:
            continue
        inner = S.inner_while(loop.body, orelse=False)
        if inner and any(S.name(a.target) == left and isinstance(a.op, ast.Add) and S.is_literal(a.value, 1) for a in every(inner, ast.AugAssign)):
            yield "window_shrink_variable/loop", inner, left
            yield "window_expand", loop, right
            if _judges_window(inner.test):
                yield "window_validity_check", inner
        elif (paired or S.is_range(loop.iter) or S.method(loop.iter) == "keys") and _assigned_in(loop.body, left):
            yield "window_expand", loop, right
            yield "window_shrink_variable/assignment", loop, left


_SUMS = (ast.Add, ast.Mult, ast.Sub)


def _prefix_like(node) -> bool:
    return isinstance(node, ast.Name) or (isinstance(node, ast.Attribute) and S.says(node.attr, "prefix", "pref", "cum", "accu", "running"))


def _cumulative(s: ast.stmt, appends: bool) -> bool:
    """An element made from an element, or appended as arithmetic on one."""
    if isinstance(s, ast.Assign) and S.binary(s.value, *_SUMS) and isinstance(s.value.left, ast.Subscript):
        return any(isinstance(t, ast.Subscript) and (S.name(t.value) or (appends and _prefix_like(t.value))) for t in s.targets)
    if isinstance(s, ast.Expr) and S.method(s.value) == "append":
        return any(S.binary(x, *_SUMS) and any(_prefix_like(e.value) for e in every(x, ast.Subscript)) for x in s.value.args)
    return False


def _stores(body, sums: set[str]) -> bool:
    """A running sum kept under a key, or as a key."""
    kept = any(isinstance(t, ast.Subscript) and (isinstance(t.value, ast.Dict) or (S.name(t.value) and t.value.id not in sums and S.names(a.value) & sums)) for a in every(body, ast.Assign) for t in a.targets)
    return kept or any(S.name(s.value) and s.value.id not in sums and S.name(s.slice) in sums for s in every(body, ast.Subscript))


def _looks_up(body, sums: set[str]) -> bool:
    tests = [t.test for t in every(body, ast.If)]
    return (
        any(S.name(s.value) and s.value.id not in sums for s in every(tests, ast.Subscript))
        or any(S.binary(b, ast.Sub) and S.name(b.left) in sums for b in every(tests, ast.BinOp))
        or any("get" in (S.method(c), S.called(c)) for c in every(tests, ast.Call))
    )


@detector("prefix_sum")
def prefix_sum(tree):
    for loop in every(tree, ast.For):
        if not S.name(loop.target):
            continue
        appends = any(S.method(c) == "append" for c in every(loop.body, ast.Call))
        filled = any(isinstance(t, ast.Subscript) and S.name(t.value) for s in loop.body if isinstance(s, ast.Assign) for t in s.targets)
        grows = any(_cumulative(s, appends) or (isinstance(s, ast.AugAssign) and isinstance(s.op, _SUMS)) for s in loop.body)
        if (appends or filled) and grows:
            yield "prefix_array_construction", loop
            yield "prefix_accumulator", loop
    for loop in every(tree, ast.For):
        sums = {s.target.id for s in [*loop.body, *loop.orelse] if isinstance(s, ast.AugAssign) and isinstance(s.op, ast.Add) and S.name(s.target)}
        stored = bool(sums) and _stores(loop.body, sums)
        if stored or (sums and _looks_up(loop.body, sums)):
            yield "running_sum_update", loop, ", ".join(sorted(sums))
            if stored:
                yield "dictionary_prefix_lookup", loop


# Names of bounds and of middles, bounds that may be moved, bounds of a half.
LOW, HIGH = ("left", "low", "l", "lo", "start", "i"), ("right", "high", "r", "hi", "end", "j")
MIDDLE = ("mid", "m", "middle", "pivot")
MOVED = ("left", "low", "l", "lo", "right", "high", "r", "hi")
HALF = ("left", "low", "l", "lo", "mid", "m", "right", "high", "r", "hi")


def _bisecting(tree) -> Iterator[ast.While]:
    """Loops while two bounds are in order."""
    for loop in every(tree, ast.While):
        t = loop.test
        if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ORDER):
            a, b = map(S.name, S.ends(t))
            if (a in LOW and b in HIGH) or (a in HIGH and b in LOW):
                yield loop


def _middle(value, from_low: bool) -> bool:
    """(a + b) // 2, (b - a) // 2, a // 2; halves plus something; the sum of two variables; with ``from_low`` also a + (b - a) // 2."""
    if S.binary(value, ast.FloorDiv):
        return isinstance(value.left, ast.Name) or S.binary(value.left, ast.Add, ast.Sub)
    if S.binary(value, ast.Add):
        return S.binary(value.left, ast.FloorDiv) or (isinstance(value.left, ast.Name) and (isinstance(value.right, ast.Name) or (from_low and S.binary(value.right, ast.FloorDiv))))
    return False


def _finds_middle(loop, from_low: bool = False) -> bool:
    return any(_middle(a.value, from_low) and any(S.name(t) in MIDDLE for t in a.targets) for a in every(loop.body, ast.Assign))


def _steps_past(loop) -> bool:
    """A bound moved next to the middle, or by a whole number."""
    def moved(t, v):
        if S.name(t) not in MOVED or not S.binary(v, ast.Add, ast.Sub):
            return False
        return S.name(v.left) in MIDDLE or S.name(v.right) in MIDDLE or (S.name(v.left) == t.id and isinstance(v.right, ast.Constant) and isinstance(v.right.value, int))

    return any(moved(t, a.value) for a in every(loop.body, ast.Assign) for t in a.targets)


def _asks(loop, in_parts: bool = False) -> bool:
    """A branch on a call with the middle, negated or not; with ``in_parts`` also as a part of and or or."""
    def call(x):
        return isinstance(x, ast.Call) and any(S.name(a) in MIDDLE for a in x.args)

    tests = [t.test for t in every(loop.body, ast.If)]
    bare = [t.operand if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not) else t for t in tests]
    return any(map(call, bare)) or (in_parts and any(call(v) for t in tests if isinstance(t, ast.BoolOp) for v in t.values))


@detector("binary_search_standard")
def binary_search_standard(tree):
    for loop in _bisecting(tree):
        if _finds_middle(loop, from_low=True) and _steps_past(loop) and any(every(loop.body, ast.If)) and not _asks(loop):
            yield "binary_midpoint", loop
            yield "boundary_update", loop
            yield "mid_comparison", loop
            yield "left_right_boundary", loop


@detector("binary_search_answer")
def binary_search_answer(tree):
    for loop in _bisecting(tree):
        if not (_finds_middle(loop) and _asks(loop, in_parts=True)):
            continue
        yield "answer_midpoint", loop
        yield "feasibility_check", loop
        moved = [a.value for a in every(loop.body, ast.Assign) if any(S.name(t) in MOVED for t in a.targets)]
        if any(S.name(v) in MIDDLE or (isinstance(v, ast.BinOp) and S.is_literal(v.right, 1) and S.name(v.left) in MIDDLE) for v in moved):
            yield "answer_boundary_update", loop
        yield "feasibility_loop", loop


@detector("heap_top_k")
def heap_top_k(tree):
    def what(call):
        inside = S.method(call) and S.receiver(call)
        return S.method(call) if S.method(call) and inside in (None, "heapq") else S.called(call)

    calls = [(what(c), c) for c in every(tree, ast.Call)]
    for key, wanted in (("heap_push", ("heappush",)), ("heap_pop", ("heappop",)), ("heapify_call", ("heapify",)), ("nlargest_nsmallest", ("nlargest", "nsmallest"))):
        for w, call in calls:
            if w in wanted:
                yield key, call, ast.unparse(call)


def _monotonic(tree, made, *pops: str):
    """(loop, inner loop, variable): a container made before is emptied in a while loop that asks it and filled again."""
    for loop in every(tree, ast.For):
        box = S.made_before(tree, loop, made, ast.FunctionDef)
        inner = box and S.inner_while(loop.body, orelse=True)
        if inner and box in S.names(inner.test) and S.calls_on(inner, box, *pops) and S.calls_on(loop.body, box, "append"):
            yield loop, inner, box


@detector("monotonic_stack")
def monotonic_stack(tree):
    def empty(v):
        return (isinstance(v, ast.List) and not v.elts) or (S.called(v) == "list" and not v.args)

    for loop, inner, box in _monotonic(tree, empty, "pop"):
        parts = inner.test.values if isinstance(inner.test, ast.BoolOp) and isinstance(inner.test.op, ast.And) else []
        ops = [type(o).__name__ for c in parts if isinstance(c, ast.Compare) for o in c.ops if isinstance(o, ORDER)]
        yield "monotonic_pop", inner, box, ops[-1] if ops else "__contains__"
        yield "stack_push", loop, box
        yield "comparison_loop", loop


@detector("monotonic_deque")
def monotonic_deque(tree):
    for loop, inner, box in _monotonic(tree, lambda v: S.called(v) == "deque" and len(v.args) <= 1, "pop", "popleft"):
        yield "monotonic_pop", inner, box
        yield "queue_append", loop, box
        if S.calls_on(loop.body, box, "popleft"):
            yield "queue_popleft", loop, box
        yield "deque_creation", loop, box


# Names of pointers at two speeds; of pointers of a reversal.
RUNNERS = ("slow", "fast", "tortoise", "hare", "slow_ptr", "fast_ptr")
SHIFTED = ("prev", "previous", "curr", "current", "next_node", "next_temp", "nxt", "nxt_temp")


def _hops(t, v) -> int:
    """How many times ``.next`` moves a variable on from itself."""
    n = 0
    while S.attribute(v, "next"):
        n, v = n + 1, v.value
    return n if S.name(t) and S.name(t) == S.name(v) else 0


def _advances(loop) -> Counter:
    moved = Counter()
    for a in every(loop.body, ast.Assign):
        for t, v in S.pairs(a):
            if n := _hops(t, v):
                moved[t.id] += n
    return moved


@detector("fast_slow_pointers", some("floyd_traversal", "cycle_check"))
def fast_slow_pointers(tree):
    runners = S.like(S.names(tree), *RUNNERS)
    if len(runners) >= 2:
        yield "pointer_names", None, sorted(runners)
    for loop in every(tree, ast.While):
        moved = _advances(loop)
        if len(set(moved.values())) >= 2:
            yield "floyd_traversal", loop, len(moved), set(moved.values())
    met = {}
    for loop in every(tree, ast.While):
        known = set(_advances(loop)) | S.like(S.names(loop), *RUNNERS)
        for test in [loop.test, *(t.test for t in every(loop.body, ast.If))]:
            if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Eq, ast.NotEq, ast.Is, ast.IsNot)):
                a, b = map(S.name, S.ends(test))
                if len(known) >= 2 and a in known and b in known:
                    met[a, b] = True
    for a, b in met:
        yield "cycle_check", None, a, b


@detector("linked_list_reversal", lambda g: "recursive_rewiring" in g or ("pointer_rewiring" in g and bool(g & {"prev_curr_update", "reversal_variable_names"})))
def linked_list_reversal(tree):
    for loop in every(tree, ast.While):
        given = [p for a in every(loop.body, ast.Assign) for p in S.pairs(a)]
        if not any(S.attribute(t, "next") and S.name(t.value) for t, _ in given):
            continue
        yield "pointer_rewiring", loop
        moves = [(t.id, v.id) for t, v in given if S.name(t) and S.name(v)]
        onward = {}
        for t, v in moves:
            onward.setdefault(t, set()).add(v)
        if any(onward.get(v, set()) - {t} for t, v in moves):
            yield "prev_curr_update", loop
        if len(found := S.like(S.names(loop), *SHIFTED)) >= 2:
            yield "reversal_variable_names", loop, sorted(found)
    for fn in S.functions(tree):
        turned = [a for a in every(fn, ast.Assign) for t, v in S.pairs(a) if t is a.targets[0] and S.attribute(t, "next") and S.attribute(t.value, "next") and S.name(t.value.value) and S.name(v) == S.name(t.value.value)]
        if turned:
            yield "recursive_rewiring", fn, turned[0].value.id
            if any(S.attribute(x, "next") for x in S.passed(S.self_calls(fn))):
                yield "recursive_call_with_next", fn, fn.name


# Parts of names of neighbours, of graphs, of marks.
NEIGHBOURS = ("neighbor", "neighbors", "adjacent", "adj", "children", "child", "nbr")
QUEUED = ("neighbor", "neighbors", "adjacent", "adj", "nbr", "next_node")
GRAPHS = ("graph", "adj", "tree", "node")
MARKS = ("visited", "seen")
PROGRESS = ("distance", "step", "level", "depth", "dist", "minute")


def _either_way(word: str | None, parts) -> bool:
    """Whether a name has one of the parts in it or is a piece of one."""
    return word is not None and any(p in word.lower() or word.lower() in p for p in parts)


def _marks(tree) -> bool:
    return any(S.method(c) in ("add", "append", "discard") and S.says(S.receiver(c), *MARKS) for c in every(tree, ast.Call))


def _none_test(test) -> bool:
    if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)):
        return any(isinstance(x, ast.Constant) and x.value is None for x in S.ends(test))
    return isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not) and isinstance(test.operand, ast.Name)


@detector("dfs_recursive", lambda g: "recursive_call" in g and bool(g & {"graph_traversal", "child_recursion", "grid_expansion", "visited_tracking"}))
def dfs_recursive(tree):
    for fn in S.functions(tree):
        given = S.passed(calls := S.self_calls(fn))
        if not calls:
            continue
        yield "recursive_call", fn, fn.name
        loops = list(every(fn, ast.For))
        over = [x.iter for x in loops if isinstance(x.iter, ast.Subscript)]
        if (
            any(_either_way(S.name(x.target), NEIGHBOURS) or (isinstance(x.iter, ast.Attribute) and _either_way(x.iter.attr, NEIGHBOURS)) for x in loops)
            or any(S.says(S.name(x.value), *GRAPHS) or S.says(S.name(x.slice), *GRAPHS) for x in over)
        ):
            yield "graph_traversal", fn
        if any(S.attribute(x, "left", "right") or S.method(x) in ("left", "right") for x in given):
            yield "child_recursion", fn
        if sum(S.binary(x, ast.Add, ast.Sub) and (S.is_literal(x.left, 1) or S.is_literal(x.right, 1)) for x in given) >= 3:
            yield "grid_expansion", fn
        asked = any(S.says(S.name(x), *MARKS) for c in every(fn, ast.Compare) for x in S.sides(c))
        if asked or _marks(fn) or any(S.says(S.name(s.value), *MARKS) for s in every(fn, ast.Subscript)):
            yield "visited_tracking", fn
        if any(_none_test(t.test) for t in every(fn, ast.If)):
            yield "base_case", fn


def _pops_in_order(loop: ast.While, box: str) -> bool:
    """Whether the stack is emptied while a comparison holds: in an inner loop, or by the loop's own test."""
    def ordered(tree):
        return any(isinstance(o, ORDER) for c in every(tree, ast.Compare) for o in c.ops)

    inner = any(box in S.names(w) and S.calls_on(w, box, "pop") and ordered(w) for w in every(loop.body, ast.While))
    return inner or (ordered(loop.test) and box in S.names(loop.test))


def _visits_next(loop: ast.For | ast.While, box: str) -> bool:
    if S.calls_on(loop, box, "append", "extend"):
        return True
    if isinstance(loop, ast.While):
        return False
    over = loop.iter
    return S.says(S.name(loop.target), *NEIGHBOURS) or (isinstance(over, ast.Attribute) and S.says(over.attr, *NEIGHBOURS)) or (isinstance(over, ast.Subscript) and S.says(S.name(over.value), *GRAPHS))


@detector("dfs_iterative", lambda g: "explicit_stack" in g and bool(g & {"stack_traversal", "child_push", "visited_tracking"}))
def dfs_iterative(tree):
    for loop in every(tree, ast.While):
        box = S.made_before(tree, loop, lambda v: isinstance(v, ast.List) or S.called(v) in ("list", "deque"), ast.FunctionDef)
        if not box or not S.calls_on(loop.body, box, "pop") or _pops_in_order(loop, box):
            continue
        yield "explicit_stack", loop, box
        if any(_visits_next(x, box) for x in every(loop.body, *LOOP)):
            yield "stack_traversal", loop, box
        if S.calls_on(loop.body, box, "append", "extend"):
            yield "child_push", loop, box
        if _marks(loop.body):
            yield "visited_tracking", loop


def _queues(tree) -> Iterator[tuple[ast.While, str]]:
    """Loops that take from the front of a container: the first one that they take from."""
    for loop in every(tree, ast.While):
        takes = [c for c in every(loop.body, ast.Call) if S.method(c) in ("popleft", "pop") and S.receiver(c)]
        box = S.receiver(takes[0]) if takes else None
        if any(S.receiver(c) == box and (S.method(c) == "popleft" or (len(c.args) == 1 and S.is_literal(c.args[0], 0))) for c in takes):
            yield loop, box


def _progress(loop, from_zero: bool) -> bool:
    """A distance raised or lowered; with ``from_zero`` also set to 0."""
    if any(S.says(S.name(a.target), *PROGRESS) and isinstance(a.op, (ast.Add, ast.Sub)) for a in every(loop.body, ast.AugAssign)):
        return True
    given = [a.value for a in every(loop.body, ast.Assign) if any(S.says(S.name(t), *PROGRESS) for t in a.targets)]
    return any(S.binary(v, ast.Add, ast.Sub) or (from_zero and S.is_literal(v, 0)) for v in given)


@detector("bfs_level_order", lambda g: {"queue_popleft", "child_enqueue"} <= g and not g & {"distance_tracking", "visited_tracking"})
def bfs_level_order(tree):
    imported = any(a.name == "collections" for i in every(tree, ast.Import) for a in i.names) or any(i.module == "collections" and any(a.name == "deque" for a in i.names) for i in every(tree, ast.ImportFrom))
    for loop, box in _queues(tree):
        yield "queue_popleft", loop, box
        if S.calls_on(loop.body, box, "append", "extend"):
            yield "child_enqueue", loop, box
        if any("len" in (S.called(c), S.method(c)) for c in every(loop.body, ast.Call)) or any(S.says(S.name(t), "level", "size", "depth") for t in S.written(loop.body)):
            yield "level_tracking", loop
        if imported:
            yield "deque_import", loop
        if _progress(loop, from_zero=False):
            yield "distance_tracking", loop
        if _marks(loop.body):
            yield "visited_tracking", loop


@detector("bfs_shortest_path", lambda g: "queue_traversal" in g and bool(g & {"distance_tracking", "visited_set"}))
def bfs_shortest_path(tree):
    for loop, box in _queues(tree):
        yield "queue_traversal", loop, box
        if _progress(loop, from_zero=True):
            yield "distance_tracking", loop
        if _marks(loop.body) or any(S.says(n.id, *MARKS) and isinstance(n.ctx, ast.Store) for n in every(loop, ast.Name)):
            yield "visited_set", loop
        inner = list(every(loop.body, ast.For))
        if any(
            _either_way(S.name(f.target), QUEUED) or (isinstance(f.iter, ast.Attribute) and _either_way(f.iter.attr, QUEUED)) or (isinstance(f.iter, ast.Subscript) and S.says(S.name(f.iter.value), *GRAPHS, "neighbor"))
            for f in inner
        ):
            yield "neighbor_expansion", loop
        if any(S.called(x) == "len" or S.attribute(x, "len") for f in loop.body if isinstance(f, ast.For) and S.is_range(f.iter) for x in f.iter.args):
            yield "level_for_loop", loop


# Names of a node's value; parts of names of bounds and of operations.
VALUES = ("val", "value", "key", "data")
BOUNDS = ("min", "max", "minimum", "maximum", "lower", "upper", "low", "high", "lo", "hi")
OPERATIONS = ("search", "insert", "delete", "remove", "find", "contains", "put", "add", "bst")


def _value_of(node) -> bool:
    """A node's value, something of it, or a variable so called."""
    while isinstance(node, ast.Attribute):
        if node.attr in VALUES:
            return True
        node = node.value
        if not isinstance(node, ast.Attribute):
            return False
    return S.name(node) in VALUES


def _orders_values(c) -> bool:
    if not isinstance(c, ast.Compare):
        return False
    around = S.sides(c)
    return any(isinstance(o, ORDER) and (_value_of(a) or _value_of(b)) for a, o, b in zip(around, c.ops, around[1:], strict=False))


@detector("binary_search_tree", lambda g: {"bst_comparison", "bst_recursion"} <= g)
def binary_search_tree(tree):
    for fn in S.functions(tree):
        compares = any(_orders_values(c) for t in every(fn, ast.If) for c in S.conditions(t.test))
        recurs = any(S.attribute(x, "left", "right") for x in S.passed(S.self_calls(fn)))
        if not compares and not recurs:
            continue
        if compares:
            yield "bst_comparison", fn
        if recurs:
            yield "bst_recursion", fn
        bounded = any(len(c.ops) == 1 and isinstance(c.ops[0], ORDER) and any(S.attribute(x, *VALUES) for x in S.ends(c)) for c in every(fn, ast.Compare))
        if bounded and S.like({a.arg for a in fn.args.args}, *BOUNDS):
            yield "min_max_constraint", fn
        if S.says(fn.name, *OPERATIONS):
            yield "bst_operation", fn


def _degree(node) -> bool:
    return isinstance(node, ast.Subscript) and S.says(S.name(node.value), "indeg", "degree")


def _is_free(test) -> bool:
    """A degree compared with 0."""
    if not (isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Eq, ast.Is))):
        return False
    a, b = S.ends(test)
    return (_degree(a) and S.is_literal(b, 0)) or (_degree(b) and S.is_literal(a, 0))


def _free_only(value) -> bool:
    """A list of what has degree 0, or a deque of one."""
    if isinstance(value, ast.ListComp):
        return any(_is_free(i) for g in value.generators for i in g.ifs)
    if isinstance(value, ast.List):
        return any(isinstance(e, ast.IfExp) and _is_free(e.test) for e in value.elts)
    return S.called(value) == "deque" and any(map(_free_only, value.args))


def _counts(value) -> bool:
    if S.binary(value, ast.Mult):
        return any(isinstance(x, ast.List) or S.is_literal(x, 0) for x in (value.left, value.right))
    return isinstance(value, (ast.ListComp, ast.DictComp)) or S.called(value) == "list"


@detector("topological_sort", lambda g: bool(g & {"indegree_array", "indegree_increment", "indegree_decrement"}) and bool(g & {"zero_indegree_queue", "conditional_enqueue"}))
def topological_sort(tree):
    for scope in every(tree, ast.Module, ast.FunctionDef):
        def moved(op, by, scope=scope):
            by_one = any(_degree(a.target) and isinstance(a.op, op) and by(a.value) for a in every(scope, ast.AugAssign))
            return by_one or any(len(a.targets) == 1 and _degree(a.targets[0]) and S.binary(a.value, op) for a in every(scope, ast.Assign))

        made = any(_counts(a.value) and any(S.says(S.name(t), "indeg", "in_degree", "degree") for t in a.targets) for a in every(scope, ast.Assign))
        raised, lowered = moved(ast.Add, lambda v: S.is_literal(v, 1) or isinstance(v, ast.Name)), moved(ast.Sub, lambda v: S.is_literal(v, 1))
        if not (made or raised or lowered):
            continue
        if made:
            yield "indegree_array", scope
        if raised:
            yield "indegree_increment", scope
        if lowered:
            yield "indegree_decrement", scope
        if any(_free_only(a.value) and any(map(S.name, a.targets)) for a in every(scope, ast.Assign)):
            yield "zero_indegree_queue", scope
        if any(isinstance(s, ast.Expr) and S.method(s.value) in ("append", "extend") for t in every(scope, ast.If) if _is_free(t.test) for s in t.body):
            yield "conditional_enqueue", scope


def _sets_parent(fn) -> bool:
    """An element of parent, or of self.parent, assigned."""
    return any(isinstance(t, ast.Subscript) and (S.name(t.value) == "parent" or (S.attribute(t.value, "parent") and S.name(t.value.value) == "self")) for t in S.written(fn))


def _calls_itself(fn) -> bool:
    return any(S.called(c) == fn.name or (S.method(c) == fn.name and S.receiver(c) == "self") for c in every(fn, ast.Call))


@detector("union_find", lambda g: "parent_array" in g and bool(g & {"find_recursive", "find_iterative", "union_operation"}))
def union_find(tree):
    for cls in every(tree, ast.ClassDef):
        if not any(S.attribute(t, "parent") and (S.called(a.value) in ("list", "range") or isinstance(a.value, (ast.List, ast.ListComp))) for a in every(cls, ast.Assign) for t in a.targets):
            continue
        methods = [f for f in cls.body if isinstance(f, ast.FunctionDef)]
        finds = [f for f in methods if (S.says(f.name, "find") or f.name == "f") and _sets_parent(f)]
        recursive, iterative = any(map(_calls_itself, finds)), any(any(every(f, ast.While)) for f in finds)
        unites = any(S.says(f.name, "union") or f.name.lower() in ("unite", "merge", "join") for f in methods)
        if not (recursive or iterative or unites):
            continue
        yield "parent_array", cls
        if recursive:
            yield "find_recursive", cls
        if iterative:
            yield "find_iterative", cls
        if unites:
            yield "union_operation", cls
        if any((S.says(f.name, "connect") or f.name.lower() == "same") and any(S.method(c) in ("find", "f") for c in every(f, ast.Call)) for f in methods):
            yield "connected_check", cls
        ranks = {t.attr for t in S.written(cls) if isinstance(t, ast.Attribute) and S.says(t.attr, "rank", "size")}
        if any(isinstance(x, ast.Subscript) and S.attribute(x.value, *ranks) for t in every(cls, ast.If) if isinstance(t.test, ast.Compare) for x in S.ends(t.test)):
            yield "rank_optimization", cls


def _numbers(node) -> bool:
    """An element of something called like an array."""
    return isinstance(node, ast.Subscript) and S.says(S.name(node.value), "nums", "arr", "a", "array", "list", "values")


def _at(node) -> str | None:
    """The name that an element is taken at."""
    if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
        return node.slice.value.lower()
    return node.slice.id.lower() if isinstance(node.slice, ast.Name) else None


def _wanted(word: str | None) -> bool:
    return word is not None and ("target" in word.lower() or word.lower() == "t" or "key" in word.lower())


def _compares_half(c) -> bool:
    return isinstance(c, ast.Compare) and len(c.ops) == 1 and isinstance(c.ops[0], ORDER) and all(_numbers(x) and _at(x) in HALF for x in S.ends(c))


def _ranges(c) -> bool:
    """A comparison of the wanted value with an element, or one with it in a chain of two."""
    if len(c.ops) == 1:
        a, b = S.ends(c)
        if _numbers(a) and _numbers(b):
            return _wanted(_at(a)) or _wanted(_at(b))
        return (_numbers(a) and _wanted(S.name(b))) or (_numbers(b) and _wanted(S.name(a)))
    return len(c.ops) == 2 and isinstance(c.ops[0], ORDER) and any(_wanted(S.name(x)) for x in S.sides(c))


@detector("binary_search_rotated", lambda g: {"sorted_half_comparison", "target_range_check"} <= g)
def binary_search_rotated(tree):
    for loop in _bisecting(tree):
        if not _finds_middle(loop) or _asks(loop):
            continue
        parts = [c for t in every(loop.body, ast.If) for c in (t.test.values if isinstance(t.test, ast.BoolOp) else [t.test]) if isinstance(c, ast.Compare)]
        yield "rotated_midpoint", loop
        if any(map(_compares_half, parts)):
            yield "sorted_half_comparison", loop
        if any(map(_ranges, parts)):
            yield "target_range_check", loop
        if _steps_past(loop):
            yield "rotated_boundary_update", loop


# Parts of names of a best value, of running bests, of judged values; names of moving indexes.
BEST = ("best", "max", "min", "optimum", "optimal", "profit", "gain", "max_val", "min_val")
RUNNING = ("max", "min", "best", "profit")
JUDGED = ("profit", "price", "val", "curr", "best", "max", "min")
MOVING = ("i", "j", "k", "idx", "pos", "index", "left", "right", "l", "r")


@detector("greedy_local", lambda g: "local_optimum_selection" in g or {"immediate_decision", "forward_progress"} <= g)
def greedy_local(tree):
    for fn in S.functions(tree):
        kept = [a.value for a in every(fn, ast.Assign) if len(a.targets) == 1 and S.says(S.name(a.targets[0]), *BEST)]
        chosen = any(c.args or c.keywords for c in S.extreme(fn)) or any(S.binary(v, ast.Add, ast.Sub) or S.called(v) in ("max", "min") for v in kept)
        if chosen or any(S.says(S.name(a.target), *RUNNING) for a in every(fn, ast.AugAssign)):
            yield "local_optimum_selection", fn
        judged = [t for t in every(fn, ast.If) if isinstance(t.test, ast.Compare) and any(S.says(S.name(x), *JUDGED) for x in S.ends(t.test))]
        if any(isinstance(s, (ast.Assign, ast.AugAssign)) for t in judged for s in t.body):
            yield "immediate_decision", fn
        loops = [x for x in every(fn, *LOOP) if isinstance(x, ast.While) or S.is_range(x.iter)]
        if any(isinstance(a.op, ast.Add) and (S.name(a.target) or "").lower() in MOVING for x in loops for a in every(x, ast.AugAssign)):
            yield "forward_progress", fn


_ENDS = ("start", "end", "left", "right")


def _end_of(node) -> bool:
    """The first or second element of something."""
    return isinstance(node, ast.Subscript) and S.is_literal(node.slice, 0, 1)


def _by_end(call) -> bool:
    """Sorted by a key that reads an interval's end."""
    if S.called(call) != "sorted" and S.method(call) != "sort":
        return False
    keys = [k.value for k in call.keywords if k.arg == "key" and isinstance(k.value, ast.Lambda)]
    return any(_end_of(x) or S.attribute(x, *_ENDS) for k in keys for x in every(k, ast.Subscript, ast.Attribute))


@detector("greedy_interval", lambda g: "interval_sorting" in g and bool(g & {"interval_comparison", "interval_merge_scheduling"}))
def greedy_interval(tree):
    for fn in S.functions(tree):
        if not any(_by_end(c) for c in every(fn, ast.Call)):
            continue
        yield "interval_sorting", fn
        opened = {n for x in every(fn, ast.For) if isinstance(x.target, ast.Tuple) for t in x.target.elts if (n := S.name(t))}
        tests = [t for t in every(fn, ast.If)]

        def touches(c, opened=opened):
            return any(S.name(x) in opened for x in S.ends(c))

        def compares(c, judged: bool):
            around = S.ends(c)
            named = any(isinstance(x, ast.Subscript) and S.says(S.name(x.value), "interval", "intervals", "balloon", "point") for x in around)
            at_end = (judged or isinstance(c.ops[0], ORDER)) and any(map(_end_of, around))
            return named or at_end or touches(c) or any(S.attribute(x, *_ENDS) for x in around)

        if any(compares(c, False) for c in every(fn, ast.Compare)) or any(compares(t.test, True) for t in tests if isinstance(t.test, ast.Compare)):
            yield "interval_comparison", fn

        def schedules(t):
            ordered = [c for c in every(t.test, ast.Compare) if len(c.ops) == 1 and isinstance(c.ops[0], ORDER)]
            if not any(touches(c) or any(map(_end_of, S.ends(c))) for c in ordered):
                return False
            given = [x for s in [*t.body, *t.orelse] if isinstance(s, ast.Assign) for x in s.targets]
            return any(_end_of(x) or (isinstance(x, ast.Attribute) and (x.attr in _ENDS or S.says(S.name(x.value), "merged", "result", "new"))) for x in given)

        if any(map(schedules, tests)):
            yield "interval_merge_scheduling", fn
        gates = [t for t in tests if isinstance(t.test, ast.Compare) and (touches(t.test) or any(map(_end_of, S.ends(t.test))))]
        if any(isinstance(s, ast.AugAssign) and S.says(S.name(s.target), "count", "res", "cnt", "total") for t in gates for s in t.body):
            yield "greedy_selection", fn


def _appended(fn) -> set[str]:
    return {n for c in every(fn, ast.Call) if S.method(c) == "append" and (n := S.receiver(c))}


@detector("backtracking_subset", lambda g: "choose_recurse_unchoose" in g or {"recursive_branching", "state_restoration"} <= g)
def backtracking_subset(tree):
    for fn in S.functions(tree):
        calls = len(S.self_calls(fn))
        undone = any(S.method(e.value) == "pop" for e in every(fn, ast.Expr))
        chosen = bool(calls) and bool(_appended(fn)) and undone
        if calls < 2 and not chosen:
            continue
        if chosen:
            yield "choose_recurse_unchoose", fn
        if calls >= 2:
            yield "recursive_branching", fn
        if undone or any(isinstance(a.op, ast.Sub) for a in every(fn, ast.AugAssign)):
            yield "state_restoration", fn
        if S.like(_appended(fn), "res", "result", "subset", "path", "sol", "curr", "temp", "combo"):
            yield "subset_generation", fn


def _flags(value) -> bool:
    """A list with False in it, repeated or not, or a comprehension."""
    rows = value.left if S.binary(value, ast.Mult) else value
    return isinstance(value, ast.ListComp) or (isinstance(rows, ast.List) and any(isinstance(e, ast.Constant) and e.value is False for e in rows.elts))


@detector("backtracking_permutation", lambda g: "swap_recurse_swap" in g or {"visited_array", "permutation_generation"} <= g)
def backtracking_permutation(tree):
    for fn in S.functions(tree):
        calls = S.self_calls(fn)
        pairs = [s.targets[0] for x in every(fn, ast.For) if S.is_range(x.iter) for s in x.body if isinstance(s, ast.Assign) and len(s.targets) == 1]
        swaps = any(isinstance(t, (ast.Tuple, ast.List)) and any(isinstance(e, ast.Subscript) for e in t.elts) for t in pairs)
        flagged = any(_flags(a.value) and any(S.says(S.name(t), "used", "visited", "seen", "taken", "chosen", "cols") for t in a.targets) for a in every(fn, ast.Assign))
        flagged = flagged or any(S.says(S.name(s.value), "used", "visited", "seen", "taken", "cols") for s in every(fn, ast.Subscript))
        if not calls or not (swaps or flagged):
            continue
        if swaps:
            yield "swap_recurse_swap", fn
        if flagged:
            yield "visited_array", fn
        if S.like(_appended(fn), "perm", "res", "result", "path", "sol", "curr"):
            yield "permutation_generation", fn
        if any(S.binary(x, ast.Add) and (S.is_literal(x.left, 1) or S.is_literal(x.right, 1)) for x in S.passed(calls)):
            yield "recursive_exploration", fn


# ---- dynamic programming


def _listed(fn) -> bool:
    """A list repeated."""
    return any(S.binary(a.value, ast.Mult) and isinstance(a.value.left, ast.List) for a in every(fn, ast.Assign))


def _repeated(row) -> bool:
    return S.binary(row, ast.Mult)


def _row(row) -> bool:
    return isinstance(row, ast.List)


def _arithmetic(row) -> bool:
    return isinstance(row, ast.BinOp)


def _of_tables(calls) -> bool:
    return any(S.table(x) for c in calls for x in c.args)


def _depths(fn) -> set[int]:
    """Whole numbers that indexes of table cells are reduced by, or reduced from."""
    found = set()
    for s in every(fn, ast.Subscript):
        if S.cell(s) and S.binary(s.slice, ast.Sub):
            by = next((x for x in (s.slice.right, s.slice.left) if isinstance(x, ast.Constant)), None)
            if by is not None and isinstance(by.value, int):
                found.add(by.value)
    return found


def _forward(g: set[str]) -> bool:
    only_sums = "index_lookback" in g and not g & {"multi_level_lookback", "max_min_recurrence", "conditional_recurrence", "recursive_lookback"}
    return bool(g & {"index_lookback", "recursive_lookback"}) and len(g & {"dp_array_1d", "table_fill_loop", "cache_decorator", "base_case_return"}) >= 2 and not only_sums


@detector("dp_1d_forward", _forward)
def dp_1d_forward(tree):
    for fn in S.functions(tree):
        plain = [x for x in every(fn, ast.For) if not any(y is not x for y in every(x, ast.For))]
        depths = _depths(fn)
        judged = [(t, c) for t in every(fn, ast.If) for c in S.conditions(t.test) if isinstance(c, ast.Compare)]
        if _listed(fn):
            yield "dp_array_1d", fn
        if any(S.cell(t) for x in plain for t in S.written(x)):
            yield "table_fill_loop", fn
        if depths:
            yield "index_lookback", fn
        if len(depths) >= 2:
            yield "multi_level_lookback", fn
        if any(S.binary(x, ast.Sub) for x in S.passed(S.self_calls(fn))):
            yield "recursive_lookback", fn
        if S.cached(fn):
            yield "cache_decorator", fn
        if any(S.binary(b, *_SUMS) and any(map(S.cell, every(b, ast.Subscript))) for b in every(fn, ast.BinOp)):
            yield "recurrence_expression", fn
        if S.extreme(fn):
            yield "max_min_recurrence", fn
        if any(any((S.name(x) or "").lower() in ("n", "i", "idx", "index") for x in S.sides(c)) and any(isinstance(s, ast.Return) for s in t.body) for t, c in judged):
            yield "base_case_return", fn
        if any(S.cell(v) or (S.called(v) in ("max", "min") and _of_tables([v])) for v in S.returned(fn)):
            yield "result_aggregation", fn

        def conditional(t, c):
            fills = any(S.cell(x) for s in t.body if isinstance(s, ast.Assign) for x in s.targets)
            return any(S.cell(x) or (fills and (S.name(x) or "").lower() in ("i", "j", "n", "idx")) for x in S.sides(c))

        if any(conditional(t, c) for t, c in judged):
            yield "conditional_recurrence", fn


def _leaves(target) -> Iterator[ast.AST]:
    if isinstance(target, ast.Tuple):
        for t in target.elts:
            yield from _leaves(t)
    else:
        yield target


def _state(target) -> str | None:
    """The variable that a target writes, whole or an element of it."""
    return S.base(target) if isinstance(target, (ast.Name, ast.Subscript)) else None


def _crosses(call: ast.Call, mine: str, states: set[str]) -> bool:
    """Whether a choice draws on another state: as it is, as what arithmetic starts from, or as an element."""
    for x in call.args:
        first = x
        while isinstance(first, ast.BinOp):
            first = first.left
        of = _state(first)
        if of in states and (of != mine or (first is x and isinstance(x, ast.Subscript))):
            return True
    return False


def _transits(fn, states: set[str]) -> bool:
    for a in every(fn, ast.Assign):
        for call in S.extreme(a.value):
            if not S.names(call.args) & states:
                continue
            given = [x for t in a.targets for x in (t.elts if isinstance(t, ast.Tuple) else [t]) if not (isinstance(t, ast.Tuple) and not S.name(x))]
            mine = next((s for x in given if (s := _state(x)) and (s in states or (isinstance(x, ast.Subscript) and s.lower().startswith("dp")))), None)
            if mine and _crosses(call, mine, states):
                return True
    return False


@detector("dp_state_machine", lambda g: {"state_variables", "state_transition"} <= g and bool(g & {"dp_array_1d", "table_fill_loop", "cache_decorator"}))
def dp_state_machine(tree):
    for fn in S.functions(tree):
        leaves = [x for loop in every(fn, *LOOP) for t in S.written(loop) for x in _leaves(t)]
        states = {s for x in leaves if (s := _state(x))}
        cells = Counter(s for x in leaves if isinstance(x, ast.Subscript) and (s := _state(x)))
        chosen = set()
        for x in S.passed(S.extreme(fn)):
            chosen |= S.names(x) if isinstance(x, ast.BinOp) else {_state(x)} - {None}
        if len(states & chosen) >= 2 or any(n >= 2 and s in chosen for s, n in cells.items()):
            yield "state_variables", fn
        if _transits(fn, states):
            yield "state_transition", fn
        lists = [a.value.right for a in every(fn, ast.Assign) if S.binary(a.value, ast.Mult) and isinstance(a.value.left, ast.List)]
        if any(isinstance(n, ast.UnaryOp) or (isinstance(n, ast.Constant) and isinstance(n.value, int) and 2 <= n.value <= 4) for n in lists):
            yield "dp_array_1d", fn
        if any(every(fn, ast.For)) and not any(S.nested_for(fn)):
            yield "table_fill_loop", fn
        if S.cached(fn):
            yield "cache_decorator", fn
        if any(isinstance(x, ast.Name) or (isinstance(x, ast.Subscript) and S.name(x.value)) for v in S.returned(fn) if S.called(v) in ("max", "min") for x in v.args):
            yield "result_aggregation", fn


_BEFORE = ("j", "k", "prev", "p")


@detector("dp_1d_sequence", lambda g: {"nested_fill_loops", "inner_lookback"} <= g and bool(g & {"dp_array_1d", "recurrence_expression", "result_aggregation"}))
def dp_1d_sequence(tree):
    def earlier(s):
        """A cell at a variable for an earlier place, or at arithmetic with one."""
        at = S.names(s.slice) if isinstance(s.slice, (ast.Name, ast.BinOp)) else set()
        return S.cell(s) and any(n.lower() in _BEFORE for n in at)

    for fn in S.functions(tree):
        inner = list(S.nested_for(fn))
        if any(S.cell(t) for x in inner for t in S.written(x)):
            yield "nested_fill_loops", fn
        if any(earlier(s) for x in inner for s in every(x, ast.Subscript)):
            yield "inner_lookback", fn
        if _listed(fn):
            yield "dp_array_1d", fn
        if any(isinstance(x, ast.BinOp) and any(map(S.cell, every(x, ast.Subscript))) for x in S.passed(S.extreme(fn))):
            yield "recurrence_expression", fn
        if _of_tables(v for v in S.returned(fn) if S.called(v) in ("max", "min")):
            yield "result_aggregation", fn


def _char_of(node, *starts: str) -> bool:
    """An element of something called like a text."""
    return isinstance(node, ast.Subscript) and (S.name(node.value) or "").lower().startswith(starts)


def _equals(fn) -> list[ast.AST]:
    """Both sides of each equality; of a chain, all sides for each equality in it."""
    return [x for c in every(fn, ast.Compare) for o in c.ops if isinstance(o, ast.Eq) for x in S.sides(c)]


def _assigns_if(fn, *indexes: str) -> bool:
    """A branch on an index that assigns something."""
    return any(
        isinstance(t.test, ast.Compare) and any((S.name(x) or "").lower() in indexes for x in S.sides(t.test)) and any(isinstance(s, ast.Assign) for s in t.body) for t in every(fn, ast.If)
    )


@detector("dp_2d_grid", lambda g: {"grid_lookback", "nested_fill_loops"} <= g and bool(g & {"dp_array_2d", "recurrence_expression", "result_aggregation"}) and "string_compare" not in g)
def dp_2d_grid(tree):
    for fn in S.functions(tree):
        if S.looks_back(fn):
            yield "grid_lookback", fn
        if any(S.cell_2d(t) or (S.cell(t) and isinstance(t.slice, ast.Subscript)) for x in S.nested_for(fn) for t in S.written(x)):
            yield "nested_fill_loops", fn
        if S.listed_rows(fn, _row, _repeated):
            yield "dp_array_2d", fn
        if S.extreme(fn) and any(S.cell_2d(s) and (isinstance(s.slice, ast.BinOp) or isinstance(s.value.slice, ast.BinOp)) for s in every(fn, ast.Subscript)):
            yield "recurrence_expression", fn
        if any(S.cell_2d(v) or (S.cell(v) and isinstance(v.slice, (ast.UnaryOp, ast.Constant))) or (S.called(v) in ("max", "min") and _of_tables([v])) for v in S.returned(fn)):
            yield "result_aggregation", fn
        if _assigns_if(fn, "r", "c", "row", "col", "i", "j"):
            yield "base_case_return", fn
        if any(_char_of(x, "s", "str", "word", "text", "char") for x in _equals(fn)):
            yield "string_compare", fn


@detector("dp_2d_string", lambda g: {"string_compare", "grid_lookback"} <= g and bool(g & {"dp_array_2d", "nested_fill_loops", "recurrence_expression", "base_case_return"}))
def dp_2d_string(tree):
    for fn in S.functions(tree):
        if sum(_char_of(x, "s", "str", "word", "text", "char", "a", "b", "p", "q", "t") for x in _equals(fn)) >= 2:
            yield "string_compare", fn
        if S.looks_back(fn):
            yield "grid_lookback", fn
        if S.listed_rows(fn, _repeated):
            yield "dp_array_2d", fn
        if any(S.cell_2d(t) for x in S.nested_for(fn) for t in S.written(x)):
            yield "nested_fill_loops", fn
        if S.extreme(fn):
            yield "recurrence_expression", fn
        if _assigns_if(fn, "i", "j", "m", "n", "row", "col"):
            yield "base_case_return", fn
        if any(S.cell_2d(v) or (S.cell(v) and isinstance(v.slice, ast.UnaryOp)) for v in S.returned(fn)):
            yield "result_aggregation", fn


@detector("dp_knapsack", lambda g: {"capacity_compare", "max_min_recurrence"} <= g and bool(g & {"dp_array_2d", "nested_fill_loops", "grid_lookback"}))
def dp_knapsack(tree):
    def element(x):
        """An element of a variable, or arithmetic with one."""
        return any(S.name(s.value) for s in (every(x, ast.Subscript) if isinstance(x, ast.BinOp) else [x] if isinstance(x, ast.Subscript) else []))

    for fn in S.functions(tree):
        tests = [t.test for t in every(fn, ast.If) if isinstance(t.test, ast.Compare)]
        if any(any(isinstance(o, ORDER) for o in c.ops) and any(map(element, S.sides(c))) for c in tests):
            yield "capacity_compare", fn
        either = any(any(map(S.refers, b.values)) for b in every(fn, ast.BoolOp)) and any(map(S.refers, S.written(fn)))
        if either or any(map(S.refers, S.passed(S.extreme(fn)))):
            yield "max_min_recurrence", fn
        if S.listed_rows(fn, _row, _arithmetic):
            yield "dp_array_2d", fn
        if any(S.any_cell(t) for x in S.nested_for(fn) for t in S.written(x)):
            yield "nested_fill_loops", fn
        if any(S.cell_2d(s) for s in every(fn, ast.Subscript)):
            yield "grid_lookback", fn
        if any(map(S.any_cell, S.returned(fn))):
            yield "result_aggregation", fn


def _by_length(loop: ast.For) -> bool:
    """A range from somewhere, or over a length. A tuple of variables over a range is an error: the pattern doesn't count then."""
    return S.is_range(loop.iter) and (loop.target.id.lower() in ("length", "len", "l", "gap", "g") or len(loop.iter.args) >= 2)


@detector("dp_interval", lambda g: "length_based_loop" in g and len(g & {"dp_array_2d", "pair_loop", "grid_lookback", "recurrence_expression"}) >= 2)
def dp_interval(tree):
    def pairs_up(loop):
        """The other end of an interval computed in an inner loop from one end or from the length."""
        given = [a.value for x in every(loop, ast.For) if x is not loop for a in every(x, ast.Assign) if any((S.name(t) or "").lower() in ("j", "end", "right") for t in a.targets)]
        near = {"i", "start", "idx", "left", loop.target.id.lower()}
        return any(isinstance(v, ast.BinOp) and near & {n.lower() for n in S.names(v)} for v in given)

    for fn in S.functions(tree):
        if any(_by_length(x) for x in every(fn, ast.For)):
            yield "length_based_loop", fn
        if S.listed_rows(fn, _row, _arithmetic):
            yield "dp_array_2d", fn
        if any(_by_length(x) and pairs_up(x) for x in every(fn, ast.For)):
            yield "pair_loop", fn
        if any(S.cell_2d(s) for s in every(fn, ast.Subscript)):
            yield "grid_lookback", fn
        if any(map(S.refers, S.passed(S.extreme(fn)))) and any(map(S.refers, S.written(fn))):
            yield "recurrence_expression", fn
        if any(S.binary(b, ast.Add) and all(any(S.cell_2d(s) for s in every(x, ast.Subscript)) for x in (b.left, b.right)) for b in every(fn, ast.BinOp)):
            yield "partition_lookback", fn
        if any(map(S.any_cell, S.returned(fn))):
            yield "result_aggregation", fn
