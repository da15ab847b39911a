"""Match operators as Spark expressions, and the registry of custom ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.text import LOWER, UPPER
from tidegate.plans.core_rules import PREDICATES
from tidegate.plans.model import Op

ASCII = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Test:
    """A condition on a value with the place of what it matched; off None: the whole value."""

    hit: Column
    off: Column
    length: Column


def whole(hit: Column, data: Column) -> Test:
    return Test(hit, F.lit(0), F.length(data))


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_text(s: str) -> str:
    """A string literal in SQL."""
    if s.isascii() and s.isprintable():
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"decode(unhex('{s.encode('latin-1').hex()}'), 'ISO-8859-1')"


def contains_any(data: Column, folded: Column | str, needles: tuple[str, ...]) -> Test:
    """The first needle, in list order, that occurs; case folded. Of a named column the expression is built as one SQL text, which is much quicker to make."""
    low = [n.translate(ASCII) for n in needles if n]
    if not low:
        return whole(F.lit(False), data)
    if isinstance(folded, str):
        tests = [(f"contains(`{folded}`, {sql_text(n)})", sql_text(n), len(n)) for n in low]
        off = " ".join(f"WHEN {t} THEN locate({x}, `{folded}`) - 1" for t, x, _ in tests)
        size = " ".join(f"WHEN {t} THEN {k}" for t, _, k in tests)
        return Test(gate(tuple(low), folded), F.expr(f"CASE {off} END"), F.expr(f"CASE {size} END"))
    off, length = F.lit(0), F.lit(0)
    for n in reversed(low):
        there = folded.contains(n)
        off = F.when(there, F.locate(n, folded) - 1).otherwise(off)
        length = F.when(there, F.lit(len(n))).otherwise(length)
    return Test(any_true([folded.contains(n) for n in low]), off, length)


def regex(data: Column, pattern: str, negated: bool = False) -> Test:
    """Leftmost match of a pattern of the linear-time subset (:func:`check_regex`)."""
    pattern = check_regex(pattern)
    if negated:
        return whole(~data.rlike(pattern), data)
    found = F.regexp_extract(data, f"({pattern})", 1)
    return Test(data.rlike(pattern), F.regexp_instr(data, F.lit(f"({pattern})")) - 1, F.length(found))


def check_regex(pattern: str) -> str:
    """Refuse what a linear-time engine has not (look-around, back-references, possessive and atomic groups), and write white space and the end of text as that engine means them."""
    import re

    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: "\\1" if m[0][0] == "\\" and m[0][1].isdigit() and m[0][1] != "0" else "x", pattern)
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\1|[*+?}]\+", bare):
        raise ValueError(f"pattern is not of the linear-time subset: {pattern!r}")
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\s", r"\1[\\t\\n\\f\\r ]", pattern) if "[" not in pattern else pattern
    return re.sub(r"\$\Z", r"\\z", out) if re.search(r"(?<!\\)\$\Z", out) else out


def named_predicate(name: str, data: Column, folded: Column) -> Test:
    spec = PREDICATES[name]
    value = folded if spec.get("fold") else data
    hit = F.lit(True)
    for p in spec.get("all", ()):
        hit = hit & value.rlike(p)
    if "any" in spec:
        hit = hit & any_true([value.rlike(p) for p in spec["any"]])
    head = F.regexp_extract(value, r"^[^?#]*", 0)
    for p in spec.get("head", ()):
        hit = hit & head.rlike(p)
    if "head_any" in spec:
        hit = hit & any_true([head.rlike(p) for p in spec["head_any"]])
    return whole(hit, data)


CUSTOM: dict[str, tuple[Callable, tuple[str, ...] | None]] = {}


def register_operator(name: str, build: Callable[[Column, Column, tuple], Column], literals: tuple[str, ...] | None = None) -> None:
    """Add an operator: a function of (value, folded value, arguments) to a boolean column, and the literals of which a value must hold one. Python functions belong in a pandas or Arrow UDF that the expression calls."""
    CUSTOM[name] = (build, literals)


def is_detector(op: Op) -> bool:
    return op.name.startswith("detect_")


def test_of(op: Op, data: Column | str, folded: Column | str) -> Test:
    """The expression of an operator that is not a detector, on columns or their names."""
    data = column(data)
    if op.name in ("contains", "contains_any"):
        t = contains_any(data, folded, op.args)
        return Test(~t.hit, F.lit(0), F.length(data)) if op.negated else t
    folded = column(folded)
    if op.name == "equals":
        t = whole(data == op.args[0], data)
    elif op.name == "has_prefix":
        t = Test(folded.startswith(op.args[0].translate(ASCII)), F.lit(0), F.lit(len(op.args[0])))
    elif op.name == "rx":
        return regex(data, op.args[0], op.negated)
    elif op.name.startswith("func:") and op.name[5:] in PREDICATES:
        t = named_predicate(op.name[5:], data, folded)
    elif op.name in CUSTOM:
        t = whole(CUSTOM[op.name][0](data, folded, op.args), data)
    else:
        raise ValueError(f"unknown operator {op.name}")
    return Test(~t.hit, F.lit(0), F.length(data)) if op.negated else t


def gate(literals: tuple[str, ...], folded: Column | str) -> Column:
    """Whether a value holds one of the literals, case folded."""
    if isinstance(folded, str) and literals:
        tests = [f"contains(`{folded}`, {sql_text(x.translate(ASCII))})" for x in literals]
        while len(tests) > 1:
            tests = [f"({a} OR {b})" for a, b in zip(tests[::2], tests[1::2], strict=False)] + ([tests[-1]] if len(tests) % 2 else [])
        return F.expr(tests[0])
    folded = column(folded)
    return any_true([folded.contains(x.translate(ASCII)) for x in literals])


def any_true(tests: list[Column]) -> Column:
    """A balanced disjunction, so that long lists make no deep expressions."""
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + ([tests[-1]] if len(tests) % 2 else [])
    return tests[0] if tests else F.lit(False)
