"""Matching of large plans in one pass: literal automata for each chain, then the operators of candidate rules.

A rule can match only a value that holds one of its literals, so one automaton for each chain finds all candidates of a
value at a cost that does not depend on the number of rules. Operators are then run for the candidates alone. The
semantics are those of the expressions in operators.predicates; tests hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.detectors import DETECTORS, THRESHOLD
from tidegate.plans.core_rules import PREDICATES
from tidegate.plans.model import FOLDED, Op, Plan, Rule

Span = tuple[int, int] | None
MATCHED = 256
FOUND = "array<struct<place:int,off:int,len:int,matched:string>>"
_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("off", pa.int32()), ("len", pa.int32()), ("matched", pa.string())]))


def supported(op: Op) -> bool:
    """Whether an operator is run here; negated ones and those without a literal are expressions."""
    if op.negated:
        return False
    return op.name in ("contains", "contains_any", "equals", "has_prefix", "rx") or op.name.startswith("detect_") or op.name.startswith("func:") and op.name[5:] in PREDICATES


def _pattern(p: str) -> re.Pattern:
    return re.compile(p.replace(r"\z", r"\Z"))


def evaluator(op: Op) -> Callable[[str, str], Span]:
    """A function of (data, folded data) to where an operator matches."""
    if op.name in ("contains", "contains_any"):
        low = [a.lower() for a in op.args if a]

        def first(data: str, folded: str) -> Span:
            for n in low:
                if (i := folded.find(n)) >= 0:
                    return i, len(n)
            return None

        return first
    if op.name == "equals":
        return lambda data, folded: (0, len(data)) if data == op.args[0] else None
    if op.name == "has_prefix":
        low = op.args[0].lower()
        return lambda data, folded: (0, len(low)) if folded.startswith(low) else None
    if op.name == "rx":
        from tidegate.operators.predicates import check_regex

        p = _pattern(check_regex(op.args[0]))
        return lambda data, folded: (m.start(), m.end() - m.start()) if (m := p.search(data)) else None
    if op.name.startswith("detect_"):
        run, args = DETECTORS[op.name.removeprefix("detect_")], op.args

        def judge(data: str, folded: str) -> Span:
            v = run(data, args) if args else run(data)
            return (v.off, v.length) if v.score >= THRESHOLD else None

        return judge
    spec = PREDICATES[op.name[5:]]
    every, some = [_pattern(p) for p in spec.get("all", ())], [_pattern(p) for p in spec.get("any", ())]
    head, heads = [_pattern(p) for p in spec.get("head", ())], [_pattern(p) for p in spec.get("head_any", ())]

    def predicate(data: str, folded: str) -> Span:
        value = folded if spec.get("fold") else data
        if not all(p.search(value) for p in every) or some and not any(p.search(value) for p in some):
            return None
        if head or heads:
            start = re.match(r"[^?#]*", value)[0]
            if not all(p.search(start) for p in head) or heads and not any(p.search(start) for p in heads):
                return None
        return 0, len(data)

    return predicate


def _phase_test(rule: Rule) -> tuple[int, int]:
    """Least and greatest phase of arrival that a rule sees."""
    if rule.phase == 1:
        return 1, 1
    if rule.phase == 2:
        return (2 if rule.derived_from else 1), 2
    return 3, rule.phase


class Machine:
    """The automata and evaluators of some places of a plan."""

    def __init__(self, rules: list[tuple[int, Rule]], chains: list[tuple[str, ...]]):
        import ahocorasick

        self.parts = []
        for c, chain in enumerate(chains):
            here = [(i, r) for i, r in rules if r.transforms == chain]
            literals: dict[str, set[int]] = {}
            for i, r in here:
                for x in r.literals:
                    literals.setdefault(x, set()).add(i)
            a = ahocorasick.Automaton()
            for x, ids in literals.items():
                a.add_word(x, frozenset(ids))
            a.make_automaton()
            kinds = {t.kind for _, r in here for t in r.targets}
            self.parts.append((c, a, kinds))
        shared: dict[Op, Callable] = {}
        self.rules = {i: (r, shared.setdefault(r.op, evaluator(r.op)), *_phase_test(r)) for i, r in rules}
        self.group = {i: id(self.rules[i][1]) for i in self.rules}

    def applies(self, r: Rule, target: str, key: str) -> bool:
        for t in r.targets:
            if t.kind != target:
                continue
            if not t.name or t.name == key or t.kind == "RESOLVED" and key.startswith(t.name + ".") or t.kind in FOLDED and t.name.lower() == key.lower():
                return True
        return False

    def run(self, target: str, key: str, arrived: int, texts: list[tuple[str | None, str | None]]) -> list[dict]:
        out = []
        for c, machine, kinds in self.parts:
            data, folded = texts[c]
            if target not in kinds or not folded:
                continue
            candidates: set[int] = set()
            seen = set()
            for _, ids in machine.iter(folded):
                if ids not in seen:
                    seen.add(ids)
                    candidates |= ids
            results: dict[int, Span] = {}
            for i in sorted(candidates):
                r, test, lo, hi = self.rules[i]
                if not lo <= arrived <= hi or not self.applies(r, target, key):
                    continue
                k = self.group[i]  # a rule and its mirror share an operator
                if k not in results:
                    results[k] = test(data, folded)
                if results[k] is not None:
                    off, n = results[k]
                    out.append({"place": i, "off": off, "len": n, "matched": data[off : off + min(n, MATCHED)]})
        return out


_MACHINES: dict[tuple, Machine] = {}


def machine_of(key: tuple, rules, chains) -> Machine:
    """One machine for each worker process and plan."""
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Machine(rules, chains)
    return _MACHINES[key]


def found(plan: Plan, places: list[int], columns: dict[tuple[str, ...], tuple[str, str]]) -> Column:
    """FOUND of the places of a plan on a value's target, key, arrived and chain columns (data and folded data of each chain)."""
    rules = [(i, plan.placed[i].rule) for i in places]
    chains = sorted({r.transforms for _, r in rules})
    names = list(dict.fromkeys(n for c in chains for n in columns[c]))
    at = [tuple(names.index(n) for n in columns[c]) for c in chains]
    key = (hash(tuple(rules)), tuple(chains))

    @F.arrow_udf(FOUND)
    def match_plan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        machine = machine_of(key, rules, chains)
        for target, k, arrived, *data in batches:
            texts = [d.to_pylist() for d in data]
            rows = [
                machine.run(t, kk or "", a, [(texts[i][n], texts[j][n]) for i, j in at])
                for n, (t, kk, a) in enumerate(zip(target.to_pylist(), k.to_pylist(), arrived.to_pylist(), strict=True))
            ]
            yield pa.array(rows, _ARROW)

    return match_plan("target", "key", "arrived", *names)
