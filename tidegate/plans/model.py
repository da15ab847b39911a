"""Rules as data: their parts, validation, phases' order of evaluation, and the compile report."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

#: Phases, severities with their scores, confidences with their false-positive ceilings, id ranges.
PHASES = {"request_headers": 1, "request_body": 2, "response_headers": 3, "response_body": 4, "logging": 5}
SEVERITY_SCORE = {"notice": 2, "warning": 3, "error": 4, "critical": 5}
SEVERITIES = tuple(SEVERITY_SCORE)
CONFIDENCES = ("heuristic", "low", "medium", "high", "certain")
CEILING = {"heuristic": 1.0, "low": 0.05, "medium": 0.01, "high": 0.001, "certain": 0.0001}
PARANOIA = {1: "high", 2: "medium", 3: "low", 4: "heuristic"}
RANGES = {"core": (1, 99_999), "bundle": (100_000, 899_999), "crs": (900_000, 999_999), "user": (1_000_000, 2**32 - 1)}
THRESHOLD = 5
TARGET_PHASE = {
    **dict.fromkeys("REQUEST_METHOD REQUEST_URI REQUEST_PROTOCOL REQUEST_LINE REQUEST_PATH REQUEST_HEADERS REQUEST_HEADER_NAMES REQUEST_COOKIES REQUEST_COOKIE_NAMES ARGS ARGS_NAMES ARGS_GET ARGS_JOINED REMOTE_ADDR RESOLVED".split(), 1),
    **dict.fromkeys("ARGS_POST FILES_NAMES REQUEST_BODY".split(), 2),
    **dict.fromkeys("RESPONSE_STATUS RESPONSE_HEADERS RESPONSE_HEADER_NAMES".split(), 3),
    "RESPONSE_BODY": 4,
}
FOLDED = frozenset("REQUEST_HEADERS REQUEST_HEADER_NAMES REQUEST_COOKIES REQUEST_COOKIE_NAMES RESPONSE_HEADERS RESPONSE_HEADER_NAMES".split())


@dataclass(frozen=True)
class Target:
    kind: str
    name: str = ""


@dataclass(frozen=True)
class Op:
    """A predicate by name with its arguments; ``literals`` are the strings of which a value must hold one."""

    name: str
    args: tuple = ()
    negated: bool = False
    literals: tuple[str, ...] | None = None
    cost: int = 4


@dataclass(frozen=True)
class Action:
    kind: str = "score"
    score: int = 0
    status: int = 0


@dataclass(frozen=True)
class Rule:
    id: int
    phase: int
    targets: tuple[Target, ...]
    op: Op
    transforms: tuple[str, ...] = ()
    actions: tuple[Action, ...] = (Action(),)
    severity: str = "warning"
    confidence: str = "high"
    msg: str = ""
    tags: tuple[str, ...] = ()
    derived_from: int = 0

    @property
    def literals(self) -> tuple[str, ...]:
        return literals_of(self.op)

    @property
    def authored(self) -> int:
        return self.derived_from or self.id


def literals_of(op: Op) -> tuple[str, ...]:
    """What the prefilter looks for: declared literals, or the operator's own needles. None means it is unconditional."""
    if op.literals is not None:
        return tuple(dict.fromkeys(x.lower() if x.isascii() else x for x in op.literals if x))
    if op.negated:
        return ()
    if op.name in ("contains", "contains_any", "equals", "has_prefix"):
        return tuple(dict.fromkeys(str(a).lower() for a in op.args if a))
    return ()


class RuleError(ValueError):
    """All faults of a rule set."""


def validate(rules: list[Rule], known_ops=None, known_transforms=None, user_only: bool = False) -> list[str]:
    """Every fault of every rule; none is skipped."""
    faults, seen = [], set()
    for r in rules:
        say = lambda x, r=r: faults.append(f"rule {r.id}: {x}")
        if not r.id:
            say("zero id")
        elif r.id in seen:
            say("duplicate id")
        seen.add(r.id)
        if user_only and r.id and r.id < RANGES["user"][0]:
            say("reserved id")
        if r.phase not in PHASES.values():
            say("invalid phase")
        if not r.targets:
            say("no targets")
        for t in r.targets:
            if t.kind not in TARGET_PHASE:
                say(f"unknown target {t.kind}")
            elif TARGET_PHASE[t.kind] > r.phase:
                say(f"target {t.kind} comes after the rule's phase")
        if r.op is None:
            say("no operator")
        elif known_ops is not None and r.op.name not in known_ops and not r.op.name.startswith("func:"):
            say(f"unknown operator {r.op.name}")
        for t in r.transforms:
            if t is None or known_transforms is not None and t not in known_transforms:
                say(f"unknown transform {t}")
        if any(a is None for a in r.actions):
            say("no action")
        if r.severity not in SEVERITIES:
            say("bad severity")
        if r.confidence not in CONFIDENCES:
            say("bad confidence")
    return faults


def select_by_confidence(rules: list[Rule], least: str = "high") -> list[Rule]:
    return [r for r in rules if CONFIDENCES.index(r.confidence) >= CONFIDENCES.index(least)]


@dataclass(frozen=True)
class Placed:
    """A rule with its place in the order of evaluation of its phase."""

    rule: Rule
    group: int
    index: int


@dataclass
class Plan:
    """Rules in order of evaluation: by phase, then by chain (its transform names, a shorter prefix first), then by id."""

    placed: list[Placed]
    chains: list[tuple[str, ...]] = field(default_factory=list)

    @property
    def rules(self) -> list[Rule]:
        return [p.rule for p in self.placed]


def compile_rules(rules: list[Rule], least: str = "high", user_only: bool = False, known_ops=None, known_transforms=None) -> Plan:
    kept = select_by_confidence(rules, least)
    faults = validate(kept, known_ops, known_transforms, user_only)
    if faults:
        raise RuleError("\n".join(faults))
    kept = sorted(kept, key=lambda r: (r.phase, r.id))
    placed, chains = [], sorted({r.transforms for r in kept})
    for phase in sorted({r.phase for r in kept}):
        groups = sorted({r.transforms for r in kept if r.phase == phase})
        for g, c in enumerate(groups):
            placed += [Placed(r, g, i) for i, r in enumerate(x for x in kept if x.phase == phase and x.transforms == c)]
    return Plan(placed, chains)


def concat(*sets: list[Rule]) -> list[Rule]:
    return [r for s in sets for r in s]


def remove_rules(rules: list[Rule], ids: set[int]) -> list[Rule]:
    return [r for r in rules if r.id not in ids]


def mirrored(rules: list[Rule]) -> list[Rule]:
    """Add body mirrors (id + 900) of request-header rules that read unnamed arguments or argument names, and response-body mirrors (id + 100) of response-header rules."""
    out = list(rules)
    for r in rules:
        kinds = [t.kind for t in r.targets if not t.name]
        if r.phase == 1 and ("ARGS" in kinds or "ARGS_NAMES" in kinds):
            targets = ([Target("ARGS"), Target("REQUEST_BODY")] if "ARGS" in kinds else []) + ([Target("ARGS_NAMES")] if "ARGS_NAMES" in kinds else [])
            out.append(replace(r, id=r.id + 900, phase=2, targets=tuple(targets), derived_from=r.id))
        if r.phase == 3:
            out.append(replace(r, id=r.id + 100, phase=4, targets=(Target("RESPONSE_BODY"),)))
    return out


def compile_report(plan: Plan) -> dict:
    """Counts of the compiled set: rules, prefiltered and unconditional ones, literals, chains, and rules by confidence."""
    literals = {x for r in plan.rules for x in r.literals}
    states = {x[:k] for x in literals for k in range(1, len(x) + 1)}
    unconditional = [r for r in plan.rules if not r.literals]
    return {
        "rules": len(plan.rules),
        "prefiltered": len(plan.rules) - len(unconditional),
        "unconditional": [(r.id, "negated" if r.op.negated else "no literal") for r in unconditional],
        "literals": len(literals),
        "states": len(states) + 1,
        "chain_groups": len({(p.rule.phase, p.rule.transforms) for p in plan.placed}),
        "by_confidence": {c: sum(r.confidence == c for r in plan.rules) for c in CONFIDENCES},
    }


RULE_SCHEMA = (
    "rule_id bigint, derived_from bigint, phase int, targets array<struct<kind:string,name:string>>, transforms array<string>, "
    "op struct<name:string,args:array<string>,negated:boolean>, literals array<string>, "
    "actions array<struct<kind:string,score:int,status:int>>, severity string, confidence string, msg string, tags array<string>"
)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table."""
    rows = [(r.id, r.derived_from, r.phase, [(t.kind, t.name) for t in r.targets], list(r.transforms), (r.op.name, [str(a) for a in r.op.args], r.op.negated), list(r.literals), [(a.kind, a.score, a.status) for a in r.actions], r.severity, r.confidence, r.msg, list(r.tags)) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_frame(rows: DataFrame) -> list[Rule]:
    """Rules of a table: a rule set is small, and is read on the driver where plans are made."""
    out = []
    for r in rows.orderBy("rule_id").collect():
        op = Op(r.op.name, tuple(r.op.args), r.op.negated, tuple(r.literals) or None)
        out.append(Rule(r.rule_id, r.phase, tuple(Target(t.kind, t.name) for t in r.targets), op, tuple(r.transforms), tuple(Action(a.kind, a.score, a.status) for a in r.actions), r.severity, r.confidence, r.msg, tuple(r.tags), r.derived_from))
    return out
