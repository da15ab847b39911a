"""Matching a compiled plan on values: values -> readings -> chains -> hits.

Small plans are expressions. Rules of plain operators become entries of one generated array, inside one projection; a detector's entry is the value
that passed its target and literal gate, and one Arrow function judges these entries alone. The input is read once and
nothing is shuffled: a value is a row, and hits come out of the row they belong to. Plans of many literals are matched by
automata in one Arrow function (operators.automaton), with only what that does not support as expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import readings as rd
from tidegate.functions.detectors import THRESHOLD, detect_many
from tidegate.functions.text import TRANSFORMS, lowercase
from tidegate.operators import automaton
from tidegate.operators.predicates import any_true, gate, is_detector, test_of
from tidegate.plans.core_rules import PREDICATES
from tidegate.plans.model import CONFIDENCES, FOLDED, SEVERITIES, SEVERITY_SCORE, Plan, Rule, Target

TERMINAL = ("block", "allow")
HIT = (
    "phase int, value_seq int, reading_ord int, group_ord int, conditional int, rule_idx int, action_idx int, rule_id bigint, derived_from bigint, "
    "target string, key string, off int, len int, matched string, reading_class int, action string, score int, status int, severity int, confidence int"
)
#: Order of evaluation of hits within a transaction.
EVAL_KEY = ("phase", "value_seq", "reading_ord", "group_ord", "conditional", "rule_idx", "action_idx")


def target_test(t: Target, target: Column, key: Column) -> Column:
    """Whether a value is of a target: any key if the target names none; header and cookie names fold case; a resolver's name covers its keys."""
    hit = target == t.kind
    if not t.name:
        return hit
    if t.kind == "RESOLVED":
        return hit & ((key == t.name) | key.startswith(t.name + "."))
    if t.kind in FOLDED:
        return hit & (lowercase(key) == t.name.lower())
    return hit & (key == t.name)


def applies(rule: Rule, target: Column, key: Column, arrived: Column) -> Column:
    """Target and phase: header rules see what came with the headers; mirrors see what came with the body, other body rules see both; response rules see the response."""
    hit = F.lit(False)
    for t in rule.targets:
        hit = hit | target_test(t, target, key)
    if rule.phase == 1:
        when = arrived == 1
    elif rule.phase == 2:
        when = arrived == 2 if rule.derived_from else arrived <= 2
    else:
        when = (arrived >= 3) & (arrived <= rule.phase)
    return when & hit


def with_chains(values: DataFrame, chains: list[tuple[str, ...]], data: str = "data") -> tuple[DataFrame, dict[tuple[str, ...], str]]:
    """Add a column for every prefix of every chain, each computed from the one before."""
    names: dict[tuple[str, ...], str] = {(): data}
    prefixes = sorted({c[:k] for c in chains for k in range(1, len(c) + 1)}, key=lambda c: (len(c), c))
    for depth in sorted({len(p) for p in prefixes}):
        step = {}
        for p in (p for p in prefixes if len(p) == depth):
            names[p] = "__c_" + "_".join(p)
            step[names[p]] = TRANSFORMS[p[-1]](F.col(names[p[:-1]]))
        values = values.withColumns(step)
    return values, names


def _entry(place: int | None, off: Column, length: Column, matched: Column, detector: int | None = None, data: Column | None = None) -> Column:
    """A hit by the number of its rule's place; or a value for a detector."""
    d = F.lit(None).cast("string") if data is None else data
    return F.struct(F.lit(place).cast("int").alias("place"), off.cast("int").alias("off"), length.cast("int").alias("len"), matched.alias("matched"), F.lit(detector).cast("int").alias("number"), d.alias("d"))


def places_frame(spark: SparkSession, plan: Plan) -> DataFrame:
    """What hits take from their rule: one row for each place and action of a plan."""
    rows = []
    for i, p in enumerate(plan.placed):
        r = p.rule
        for k, a in enumerate(r.actions):
            score = (a.score or SEVERITY_SCORE[r.severity]) if a.kind == "score" else 0
            rows.append((i, r.phase, p.group, int(bool(r.literals)), p.index, k, r.id, r.derived_from, a.kind, score, a.status, SEVERITIES.index(r.severity), CONFIDENCES.index(r.confidence)))
    kind = "place int, phase int, group_ord int, conditional int, rule_idx int, action_idx int, rule_id bigint, derived_from bigint, action string, score int, status int, severity int, confidence int"
    return spark.createDataFrame(rows, kind)


#: Literals beyond which a plan is matched by automata.
MANY = 100


def match(values: DataFrame, plan: Plan, keep: tuple[str, ...] = ("tx_id",), fork: bool = True, strategy: str = "auto") -> DataFrame:
    """All hits of a plan on values (keep..., value_seq, arrived, target, key, data, inert). Inert values are not looked at. Rules without literals see only the verbatim reading.

    ``strategy``: ``expressions``, ``automaton`` (operators.automaton for what it supports), or ``auto`` by the number of literals."""
    keep = list(keep)
    kinds = sorted({t.kind for r in plan.rules for t in r.targets})
    rows = values.filter(~F.col("inert") & F.col("target").isin(kinds)) if "inert" in values.columns else values.filter(F.col("target").isin(kinds))
    rows = rows.select(*keep, "value_seq", "arrived", "target", "key", "data")
    rows = rd.fork(rows) if fork else rows.withColumns({"reading_ord": F.lit(0), "reading_class": F.lit(0)})
    rows, name = with_chains(rows, plan.chains)
    folded = {}
    for c in plan.chains:
        folded[c] = name[c] if "lowercase" in c else f"__f_{'_'.join(c)}"
    rows = rows.withColumns({folded[c]: lowercase(F.col(name[c])) for c in plan.chains if "lowercase" not in c})
    target, key, arrived, verbatim = F.col("target"), F.col("key"), F.col("arrived"), F.col("reading_ord") == 0
    if strategy == "auto":
        strategy = "automaton" if sum(len(r.literals) for r in plan.rules) > MANY else "expressions"
    swept = [i for i, p in enumerate(plan.placed) if strategy == "automaton" and p.rule.literals and automaton.supported(p.rule.op)]
    if swept:
        rows = rows.withColumn("__swept", automaton.found(plan, swept, {c: (name[c], folded[c]) for c in plan.chains}))
    tests: dict = {}

    def applied(r: Rule) -> Column:
        k = (r.targets, r.phase, bool(r.derived_from))
        if k not in tests:
            tests[k] = applies(r, target, key, arrived)
        return tests[k]

    shared: dict[tuple, list[int]] = {}
    none, entries = F.lit(None).cast("string"), []
    for i, p in enumerate(plan.placed):
        r = p.rule
        if i in set(swept):
            continue
        if is_detector(r.op):
            shared.setdefault((r.op.name.removeprefix("detect_"), r.op.args, r.transforms), []).append(i)
            continue
        data, low = F.col(name[r.transforms]), folded[r.transforms]
        t = test_of(r.op, name[r.transforms], low)
        own = not r.op.negated and (r.op.literals is None and r.op.name in ("contains", "contains_any", "equals", "has_prefix") or r.op.name.startswith("func:") and r.op.name[5:] in PREDICATES and not PREDICATES[r.op.name[5:]].get("gated"))
        when = applied(r)
        if not r.literals:
            when = when & verbatim
        elif not own:
            when = when & gate(r.literals, low)
        entries.append(F.when(when & t.hit, _entry(i, t.off, t.length, F.substring(data, t.off.cast("int") + 1, F.least(t.length.cast("int"), F.lit(256))))))
    for k, ((_, _, chain), places) in enumerate(shared.items()):
        when = any_true([applied(plan.placed[i].rule) for i in places]) & gate(plan.placed[places[0]].rule.literals, folded[chain])
        entries.append(F.when(when, _entry(None, F.lit(None), F.lit(None), none, k, F.col(name[chain]))))
    base = [*keep, "value_seq", "arrived", "target", "key", "reading_ord", "reading_class"]
    out = None
    if swept:
        entry = lambda x: F.struct(x["place"].alias("place"), x["off"].alias("off"), x["len"].alias("len"), x["matched"].alias("matched"), F.lit(None).cast("int").alias("number"), none.alias("d"))
        sweep = F.transform("__swept", entry)
        every = F.concat(F.array_compact(F.array(*entries)), sweep) if entries else sweep
    elif entries:
        every = F.array_compact(F.array(*entries))
    if entries or swept:
        # an explode is a barrier: filters on what comes out are not evaluated again below it
        rows = rows.select(*base, F.explode(every).alias("__e"))
        if shared:
            rows = rows.withColumn("__v", detect_many([k[:2] for k in shared])(F.col("__e.number"), F.col("__e.d")))
            late = [F.when((F.col("__e.number") == k) & (F.col("__v.score") >= THRESHOLD) & applied(plan.placed[i].rule), F.lit(i)) for k, places in enumerate(shared.values()) for i in places]
            judged = F.transform(F.array_compact(F.array(*late)), lambda i: _entry(None, F.col("__v.off"), F.col("__v.len"), F.substring(F.col("__e.d"), F.col("__v.off") + 1, F.least(F.col("__v.len"), F.lit(256)))).withField("place", i))
            rows = rows.select(*base, F.explode(F.when(F.col("__e.number").isNull(), F.array(F.col("__e"))).otherwise(judged)).alias("__e"))
        hits = rows.select(*base, F.col("__e.place").alias("place"), F.col("__e.off").alias("off"), F.col("__e.len").alias("len"), F.col("__e.matched").alias("matched"))
        out = hits.join(F.broadcast(places_frame(values.sparkSession, plan)), "place").drop("place", "arrived")
    if out is None:
        empty = rows.limit(0).select(*keep, "value_seq", "target", "key", "reading_ord", "reading_class")
        return empty.selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (x.split() for x in HIT.split(", ")) if n not in empty.columns])
    return out


#: Most literals of a set that is sent to every worker.
MAX_LITERALS = 1_000_000


def literal_hits(values: DataFrame, literals: DataFrame, keep: tuple[str, ...] = ("tx_id",), data: str = "data") -> DataFrame:
    """The strategy for very many literal rules: (keep..., rule_id) of every rule (rule_id, literal) whose literal a value holds, case folded.

    One automaton of all literals scans a value once, so the work for a value does not depend on the number of rules. A
    rule set is metadata: its literals are read on the driver and sent to the workers, within MAX_LITERALS."""
    rows = literals.select("rule_id", lowercase(F.col("literal")).alias("literal")).filter("literal <> ''").limit(MAX_LITERALS + 1).collect()
    if len(rows) > MAX_LITERALS:
        raise ValueError(f"more than {MAX_LITERALS} literals")
    words: dict[str, list[int]] = {}
    for r in rows:
        words.setdefault(r["literal"], []).append(r["rule_id"])
    table = tuple(sorted((w, tuple(sorted(set(ids)))) for w, ids in words.items()))

    @F.arrow_udf("array<bigint>")
    def literal_rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, ids in table:
            machine.add_word(w, ids)
        machine.make_automaton()
        for batch in batches:
            found = [None if d is None else sorted({i for _, ids in machine.iter(d) for i in ids}) if table else [] for d in batch.to_pylist()]
            yield pa.array(found, pa.list_(pa.int64()))

    low = values.select(*keep, literal_rules(lowercase(F.col(data))).alias("__r"))
    return low.select(*keep, F.explode("__r").alias("rule_id")).distinct()
