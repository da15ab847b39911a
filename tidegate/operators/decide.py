"""From hits to decisions: exceptions, first terminal hit, anomaly score, explanation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.readings import interpretation
from tidegate.operators.match import EVAL_KEY, TERMINAL
from tidegate.plans.model import CONFIDENCES, SEVERITIES, THRESHOLD

EXCEPTION_SCHEMA = "rule_id bigint, path string, target string, key string, note string"
REASONS = ("no_match", "rule", "threshold", "budget_exhausted", "limit_exceeded", "schema_violation", "framing_ambiguous", "undecidable")


#: Custom actions: a function of the hits whose rule names the action, to the same hits with their outcome columns set.
ACTIONS: dict = {}


def register_action(name: str, run) -> None:
    """Add an action. ``run`` maps a frame of hits to a frame of hits, and may set action (block, allow, score, log), score and status."""
    ACTIONS[name] = run


def with_actions(hits: DataFrame) -> DataFrame:
    """Hits with the outcomes of registered actions."""
    for name, run in ACTIONS.items():
        hits = hits.filter(F.col("action") != name).unionByName(run(hits.filter(F.col("action") == name)))
    return hits


def eval_key() -> Column:
    return F.struct(*EVAL_KEY)


#: Most exceptions of a table: they are a hand-written list, read on the driver and made part of the plan.
MAX_EXCEPTIONS = 10_000


def covered(exceptions: DataFrame, path: str = "path") -> Column:
    """Whether an exception covers a hit, as a condition on its row. An exception is a conjunction of what it names: rule (or the rule it derives from), path (exact, or up to a trailing *), target, key. One that names nothing is not used."""
    named = exceptions.filter("rule_id IS NOT NULL OR path IS NOT NULL OR target IS NOT NULL OR key IS NOT NULL").select("rule_id", "path", "target", "key")
    rows = named.limit(MAX_EXCEPTIONS + 1).collect()
    if len(rows) > MAX_EXCEPTIONS:
        raise ValueError(f"more than {MAX_EXCEPTIONS} exceptions")
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), "array<struct<rule_id:bigint,path:string,target:string,key:string>>")
    p = F.col(path)

    def covers(e: Column) -> Column:
        rule = e["rule_id"].isNull() | (e["rule_id"] == F.col("rule_id")) | ((F.col("derived_from") != 0) & (e["rule_id"] == F.col("derived_from")))
        stem = F.substring(e["path"], F.lit(1), F.length(e["path"]) - 1)
        there = e["path"].isNull() | (p == e["path"]) | (e["path"].endswith("*") & p.startswith(stem))
        return rule & there & (e["target"].isNull() | (e["target"] == F.col("target"))) & (e["key"].isNull() | (e["key"] == F.col("key")))

    return F.coalesce(F.exists(listed, covers), F.lit(False))


def without_exceptions(hits: DataFrame, exceptions: DataFrame, path: str = "path") -> DataFrame:
    """Hits that no exception covers (:func:`covered`)."""
    return hits.filter(~covered(exceptions, path))


def narrowest_exception(hits: DataFrame, path: str = "path") -> DataFrame:
    """The exception that would cover a hit and least else."""
    rule = F.when(F.col("derived_from") != 0, F.col("derived_from")).otherwise(F.col("rule_id"))
    return hits.withColumn("exception", F.struct(rule.alias("rule_id"), F.col(path).alias("path"), F.col("target").alias("target"), F.col("key").alias("key")))


def decide(hits: DataFrame, keep: tuple[str, ...] = ("tx_id",), threshold: int = THRESHOLD, detection_only: bool = False, exceptions: DataFrame | None = None, path: str = "path", stop_when_suppressed: bool = True) -> DataFrame:
    """One decision for each transaction with hits.

    Within a phase, evaluation ends at the first terminal hit; later phases run only while nothing is decided. Scores add
    up over phases, and the threshold blocks by the phase's hit of highest severity (the first of equals). An excepted hit
    loses its score and its verdict; with ``stop_when_suppressed`` a suppressed terminal hit still ends its phase, so what
    came after it does not count, as in a one-pass evaluator; without, the rest counts.
    """
    keep = list(keep)
    rows = hits.withColumn("__ok", F.lit(True) if exceptions is None else ~covered(exceptions, path))
    terminal = F.col("action").isin(*TERMINAL)
    ends = terminal if stop_when_suppressed else terminal & F.col("__ok")
    hit = F.struct("rule_id", "derived_from", "target", "key", "off", "len", "matched", "reading_class", "action", "status", "severity", "confidence")
    w = Window.partitionBy(*keep, "phase").orderBy(*EVAL_KEY[1:]).rowsBetween(Window.unboundedPreceding, -1)
    live = rows.withColumn("__ended", F.coalesce(F.max(ends.cast("int")).over(w), F.lit(0))).filter("__ended = 0")
    sums = live.groupBy(*keep, "phase").agg(
        F.sum(F.when(F.col("__ok"), F.col("score")).otherwise(0)).cast("bigint").alias("__score"),
        F.min_by(hit, F.when(terminal & F.col("__ok"), eval_key())).alias("__first"),
        F.max(F.when(terminal & F.col("__ok"), 1).otherwise(0)).alias("__terminal"),
        F.max_by(hit, F.when(F.col("__ok"), F.struct(F.col("severity"), *[(-F.col(k)).alias(k) for k in EVAL_KEY]))).alias("__worst"),
    )
    run = Window.partitionBy(*keep).orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    phases = sums.withColumn("__total", F.sum("__score").over(run))
    decided = (F.col("__terminal") == 1) | (F.col("__total") >= threshold)
    per = phases.groupBy(*keep).agg(
        F.min_by(F.struct("phase", "__first", "__worst", "__terminal", "__total"), F.when(decided, F.col("phase"))).alias("d"),
        F.max("__total").alias("__all"),
    )
    first = F.col("d.__terminal") == 1
    by = F.when(first, F.col("d.__first")).otherwise(F.col("d.__worst"))
    per = per.withColumn("h", F.when(F.col("d").isNotNull(), by))
    blocks = F.col("d").isNotNull() & (~first | (F.col("h.action") == "block"))
    verdict = F.when(blocks & F.lit(not detection_only), "block").otherwise("allow")
    reason = F.when(F.col("d").isNull(), "no_match").when(first, "rule").otherwise("threshold")
    return per.select(
        *keep, verdict.alias("verdict"), reason.alias("reason"), F.coalesce(F.nullif(F.col("h.status"), F.lit(0)), F.when(blocks, 403).otherwise(0)).cast("int").alias("status"),
        F.coalesce("d.__total", "__all").cast("bigint").alias("score"), F.col("d.phase").alias("phase"), F.coalesce("h.rule_id", F.lit(0)).cast("bigint").alias("rule_id"),
        F.col("h.target").alias("target"), F.col("h.key").alias("key"), F.col("h.off").alias("off"), F.col("h.len").alias("len"), F.col("h.matched").alias("matched"), F.col("h.severity").alias("severity"),
        interpretation(F.coalesce("h.reading_class", F.lit(0))).alias("interpretation"),
    )


def all_decisions(transactions: DataFrame, decisions: DataFrame, gates: DataFrame | None = None, keep: tuple[str, ...] = ("tx_id",), detection_only: bool = False, fail_closed: bool = True) -> DataFrame:
    """A decision for every transaction: gates (keep..., gate_phase, reason) come before the rules of their phase, then hits, else no_match. Limit and undecidable gates block only in blocking mode and if failing closed."""
    rows = transactions.select(*keep).join(decisions, list(keep), "left")
    if gates is None:
        return rows.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "reason": F.coalesce("reason", F.lit("no_match"))})
    first = gates.groupBy(*keep).agg(F.min_by("reason", F.struct("gate_phase", "gate_ord")).alias("__reason"), F.min("gate_phase").alias("__gp"))
    rows = rows.join(first, list(keep), "left")
    gated = F.col("__reason").isNotNull() & (F.col("phase").isNull() | (F.col("__gp") <= F.col("phase")))
    soft = F.col("__reason").isin("limit_exceeded", "undecidable", "budget_exhausted")
    closes = F.lit(not detection_only) & (~soft | F.lit(fail_closed))
    return rows.withColumns({
        "verdict": F.when(gated, F.when(closes, "block").otherwise("allow")).otherwise(F.coalesce("verdict", F.lit("allow"))),
        "reason": F.when(gated, F.col("__reason")).otherwise(F.coalesce("reason", F.lit("no_match"))),
    }).drop("__reason", "__gp")


def explain(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits with what a person needs to judge them: message, chain, operator, reading and place."""
    r = rules.select("rule_id", "msg", F.concat_ws(" → ", "transforms").alias("chain"), F.col("op.name").alias("operator"))
    out = hits.join(F.broadcast(r), "rule_id", "left")
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    tiers = F.array(*[F.lit(c) for c in CONFIDENCES])
    return out.withColumns({"severity_name": F.get(names, F.col("severity")), "confidence_name": F.get(tiers, F.col("confidence")), "interpretation": interpretation(F.col("reading_class"))})
