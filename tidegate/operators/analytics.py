"""Telemetry, calibration, corpus reports and audit records over decisions and hits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.plans.model import CEILING, CONFIDENCES, SEVERITIES

#: Reasons that telemetry counts as exhausted and as errors.
EXHAUSTED, ERRORS = ("budget_exhausted",), ("limit_exceeded", "framing_ambiguous", "undecidable")
MATCHED_BYTES, SAMPLES = 256, 5


def snapshot(decisions: DataFrame, by: list[Column] | None = None, latency: str | None = None) -> DataFrame:
    """Counters over decisions (verdict, reason[, undeclared]), for the whole or for groups such as a time window."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    undeclared = n(F.col("undeclared")) if "undeclared" in decisions.columns else F.lit(0).cast("bigint")
    aggs = [F.count("*").alias("requests"), n(F.col("verdict") == "block").alias("blocked"), n(F.col("verdict") == "allow").alias("allowed"), n(F.col("reason").isin(*EXHAUSTED)).alias("exhausted"), n(F.col("reason").isin(*ERRORS)).alias("errors"), undeclared.alias("undeclared")]
    if latency:
        aggs += [F.expr(f"coalesce(sum({latency}) div count(*), 0)").alias("mean_ns"), F.coalesce(F.max(latency), F.lit(0)).cast("bigint").alias("max_ns")]
    return decisions.groupBy(*(by or [])).agg(*aggs)


def block_rate(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("block_rate", F.when(F.col("requests") > 0, F.col("blocked") / F.col("requests")).otherwise(F.lit(0.0)))


def by_rule(decisions: DataFrame) -> DataFrame:
    return decisions.filter("rule_id <> 0").groupBy("rule_id").agg(F.count("*").alias("n"))


def by_severity(decisions: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return decisions.filter("rule_id <> 0").groupBy(F.get(names, F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


def top_rules(decisions: DataFrame, n: int) -> DataFrame:
    """The n rules that decided most often; of equals, the least id first."""
    return by_rule(decisions).orderBy(F.desc("n"), F.asc("rule_id")).limit(n)


def suggested_tier(measured: Column) -> Column:
    """The strictest tier whose ceiling a measured rate does not exceed."""
    out = F.lit("heuristic")
    for tier in CONFIDENCES:
        out = F.when(measured <= CEILING[tier], F.lit(tier)).otherwise(out)
    return out


def calibrate(hits: DataFrame, rules: DataFrame, requests: int | Column, keep: tuple[str, ...] = ("tx_id",), mode: str = "all_hits") -> DataFrame:
    """False-positive rates of rules on a benign corpus: each request counts once for a rule; rules without a hit are there too.

    ``first_terminal`` credits the first rule of a request alone, as an evaluator that stops there would."""
    one = hits.select(*keep, "rule_id").distinct()
    if mode == "first_terminal":
        from tidegate.operators.decide import eval_key

        one = hits.groupBy(*keep).agg(F.min_by("rule_id", eval_key()).alias("rule_id"))
    fired = one.groupBy("rule_id").agg(F.count("*").alias("hits"))
    ceiling = F.create_map(*[x for k, v in CEILING.items() for x in (F.lit(k), F.lit(v))])
    total = F.lit(requests) if isinstance(requests, int) else requests
    out = rules.select("rule_id", "confidence").join(fired, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    measured = F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0))
    out = out.withColumns({"measured": measured, "ceiling": F.element_at(ceiling, F.col("confidence"))})
    return out.withColumns({"passed": F.col("measured") <= F.col("ceiling"), "suggested": suggested_tier(F.col("measured"))}).orderBy(F.desc("measured"), "rule_id")


def power(requests: int) -> dict:
    """What a corpus of so many requests can tell: the least rate it can show, and the tiers it is too small for with the size they need."""
    least = 1 / requests if requests else 1.0
    need = {t: math.ceil(1 / c) for t, c in CEILING.items() if c < 1}
    return {"min_detectable": least, "unvalidated": {t: n for t, n in need.items() if requests < n}}


def hit_samples(hits: DataFrame, keep: tuple[str, ...] = ("tx_id",), n: int = SAMPLES) -> DataFrame:
    """At most n sample requests of each rule: the n least ids, kept as bounded arrays so that a rule that fires everywhere costs little."""
    first = hits.groupBy("rule_id", F.pmod(F.hash(*keep), F.lit(64)).alias("__s")).agg(F.slice(F.array_sort(F.collect_set(F.col(keep[0]))), 1, n).alias("s"))
    return first.groupBy("rule_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))), 1, n).alias("samples"))


def corpus_report(results: DataFrame) -> DataFrame:
    """Cases and blocked ones by class, by technique, and overall, from rows (class, technique, blocked)."""
    return results.groupingSets([[F.col("class")], [F.col("technique")], []], F.col("class"), F.col("technique")).agg(F.count("*").alias("cases"), F.sum(F.col("blocked").cast("bigint")).alias("blocked"))


def audit_records(decisions: DataFrame, hits_path: Column | None = None) -> DataFrame:
    """One record for each decision, with the matched bytes cut to MATCHED_BYTES and the exception that would cover it."""
    keep = [c for c in ("tx_id", "verdict", "reason", "status", "score", "phase", "rule_id", "target", "key", "off", "len", "severity", "interpretation") if c in decisions.columns]
    path = hits_path if hits_path is not None else (F.col("path") if "path" in decisions.columns else F.lit(None).cast("string"))
    exception = F.when(F.col("rule_id") != 0, F.struct("rule_id", path.alias("path"), "target", "key"))
    return decisions.select(*keep, F.substring("matched", 1, MATCHED_BYTES).alias("matched"), exception.alias("suggested_exception"))


def relevant(records: DataFrame) -> DataFrame:
    """Records of which something came: not plain allows."""
    return records.filter("NOT (verdict = 'allow' AND reason = 'no_match')")


def severity_at_least(records: DataFrame, least: str) -> DataFrame:
    """Records of at least a severity; those without a rule pass."""
    return records.filter((F.col("rule_id") == 0) | (F.col("severity") >= SEVERITIES.index(least)))


def write_audit(records: DataFrame, *paths: str) -> None:
    """JSON lines to every sink."""
    for p in paths:
        records.write.mode("append").json(p)


def conformance(cases: DataFrame) -> DataFrame:
    """Outcome of each case (expects_block, blocked, expected array, forbidden array, fired array, skipped, mode) by the two judges: detection compares blocking, rule_id the ids that fired."""
    ids = F.when((F.size(F.array_except("expected", "fired")) == 0) & ~F.arrays_overlap("forbidden", "fired"), "pass").otherwise("fail")
    detection = F.when(F.col("expects_block"), F.when(F.col("blocked"), "pass").otherwise("fail")).otherwise(F.when(F.col("blocked"), "fail").otherwise("pass"))
    return cases.withColumn("outcome", F.when(F.col("skipped"), "skip").when(F.col("mode") == "rule_id", ids).otherwise(detection))
