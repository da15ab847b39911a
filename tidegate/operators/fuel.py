"""Deterministic work metering: the cost of every value and rule, summed in order of evaluation against a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import readings as rd
from tidegate.functions.text import lowercase
from tidegate.operators.match import applies, with_chains
from tidegate.operators.predicates import gate
from tidegate.plans.model import Plan

#: Costs and the default limit.
PER_RULE, PER_CHANGED_BYTE, LIMIT = 8, 2, 32_000_000


def value_cost(data: Column, steps: list[tuple[Column, Column]], scanned: list[Column]) -> Column:
    """Bytes read once, twice the output of every transform (its input, its output) that changed something, and the bytes that a prefilter scans."""
    cost = F.length(data)
    for before, after in steps:
        cost = cost + F.when(after != before, PER_CHANGED_BYTE * F.length(after)).otherwise(0)
    for c in scanned:
        cost = cost + F.length(c)
    return cost.cast("bigint")


def rule_cost(op_cost: Column) -> Column:
    return (PER_RULE + op_cost).cast("bigint")


def metered(values: DataFrame, plan: Plan, keep: tuple[str, ...] = ("tx_id",), fork: bool = True) -> DataFrame:
    """(keep..., value_seq, reading_ord, arrived, cost) of every value and reading that a plan evaluates: the value's cost with the chains of rules that see it, and that of each rule which its literals (or, without any, the verbatim reading) let through."""
    keep = list(keep)
    kinds = sorted({t.kind for r in plan.rules for t in r.targets})
    rows = values.filter(F.col("target").isin(kinds))
    rows = (rows.filter(~F.col("inert")) if "inert" in rows.columns else rows).select(*keep, "value_seq", "arrived", "target", "key", "data")
    rows = rd.fork(rows) if fork else rows.withColumns({"reading_ord": F.lit(0), "reading_class": F.lit(0)})
    rows, name = with_chains(rows, plan.chains)
    folded = {c: name[c] if "lowercase" in c else f"__f_{'_'.join(c)}" for c in plan.chains}
    rows = rows.withColumns({folded[c]: lowercase(F.col(name[c])) for c in plan.chains if "lowercase" not in c})
    steps = [(F.col(name[c[:-1]]), F.col(name[c])) for c in name if c]
    scanned = [F.col(name[c]) for c in plan.chains if any(r.literals for r in plan.rules if r.transforms == c)]
    cost = value_cost(F.col("data"), steps, scanned)
    for r in plan.rules:
        reached = gate(r.literals, folded[r.transforms]) if r.literals else F.col("reading_ord") == 0
        cost = cost + F.when(applies(r, F.col("target"), F.col("key"), F.col("arrived")) & reached, rule_cost(F.lit(r.op.cost))).otherwise(0)
    return rows.select(*keep, "value_seq", "reading_ord", "arrived", cost.cast("bigint").alias("cost"))


def spent(costs: DataFrame, keep: tuple[str, ...] = ("tx_id",), order: tuple[str, ...] = ("value_seq",), cost: str = "cost", limit: int = LIMIT) -> DataFrame:
    """Adds fuel_spent, the running sum within a transaction, and exhausted. A limit of 0 or less is none. A transaction is a bounded window: its values are limited."""
    w = Window.partitionBy(*keep).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(cost).over(w)
    return costs.withColumn("fuel_spent", total.cast("bigint")).withColumn("exhausted", F.lit(limit > 0) & (F.col("fuel_spent") > limit))


#: Comes after every phase: hits that were reached in time decide first.
AFTER_ALL = 99


def within(hits: DataFrame, metered: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Hits of values (and, where they are metered, readings) that were reached before the fuel ran out."""
    on = [*keep, "value_seq", *(["reading_ord"] if "reading_ord" in metered.columns else [])]
    return hits.join(metered.filter("NOT exhausted").select(*on), on, "left_semi")


def gates(metered: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """(keep..., gate_phase, gate_ord, reason, detail) of transactions whose fuel ran out, for :func:`operators.decide.all_decisions` with the hits of :func:`within`."""
    over = metered.filter("exhausted").groupBy(*keep).agg(F.min("value_seq").alias("__v"))
    return over.select(*keep, F.lit(AFTER_ALL).alias("gate_phase"), F.lit(0).alias("gate_ord"), F.lit("budget_exhausted").alias("reason"), F.concat(F.lit("at value "), F.col("__v")).alias("detail"))
