"""Command line: calibrate a corpus, lint a rule set, explain a rule or a request, import rule files."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegate.plans import core_rules, model, seclang


def _rules(path: str | None) -> list[model.Rule]:
    if not path:
        return core_rules.default_rules()
    if os.path.isdir(path):
        return model.rules_from_frame(SparkSession.builder.getOrCreate().read.parquet(path))
    with open(path, encoding="utf-8") as f:
        return seclang.parse(f.read())[0]


def lint(rules: list[model.Rule], most: int = 0) -> tuple[str, bool]:
    """The compile report as text, and whether the unconditional rules are within a number."""
    r = model.compile_report(model.compile_rules(rules, "heuristic"))
    lines = [f"{k}: {r[k]}" for k in ("rules", "prefiltered", "literals", "states", "chain_groups")]
    lines += [f"confidence {k}: {n}" for k, n in r["by_confidence"].items() if n]
    lines += [f"unconditional {i}: {why}" for i, why in r["unconditional"]]
    return "\n".join(lines), len(r["unconditional"]) <= most


def describe(rule: model.Rule) -> str:
    """A rule in words."""
    targets = ", ".join(t.kind + (f":{t.name}" if t.name else "") for t in rule.targets)
    phase = next(k for k, v in model.PHASES.items() if v == rule.phase)
    return "\n".join([f"{rule.id} {rule.msg}", f"phase: {phase}", f"severity: {rule.severity}, confidence: {rule.confidence}", f"targets: {targets}", f"chain: {' → '.join(rule.transforms) or 'none'}", f"operator: {rule.op.name} (cost {rule.op.cost})", f"literals: {', '.join(map(repr, rule.literals[:6]))}"])


def explain_request(spark: SparkSession, rules: list[model.Rule], target: str, method: str = "GET", headers=(), body: str | None = None, content_type: str | None = None):
    """Decision and hits of one request."""
    from tidegate.operators import decide
    from tidegate.operators.match import match
    from tidegate.sources import transactions as tx

    head = [*headers, *([("Content-Type", content_type)] if content_type else [])]
    df = spark.createDataFrame([(0, method, target, head, bytearray(body.encode()) if body is not None else None)], f"tx_id bigint, method string, target string, headers {tx.NAMED}, body binary")
    t, plan = tx.transactions(df), model.compile_rules(rules)
    hits = match(tx.explode_values(t), plan)
    return decide.all_decisions(t, decide.decide(hits), tx.gates(t)), decide.explain(hits, model.rules_frame(spark, plan.rules))


def calibrate(spark: SparkSession, rules: list[model.Rule], corpus: str):
    """The calibration table of a benign corpus, and how many requests it has. Nothing blocks, every tier is in, nothing is metered."""
    from tidegate.operators import analytics
    from tidegate.operators.match import match
    from tidegate.sources import transactions as tx

    requests = tx.read_corpus(spark, corpus)
    n = requests.count()
    hits = match(tx.explode_values(tx.transactions(requests)), model.compile_rules(rules, "heuristic"))
    return analytics.calibrate(hits, model.rules_frame(spark, rules), n), n


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidegate")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("calibrate")
    c.add_argument("--corpus", required=True)
    c.add_argument("--rules")
    x = sub.add_parser("lint")
    x.add_argument("--rules")
    x.add_argument("--max-unconditional", type=int, default=0)
    e = sub.add_parser("explain")
    e.add_argument("rule", nargs="?", type=int)
    for name, default in (("--target", "/"), ("--method", "GET"), ("--body", None), ("--content-type", None), ("--rules", None)):
        e.add_argument(name, default=default)
    e.add_argument("--arg", action="append", default=[])
    e.add_argument("--header", action="append", default=[])
    s = sub.add_parser("import")
    s.add_argument("files", nargs="+")
    s.add_argument("--strict", action="store_true")
    s.add_argument("--out", help="write the rules as a table (Parquet), for --rules of the other commands")
    a = p.parse_args(argv)
    if a.command == "import":
        taken: list[model.Rule] = []
        for path in a.files:
            with open(path, encoding="utf-8") as f:
                rules, report = seclang.parse(f.read(), a.strict)
            print(f"{path}: {len(rules)} rules, {len(report.skipped)} skipped")
            print("\n".join(f"  {d} {i}: {why}" for d, i, why in report.skipped))
            taken += rules
        if a.out:
            faults = model.validate(taken)
            if faults:
                print("\n".join(faults))
                return 1
            model.rules_frame(SparkSession.builder.getOrCreate(), taken).coalesce(1).write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "lint":
        text, good = lint(_rules(a.rules), a.max_unconditional)
        print(text)
        return int(not good)
    if a.command == "explain" and a.rule:
        found = [r for r in _rules(a.rules) if r.id == a.rule]
        print(describe(found[0]) if found else f"no rule {a.rule}")
        return int(not found)
    from tidegate.session import ship_package

    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    if a.command == "explain":
        target = a.target + ("?" if a.arg and "?" not in a.target else "") + "&".join(a.arg)
        headers = [tuple(v.strip() for v in h.split(":", 1)) for h in a.header]
        decisions, hits = explain_request(spark, _rules(a.rules), target, a.method, headers, a.body, a.content_type)
        decisions.show(truncate=False, vertical=True)
        hits.show(truncate=False, vertical=True)
        return 0
    from tidegate.operators.analytics import power

    table, n = calibrate(spark, _rules(a.rules), a.corpus)
    told = power(n)
    print(f"{n} requests; the least rate they can show is {told['min_detectable']:.6f}")
    print("\n".join(f"too few for {t}: {k} are needed" for t, k in told["unvalidated"].items()))
    table.show(1000, truncate=False)
    return int(table.filter(~F.col("passed")).limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
