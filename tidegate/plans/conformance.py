"""Conformance cases in the YAML format of regression suites: requests with expectations, replayed through a plan."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.plans.model import Plan
from tidegate.sources.transactions import NAMED

CASE = f"tx_id bigint, name string, method string, target string, headers {NAMED}, body binary, response_status int, response_headers {NAMED}, response_body binary, expects_block boolean, expected array<bigint>, forbidden array<bigint>, skipped boolean"
#: What a replay cannot judge.
SKIPS = ("raw_request", "encoded_request", "follow_redirect", "save_cookie")


def reflected(data: str | None) -> str | None:
    """What a reflecting origin answers to a body of the form {"body": "..."}: all up to the last quote, since such bodies need not be JSON."""
    _, key, rest = (data or "").partition('"body"')
    found = re.match(r'(?s)[: \t]*"(.*)"', rest) if key else None
    return found[1] if found else None


def load(text: str) -> list[tuple]:
    """Rows of CASE, one for each stage of each test of a YAML document."""
    import yaml

    out = []
    for doc in yaml.safe_load_all(text):
        if not doc or (doc.get("meta") or {}).get("enabled") is False:
            continue
        for test in doc.get("tests") or []:
            for stage in test.get("stages") or []:
                stage = stage.get("stage", stage)
                given, want = stage.get("input") or {}, stage.get("output") or {}
                log = want.get("log") or {}
                expected = [int(i) for i in log.get("expect_ids") or []]
                forbidden = [int(i) for i in log.get("no_expect_ids") or []]
                blocks = bool(expected or log.get("match_regex") or want.get("log_contains")) or not (forbidden or log.get("no_match_regex") or want.get("no_log_contains")) and want.get("status") == 403
                uri = urlsplit(given.get("uri") or "/")
                target = (uri.path or "/") + (f"?{uri.query}" if uri.query else "")
                skipped = any(given.get(k) for k in SKIPS) or bool(want.get("response_contains"))
                data = given.get("data") or given.get("encoded_data")
                answer = reflected(None if data is None else str(data))
                response = (None, None, None) if answer is None else (200, [("Content-Type", "text/html")], bytearray(answer.encode()))
                headers = [(str(n), str(v)) for n, v in (given.get("headers") or {}).items()]
                name = f"{doc.get('rule_id', '')}-{test.get('test_id', test.get('test_title', ''))}"
                out.append((len(out), name, given.get("method") or "GET", target, headers, bytearray(str(data).encode()) if data is not None else None, *response, blocks, expected, forbidden, skipped))
    return out


def replay(spark: SparkSession, cases: list[tuple], plan: Plan, mode: str = "detection") -> DataFrame:
    """Outcome of each case under a plan: see operators.analytics.conformance."""
    from tidegate.operators import analytics, decide
    from tidegate.operators.match import match
    from tidegate.sources import transactions as tx

    df = spark.createDataFrame(cases, CASE)
    hits = match(tx.explode_values(tx.transactions(df)), plan)
    fired = hits.groupBy("tx_id").agg(F.collect_set("rule_id").alias("fired"))
    blocked = decide.decide(hits).select("tx_id", (F.col("verdict") == "block").alias("blocked"))
    rows = df.join(fired, "tx_id", "left").join(blocked, "tx_id", "left")
    rows = rows.withColumns({"fired": F.coalesce("fired", F.array().cast("array<bigint>")), "blocked": F.coalesce("blocked", F.lit(False)), "mode": F.lit(mode)})
    return analytics.conformance(rows).select("tx_id", "name", "expects_block", "blocked", "fired", "outcome")
