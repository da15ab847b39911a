"""Queries: values of transactions, gates, bodies, rules, decisions, schema, analytics, imports and streams."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import validators as vd
from tidegate.functions.text import lowercase, to_bytes
from tidegate.operators import analytics, decide, fuel, schema
from tidegate.operators.match import literal_hits, match
from tidegate.operators.predicates import gate
from tidegate.plans import api_import, core_rules, model, seclang
from tidegate.plans.model import Action, Op, Rule, Target
from tidegate.session import scratch_folder, spread, table
from tidegate.sources import bodies, transactions as tx
from tidegate.suites.common import LOW, URLS, document_values, event_transactions, page_transactions, query

PAIRS = """p AS (SELECT page_id, k, CASE WHEN contains(pair, '=') THEN substr(pair, 1, strpos(pair, '=') - 1) ELSE pair END AS name, CASE WHEN contains(pair, '=') THEN substr(pair, strpos(pair, '=') + 1) ELSE '' END AS value
FROM (SELECT page_id, unnest(parts) AS pair, unnest(range(len(parts))) AS k FROM (SELECT page_id, list_filter(string_split_regex(CASE WHEN contains(target, '?') THEN substr(target, strpos(target, '?') + 1) ELSE '' END, '[&;]'), lambda x: x <> '') AS parts FROM u)))"""


# ---------------------------------------------------------------- values and gates
@query(f"WITH {URLS} SELECT page_id AS tx_id, target, split_part(target, '?', 1) AS path FROM u")
def explode_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tx.explode_values(page_transactions(spark, sf_dir), bodies=False).filter("target = 'REQUEST_URI'")
    return v.select("tx_id", F.col("data").alias("target"), "path")


@query(f"WITH {URLS}, {PAIRS} SELECT page_id AS tx_id, name AS key, value AS data, (4 + 2 * k)::INT AS value_seq FROM p")
def explode_query_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tx.explode_values(page_transactions(spark, sf_dir), bodies=False).filter("target = 'ARGS'")
    return v.select("tx_id", "key", "data", "value_seq")


@query(f"WITH {URLS}, {PAIRS} SELECT name, count(*) AS n FROM p GROUP BY name")
def arg_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tx.explode_values(page_transactions(spark, sf_dir), bodies=False).filter("target = 'ARGS_NAMES'")
    return v.groupBy(F.col("data").alias("name")).agg(F.count("*").alias("n"))


def _headers(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in pairs])


@query("SELECT event_id AS tx_id, CASE event_id % 5 WHEN 0 THEN 'content-length is not a number' WHEN 1 THEN 'content-length differs' WHEN 2 THEN 'transfer-encoding has white space around it' WHEN 3 THEN 'content-length and transfer-encoding' END AS detail FROM events WHERE event_id % 5 < 4")
def header_gate_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cl, te = "Content-Length", "Transfer-Encoding"
    kinds = [_headers((cl, "1x")), _headers((cl, "1"), (cl.lower(), "2")), _headers((te, " chunked")), _headers((cl, "5"), (te, "chunked")), _headers((cl, "5"), (cl, "5"))]
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.get(F.array(*kinds), (F.col("event_id") % 5).cast("int")).alias("headers"))
    return tx.gates(tx.transactions(e)).select("tx_id", "detail")


@query("SELECT doc_id AS tx_id, 'limit_exceeded' AS reason FROM documents WHERE strlen(text) * 300 > 1048576")
def limit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tx_id"), F.lit("POST").alias("method"), F.encode(F.repeat("text", 300), "UTF-8").alias("body"))
    return tx.gates(tx.transactions(d)).select("tx_id", "reason")


@query(r"""SELECT page_id, least(len(r), 256)::BIGINT AS runs, strlen(r[least(len(r), 256)])::INT AS last FROM (SELECT page_id, regexp_extract_all(html, '[ -~]{8,}') AS r FROM pages) WHERE len(r) > 0""")
def printable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind a NUL byte are binary bodies, of which the printable runs are kept (up to the format's limit of 256)."""
    body = F.concat(F.unhex(F.lit("00")), F.encode("html", "UTF-8"))
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    b = p.select("page_id", bodies.body_entries(body, F.lit("application/octet-stream"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True)).alias("b"))
    runs = F.filter("b.entries", lambda e: e["target"] == "REQUEST_BODY")
    return b.select("page_id", F.size(runs).cast("bigint").alias("runs"), F.length(F.try_element_at(runs, F.lit(-1))["data"]).alias("last")).filter("runs > 0")


@query(r"""SELECT page_id AS tx_id, target, key, data FROM (SELECT page_id, 'REMOTE_ADDR' AS target, '' AS key, '198.51.100.' || page_id % 256 AS data FROM pages UNION ALL SELECT page_id, 'REQUEST_HEADERS', 'Referer', url FROM pages UNION ALL SELECT page_id, 'REQUEST_HEADER_NAMES', '', 'Referer' FROM pages UNION ALL SELECT page_id, 'RESPONSE_STATUS', '', (200 + page_id % 3)::VARCHAR FROM pages UNION ALL SELECT page_id, 'RESPONSE_HEADERS', 'Content-Location', url FROM pages UNION ALL SELECT page_id, 'RESPONSE_HEADER_NAMES', '', 'Content-Location' FROM pages)""")
def explode_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, remote address, status and response headers come back as values."""
    one = lambda n: F.array(F.struct(F.lit(n).alias("name"), F.col("url").alias("value")))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("tx_id"), F.concat(F.lit("198.51.100."), F.col("page_id") % 256).alias("remote_addr"), one("Referer").alias("headers"), (200 + F.col("page_id") % 3).cast("int").alias("response_status"), one("Content-Location").alias("response_headers"))
    v = tx.explode_values(tx.transactions(p), bodies=False)
    return v.filter(F.col("target").isin("REMOTE_ADDR", "REQUEST_HEADERS", "REQUEST_HEADER_NAMES", "RESPONSE_STATUS", "RESPONSE_HEADERS", "RESPONSE_HEADER_NAMES")).select("tx_id", "target", "key", "data")


@query("SELECT event_id AS tx_id, target, key, data FROM (SELECT event_id, 'ARGS' AS target, 'u.id' AS key, user_id::VARCHAR AS data FROM events UNION ALL SELECT event_id, 'ARGS', 'u.tags[0]', event_type FROM events UNION ALL SELECT event_id, 'ARGS', 'u.tags[1].n', json_extract_string(props, '$.k') FROM events)")
def json_flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested object with a list: paths of keys and indexes."""
    body = F.concat(F.lit('{"u":{"id":'), F.col("user_id"), F.lit(',"tags":["'), F.col("event_type"), F.lit('",{"n":'), F.get_json_object("props", "$.k"), F.lit("}]}}"))
    found = _bodies(spark, sf_dir, F.encode(body, "UTF-8"), "application/json")
    return found.filter("target = 'ARGS'").select(F.col("event_id").alias("tx_id"), "target", "key", "data")


@query("SELECT event_id AS tx_id, 'ARGS' AS target, 'k' AS key, json_extract_string(props, '$.k') AS data FROM events UNION ALL SELECT event_id, 'ARGS_NAMES', '', 'k' FROM events")
def json_flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tx.explode_values(event_transactions(spark, sf_dir))
    return v.filter("arrived = 2").select("tx_id", "target", "key", "data")


def _bodies(spark, sf_dir, body, kind: str, coding=None) -> DataFrame:
    """Entries of one body for each event."""
    e = spread(table(spark, sf_dir, "events")).select("event_id", bodies.body_entries(body, F.lit(kind), F.lit(coding).cast("string"), F.lit(None).cast("string"), F.lit(True)).alias("b"))
    return e.select("event_id", F.inline("b.entries"))


@query("SELECT event_id, 'ARGS' AS target, 'type' AS key, event_type AS data FROM events UNION ALL SELECT event_id, 'ARGS', 'p', props FROM events UNION ALL SELECT event_id, 'ARGS_NAMES', '', n FROM events, (VALUES ('type'), ('p')) t(n)")
def form_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode(F.concat(F.lit("type="), F.url_encode("event_type"), F.lit("&&p="), F.url_encode("props")), "UTF-8")
    return _bodies(spark, sf_dir, body, "application/x-www-form-urlencoded").select("event_id", "target", "key", "data")


@query("SELECT event_id, 'ARGS' AS target, 'f' AS key, props AS data FROM events UNION ALL SELECT event_id, 'ARGS', 'f.filename', event_type FROM events UNION ALL SELECT event_id, 'FILES_NAMES', 'f.filename', event_type FROM events UNION ALL SELECT event_id, 'ARGS_NAMES', '', 'f' FROM events")
def multipart_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('--XX\r\nContent-Disposition: form-data; name="f"; filename="'), F.col("event_type"), F.lit('"\r\n\r\n'), F.col("props"), F.lit("\r\n--XX--\r\n"))
    return _bodies(spark, sf_dir, F.encode(body, "UTF-8"), "multipart/form-data; boundary=XX").select("event_id", "target", "key", "data")


@query("SELECT event_id, data FROM events, LATERAL (VALUES (to_base64(encode(props))), (props)) t(data)")
def base64_decode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base64 body is there as it is and decoded."""
    body = F.encode(F.base64(F.encode("props", "UTF-8")), "UTF-8")
    return _bodies(spark, sf_dir, body, "text/plain").select("event_id", "data")


@query("SELECT event_id, event_type AS data FROM events")
def grpc_unframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gRPC frame with one string field."""
    n = F.octet_length(F.col("event_type"))
    frame = F.concat(F.unhex(F.concat(F.lit("00"), F.lpad(F.hex((n + 2).cast("bigint")), 8, "0"), F.lit("0A"), F.lpad(F.hex(n.cast("bigint")), 2, "0"))), F.encode("event_type", "UTF-8"))
    return _bodies(spark, sf_dir, frame, "application/grpc").select("event_id", "data")


@query("SELECT event_id, '1.2' AS key, event_type AS data FROM events")
def protobuf_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string in a message in a message."""
    n = F.octet_length(F.col("event_type"))
    one = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    inner = F.concat(F.lit("12"), one(n), F.hex(F.encode("event_type", "UTF-8")))
    frame = F.concat(F.lit("00"), F.lpad(F.hex((n + 4).cast("bigint")), 8, "0"), F.lit("0A"), one(n + 2), inner)
    return _bodies(spark, sf_dir, F.unhex(frame), "application/grpc").filter("key = '1.2'").select("event_id", "key", "data")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS data FROM events")
def gzip_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' bodies, packed by gzip."""
    import gzip

    @F.arrow_udf("binary")
    def packed(body: pa.Array) -> pa.Array:
        return pa.array([None if b is None else gzip.compress(b, mtime=0) for b in body.to_pylist()], pa.binary())

    found = _bodies(spark, sf_dir, packed(F.encode("props", "UTF-8")), "application/json", "gzip")
    return found.filter("target = 'ARGS'").select("event_id", "key", "data")


# ---------------------------------------------------------------- rules
DOC_RULES = {1: ("password", "passwd"), 2: ("secret",), 3: ("akia",), 4: ("license", "copyright"), 5: ("worthless", "@example")}


def _literal_plan(score: bool = False) -> model.Plan:
    action = (Action("score") if score else Action("block"),)
    severity = {1: "critical", 2: "error", 3: "critical", 4: "notice", 5: "warning"}
    rules = [Rule(i, 1, (Target("ARGS"),), Op("contains_any", w), ("lowercase",), action, severity[i]) for i, w in DOC_RULES.items()]
    return model.compile_rules(rules)


def _literal_hits_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS rule_id FROM documents WHERE {' OR '.join(f'contains({LOW}, {chr(39)}{w}{chr(39)})' for w in ws)}" for i, ws in DOC_RULES.items())


HITS = f"hits AS ({_literal_hits_sql()})"


@query(f"WITH {HITS} SELECT rule_id, count(*) AS hits, count(DISTINCT doc_id) AS requests FROM hits GROUP BY rule_id")
def literal_rules_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match(document_values(spark, sf_dir), _literal_plan(), fork=False)
    return hits.groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("tx_id").alias("requests"))


@query(f"WITH {HITS} SELECT doc_id, rule_id FROM hits")
def many_literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy for very many literals, with a thousand that never occur."""
    literals = [(i, w) for i, ws in DOC_RULES.items() for w in ws]
    lit = spark.createDataFrame(literals, "rule_id bigint, literal string").unionByName(spark.range(1000, 2000).select(F.col("id").alias("rule_id"), F.format_string("synthetic_attack_token_%06d", "id").alias("literal")))
    return literal_hits(document_values(spark, sf_dir), lit).select(F.col("tx_id").alias("doc_id"), "rule_id")


@query()
def core_rules_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = model.compile_rules(core_rules.default_rules())
    return match(document_values(spark, sf_dir), plan).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("tx_id").alias("requests"))


def _posted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of requests that post a page's html as an argument, and get the page."""
    p = spread(table(spark, sf_dir, "pages")).filter("html IS NOT NULL")
    named = F.array(F.struct(F.lit("html").alias("name"), to_bytes(F.col("html")).alias("value")))
    t = tx.transactions(p.select(F.col("page_id").alias("tx_id"), to_bytes(tx.url_target(F.col("url"))).alias("target"), named.alias("args"), F.lit(200).alias("response_status"), F.encode("html", "UTF-8").alias("response_body")))
    return tx.explode_values(t, bodies=False)


@query("SELECT rule_id, count(*) AS requests FROM pages, (VALUES (1003::BIGINT), (1006)) t(rule_id) WHERE html IS NOT NULL AND page_id % 2 = rule_id % 2 GROUP BY rule_id")
def core_rules_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All core rules on the pages' hosts as paths: odd ones ask for a system file, even ones for a repository."""
    p = spread(table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", "url"))
    where = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("/en/"), F.col("page_id"), F.lit("?f=/etc/passwd"))).otherwise(F.concat(F.lit("/en/"), F.col("page_id"), F.lit("/.git/HEAD")))
    t = tx.transactions(p.select(F.col("page_id").alias("tx_id"), where.alias("target")))
    hits = match(tx.explode_values(t, bodies=False), model.compile_rules(core_rules.default_rules()))
    return hits.groupBy("rule_id").agg(F.countDistinct("tx_id").alias("requests"))


@query()
def core_rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = model.compile_rules(core_rules.default_rules())
    return match(_posted_pages(spark, sf_dir), plan).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("tx_id").alias("requests"))


@query("SELECT 'block' AS verdict, 'rule' AS reason, count(*) AS n FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'allow', 'no_match', count(*) FROM events WHERE event_id % 4 <> 0")
def core_rules_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which every fourth carries an attack, through the core rules to decisions for all."""
    e = spread(table(spark, sf_dir, "events").select("event_id"))
    attack = F.get(F.array(*[F.lit(x) for x in ("/?q=%3Cscript%3Ealert(1)%3C/script%3E", "/?q=1%27%20or%20%271%27=%271", "/..%252f..%252fetc/passwd", "/?u[$ne]=1", "/?x=;cat%20/etc/passwd", "/.git/config")]), (F.col("event_id") / 4 % 6).cast("int"))
    t = tx.transactions(e.select(F.col("event_id").alias("tx_id"), F.when(F.col("event_id") % 4 == 0, attack).otherwise(F.concat(F.lit("/items?id="), F.col("event_id"))).alias("target")))
    hits = match(tx.explode_values(t, bodies=False), model.compile_rules(core_rules.default_rules()))
    return decide.all_decisions(t, decide.decide(hits)).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


@query("SELECT phase, n FROM (VALUES (1, 38::BIGINT), (2, 33::BIGINT), (3, 3::BIGINT), (4, 4::BIGINT)) t(phase, n)")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.rules_frame(spark, core_rules.default_rules()).groupBy("phase").agg(F.count("*").alias("n"))


@query("SELECT rule_id, derived_from, rule_id - derived_from AS apart FROM (SELECT (range + 900)::BIGINT AS rule_id, range::BIGINT AS derived_from FROM range(1, 20000)) WHERE derived_from IN (1001,1003,1004,1005,1009,2010,3010,3011,4003,4004,4005,4006,4007,4008,4009,4010,4011,4012,4013,4014,4015,4016,4017,7001,7002,8001,9001,11001,11002,12001,13001,14001)")
def body_mirror_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrors as rows derived from the table of authored rules."""
    r = model.rules_frame(spark, core_rules.authored())
    reads = F.exists("targets", lambda t: (t["name"] == "") & t["kind"].isin("ARGS", "ARGS_NAMES"))
    m = r.filter((F.col("phase") == 1) & reads).select((F.col("rule_id") + 900).alias("rule_id"), F.col("rule_id").alias("derived_from"))
    return m.withColumn("apart", F.col("rule_id") - F.col("derived_from"))


@query()
def compile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = model.compile_report(model.compile_rules(core_rules.default_rules()))
    return spark.createDataFrame([(r["rules"], r["prefiltered"], len(r["unconditional"]), r["literals"], r["states"], r["chain_groups"])], "rules int, prefiltered int, unconditional int, literals int, states int, chain_groups int")


@query("SELECT confidence, n FROM (VALUES ('certain', 53::BIGINT), ('high', 25::BIGINT)) t(confidence, n)")
def confidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*core_rules.default_rules(), core_rules.loopback_ssrf(1_000_001)]
    return model.rules_frame(spark, model.select_by_confidence(rules, "high")).groupBy("confidence").agg(F.count("*").alias("n"))


@query("SELECT rule_id, count(*) AS n FROM events, (VALUES (1000001::BIGINT), (1000002), (1000003)) t(rule_id) WHERE event_id % 3 = rule_id - 1000001 GROUP BY rule_id")
def opt_in_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in rules on requests made for each."""
    rules = [core_rules.loopback_ssrf(1_000_001), core_rules.crlf_header(1_000_002), core_rules.wordpress_hardening(1_000_003), core_rules.graphql_introspection(1_000_004)]
    targets = F.array(F.lit("/?u=http://localhost/x"), F.lit("/?u=x%0d%0aSet-Cookie:%20a=1"), F.lit("/wp-content/plugins/x.php"))
    t = tx.transactions(table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.get(targets, (F.col("event_id") % 3).cast("int")).alias("target")))
    hits = match(tx.explode_values(t, bodies=False), model.compile_rules(rules, "heuristic"))
    return hits.select("tx_id", "rule_id").distinct().groupBy("rule_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- decisions
@query(f"WITH {HITS} SELECT doc_id AS tx_id, min(rule_id) AS rule_id, 'block' AS verdict, 'rule' AS reason FROM hits GROUP BY doc_id")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match(document_values(spark, sf_dir), _literal_plan(), fork=False)
    return decide.decide(hits).select("tx_id", "rule_id", "verdict", "reason")


_SCORES = "s AS (SELECT doc_id, sum(CASE rule_id WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE 3 END)::BIGINT AS score, arg_max(rule_id, (CASE rule_id WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE 3 END) * 100 - rule_id) AS worst FROM hits GROUP BY doc_id)"


@query(f"WITH {HITS}, {_SCORES} SELECT doc_id AS tx_id, score, CASE WHEN score >= 5 THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN score >= 5 THEN worst ELSE 0 END AS rule_id FROM s")
def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match(document_values(spark, sf_dir), _literal_plan(score=True), fork=False)
    return decide.decide(hits).select("tx_id", "score", "verdict", "rule_id")


@query(f"WITH {HITS} SELECT doc_id AS tx_id, rule_id FROM hits WHERE rule_id <> 4 AND NOT (rule_id = 5 AND doc_id % 2 = 0)")
def exceptions_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match(document_values(spark, sf_dir), _literal_plan(), fork=False).withColumn("path", F.concat(F.lit("/doc/"), F.when(F.col("tx_id") % 2 == 0, "even/x").otherwise("odd")))
    ex = spark.createDataFrame([(4, None, None, None, "licences are fine"), (5, "/doc/even/*", "ARGS", "q", "narrow"), (None, None, None, None, "empty: refused")], decide.EXCEPTION_SCHEMA)
    return decide.without_exceptions(hits, ex).select("tx_id", "rule_id")


@query(f"WITH {HITS} SELECT doc_id AS tx_id, rule_id, '/d' AS path, 'ARGS' AS target, 'q' AS key FROM hits")
def narrowest_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match(document_values(spark, sf_dir), _literal_plan(), fork=False).withColumn("path", F.lit("/d"))
    return decide.narrowest_exception(hits).select("tx_id", "exception.*")


@query("SELECT reason, verdict, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'framing_ambiguous' WHEN 1 THEN 'limit_exceeded' WHEN 2 THEN 'rule' ELSE 'no_match' END AS reason, CASE event_id % 4 WHEN 3 THEN 'allow' ELSE 'block' END AS verdict FROM events) GROUP BY ALL")
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(_headers(("Content-Length", "x")), F.array_repeat(F.struct(F.lit("a").alias("name"), F.lit("b").alias("value")), 201), _headers(("User-Agent", "sqlmap/1.0")), _headers(("User-Agent", "x")))
    t = tx.transactions(table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.get(heads, (F.col("event_id") % 4).cast("int")).alias("headers")))
    rules = [r for r in core_rules.authored() if r.id == 5001]
    hits = match(tx.explode_values(t, bodies=False), model.compile_rules(rules), fork=False)
    return decide.all_decisions(t, decide.decide(hits), tx.gates(t)).groupBy("reason", "verdict").agg(F.count("*").alias("n"))


@query("SELECT doc_id, turn, sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY turn)::BIGINT AS fuel_spent, sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY turn) > 2000 AS exhausted FROM (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS text FROM conversations)")
def fuel_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("cost"))
    return fuel.spent(c, ("doc_id",), ("turn",), limit=2000).select("doc_id", "turn", "fuel_spent", "exhausted")


_TOLD = 1500
_FUEL = f"""c AS (SELECT conv_id, turn, {LOW} AS low, strlen({LOW}) AS n, text <> {LOW} AS changed FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
k AS (SELECT *, contains(low, 'einheit') AS hit, n + n + CASE WHEN changed THEN 2 * n ELSE 0 END + CASE WHEN contains(low, 'einheit') THEN 12 ELSE 0 END AS cost FROM c),
m AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) > {_TOLD} AS exhausted FROM k)"""


@query(f"WITH {_FUEL} SELECT conv_id AS tx_id, CASE WHEN bool_or(hit AND NOT exhausted) THEN 'rule' WHEN bool_or(exhausted) THEN 'budget_exhausted' ELSE 'no_match' END AS reason, CASE WHEN bool_or(hit AND NOT exhausted) OR bool_or(exhausted) THEN 'block' ELSE 'allow' END AS verdict FROM m GROUP BY conv_id")
def fuel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transactions whose turns are values: work is metered, and what comes after the fuel ran out decides nothing."""
    c = spread(table(spark, sf_dir, "conversations"))
    v = c.select(F.col("conv_id").alias("tx_id"), F.col("turn").alias("value_seq"), F.lit(1).alias("arrived"), F.lit("ARGS").alias("target"), F.lit("q").alias("key"), to_bytes(F.coalesce("text", F.lit(""))).alias("data"), F.lit(False).alias("inert"))
    plan = model.compile_rules([Rule(1, 1, (Target("ARGS"),), Op("contains", ("einheit",)), ("lowercase",), (Action("block"),), "critical")])
    used = fuel.spent(fuel.metered(v, plan, fork=False), order=("value_seq", "reading_ord"), limit=_TOLD)
    found = fuel.within(match(v, plan, fork=False), used)
    d = decide.all_decisions(c.select(F.col("conv_id").alias("tx_id")).distinct(), decide.decide(found), fuel.gates(used))
    return d.select("tx_id", "reason", "verdict")


@query()
def explain_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = model.compile_rules(core_rules.default_rules())
    hits = match(_posted_pages(spark, sf_dir), plan)
    return decide.explain(hits, model.rules_frame(spark, plan.rules)).select("tx_id", "rule_id", "msg", "chain", "operator", "matched", "off", "len", "severity_name", "confidence_name", "interpretation")


# ---------------------------------------------------------------- schema
def _checked(name: str, sql: str, make) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir)

    run.__name__ = f"validate_{name}"
    query(sql)(run)


def _count(df: DataFrame, value, **how) -> DataFrame:
    return df.groupBy(F.coalesce(vd.violation(value, **how), F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


_checked("integer", "SELECT CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'ok' ELSE 'wrong_type' END AS outcome, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_orderkey AS VARCHAR) WHEN l_orderkey % 3 = 1 THEN '-' || l_orderkey ELSE l_returnflag END AS v FROM lineitem) GROUP BY 1", lambda s, d: _count(table(s, d, "lineitem"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_orderkey").cast("string")).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("-"), "l_orderkey")).otherwise(F.col("l_returnflag")), kind="integer"))
_checked("number", "SELECT CASE WHEN l_orderkey % 4 = 3 THEN 'wrong_type' ELSE 'ok' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1", lambda s, d: _count(table(s, d, "lineitem"), F.get(F.array(F.concat("l_orderkey", F.lit(".5")), F.concat("l_orderkey", F.lit("e+3")), F.concat(F.lit("-."), "l_partkey"), F.concat("l_orderkey", F.lit("e"))), (F.col("l_orderkey") % 4).cast("int")), kind="number"))
_checked("boolean", "SELECT CASE WHEN o_custkey % 3 = 2 THEN 'wrong_type' ELSE 'ok' END AS outcome, count(*) AS n FROM orders GROUP BY 1", lambda s, d: _count(table(s, d, "orders"), F.get(F.array(F.lit("true"), F.lit("0"), F.lit("tRUE")), (F.col("o_custkey") % 3).cast("int")), kind="boolean"))
_checked("enum", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ok' ELSE 'not_in_enum' END AS outcome, count(*) AS n FROM customer GROUP BY 1", lambda s, d: _count(table(s, d, "customer"), F.col("c_mktsegment"), kind="enum", enum=F.array(F.lit("BUILDING"), F.lit("MACHINERY"))))
_checked("uuid", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'bad_format' END AS outcome, count(*) AS n FROM documents GROUP BY 1", lambda s, d: _count(table(s, d, "documents"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lpad(F.hex("doc_id"), 8, "0"), F.lit("-0000-4a00-8000-0123456789aB"))).otherwise(F.hex("doc_id")), kind="string", fmt="uuid"))
_checked("date", "SELECT 'ok' AS outcome, count(*) AS n FROM lineitem", lambda s, d: _count(table(s, d, "lineitem"), F.date_format("l_shipdate", "yyyy-MM-dd"), kind="string", fmt="date"))
_checked("datetime", "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'bad_format' ELSE 'ok' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1", lambda s, d: _count(table(s, d, "lineitem"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("Z")), kind="string", fmt="date-time"))
_checked("email", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'bad_format' END AS outcome, count(*) AS n FROM customer GROUP BY 1", lambda s, d: _count(table(s, d, "customer"), F.concat(F.lit("c"), "c_custkey", F.get(F.array(F.lit("@example.com"), F.lit("@@x.com"), F.lit("@.com")), (F.col("c_custkey") % 3).cast("int"))), kind="string", fmt="email"))
_checked("hex", "SELECT 'ok' AS outcome, count(*) AS n FROM documents", lambda s, d: _count(table(s, d, "documents"), F.md5(F.col("doc_id").cast("string")), kind="string", fmt="hex"))
_checked("base64", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'bad_format' END AS outcome, count(*) AS n FROM documents GROUP BY 1", lambda s, d: _count(table(s, d, "documents"), F.concat(F.when(F.col("doc_id") % 2 == 0, "").otherwise("=a"), F.base64(F.md5(F.col("doc_id").cast("string")).cast("binary"))), kind="string", fmt="base64"))
_checked("ipv4", "SELECT CASE WHEN event_id % 300 <= 255 THEN 'ok' ELSE 'bad_format' END AS outcome, count(*) AS n FROM events GROUP BY 1", lambda s, d: _count(table(s, d, "events"), F.concat(F.lit("10.0.3."), F.col("event_id") % 300), kind="string", fmt="ipv4"))
_checked("range", "SELECT CASE WHEN l_quantity BETWEEN 10 AND 30 THEN 'ok' ELSE 'out_of_range' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1", lambda s, d: _count(table(s, d, "lineitem"), F.col("l_quantity").cast("int").cast("string"), kind="integer", low=F.lit(10.0), high=F.lit(30.0)))
_checked("length", "SELECT CASE WHEN length(p_name) > 20 THEN 'too_long' ELSE 'ok' END AS outcome, count(*) AS n FROM part GROUP BY 1", lambda s, d: _count(table(s, d, "part"), F.col("p_name"), kind="string", max_length=F.lit(20)))

_OPS = [
    schema.Operation("GET", "/orders/{id}", query=[schema.Field("n", "integer", required=True, max=500.0), schema.Field("c", "enum", enum=("a", "b"))], strict=True),
    schema.Operation("", "/health"),
    schema.Operation("GET", "/static/*"),
]


def _api(spark, sf_dir) -> DataFrame:
    """Requests to the API of _OPS, one for each order."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    k = F.col("o_orderkey")
    target = F.when(k % 4 == 0, F.concat(F.lit("/orders/"), k, F.lit("?n="), F.col("o_custkey"))).when(k % 4 == 1, F.lit("/health")).when(k % 4 == 2, F.lit("/static/a/b.css?x=1")).otherwise(F.lit("/orders/1?c=z&zz=1"))
    return tx.transactions(o.select(k.alias("tx_id"), target.alias("target"))).withColumn("path", tx.path_of(F.col("target")))


@query("SELECT o_orderkey AS tx_id, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS op_ord FROM orders")
def route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.routes(_api(spark, sf_dir), _OPS).select("tx_id", "op_ord")


@query(f"WITH {URLS} SELECT page_id AS tx_id FROM u WHERE NOT starts_with(target, '/en/')")
def undeclared_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_transactions(spark, sf_dir).withColumn("path", tx.path_of(F.col("target")))
    return schema.undeclared(schema.routes(t, [schema.Operation("GET", "/en/*")])).select("tx_id")


@query("SELECT o_orderkey AS tx_id, 'n' AS name FROM orders WHERE o_orderkey % 4 = 3")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = schema.routed_rows(_api(spark, sf_dir), _OPS)
    return schema.missing_in_rows(tx.with_values(t, ("tx_id", "op_ord"), bodies=False), _OPS).select("tx_id", "name")


@query("SELECT o_orderkey AS tx_id, CASE WHEN o_orderkey % 4 = 3 THEN 'c' ELSE 'n' END AS key, CASE WHEN o_orderkey % 4 = 3 THEN 'not_in_enum' ELSE 'out_of_range' END AS violation FROM orders WHERE o_orderkey % 4 = 3 OR (o_orderkey % 4 = 0 AND o_custkey > 500)")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = schema.routed_rows(_api(spark, sf_dir), _OPS), schema.fields_frame(spark, _OPS)
    checked = schema.validated(tx.explode_values(t, ("tx_id", "op_ord"), bodies=False), None, f)
    return schema.violations(checked).select("tx_id", "key", "violation")


@query("SELECT count(*) AS inert FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey <= 500")
def inert_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = schema.routed_rows(_api(spark, sf_dir), _OPS), schema.fields_frame(spark, _OPS)
    checked = schema.validated(tx.explode_values(t, ("tx_id", "op_ord"), bodies=False), None, f)
    return checked.filter("inert").agg(F.count("*").alias("inert"))


OPENAPI = """
openapi: 3.0.0
paths:
  /orders/{id}:
    parameters: [{in: path, name: id, schema: {type: integer}}, {in: query, name: n, required: true, schema: {type: integer}}]
    get: {parameters: [{in: query, name: when, schema: {type: string, format: date-time}}]}
    post:
      requestBody: {content: {application/json: {schema: {$ref: '#/components/schemas/Order'}}}}
components:
  schemas:
    Base: {properties: {id: {type: string, format: uuid}}, required: [id]}
    Order: {allOf: [{$ref: '#/components/schemas/Base'}, {properties: {state: {enum: [open, done]}, note: {type: string, maxLength: 9, pattern: x}}}]}
"""


@query("SELECT method, field_loc, name, kind, required FROM (VALUES ('GET', 'query', 'n', 'integer', true), ('GET', 'query', 'when', 'string', false), ('POST', 'query', 'n', 'integer', true), ('POST', 'body', 'id', 'string', true), ('POST', 'body', 'state', 'enum', false), ('POST', 'body', 'note', 'string', false)) t(method, field_loc, name, kind, required)")
def openapi_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, _ = api_import.openapi(OPENAPI)
    return schema.fields_frame(spark, ops).filter("name IS NOT NULL").select("method", "field_loc", "name", "kind", "required")


@query("SELECT path, name, kind FROM (VALUES ('/shop.Orders/Get', '1', 'string'), ('/shop.Orders/Get', '2.1', 'integer')) t(path, name, kind)")
def grpc_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [{"package": "shop", "messages": {"Req": [(1, 9, None), (2, 11, ".shop.Sub")], "Sub": [(1, 5, None)]}, "services": {"Orders": {"Get": ".shop.Req"}}}]
    return schema.fields_frame(spark, api_import.grpc_services(files)).filter("name IS NOT NULL").select("path", "name", "kind")


# ---------------------------------------------------------------- analytics
def _decisions(spark, sf_dir) -> DataFrame:
    """A decision for each event, by its type and value."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    return e.select(
        F.col("event_id").alias("tx_id"), "ts", "user_id", F.when(m < 3, "block").otherwise("allow").alias("verdict"), F.when(m < 2, "rule").when(m == 2, "limit_exceeded").when(m == 3, "budget_exhausted").otherwise("no_match").alias("reason"),
        (m == 4).alias("undeclared"), F.when(m < 2, 1000 + F.col("event_id") % 7).otherwise(0).cast("bigint").alias("rule_id"), F.when(m < 2, (F.col("event_id") % 4).cast("int")).alias("severity"), (F.col("event_id") * 3).alias("ns"),
    )


_DECISIONS = "d AS (SELECT event_id AS tx_id, ts, user_id, event_id % 10 AS m, CASE WHEN event_id % 10 < 2 THEN 1000 + event_id % 7 ELSE 0 END AS rule_id, (event_id % 4)::INT AS severity, event_id * 3 AS ns FROM events)"
_COUNTS = "count(*) AS requests, count(*) FILTER (m < 3) AS blocked, count(*) FILTER (m >= 3) AS allowed, count(*) FILTER (m = 3) AS exhausted, count(*) FILTER (m = 2) AS errors, count(*) FILTER (m = 4) AS undeclared"


@query(f"WITH {_DECISIONS} SELECT {_COUNTS}, (sum(ns) // count(*))::BIGINT AS mean_ns, max(ns)::BIGINT AS max_ns FROM d")
def telemetry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.snapshot(_decisions(spark, sf_dir), latency="ns")


@query(f"WITH {_DECISIONS} SELECT round(count(*) FILTER (m < 3) / count(*), 6) AS block_rate FROM d")
def block_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.block_rate(analytics.snapshot(_decisions(spark, sf_dir))).select(F.round("block_rate", 6).alias("block_rate"))


@query(f"WITH {_DECISIONS} SELECT rule_id, count(*) AS n FROM d WHERE rule_id <> 0 GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 3")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_rules(_decisions(spark, sf_dir), 3)


@query(f"WITH {_DECISIONS} SELECT ['notice', 'warning', 'error', 'critical'][severity + 1] AS severity, count(*) AS n FROM d WHERE rule_id <> 0 GROUP BY 1")
def by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.by_severity(_decisions(spark, sf_dir))


def _calibrated(spark, sf_dir, mode: str) -> DataFrame:
    """Literal rules on the documents labelled clean."""
    clean = table(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("tx_id")).distinct()
    v = document_values(spark, sf_dir).join(clean, "tx_id", "left_semi")
    hits = match(v, _literal_plan(), fork=False)
    n = clean.count()
    return analytics.calibrate(hits, model.rules_frame(spark, _literal_plan().rules), n, mode=mode).select("rule_id", "hits", F.round("measured", 9).alias("measured"), "passed", "suggested")


_TIER = "CASE WHEN measured <= 0.0001 THEN 'certain' WHEN measured <= 0.001 THEN 'high' WHEN measured <= 0.01 THEN 'medium' WHEN measured <= 0.05 THEN 'low' ELSE 'heuristic' END"
_CALIBRATION = f"WITH {HITS}, clean AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0), h AS (SELECT * FROM (SELECT %s FROM hits JOIN clean USING (doc_id) %s) GROUP BY ALL), c AS (SELECT r.rule_id, count(h.rule_id) AS hits, count(h.rule_id) / (SELECT count(*) FROM clean) AS measured FROM (VALUES (1::BIGINT), (2), (3), (4), (5)) r(rule_id) LEFT JOIN h ON h.rule_id = r.rule_id GROUP BY r.rule_id) SELECT rule_id, hits, round(measured, 9) AS measured, measured <= 0.001 AS passed, {_TIER} AS suggested FROM c"


@query(_CALIBRATION % ("doc_id, rule_id", ""))
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "all_hits")


@query(_CALIBRATION % ("doc_id, min(rule_id) AS rule_id", "GROUP BY doc_id"))
def calibration_first_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "first_terminal")


@query(f"SELECT l_orderkey % 1000 AS k, {_TIER.replace('measured', '((l_orderkey % 1000) / 10000.0)')} AS tier FROM lineitem GROUP BY ALL")
def suggested_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("k")).distinct()
    return k.select("k", analytics.suggested_tier(F.col("k") / 10000.0).alias("tier"))


@query("SELECT event_type AS class, technique, count(*) AS cases, sum((user_id % 3 = 0)::BIGINT)::BIGINT AS blocked FROM (SELECT event_type, 't' || (event_id % 4) AS technique, user_id FROM events) GROUP BY GROUPING SETS ((event_type), (technique), ())")
def corpus_by_class_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.concat(F.lit("t"), F.col("event_id") % 4).alias("technique"), (F.col("user_id") % 3 == 0).alias("blocked"))
    return analytics.corpus_report(e)


@query(f"WITH {HITS} SELECT doc_id AS tx_id, min(rule_id) AS rule_id, 'block' AS verdict, 403 AS status, 'q' AS except_key FROM hits GROUP BY doc_id")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.decide(match(document_values(spark, sf_dir), _literal_plan(), fork=False))
    return analytics.relevant(analytics.audit_records(d)).select("tx_id", "rule_id", "verdict", "status", F.col("suggested_exception.key").alias("except_key"))


@query(f"WITH {HITS} SELECT tx_id, rule_id FROM (SELECT doc_id AS tx_id, min(rule_id) AS rule_id FROM hits GROUP BY doc_id) WHERE rule_id IN (1, 2, 3, 5)")
def severity_filter_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.decide(match(document_values(spark, sf_dir), _literal_plan(), fork=False))
    return analytics.severity_at_least(analytics.audit_records(d), "warning").select("tx_id", "rule_id")


@query("SELECT mode, outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'detection' ELSE 'rule_id' END AS mode, CASE WHEN event_id % 11 = 0 THEN 'skip' WHEN event_id % 2 = 0 THEN CASE WHEN (event_id % 3 = 0) = (event_id % 5 = 0) THEN 'pass' ELSE 'fail' END ELSE CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 0 THEN 'pass' ELSE 'fail' END END AS outcome FROM events) GROUP BY ALL")
def conformance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    cases = table(spark, sf_dir, "events").select(
        F.when(k % 2 == 0, "detection").otherwise("rule_id").alias("mode"), (k % 11 == 0).alias("skipped"), (k % 3 == 0).alias("expects_block"), (k % 5 == 0).alias("blocked"),
        F.array(F.lit(1)).alias("expected"), F.array(F.lit(9)).alias("forbidden"), F.concat(F.when(k % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(2))), F.when(k % 7 == 0, F.array(F.lit(9))).otherwise(F.array(F.lit(3)))).alias("fired"),
    )
    return analytics.conformance(cases).groupBy("mode", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_DECISIONS} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, {_COUNTS} FROM d GROUP BY 1")
def events_windowed_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.streaming.streams import windowed_telemetry

    return windowed_telemetry(_decisions(spark, sf_dir), size="1 hour").drop("end")


# ---------------------------------------------------------------- side inputs and imports
@query("SELECT c_custkey AS tx_id, 'nation.' || n_nationkey AS key, n_name AS data FROM customer JOIN nation ON c_nationkey = n_nationkey")
def resolver_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tx_id"), "c_nationkey")
    side = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("k"), "n_name")
    return tx.resolved(c, side, "nation", "c_nationkey", "k", "n_name").select("tx_id", "key", "data")


@query("SELECT c_custkey AS tx_id, n_name AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(n_name, 'A')")
def resolver_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on a resolver's name covers all its keys."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tx_id"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("k"), "n_name")
    v = tx.resolved(c, n, "nation", "c_nationkey", "k", "n_name").withColumn("value_seq", F.lit(0))
    hits = match(v, model.compile_rules([Rule(1_000_000, 1, (Target("RESOLVED", "nation"),), Op("contains", ("A",)))]), fork=False)
    return hits.join(v.select("tx_id", "data"), "tx_id").select("tx_id", F.col("data").alias("matched"))


SECLANG = r"""
SecRule TX:PL "@lt 2" "id:900100,phase:1,pass,nolog,skipAfter:END"
SecMarker END
# a comment
SecRule ARGS|REQUEST_URI "@rx (?i)(password|passwd)\s*=" \
    "id:900001,phase:2,deny,t:lowercase,severity:'CRITICAL',msg:'secret',tag:'x'"
SecRule REQUEST_HEADERS:User-Agent "@pm sqlmap nikto" "id:900002,phase:1,block"
SecRule ARGS "@containsWord token" "id:900003,phase:2,pass"
SecRule ARGS "@ipMatch 1.2.3.4" "id:900004,phase:1,deny"
SecRule ARGS "!@streq a" "id:900005,phase:1,deny"
SecRule &ARGS "@gt 3" "id:900006,phase:1,deny"
SecRule ARGS "@rx a(?=b)" "id:900007,phase:1,deny"
SecRule ARGS "@contains x" "id:900008,phase:1,deny,chain"
SecRule ARGS "@contains y" "deny"
SecRule ARGS "@beginsWith the" "id:900009,phase:2,pass"
SecRule ARGS "@contains gone" "id:900010,phase:2,pass"
SecRuleRemoveById 900010-900020
SecAction "id:1,nolog"
"""


@query("SELECT outcome, count(*) AS n FROM (VALUES ('taken'), ('taken'), ('taken'), ('taken'), ('taken'), ('skipped'), ('skipped'), ('skipped'), ('skipped'), ('skipped'), ('skipped'), ('skipped')) t(outcome) GROUP BY outcome")
def seclang_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = seclang.parse(SECLANG)
    return seclang.report_frame(spark, report).groupBy("outcome").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id AS tx_id, rule_id FROM documents, (VALUES (900001::BIGINT), (900003), (900009)) t(rule_id) WHERE CASE rule_id WHEN 900001 THEN regexp_matches({LOW}, '(password|passwd)[ \t\n\f\r]*=') WHEN 900003 THEN regexp_matches(text, '(^|[^A-Za-z0-9_])token($|[^A-Za-z0-9_])') ELSE starts_with({LOW}, 'the') END")
def seclang_rules_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rules on documents as body arguments."""
    rules, _ = seclang.parse(SECLANG)
    plan = model.compile_rules([r for r in rules if r.phase == 2])
    v = document_values(spark, sf_dir).withColumn("arrived", F.lit(2))
    return match(v, plan, fork=False).select("tx_id", "rule_id").distinct()


@query(f"SELECT doc_id AS tx_id FROM documents WHERE contains({LOW}, 'license')")
def literal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = document_values(spark, sf_dir)
    return v.filter(gate(("License",), lowercase(F.col("data")))).select("tx_id")


# ---------------------------------------------------------------- streams
@query(f"WITH {HITS} SELECT doc_id AS tx_id, rule_id FROM hits")
def stream_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of literal rules on documents read as a stream."""
    from tidegate.streaming.streams import run_to_end

    path = f"{sf_dir}/documents.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    v = s.filter("text IS NOT NULL").select(F.col("doc_id").alias("tx_id"), F.lit(0).alias("value_seq"), F.lit(1).alias("arrived"), F.lit("ARGS").alias("target"), F.lit("q").alias("key"), to_bytes(F.col("text")).alias("data"), F.lit(False).alias("inert"))
    return run_to_end(match(v, _literal_plan(), fork=False).select("tx_id", "rule_id"), "stream_stateless_out")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the chunks of a body; every odd user's have gaps."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("user_id"))})
    return e.filter("n > 1").select(F.col("user_id").alias("tx_id"), (F.col("rn") * F.when(F.col("user_id") % 2 == 0, 1).otherwise(2)).cast("int").alias("seq"), (F.col("rn") == F.col("n") - 1).alias("last"), F.encode("props", "UTF-8").alias("data"), F.timestamp_seconds(F.lit(86_400) + F.col("rn")).alias("ts"))


@query("SELECT user_id AS tx_id, status, count(*) AS n FROM (SELECT user_id, CASE WHEN count(*) = max(seq) + 1 THEN 'ok' ELSE 'unfinished' END AS status FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS seq FROM events) GROUP BY user_id HAVING count(*) > 1) GROUP BY ALL")
def stream_chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of each user's events as chunks; every odd user's have gaps."""
    from tidegate.streaming.streams import assembled

    chunks = _chunks(spark, sf_dir)
    out = assembled(chunks, timeout="1 hour")
    return out.groupBy("tx_id", "status").agg(F.count("*").alias("n"))


@query("SELECT user_id AS tx_id, CASE WHEN user_id % 2 = 0 THEN 'ok' ELSE 'unfinished' END AS status, sum(strlen(props))::BIGINT AS bytes FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n > 1 GROUP BY user_id")
def stream_chunks_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks, shuffled into files and read as a stream with state; a chunk far in the future moves the watermark past all timeouts."""
    from tidegate.streaming.streams import CHUNK, assembled, run_to_end

    path = f"{scratch_folder(spark)}/chunks"
    _chunks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).repartition(8).write.parquet(path)
    spark.createDataFrame([(-1, 0, True, bytearray(b""), datetime.datetime(2100, 1, 1))], CHUNK).coalesce(1).write.mode("append").parquet(path)
    out = run_to_end(assembled(spark.readStream.schema(CHUNK).parquet(path), timeout="1 hour"), "stream_chunks_out")
    return out.filter("tx_id >= 0").select("tx_id", "status", F.octet_length("body").cast("bigint").alias("bytes"))


@query(f"WITH {_DECISIONS} SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS requests, count(*) FILTER (m < 3) AS blocked FROM d GROUP BY 1")
def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of events read as a stream, in windows of a day."""
    from tidegate.streaming.streams import run_to_end, windowed_telemetry

    path = f"{sf_dir}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    m = F.col("event_id") % 10
    d = s.select(F.col("ts").cast("timestamp").alias("ts"), F.when(m < 3, "block").otherwise("allow").alias("verdict"), F.lit("no_match").alias("reason"))
    return run_to_end(windowed_telemetry(d, size="1 day").select("start", "requests", "blocked"), "stream_windowed_out", "complete")
