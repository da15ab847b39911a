"""Queries: transforms, readings, plain operators, core predicates and expression detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import readings as rd
from tidegate.functions import text as tf
from tidegate.functions.detectors import PROMPT_BEFORE, PROMPT_DELIMITERS, PROMPT_PHRASES, PROMPT_WEIGHTS, detect
from tidegate.operators.predicates import named_predicate, regex, test_of
from tidegate.plans.model import Op
from tidegate.session import spread, table
from tidegate.sources import transactions as tx
from tidegate.suites.common import LOW, URLS, query


def docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text IS NOT NULL")


@query(f"SELECT doc_id, md5({LOW}) AS h FROM documents WHERE text IS NOT NULL")
def t_lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(tf.lowercase(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]', '', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def t_remove_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(tf.remove_whitespace(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def t_compress_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(tf.compress_whitespace(F.col("text"))).alias("h"))


@query("SELECT page_id, url_decode(replace(url_encode(url), '%20', '+')) AS decoded FROM pages")
def t_url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-encoded urls come back."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tf.from_bytes(tf.url_decode(tf.to_bytes(F.url_encode("url")))).alias("decoded"))


@query(f"WITH {URLS} SELECT page_id, split_part(target, '?', 1) AS path FROM u")
def t_normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with dots and doubled separators put in come back as they were."""
    t = table(spark, sf_dir, "pages").select("page_id", tx.path_of(tx.url_target(F.col("url"))).alias("path"))
    noisy = F.concat(F.lit("/a/../"), F.regexp_replace("path", "/", "//./"), F.when(F.col("path").endswith("/"), "").otherwise(""))
    return t.select("page_id", tf.normalize_path(noisy).alias("path"))


@query("SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def t_escape_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with every backslash doubled and line ends escaped come back."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return docs(spark, sf_dir).select("doc_id", F.md5(tf.from_bytes(tf.escape_decode(tf.to_bytes(escaped)))).alias("h"))


@query(f"SELECT doc_id, md5(regexp_replace({LOW.replace('text', 'url_decode(replace(url_encode(text), chr(43), chr(32)))')}, '[ \\t\\n\\r\\x0B\\f]', '', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def chain_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_decode, lowercase, remove_whitespace of encoded texts."""
    encoded = tf.to_bytes(F.url_encode("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(tf.from_bytes(tf.chain(encoded, ("url_decode", "lowercase", "remove_whitespace")))).alias("h"))


@query(f"WITH {URLS} SELECT page_id, {LOW.replace('text', 'split_part(target, chr(63), 1)')} AS path FROM u")
def chain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", tx.path_of(tx.url_target(F.col("url"))).alias("p"))
    return t.select("page_id", tf.chain(F.concat(F.lit("/./x/%2E%2e"), F.col("p")), ("url_decode", "lowercase", "normalize_path")).alias("path"))


@query(
    r"""SELECT doc_id, (CASE WHEN regexp_matches(text, '%2[5\x15]|%%') THEN 1 ELSE 0 END + CASE WHEN contains(text, chr(92)) THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(text, '%00') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '%([cC][01]|[eE]0)') THEN 8 ELSE 0 END
    + CASE WHEN regexp_matches(text, '\+[A-Za-z0-9+/]{1,32}-') THEN 16 ELSE 0 END + CASE WHEN regexp_matches(text, '&[#A-Za-z]') THEN 32 ELSE 0 END)::INT AS mask
    FROM documents WHERE text IS NOT NULL"""
)
def detect_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", rd.mask(tf.to_bytes(F.col("text"))).alias("mask"))


@query("SELECT page_id, replace(replace(url, '/', chr(92)), chr(92), '/') AS reading FROM pages")
def reading_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", rd.separator(F.replace("url", F.lit("/"), F.lit("\\"))).alias("reading"))


@query("SELECT page_id, split_part(url, '/', 3) AS reading FROM pages")
def reading_null_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host with the rest of the url behind an encoded null."""
    cut = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("%00"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", rd.null_truncate(cut).alias("reading"))


def _only(spark, sf_dir, made, bit: int) -> DataFrame:
    """The reading of one class of pages' urls written in a form that needs it."""
    p = table(spark, sf_dir, "pages").select("page_id", made.alias("data"))
    forked = rd.fork(p)
    return forked.filter(F.col("reading_class") == bit).select("page_id", F.col("data").alias("reading"))


@query("SELECT page_id, '<' || url || '>' AS reading FROM pages")
def reading_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    return _only(spark, sf_dir, F.concat(F.lit("&lt;"), url, F.lit("&#x3e;")), rd.ENTITY)


@query("SELECT page_id, '..%2f' || split_part(url, '/', 3) AS reading FROM pages")
def reading_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only(spark, sf_dir, F.concat(F.lit("..%252f"), F.split_part("url", F.lit("/"), F.lit(3))), rd.DOUBLE)


@query("SELECT page_id, '../' || split_part(url, '/', 3) AS reading FROM pages")
def reading_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only(spark, sf_dir, F.concat(F.lit("..%c0%af"), F.split_part("url", F.lit("/"), F.lit(3))), rd.OVERLONG)


@query("SELECT page_id, '<' || split_part(url, '/', 3) AS reading FROM pages")
def reading_utf7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only(spark, sf_dir, F.concat(F.lit("+ADw-"), F.split_part("url", F.lit("/"), F.lit(3))), rd.UTF7)


@query()
def reading_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all documents by class."""
    v = docs(spark, sf_dir).select("doc_id", tf.to_bytes(F.col("text")).alias("data"))
    f = rd.fork(v)
    return f.groupBy(rd.interpretation(F.col("reading_class")).alias("class")).agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"))


def _op(spark, sf_dir, op: Op) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", tf.to_bytes(F.col("text")).alias("d"))
    d = d.withColumn("f", tf.lowercase(F.col("d")))
    t = test_of(op, F.col("d"), F.col("f"))
    return d.filter(t.hit).select("doc_id", t.off.cast("int").alias("off"), t.length.cast("int").alias("len"))


def _at(needle: str) -> str:
    return f"strlen(substr({LOW}, 1, strpos({LOW}, '{needle}') - 1))::INT"


@query(f"SELECT doc_id, {_at('token')} AS off, 5 AS len FROM documents WHERE contains({LOW}, 'token')")
def op_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op(spark, sf_dir, Op("contains", ("Token",)))


@query(f"SELECT doc_id, CASE WHEN contains({LOW}, 'akia') THEN {_at('akia')} WHEN contains({LOW}, 'token') THEN {_at('token')} ELSE {_at('license')} END AS off, CASE WHEN contains({LOW}, 'akia') THEN 4 WHEN contains({LOW}, 'token') THEN 5 ELSE 7 END AS len FROM documents WHERE contains({LOW}, 'akia') OR contains({LOW}, 'token') OR contains({LOW}, 'license')")
def op_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op(spark, sf_dir, Op("contains_any", ("AKIA", "token", "License")))


@query("SELECT event_id, props FROM events WHERE props = '{\"k\": 69}'")
def op_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = test_of(Op("equals", ('{"k": 69}',)), F.col("props"), tf.lowercase(F.col("props")))
    return e.filter(t.hit).select("event_id", "props")


@query(f"SELECT doc_id, 0 AS off, 4 AS len FROM documents WHERE starts_with({LOW}, 'the ')")
def op_has_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op(spark, sf_dir, Op("has_prefix", ("The ",)))


_MAIL = r"[a-z0-9.]+@[a-z0-9.]+\.(com|org|net)"


@query(f"SELECT doc_id, strlen(substr(text, 1, strpos(text, regexp_extract(text, '{_MAIL}')) - 1))::INT AS off, strlen(regexp_extract(text, '{_MAIL}'))::INT AS len FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def op_rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op(spark, sf_dir, Op("rx", (_MAIL,)))


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '{_MAIL}')")
def op_rx_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.filter(regex(F.col("text"), _MAIL, True).hit).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length(text) > 3000 AND contains({LOW}, 'the')")
def op_func_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom operator with a required literal."""
    from tidegate.operators.predicates import gate, register_operator

    register_operator("long_text", lambda d, f, args: F.length(d) > args[0], ("the",))
    d = docs(spark, sf_dir).withColumn("f", tf.lowercase(F.col("text")))
    t = test_of(Op("long_text", (3000,)), F.col("text"), F.col("f"))
    return d.filter(gate(("the",), F.col("f")) & t.hit).select("doc_id")


def _case(name: str, attacks: list[str], clean: list[str]) -> None:
    """A query that puts attack and clean values of a predicate into the urls of pages, and its oracle."""
    rows = attacks + clean
    sql = "SELECT page_id, k, k < " + str(len(attacks)) + " AS hit FROM pages, range(" + str(len(rows)) + ") t(k)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*[F.lit(x) for x in rows])).alias("k", "d"))
        return p.select("page_id", F.col("k").cast("bigint").alias("k"), named_predicate(name, F.col("d"), tf.lowercase(F.col("d"))).hit.alias("hit"))

    run.__name__ = f"core_{name}"
    query(sql)(run)


_case("java_serialized_stream", ["\xac\xed\x00\x05", "'ro0abxpt"], ["plain", "aro0ab", "\xac"])
_case("php_serialized_object", ['o:8:"stdclass":1:{s:1:"a";i:1;}', "x;a:1:{i:0;s:1:b"], ["foo:1:2", "zoo:8:\"x", "a:{s"])
_case("crlf_header_injection", ["x\r\nset-cookie: a", "y\n location:z"], ["line\nbreak", "no header: here"])
_case("remote_file_inclusion", ["http://evil/x.php?a", "q=https://e/s.txt/r.jsp", "ftp://h/a.inc"], ["http://ok/a.html", "see http//x.php", "myhttp://x.php"])
_case("config_file_traversal", ["../wp-config.php", "..\\web.config"], ["wp-config.php", "../readme.md"])
_case("script_in_upload_path", ["/uploads/a.php", "/media/uploads/x.jsp/y", "/avatars/a.php. ?q"], ["/uploads/a.png", "/app/a.php"])
_case("php_under_wp_content", ["/wp-content/a.php", "/wp-content/p/x.phtml/1"], ["/wp-content/a.css", "/a.php"])
_case("backup_artifact", ["/a.php.bak", "/conf.yml~", "/backup/x.sql", "/dump/all.sql.gz"], ["/a.bak", "/x.sql", "/photo.png~"])
_case("double_extension", ["/a.php.jpg", "/b.asp;.jpg", "/c.php%00.png", "/shell.jsp/"], ["/a.php", "/lib.so.1", "/a.jpg", "/v.py.php"])
_case("script_uri", ["javascript:alert(1)", "java\nscript: //x(1)", "data:text/html,x", "vbscript:a`b`"], ["javascript: the good parts", "text/html", "my mocha: latte"])
_case("formula_injection", ["=cmd|' /c calc'!a0", "=hyperlink(\"x\")", "+powershell -x", "=exec(1)"], ["a=b", "powershell", "-1+2"])


def _prompt_sql() -> str:
    low = LOW
    signals = [f"CASE WHEN {' OR '.join(f'contains({low}, {chr(39)}{d.lower()}{chr(39)})' for d in PROMPT_DELIMITERS)} THEN {PROMPT_WEIGHTS['delimiter_injection']} ELSE 0 END"]
    before = "".join("\\" + c if c in "\\]-[^" else c for c in PROMPT_BEFORE).replace("'", "''")
    for s, phrases in PROMPT_PHRASES.items():
        test = lambda p: f"(contains({low}, '{p}') AND regexp_matches(substr({low}, 1, strpos({low}, '{p}') - 1), '(^|[{before}])[ \\t\\n\\r\\x0B\\f]*$'))"
        signals.append(f"CASE WHEN {' OR '.join(test(p) for p in phrases)} THEN {PROMPT_WEIGHTS[s]} ELSE 0 END")
    return f"SELECT conv_id, turn, score FROM (SELECT conv_id, turn, ({' + '.join(signals)})::INT AS score FROM conversations WHERE text IS NOT NULL) WHERE score >= 0"


@query(_prompt_sql())
def det_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", detect("prompt_injection")(tf.to_bytes(F.col("text")))["score"].alias("score"))


@query("SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 5 WHEN event_id % 3 = 1 THEN 8 ELSE 0 END)::INT AS score FROM events")
def det_nosqli(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, "user[$ne]").when(F.col("event_id") % 3 == 1, F.lit("a[$where][$set]")).otherwise("$filter[$schema]")
    return table(spark, sf_dir, "events").select("event_id", detect("nosqli")(name)["score"].alias("score"))


@query("SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 6 ELSE 0 END)::INT AS score FROM events")
def det_ldapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 2 == 0, F.lit("*)(uid=*))(|(uid=x")).otherwise("(plain)")
    return table(spark, sf_dir, "events").select("event_id", detect("ldapi")(value)["score"].alias("score"))


def _detector(name: str, attacks: list[str], clean: list[str]) -> None:
    """Attack and clean values in every page's row, judged by a detector; the oracle knows which is which."""
    rows = attacks + clean
    sql = f"SELECT page_id, k, k < {len(attacks)} AS hit FROM pages, range({len(rows)}) t(k)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*[F.lit(x) for x in rows])).alias("k", "d"))
        v = p.withColumn("v", detect(name)(F.col("d")))
        return v.select("page_id", F.col("k").cast("bigint").alias("k"), (F.col("v.score") >= 5).alias("hit"))

    run.__name__ = f"det_{name}"
    query(sql)(run)


_detector("sqli", ["1 or 1=1", "' union select 1,2--", "1; drop table x", "1 and sleep(5)", "pg_ls_dir('x')", "x' AND 1=1#"], ["O'Brien", "select a dress", "rock and roll", "a=1&b=2"])
_detector("xss", ["<script>alert(1)</script>", "<img src=x onerror=alert(1)>", "\" onmouseover=alert(1) x=\"", "<svg/onload=1>"], ["a < b and c > d", "<b>bold</b>", "size: 3' x 4'"])
_detector("shelli", ["x; cat /etc/passwd", "$(whoami)", "a|nc 1.2.3.4", "a=/bin/sh", "${IFS}x"], ["AT&T", "text/html; charset=utf-8", "ls -la; cat x", "cat photos; dogs"])
_detector("ssti", ["{{config.items()}}", "${T(java.lang.Runtime)}", "<%= system('x') %>"], ["{{name}}", "{{7*7}}", "costs ${price}"])
_detector("graphql", ["{" * 16 + "}" * 16, "{" + " a" * 21 + "}", "fragment A on X{...B} fragment B on X{...A}"], ["{ user(id: 1) { name } }", "query { a b c }"])
