"""Transactions as rows, and their values: request line, query, headers, cookies, bodies, responses, side inputs.

A transaction's texts are byte strings (see functions.text). Values carry the order in which they came (value_seq) and
the phase at which they are there (arrived).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.text import lowercase

NAMED = "array<struct<name:string,value:string>>"
TRANSACTION = (
    f"tx_id bigint, ts timestamp, method string, target string, protocol string, remote_addr string, headers {NAMED}, args {NAMED}, body binary, "
    f"response_status int, response_headers {NAMED}, response_body binary"
)
#: Limits. Beyond them there is a decision, not a cut.
MAX_BODY, MAX_ARGS, MAX_HEADERS, MAX_VALUE, MAX_LINE = 1 << 20, 1000, 200, 2 << 20, 8 << 10


def transactions(df: DataFrame) -> DataFrame:
    """Any frame with some of the columns of TRANSACTION, completed with the defaults of a replay."""
    from pyspark.sql.types import StructType

    defaults = {"method": F.lit("GET"), "target": F.lit("/"), "protocol": F.lit("HTTP/1.1"), "remote_addr": F.lit("192.0.2.1")}
    have = {c.lower() for c in df.columns}
    cols = []
    for f in StructType.fromDDL(TRANSACTION).fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append((F.coalesce(c, defaults[f.name]) if f.name in defaults else c).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_corpus(spark, path: str) -> DataFrame:
    """A JSON-lines corpus of requests (name, method, target, headers, args, body); blank lines and # comments are skipped."""
    line = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(?:#|\z)"))
    kind = "name string, method string, target string, headers map<string,string>, args map<string,string>, body string"
    parsed = line.select(F.from_json("value", kind).alias("r"), F.xxhash64("value").alias("tx_id")).select("tx_id", "r.*")
    pairs = lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return parsed.select("tx_id", "name", "method", "target", pairs("headers").alias("headers"), pairs("args").alias("args"), F.encode("body", "UTF-8").alias("body"))


def path_of(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def query_of(target: Column) -> Column:
    return F.when(target.contains("?"), F.regexp_extract(target, r"(?s)\?(.*)", 1)).otherwise("")


def url_target(url: Column) -> Column:
    """An absolute URL without scheme, host and fragment."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rest = F.substring_index(rest, "#", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def query_pairs(query: Column) -> Column:
    """Pairs between & or ;, at the first =; empty ones are skipped, nothing is decoded."""
    parts = F.filter(F.split(query, "[&;]", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(p.contains("="), F.regexp_extract(p, r"(?s)=(.*)", 1)).otherwise("").alias("value")))


def _one(target: str, data: Column, key: Column | str = "", arrived: int = 1) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(F.lit(arrived).alias("arrived"), F.lit(target).alias("target"), key.alias("key"), data.alias("data"))


def _empty() -> Column:
    return F.array().cast("array<struct<arrived:int,target:string,key:string,data:string>>")


def _pairs(rows: Column, kind: str, names: str | None, arrived: int = 1) -> Column:
    """Value and name entries of (name, value) pairs, in order."""
    def both(p):
        v = _one(kind, p["value"], p["name"], arrived)
        return F.array(v, _one(names, p["name"], "", arrived)) if names else F.array(v)

    return F.coalesce(F.flatten(F.transform(rows, both)), _empty())


def cookies(headers: Column) -> Column:
    of = F.filter(F.coalesce(headers, F.array().cast(NAMED)), lambda h: lowercase(h["name"]) == "cookie")
    parts = F.flatten(F.transform(of, lambda h: F.split(h["value"], ";\\s*", -1)))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.regexp_extract(p, r"(?s)=(.*)", 1).alias("value")))


def entries(line: bool = False, strict_parity: bool = False) -> Column:
    """All header-phase and response entries of a transaction in wire order, as one array. With ``strict_parity`` cookies, ARGS_GET and ARGS_JOINED stay empty and the status is no response value."""
    t = F.col("target")
    head = [_one("REQUEST_METHOD", F.col("method")), _one("REQUEST_URI", t), _one("REQUEST_PROTOCOL", F.col("protocol"))]
    whole = F.concat_ws(" ", "method", "target", "protocol")
    parts = [F.array(*head)]
    if line:
        parts.append(F.when(F.octet_length(whole) <= MAX_LINE, F.array(_one("REQUEST_LINE", whole))).otherwise(_empty()))
    parts += [F.array(_one("REQUEST_PATH", path_of(t))), _pairs(query_pairs(query_of(t)), "ARGS", "ARGS_NAMES"), _pairs(F.col("args"), "ARGS", "ARGS_NAMES")]
    parts.append(_pairs(F.col("headers"), "REQUEST_HEADERS", "REQUEST_HEADER_NAMES"))
    parts.append(F.when(F.col("remote_addr").isNotNull(), F.array(_one("REMOTE_ADDR", F.col("remote_addr")))).otherwise(_empty()))
    if not strict_parity:
        q = query_pairs(query_of(t))
        parts += [_pairs(q, "ARGS_GET", None), _pairs(cookies(F.col("headers")), "REQUEST_COOKIES", "REQUEST_COOKIE_NAMES")]
        parts.append(F.when(F.size(q) > 0, F.array(_one("ARGS_JOINED", F.array_join(F.transform(q, lambda p: p["value"]), " ")))).otherwise(_empty()))
    status = F.col("response_status").cast("string")
    parts.append(F.when(status.isNotNull(), F.array(_one("RESPONSE_STATUS", status, "", 1 if strict_parity else 3))).otherwise(_empty()))
    parts.append(_pairs(F.col("response_headers"), "RESPONSE_HEADERS", "RESPONSE_HEADER_NAMES", 3))
    body = F.decode("response_body", "ISO-8859-1")
    parts.append(F.when(F.length(body) > 0, F.array(_one("RESPONSE_BODY", body, "body", 4))).otherwise(_empty()))
    return F.concat(*parts)


def with_values(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",), line: bool = False, strict_parity: bool = False, bodies: bool = True) -> DataFrame:
    """keep..., path, and ``entries``: the values of a transaction as one array, body values after the header values. A decoder runs only for transactions with a body."""
    from tidegate.sources.bodies import body_entries

    base = tx.withColumn("__path", path_of(F.col("target")))
    all_ = entries(line, strict_parity)
    if bodies:
        some = F.when(F.octet_length("body").between(1, MAX_BODY), F.col("body"))
        base = base.withColumn("__body", body_entries(some, _header("content-type"), _header("content-encoding"), _header("grpc-encoding"), F.lit(not strict_parity)))
        seen = F.coalesce(F.col("__body.entries"), _empty())
        all_ = F.concat(F.filter(all_, lambda e: e["arrived"] <= 2), seen, F.filter(all_, lambda e: e["arrived"] > 2))
    return base.select(*keep, F.col("__path").alias("path"), all_.alias("entries"))


def explode_values(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",), line: bool = False, strict_parity: bool = False, bodies: bool = True) -> DataFrame:
    """Values of transactions: keep..., path (of the request), value_seq, arrived, target, key, data, inert. Columns that ``keep`` names beside the key go along with every value."""
    rows = with_values(tx, keep, line, strict_parity, bodies).select(*keep, "path", F.posexplode("entries").alias("value_seq", "__v"))
    return rows.select(*keep, "path", "value_seq", "__v.*", F.lit(False).alias("inert"))


def resolved(tx: DataFrame, side: DataFrame, name: str, on: str, key: str, value: str, keep: tuple[str, ...] = ("tx_id",), order: str | None = None) -> DataFrame:
    """RESOLVED values of a side table (the frame of a resolver), joined on a column of the transactions. A column ``order`` of the side goes along."""
    s = side.select(F.col(on).alias("__on"), F.col(key).cast("string").alias("__k"), F.col(value).cast("string").alias("data"), *([F.col(order).alias("n")] if order else []))
    coded = (F.length("data") >= 64) & F.col("data").rlike(r"^[A-Za-z0-9+/_-]+={0,2}\z")
    plain = F.rtrim(F.translate("data", "-_=", "+/ "))  # encoded values are decoded, in either alphabet
    full = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    s = s.withColumn("data", F.when(coded & (F.length(plain) % 4 != 1), F.decode(F.unbase64(full), "ISO-8859-1")).otherwise(F.col("data")))
    rows = tx.join(s, tx[on] == F.col("__on"))
    k = F.when(F.coalesce("__k", F.lit("")) == "", F.lit(name)).otherwise(F.concat(F.lit(name + "."), "__k"))
    return rows.select(*keep, F.lit(1).alias("arrived"), F.lit("RESOLVED").alias("target"), k.alias("key"), "data", F.lit(False).alias("inert"), *(["n"] if order else []))


#: Where values of side inputs stand among a transaction's values: after all others.
AFTER_VALUES = 1 << 30
#: Side inputs by name: (function of the session to a frame, join column, key column, value column).
RESOLVERS: dict = {}


def register_resolver(name: str, side, on: str, key: str = "key", value: str = "value") -> None:
    """Add a side input. ``side`` maps a session to a frame; it is called only for plans that read the name."""
    RESOLVERS[name] = (side, on, key, value)


def with_resolved(values: DataFrame, tx: DataFrame, plan, keep: tuple[str, ...] = ("tx_id",), most: int = MAX_ARGS) -> DataFrame:
    """Values with those of the registered side inputs that rules of a plan read: each is joined once, whatever the phases that read it.

    A side input yields at most ``most`` values for a transaction, the first by key and value; equal rows count once. An
    input whose join column the transactions lack is an error."""
    named = [t.name for r in plan.rules for t in r.targets if t.kind == "RESOLVED"]
    read = lambda n: any(not t or t == n or t.startswith(n + ".") for t in named)
    for i, name in enumerate(sorted(n for n in RESOLVERS if read(n))):
        side, on, key, value = RESOLVERS[name]
        s = side(tx.sparkSession).select(F.col(on).alias("__side"), F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v")).filter("v IS NOT NULL")
        # cut for each join value, not for each transaction; the limit is applied before the shuffle too
        s = s.distinct().withColumn("n", F.row_number().over(Window.partitionBy("__side").orderBy("k", "v"))).filter(F.col("n") <= most)
        found = resolved(tx, s.withColumnRenamed("__side", on), name, on, "k", "v", keep, order="n")
        found = found.withColumn("value_seq", (F.lit(AFTER_VALUES + i * most) + F.col("n")).cast("int")).drop("n")
        values = values.unionByName(found.select(*keep, "value_seq", "arrived", "target", "key", "data", "inert"), allowMissingColumns=True)
    return values


def framing(headers: Column) -> Column:
    """Whether message framing is ambiguous: odd or differing lengths, odd transfer codings, or both headers."""
    h = F.coalesce(headers, F.array().cast(NAMED))
    of = lambda n: F.transform(F.filter(h, lambda x: lowercase(x["name"]) == n), lambda x: x["value"])
    cl, te = of("content-length"), of("transfer-encoding")
    return (
        F.when(F.exists(cl, lambda v: ~v.rlike(r"^[0-9]+\z")), "content-length is not a number")
        .when(F.size(F.array_distinct(cl)) > 1, "content-length differs")
        .when(F.exists(te, lambda v: v.rlike(r"^[ \t\n\r\x0B\f]|[ \t\n\r\x0B\f]\z")), "transfer-encoding has white space around it")
        .when((F.size(cl) > 0) & (F.size(te) > 0), "content-length and transfer-encoding")
    )


def gates(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """(keep..., gate_phase, gate_ord, reason, detail) of every check that comes before the rules and fails."""
    n_args = F.size(query_pairs(query_of(F.col("target")))) + F.coalesce(F.size("args"), F.lit(0))
    heads = F.coalesce(F.size("headers"), F.lit(0))
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.coalesce(F.col(c), F.array().cast(NAMED)), lambda p: F.octet_length(p["value"]))), F.lit(0))
    frame = framing(F.col("headers"))
    say = lambda phase, ord_, reason, detail: F.struct(F.lit(phase).alias("gate_phase"), F.lit(ord_).alias("gate_ord"), F.lit(reason).alias("reason"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    found = F.array_compact(F.array(
        F.when(heads > MAX_HEADERS, say(1, 0, "limit_exceeded", "headers")),
        F.when(frame.isNotNull(), say(1, 1, "framing_ambiguous", frame)),
        F.when(F.greatest(longest("headers"), longest("args"), F.octet_length("target")) > MAX_VALUE, say(1, 2, "limit_exceeded", "value")),
        F.when(F.octet_length("body") > MAX_BODY, say(2, 3, "limit_exceeded", "body")),
        F.when(n_args > MAX_ARGS, say(2, 4, "limit_exceeded", "arguments")),
        F.when(F.octet_length("response_body") > MAX_BODY, say(4, 5, "limit_exceeded", "response body")),
    ))
    return tx.select(*keep, F.inline(found))


def _header(name: str) -> Column:
    """The first value of a request header, null if it is not there."""
    of = F.filter(F.coalesce("headers", F.array().cast(NAMED)), lambda h: lowercase(h["name"]) == name)
    return F.try_element_at(F.transform(of, lambda h: h["value"]), F.lit(1))


def body_gates(tx: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """(keep..., gate_phase, gate_ord, reason, detail) of bodies that cannot be decoded or that unpack beyond their limit."""
    from tidegate.sources.bodies import body_entries

    some = tx.filter(F.octet_length("body").between(1, MAX_BODY))
    status = body_entries(F.col("body"), _header("content-type"), _header("content-encoding"), _header("grpc-encoding"), F.lit(True))["status"]
    reason = F.when(F.col("detail") == "undecodable", "undecidable").when(F.col("detail").isin("too_large", "too_deep", "too_many"), "limit_exceeded")
    rows = some.select(*keep, status.alias("detail")).withColumn("reason", reason).filter("reason IS NOT NULL")
    return rows.select(*keep, F.lit(2).alias("gate_phase"), F.lit(8).alias("gate_ord"), "reason", "detail")
