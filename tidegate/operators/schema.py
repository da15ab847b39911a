"""Positive security: routes and declared fields of an API against the values of a transaction.

The API is a small table of operations and fields; it is broadcast, its size being that of a hand-written contract.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import validators as vd
from tidegate.functions.text import lowercase

FIELD_ROW = (
    "op_ord int, method string, path string, strict boolean, no_body boolean, field_loc string, field_ord int, name string, kind string, format string, "
    "enum array<string>, required boolean, max_length int, min double, max double, context string"
)
#: Fields of which the absence is tracked.
REQUIRED_FIELDS = 64


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    format: str | None = None
    enum: tuple[str, ...] = ()
    required: bool = False
    max_length: int = 0
    min: float | None = None
    max: float | None = None
    context: str | None = None


@dataclass
class Operation:
    method: str
    path: str
    query: list[Field] = field(default_factory=list)
    headers: list[Field] = field(default_factory=list)
    body: list[Field] = field(default_factory=list)
    strict: bool = False
    no_body: bool = False


def fields_frame(spark: SparkSession, operations: list[Operation]) -> DataFrame:
    """One row for each declared field, and one without a name for each operation."""
    rows = []
    for i, op in enumerate(operations):
        base = (i, op.method, op.path, op.strict, op.no_body)
        rows.append((*base, "", -1, None, None, None, None, False, 0, None, None, None))
        for loc, fields in (("query", op.query), ("header", op.headers), ("body", op.body)):
            rows += [(*base, loc, k, f.name, f.kind, f.format, list(f.enum), f.required, f.max_length, f.min, f.max, f.context) for k, f in enumerate(fields)]
    return spark.createDataFrame(rows, FIELD_ROW)


def route_pattern(path: str) -> str | None:
    """A regular expression of a templated path; None for a literal one. {x} is a segment that is not empty, a last * the rest."""
    if "{" not in path and not path.endswith("*"):
        return None
    out = ""
    for part in re.split(r"(\{[^}]*\}|\*\Z)", path):
        out += "[^/]+" if part.startswith("{") else ".*" if part == "*" else "".join("\\" + c if c in "\\.^$|?*+()[]{}" else c for c in part)
    return f"^{out}\\z"


def routes(tx: DataFrame, operations: list[Operation], keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """keep..., method, path, op_ord (null: undeclared): the exact route, else the one of any method, else templates in order. Literal routes are a map, so the lookup is no join; templates are tests in order."""
    exact, templates = {}, []
    for i, op in enumerate(operations):
        pattern = route_pattern(op.path)
        if pattern is None:
            exact.setdefault((op.method, op.path), i)
        else:
            templates.append((i, op.method, pattern))
    m, p = F.col("method"), F.col("path")
    found = F.lit(None).cast("int")
    for i, method, pattern in reversed(templates):
        found = F.when(p.rlike(pattern) & ((m == method) if method else F.lit(True)), F.lit(i)).otherwise(found)
    if exact:
        names = F.create_map(*[x for (me, pa), i in exact.items() for x in (F.lit(f"{me} {pa}"), F.lit(i))])
        found = F.coalesce(F.try_element_at(names, F.concat_ws(" ", m, p)), F.try_element_at(names, F.concat(F.lit(" "), p)), found)
    return tx.select(*keep, "method", "path", found.alias("op_ord"))


def routed_rows(tx: DataFrame, operations: list[Operation]) -> DataFrame:
    """Transactions with ``op_ord`` as a column of their own, so that values which keep it need no join to find their operation."""
    return routes(tx, operations, tuple(c for c in tx.columns if c not in ("method", "path")))


def undeclared(routed: DataFrame) -> DataFrame:
    return routed.filter("op_ord IS NULL")


def validated(values: DataFrame, routed: DataFrame | None, fields: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Values with op_ord, inert and violation. An argument is looked up by name among the fields of its place, else the field of empty name; under a strict operation, an argument without a field is a violation. Values of other targets are left alone. Values that carry op_ord (:func:`routed_rows`) stay where they are; others are joined with ``routed``."""
    loc = F.when(F.col("target") == "ARGS", F.when(F.col("arrived") == 1, "query").otherwise("body")).when(F.col("target") == "REQUEST_HEADERS", "header")
    own = "op_ord" in values.columns
    v = (values if own else values.join(routed.select(*keep, "op_ord"), list(keep), "left")).withColumn("__loc", loc)
    named = fields.filter("name IS NOT NULL").select(F.col("op_ord").alias("__o"), F.col("field_loc").alias("__l"), F.col("name").alias("__n"), F.struct("kind", "format", "enum", "max_length", "min", "max").alias("__f"))
    wild = named.filter("__n = ''").select(F.col("__o").alias("__wo"), F.col("__l").alias("__wl"), F.col("__f").alias("__w"))
    strict = fields.filter("field_ord = -1").select(F.col("op_ord").alias("__so"), F.col("strict").alias("__strict"))
    key = F.when(F.col("__loc") == "header", lowercase(F.col("key"))).otherwise(F.col("key"))
    name = F.when(F.col("__l") == "header", lowercase(F.col("__n"))).otherwise(F.col("__n"))
    v = v.join(F.broadcast(named), (F.col("op_ord") == F.col("__o")) & (F.col("__loc") == F.col("__l")) & (key == name) & (F.col("__n") != ""), "left")
    v = v.join(F.broadcast(wild), (F.col("op_ord") == F.col("__wo")) & (F.col("__loc") == F.col("__wl")), "left")
    v = v.join(F.broadcast(strict), F.col("op_ord") == F.col("__so"), "left")
    f = F.coalesce("__f", "__w")
    bad = vd.violation(F.col("data"), f["kind"], f["format"], f["enum"], f["max_length"], f["min"], f["max"])
    stray = F.col("__strict") & F.col("__loc").isin("query", "body") & f.isNull()
    violation = F.when(f.isNotNull(), bad).when(stray, "undeclared")
    inert = f.isNotNull() & bad.isNull() & vd.inert(f["kind"], f["format"])
    kept = [c for c in values.columns if c not in ("inert", "op_ord")]
    return v.select(*kept, "op_ord", F.coalesce(inert, F.lit(False)).alias("inert"), violation.alias("violation"))


def missing_required(values: DataFrame, routed: DataFrame, fields: DataFrame, keep: tuple[str, ...] = ("tx_id",), query_too: bool = True) -> DataFrame:
    """(keep..., name, field_loc) of required fields that no value has."""
    need = fields.filter("required").filter(F.col("field_ord") < REQUIRED_FIELDS).filter(F.col("field_loc").isin(["body", "query"] if query_too else ["body"]))
    wanted = routed.select(*keep, "op_ord").join(F.broadcast(need.select("op_ord", "name", "field_loc")), "op_ord")
    seen = values.filter("target = 'ARGS'").select(*keep, F.col("key").alias("name"), F.when(F.col("arrived") == 1, "query").otherwise("body").alias("field_loc")).distinct()
    return wanted.join(seen, [*keep, "name", "field_loc"], "left_anti").select(*keep, "name", "field_loc")


def missing_in_rows(valued: DataFrame, operations: list[Operation], keep: tuple[str, ...] = ("tx_id",), query_too: bool = True) -> DataFrame:
    """(keep..., name, field_loc) of required fields that no value has, from transactions with ``op_ord`` and ``entries``: each is judged in its row, nothing is shuffled."""
    need = {i: [(f.name, loc) for loc, fields in (("query", op.query if query_too else []), ("body", op.body)) for f in fields[:REQUIRED_FIELDS] if f.required] for i, op in enumerate(operations)}
    need = {i: n for i, n in need.items() if n}
    kind = "array<struct<name:string,field_loc:string>>"
    if not need:
        return valued.limit(0).select(*keep, F.lit("").alias("name"), F.lit("").alias("field_loc"))
    wanted = F.create_map(*[x for i, n in need.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("field_loc")) for a, b in n]))])
    loc = lambda e: F.when(e["arrived"] == 1, "query").otherwise("body")
    seen = F.transform(F.filter("entries", lambda e: e["target"] == "ARGS"), lambda e: F.struct(e["key"].alias("name"), loc(e).alias("field_loc")))
    gone = F.array_except(F.try_element_at(wanted, F.col("op_ord")).cast(kind), seen.cast(kind))
    return valued.select(*keep, F.inline(gone))


def violations(checked: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """The first violation of each transaction by order of its values."""
    bad = checked.filter("violation IS NOT NULL")
    return bad.groupBy(*keep).agg(F.min_by(F.struct("key", "violation"), F.col("value_seq")).alias("v")).select(*keep, F.col("v.key").alias("key"), F.col("v.violation").alias("violation"))


def inert_share(checked: DataFrame) -> Column:
    return F.avg(F.col("inert").cast("double"))


def gates(checked: DataFrame, missing: DataFrame, routed: DataFrame, tx: DataFrame, fields: DataFrame, keep: tuple[str, ...] = ("tx_id",), closed: bool = False) -> DataFrame:
    """(keep..., gate_phase, gate_ord, reason, detail) of what breaks the contract: violations in order of their values, missing fields, a body where there may be none, and, for a closed API, undeclared routes."""
    row = lambda phase, order, detail: [*keep, phase.cast("int").alias("gate_phase"), order.cast("int").alias("gate_ord"), F.lit("schema_violation").alias("reason"), detail.alias("detail")]
    out = checked.filter("violation IS NOT NULL").select(*row(F.least(F.col("arrived"), F.lit(2)), F.col("value_seq") + 10, F.concat_ws(": ", "key", "violation")))
    out = out.unionByName(missing.select(*row(F.lit(2), F.lit(7), F.concat(F.lit("missing: "), "name"))))
    bare = fields.filter("field_ord = -1 AND no_body").select("op_ord")
    sent = routed.select(*keep, "op_ord").join(F.broadcast(bare), "op_ord", "left_semi").join(tx.filter(F.octet_length("body") > 0).select(*keep), list(keep), "left_semi")
    out = out.unionByName(sent.select(*row(F.lit(2), F.lit(6), F.lit("body"))))
    if closed:
        out = out.unionByName(undeclared(routed).select(*row(F.lit(1), F.lit(9), F.lit("undeclared route"))))
    return out
