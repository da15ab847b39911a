"""Validators of declared fields, as expressions that give null or the first violation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the text of each kind and format looks like.
INTEGER = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
BOOLEANS = ["true", "false", "TRUE", "FALSE", "True", "False", "1", "0"]
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "date-time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})\z",
    "email": r"^(?=.{3,254}\z)[A-Za-z0-9._+-]+@(?=.{3})[A-Za-z0-9_+-]+\.[A-Za-z0-9._+-]*\z",
    "hex": r"^[0-9a-fA-F]+\z",
    "base64": r"^(?=.)[A-Za-z0-9+/_-]*={0,2}\z",
    "ipv4": r"^(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}\z",
}
INERT_KINDS = ("integer", "number", "boolean", "enum")
INERT_FORMATS = ("uuid", "date-time", "date", "hex", "ipv4")


def violation(value: Column, kind: Column | str, fmt: Column | str | None = None, enum: Column | None = None, max_length: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """The first broken rule: length, type, range, enum, format; null if the value is valid."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fmt = F.lit(fmt) if fmt is None or isinstance(fmt, str) else fmt
    low = F.lit(None).cast("double") if low is None else low
    high = F.lit(None).cast("double") if high is None else high
    max_length = F.lit(0) if max_length is None else max_length
    enum = F.lit(None).cast("array<string>") if enum is None else enum
    typed = (
        F.when(kind == "integer", value.rlike(INTEGER))
        .when(kind == "number", value.rlike(NUMBER))
        .when(kind == "boolean", value.isin(BOOLEANS))
        .otherwise(F.lit(True))
    )
    ranged = kind.isin("integer", "number") & (low.isNotNull() | high.isNotNull())
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    number = F.when(~value.rlike("[eE]") & (digits <= 17), value.try_cast("double"))
    in_range = number.isNotNull() & F.coalesce(number >= low, F.lit(True)) & F.coalesce(number <= high, F.lit(True))
    good = F.lit(True)
    for name, pattern in FORMATS.items():
        good = F.when(fmt == name, value.rlike(pattern)).otherwise(good)
    return (
        F.when((F.coalesce(max_length, F.lit(0)) > 0) & (F.length(value) > max_length), "too_long")
        .when(~typed, "wrong_type")
        .when(ranged & ~in_range, "out_of_range")
        .when((kind == "enum") & ~F.coalesce(F.array_contains(enum, value), F.lit(False)), "not_in_enum")
        .when(fmt.isNotNull() & ~good, "bad_format")
    )


def inert(kind: Column, fmt: Column) -> Column:
    """Whether a value that passed cannot carry an attack, and so need not be matched."""
    return kind.isin(*INERT_KINDS) | F.coalesce(fmt.isin(*INERT_FORMATS), F.lit(False))
