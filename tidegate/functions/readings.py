"""Readings: the plausible decodings of one value.

A mask says which ambiguities a value holds; each gives one more reading of the raw bytes, in the order of its bit. A
reading equal to an earlier one is dropped. Ambiguities whose decoding is a plain expression stay in the JVM; the
others are decoded by one Arrow function that sees only the values that need it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits and names of the reading classes.
DOUBLE, SEPARATOR, NULL, OVERLONG, UTF7, ENTITY = 1, 2, 4, 8, 16, 32
NAMES = {DOUBLE: "double_encoded", SEPARATOR: "separator", NULL: "null_truncate", OVERLONG: "overlong_utf8", UTF7: "utf7", ENTITY: "html_entity"}
RUN = 32
#: Named references that are decoded.
ENTITIES = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">", "sol": "/", "bsol": "\\", "colon": ":", "lpar": "(", "rpar": ")", "period": ".", "NewLine": "\n", "Tab": "\t"}

TRIGGERS = {
    DOUBLE: "%2[5\\x15]|%%",
    SEPARATOR: r"\\",
    NULL: "\\x00|%00",
    OVERLONG: "[\\xC0\\xC1]|%(?:[cC][01]|[eE]0)",
    UTF7: r"\+[A-Za-z0-9+/]{1,32}-",
    ENTITY: "&[#A-Za-z]",
}
MARKUP = "<(?:[A-Za-z]|/[A-Za-z])"


def mask(data: Column) -> Column:
    """Bits of the ambiguities of a byte string."""
    return sum((F.when(data.rlike(t), F.lit(bit)).otherwise(F.lit(0)) for bit, t in TRIGGERS.items()), F.lit(0)).cast("int")


def interpretation(bits: Column) -> Column:
    """Class names joined by ``|``; ``none`` for no bit."""
    names = F.array(*[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for b, n in NAMES.items()])
    return F.when(bits == 0, "none").otherwise(F.array_join(names, "|"))


def separator(data: Column) -> Column:
    return F.translate(data, "\\", "/")


def null_truncate(data: Column) -> Column:
    return F.regexp_extract(data, r"(?s)^(.*?)(?:\x00|%00|\z)", 1)


def url_decode_bytes(s: str) -> str:
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), s.replace("+", " ")) if "%" in s else s.replace("+", " ")


def overlong_bytes(s: str) -> str:
    """Two- and three-byte forms of characters below U+0080, collapsed."""
    if "%" in s:
        s = url_decode_bytes(s)
    short = lambda m: chr((ord(m[0][0]) & 0x1F) << 6 & 0xFF | ord(m[0][1]) & 0x3F)
    long_ = lambda m: chr((ord(m[0][1]) & 0x3F) << 6 | ord(m[0][2]) & 0x3F) if ord(m[0][1]) < 0x82 else m[0]
    return re.sub("[\xc0\xc1][\x80-\xbf]|\xe0[\x80-\xbf]{2}", lambda m: short(m) if m[0][0] != "\xe0" else long_(m), s)


_SIX = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def utf7_bytes(s: str) -> str:
    """Runs of modified base64 after ``+``; code units below 0x80 are kept."""

    def run(m: re.Match) -> str:
        if m[0] == "+-":
            return "+"
        n = 0
        for c in m[1]:
            n = n << 6 | _SIX[c]
        bits = 6 * len(m[1])
        units = [n >> bits - 16 * (k + 1) & 0xFFFF for k in range(bits // 16)]
        return "".join(chr(u) for u in units if u < 0x80)

    return re.sub(rf"\+-|\+([A-Za-z0-9+/]{{1,{RUN}}})-?", run, s)


def entity_bytes(s: str) -> str:
    """Numeric (at most eight digits) and the common named references, the former as UTF-8."""

    def one(m: re.Match) -> str:
        if m["name"]:
            return ENTITIES[m["name"]]
        v = int(m["hex"], 16) if m["hex"] else int(m["dec"])
        if v > 0x10FFFF:
            return m[0]
        return chr(v).encode("utf-8", "surrogatepass").decode("latin-1")

    names = "|".join(sorted(ENTITIES, key=len, reverse=True))
    return re.sub(rf"&(?:#[xX](?P<hex>[0-9A-Fa-f]{{1,8}});?|#(?P<dec>[0-9]{{1,8}});?|(?P<name>{names});)", one, s)


DECODERS = {DOUBLE: url_decode_bytes, OVERLONG: overlong_bytes, UTF7: utf7_bytes, ENTITY: entity_bytes}
READINGS = "array<struct<ord:int,class:int,data:string>>"
_ARROW = pa.list_(pa.struct([("ord", pa.int32()), ("class", pa.int32()), ("data", pa.string())]))


def all_readings(s: str, bits: int) -> list[dict]:
    """Every reading of a value with this mask, the value itself first."""
    out = [{"ord": 0, "class": 0, "data": s}]
    for bit in NAMES:
        if not bits & bit or bit == ENTITY and re.search(MARKUP, s):
            continue
        if bit == SEPARATOR:
            t = s.replace("\\", "/")
        elif bit == NULL:
            t = re.split("\x00|%00", s, maxsplit=1)[0]
        else:
            t = DECODERS[bit](s)
        if all(t != r["data"] for r in out):
            out.append({"ord": len(out), "class": bit, "data": t})
    return out


def decoded_readings(data: Column, bits: Column) -> Column:
    """READINGS of a byte-string column and its mask; null for null."""

    @F.arrow_udf(READINGS)
    def decode_readings(data: pa.Array, bits: pa.Array) -> pa.Array:
        rows = [None if d is None else all_readings(d, b) for d, b in zip(data.to_pylist(), bits.to_pylist(), strict=True)]
        return pa.array(rows, _ARROW)

    return decode_readings(data, bits)


def fork(values: DataFrame, data: str = "data") -> DataFrame:
    """One row for each reading of each value: adds reading_ord and reading_class, and replaces the data. Separator and null readings are expressions; the Arrow function gets a value only if another ambiguity is in it, else a null, so that the input is read once."""
    v = values.withColumn("__mask", mask(F.col(data)))
    light = SEPARATOR | NULL
    hard = F.col("__mask").bitwiseAND(~light & 63) != 0
    verbatim = F.struct(F.lit(0).alias("ord"), F.lit(0).alias("class"), F.col(data).alias("data"))
    one = lambda bit, made: F.when((F.col("__mask").bitwiseAND(bit) != 0) & (made != F.col(data)), F.struct(F.lit(0).alias("ord"), F.lit(bit).alias("class"), made.alias("data")))
    sep, cut = separator(F.col(data)), null_truncate(F.col(data))
    second = F.when(~((F.col("__mask").bitwiseAND(SEPARATOR) != 0) & (cut == sep)), one(NULL, cut))
    few = F.transform(F.array_compact(F.array(verbatim, one(SEPARATOR, sep), second)), lambda x, i: x.withField("ord", i))
    v = v.withColumn("__py", decoded_readings(F.when(hard, F.col(data)), F.col("__mask")))
    read = F.when(hard, F.col("__py")).when(F.col("__mask") == 0, F.array(verbatim)).otherwise(few)
    kept = [c for c in values.columns if c != data]
    out = v.select(*kept, F.explode(read).alias("__x"))
    return out.select(*kept, F.col("__x.ord").alias("reading_ord"), F.col("__x.class").alias("reading_class"), F.col("__x.data").alias(data))
