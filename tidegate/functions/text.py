"""Transforms of byte strings as Spark expressions.

Inside a plan a byte string is a string of code points 0-255 (ISO-8859-1), so that positions and lengths count bytes.
Case is folded for ASCII letters alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\r\x0b\f"
HEX2 = "%[0-9A-Fa-f]{2}"


def to_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes, one code point each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_bytes(data: Column) -> Column:
    """The text that such bytes are the UTF-8 of."""
    return F.decode(F.encode(data, "ISO-8859-1"), "UTF-8")


def lowercase(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def remove_whitespace(c: Column) -> Column:
    return F.translate(c, SPACE, "")


def compress_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, "[ \t\n\r\x0b\f]+", " ")


def url_decode(c: Column) -> Column:
    """One pass of percent and plus decoding; what is malformed stays. Only values with an escape are taken apart."""
    plain = F.translate(c, "+", " ")
    token = lambda t: F.when(t.rlike(f"^{HEX2}$"), F.decode(F.unhex(F.substring(t, 2, 2)), "ISO-8859-1")).otherwise(F.translate(t, "+", " "))
    parts = F.regexp_extract_all(c, F.lit(f"{HEX2}|[^%]+|%"), F.lit(0))
    return F.when(c.rlike(HEX2), F.array_join(F.transform(parts, token), "")).otherwise(plain)


def normalize_path(c: Column) -> Column:
    """Resolve dots and doubled separators; ``..`` never climbs past the root, and leads a relative path."""
    absolute = c.rlike(r"^[/\\]")
    segments = F.filter(F.split(c, r"[/\\]", -1), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(acc, s):
        top = F.element_at(acc, -1)
        climbs = F.when((F.size(acc) > 0) & (F.coalesce(top, F.lit("")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        up = climbs.when(absolute, acc).otherwise(F.concat(acc, F.array(s)))
        return F.when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(segments, empty, step)
    joined = F.array_join(kept, "/")
    tail = F.when(c.rlike(r"[/\\]$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(c.rlike(r"[\\.]|//"), F.concat(F.when(absolute, "/").otherwise(""), joined, tail)).otherwise(c)


_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "v": "\x0b", "f": "\f", "b": "\b"}
ESCAPE = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{1,3}|\\[^xu]|[^\\]+|\\"


def escape_decode(c: Column) -> Column:
    """Backslash escapes: hexadecimal, octal (at most 255), control letters; of any other, the character itself."""

    def token(t):
        kind, rest = F.substring(t, 2, 1), F.substring(t, 3, 4)
        number = F.conv(rest, 16, 10).cast("int")
        # a code point's UTF-8 bytes, written out so that surrogates have theirs too
        one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0")), "ISO-8859-1")
        two = F.concat(one(F.lit(0xC0) + F.shiftright(number, 6)), one(F.lit(0x80) + number.bitwiseAND(0x3F)))
        three = F.concat(one(F.lit(0xE0) + F.shiftright(number, 12)), one(F.lit(0x80) + F.shiftright(number, 6).bitwiseAND(0x3F)), one(F.lit(0x80) + number.bitwiseAND(0x3F)))
        coded = F.when(number < 0x80, one(number)).when(number < 0x800, two).otherwise(three)
        octal = one(F.least(F.conv(F.substring(t, 2, 3), 8, 10).cast("int"), F.lit(255)))
        simple = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _SIMPLE.items() for x in kv]), kind), kind)
        escaped = F.when(t.rlike(r"^\\[xu]."), coded).when(kind.between("0", "7"), octal).otherwise(simple)
        return F.when(t.startswith("\\") & (F.length(t) > 1), escaped).otherwise(t)

    parts = F.regexp_extract_all(c, F.lit("(?s)" + ESCAPE), F.lit(0))
    return F.when(c.contains("\\"), F.array_join(F.transform(parts, token), "")).otherwise(c)


TRANSFORMS = {
    "lowercase": lowercase,
    "remove_whitespace": remove_whitespace,
    "url_decode": url_decode,
    "compress_whitespace": compress_whitespace,
    "normalize_path": normalize_path,
    "escape_decode": escape_decode,
}


def chain(c: Column, names: tuple[str, ...]) -> Column:
    """Transforms in order."""
    for n in names:
        c = TRANSFORMS[n](c)
    return c


def register_transform(name: str, build) -> None:
    """Add a transform: a function from Column to Column."""
    TRANSFORMS[name] = build
