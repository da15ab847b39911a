"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256, so equal contents are one blob wherever and whenever they
appear. A scan anti-joins the blobs with the ledger of (blob, rule version) pairs, runs the rules on the unseen
pairs alone, appends their findings, and joins the findings back to every path that holds the blob.

Positions come without a Python function: the text is split at a rule's matches, and running sums of the lengths of
the pieces and of the matches are the code point offsets.

Cases: null texts are read as empty and hold no secret; empty texts likewise; repeated rows each get their blob's
findings; null paths keep their row; an empty table gives empty results; other columns are not read, and of
those that are kept, one that is named as a column of the result gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import broadcast_if_small, materialize


@dataclass(frozen=True)
class Rule:
    """A kind, the pattern whose leftmost non-overlapping matches are looked at, and the group and length that decide."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules. For hex, runs are maximal, so asking for 32 in the pattern finds the same runs.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
VERSION = "base-1"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _advance(kind: int, least: int):
    """The fold that turns lengths between and in matches into spans."""

    def step(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["judged"] >= least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return step


def spans_of(text: Column, rules: tuple[Rule, ...] = BASE) -> Column:
    """Spans ``struct<start, kind, end>`` (kind: the rule's index) sorted by start, then kind; code points, end exclusive."""
    found = []
    for k, r in enumerate(rules):
        matched = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        judged = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)) if r.group else matched
        between = F.split(text, r.pattern, -1)
        # zip pads with a last null match after the last piece
        rows = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(matched, F.length).alias("size"), F.transform(judged, F.length).alias("judged"))
        start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), SPAN).alias("out"))

        spans = F.aggregate(rows, start, _advance(k, r.least), lambda acc: acc["out"])
        found.append(F.when(F.regexp_like(text, F.lit(r.pattern)), spans).otherwise(F.from_json(F.lit("[]"), SPAN)))
    return F.array_sort(F.concat(*found))


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 bytes; null reads as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen(versions: DataFrame, text: str, version: str, ledger: DataFrame | None) -> DataFrame:
    """Distinct blobs (blob, text) that the ledger does not hold under this rule version. Copies meet in partial aggregates, so a blob of any number of copies moves once for each task."""
    t = F.coalesce(F.col(text), F.lit(""))
    addressed = versions.select(blob_of(F.col(text)).alias("blob"), t.alias("text"))
    if ledger is not None:
        addressed = addressed.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return addressed.groupBy("blob").agg(F.first("text").alias("text"))


def scan(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE, version: str = VERSION, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: blob, rule_version, spans (empty for clean blobs, so that they are not scanned again)."""
    new = unseen(versions, text, version, ledger)
    return new.select("blob", F.lit(version).alias("rule_version"), spans_of(F.col("text"), rules).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, version: str = VERSION, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("blob", "spans")) -> DataFrame:
    """All paths (the kept columns of versions) with the blob and its spans, under ``names`` (a kept column of such a name gives way); spans are empty where a blob has none. The ledger must be a written table. Only blobs with findings are joined: broadcast while they are few, else by a shuffle, where a blob of many paths is a skewed key whose partitions adaptive execution splits."""
    keep = [c for c in keep or [c for c in versions.columns if c != text] if c not in names]
    paths = versions.select(*keep, blob_of(F.col(text)).alias("__blob"))
    hits = ledger.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    out = paths.join(broadcast_if_small(hits), "__blob", "left")
    return out.select(*keep, F.col("__blob").alias(names[0]), F.coalesce("__spans", F.from_json(F.lit("[]"), SPAN)).alias(names[1]))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans are replaced together."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        inside = s["end"] + 1 <= acc["at"]
        overlaps = s["start"] + 1 < acc["at"]
        cut = F.concat(acc["out"], F.when(overlaps, F.lit("")).otherwise(F.concat(F.substring(text, acc["at"], s["start"] + 1 - acc["at"]), F.lit(mask))))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), F.when(inside, acc["out"]).otherwise(cut).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"], F.length(text)))))


def listed(spans: Column, rules: tuple[Rule, ...] = BASE) -> Column:
    """``kind:start:end`` comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


class Ledger:
    """Ledger rows in a shared folder, one sub-folder for each committed scan; a scan under a name that is there already is not run again."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        done = [f"{self.path}/{n}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return self.spark.read.schema(f"blob string, rule_version string, spans {SPAN}").parquet(*done) if done else None

    def commit(self, name: str, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE, version: str = VERSION) -> DataFrame:
        """Scan what this ledger has not seen, append it, and return all rows."""
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        if not mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
            scan(versions, text, rules, version, self.rows()).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.rows()


def scan_documents(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = BASE, names: tuple[str, str] = ("blob", "spans")) -> DataFrame:
    """Scan all documents against an empty ledger and give each its spans. The ledger rows are written first, as they serve every path."""
    return findings(docs, materialize(scan(docs, text, rules)), text=text, keep=keep, names=names)
