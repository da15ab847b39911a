"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is a run of L words of an item (L = 10, or the whole of a shorter item). Both sides keep the minimum k-gram
hash of every w = L - k + 1 consecutive k-grams (k = 5, or L if that is less). A window that occurs in a document
covers exactly w k-grams there, whose minimum both sides keep, so joining the kept fingerprints finds every document
that holds a window: none is missed. The hits are then extended in the documents found, by an equi-join of their
windows with those of the items on the hashes of their first and last k-gram, which cover all L words: 128 bits
together, or 64 for an item of at most k words, which is one k-gram.

Documents with equal texts are found once: a text is known by a 128-bit key, one row stands for it, and results are
joined back on the key.

Cases: null and empty texts have no words and no hits; items without words have no window; items repeat or share
windows freely; null item ids are not listed; repeated rows each get their text's result; empty tables work on
either side; other columns are not read, and of those that are kept, one that is
named as a column of the result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import broadcast_if_small, let, materialize, text_key

WINDOW = 10
GRAM = 5
#: Fixed value: what separates words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), "")


def word_count(text: Column) -> Column:
    """Size of :func:`words` without lower-casing, since a letter of either case is part of a word."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def _upto(n: Column) -> Column:
    """0 .. n-1; nothing if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(w: Column, k: int) -> Column:
    """Hash of every k consecutive words."""
    return let(w, lambda w: F.transform(_upto(F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(k)])))


def winnowed(g: Column, w: int) -> Column:
    """Distinct minima of every w consecutive hashes."""
    if w == 1:
        return F.array_distinct(g)
    return F.array_distinct(let(g, lambda g: F.transform(_upto(F.size(g) - (w - 1)), lambda i: F.least(*[F.get(g, i + d) for d in range(w)]))))


def windows(g: Column, length: int) -> Column:
    """Start and content (two hashes) of every window of so many words, from its k-gram hashes."""
    k = min(GRAM, length)
    row = lambda g, i: F.struct(F.lit(length).alias("len"), i.alias("at"), F.get(g, i).alias("p"), F.get(g, i + (length - k)).alias("q"))
    return let(g, lambda g: F.transform(_upto(F.size(g) - (length - k)), lambda i: row(g, i)))


def _fingerprint(covered: int):
    """Adds to a window the minimum of the k-gram hashes that it covers, from the row's array ``g``."""
    return lambda x: x.withField("f", F.array_min(F.slice(F.col("g"), x["at"] + 1, covered)))


def _labelled(length: int):
    return lambda f: F.struct(F.lit(length).alias("len"), f.alias("f"))


def item_windows(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(len, p, q, item, f): windows of the items with the fingerprints that any text holding them keeps."""
    items = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    out = None
    for length in range(1, window + 1):
        k = min(GRAM, length)
        of = items.filter(F.size("w") >= length if length == window else F.size("w") == length).withColumn("g", grams(F.col("w"), k))
        cut = F.transform(windows(F.col("g"), length), _fingerprint(length - k + 1))
        rows = of.select("item", F.inline(cut)).drop("at")
        out = rows if out is None else out.unionByName(rows)
    return out


def _merged(starts: Column) -> Column:
    """Number of positions covered by sorted intervals ``struct<at, len>``."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, s):
        stop = s["at"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], s["at"]))).alias("n"), F.greatest(acc["end"], stop).alias("end"))

    return F.aggregate(starts, begin, step, lambda a: a["n"])


def hits_by_text(docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(a, b, n_hit, items): one row for each distinct text that holds a window, under its key (:func:`text_key`)."""
    train = materialize(item_windows(bench, item, item_text, window).distinct())
    lengths = sorted(r["len"] for r in train.select("len").distinct().collect())  # at most ten values
    row_id = F.coalesce(F.col(doc).cast("string"), F.lit(""))
    base = docs.select(row_id.alias("id"), F.col(text).alias("t")).withColumn("k", text_key(F.col("t")))
    prints = broadcast_if_small(train.select(F.col("len"), F.col("f")).distinct())
    if not lengths:
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint, n_hit bigint, items array<string>")
    sizes = {k: [n for n in lengths if min(GRAM, n) == k] for k in sorted({min(GRAM, n) for n in lengths})}
    hashed = lambda rows: rows.select("*", words(F.col("t")).alias("w")).drop("t").select("*", *[grams(F.col("w"), k).alias(f"g{k}") for k in sizes]).drop("w")
    # 1. documents that keep a fingerprint of an item, in one pass
    kept = F.concat(*[F.transform(winnowed(F.col(f"g{k}"), n - k + 1), _labelled(n)) for k, of in sizes.items() for n in of])
    found = hashed(base.select("id", "k.a", "k.b", "t")).select("id", "a", "b", F.inline(kept)).join(prints, ["len", "f"], "left_semi").select("id", "a", "b")
    one = materialize(found.groupBy("a", "b").agg(F.min("id").alias("id")))
    # 2. their windows, each text once
    chosen = base.select("id", "k.a", "k.b", "t").join(broadcast_if_small(one), ["a", "b", "id"], "left_semi")
    cut = hashed(chosen).select("a", "b", F.inline(F.concat(*[windows(F.col(f"g{k}"), n) for k, of in sizes.items() for n in of])))
    known = train.groupBy("len", "p", "q").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = cut.join(broadcast_if_small(materialize(known)), ["len", "p", "q"])
    by_text = found.groupBy("a", "b").agg(F.collect_set(F.struct("at", "len")).alias("s"), F.collect_set("items").alias("i"))
    return by_text.select("a", "b", _merged(F.array_sort("s")).cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, keep: list[str], doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each document's kept columns with n_words, n_hit and items (ids as strings, sorted)."""
    hits = materialize(hits_by_text(docs, bench, doc, text, window=window)).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("n_hit").alias("__n_hit"), F.col("items").alias("__items"))
    keep = [c for c in keep if c not in ("n_words", "n_hit", "items")]
    key = text_key(F.col(text))
    rows = docs.select(*keep, key["a"].alias("__a"), key["b"].alias("__b"), word_count(F.col(text)).cast("bigint").alias("__n"))
    out = rows.join(broadcast_if_small(hits), ["__a", "__b"], "left")
    return out.select(*keep, F.col("__n").alias("n_words"), F.coalesce("__n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
