"""Substring deduplication by sliding sentence spans.

A text is cut into sentences. A span is a run of several consecutive sentences: from every sentence on, the shortest
run of at least two sentences and WORDS words, and likewise up to every sentence, so that all sentences of a repeated
passage are covered whatever surrounds it. A lone sentence of LONE words is a span too, and so is a whole text that is
one sentence of WORDS words. Where no white space parts words, two characters count as a word. Spans are hashed over their normalised sentences and joined globally: the
document of least id that has a span keeps it, as does the first place within a document; the sentences of every other
occurrence are removed. What is left of a text is left as it is, character for character.

A document is an id with a text: ids only order the documents, and texts that share an id come in the order of their
content address. Rows of the same id and text are copies, of which one counts as the first.

Cases: null texts stay null and empty texts empty; a text without a removed sentence is returned unchanged; exact
copies of WORDS words lose all sentences (shorter ones stay) but keep their row, with an empty text (white space goes with the sentence before it); rows
that share an id, or have none, are documents of their own; null ids come after all others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import broadcast_if_small, materialize, shared_dir, text_key

#: Least sentences and words of a span, and least words of a sentence that is a span alone.
SENTENCES, WORDS, LONE = 2, 12, 24
#: Runs (two integers each) up to which they are broadcast.
BROADCAST_RUNS = 1_000_000
#: A sentence ends after closing punctuation that white space follows (or, in scripts without spaces, anything), or at a line's end; it takes the white space after it.
SENTENCE = regex.compile(r"[^\n]*?(?:[.!?。！？]+(?:(?<=[。！？])[\"'”’)\]」』）】》]*|[\"'”’)\]]*(?=\s))[^\S\n]*\n*|\n+|\Z)")
#: Letters of scripts that put no white space between words.
UNSPACED = re.compile("[ก-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U000323af]")
SPAN = "array<struct<h:bigint,i:int,j:int,first:boolean>>"
STRUCT = pa.struct([("h", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("first", pa.bool_())])


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised sentence, words) of every sentence; they cover the text."""
    out, spaced = [], text.isascii() or not UNSPACED.search(text)
    for m in SENTENCE.finditer(text):
        if m.end() > m.start():
            words = m.group().lower().split()
            if not words and out:  # white space alone belongs to the sentence before
                a, _, s, n = out[-1]
                out[-1] = (a, m.end(), s, n)
            else:
                out.append((m.start(), m.end(), " ".join(words), len(words) if spaced else len(words) + len(UNSPACED.findall(m.group())) // 2))
    return out


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(hash, first sentence, end sentence, whether this is its first place here) of the spans of a text."""
    found = sentences(text)
    n = len(found)
    runs = {(i, i + 1) for i in range(n) if found[i][3] >= (LONE if n > 1 else WORDS)}
    total, j = 0, 0
    for i in range(n):  # forward: shortest run from i
        while j < n and (j - i < SENTENCES or total < WORDS):
            total += found[j][3]
            j += 1
        if j - i >= SENTENCES and total >= WORDS:
            runs.add((i, j))
        total -= found[i][3]
    total, i = 0, n
    for j in range(n, 0, -1):  # backward: shortest run up to j
        while i > 0 and (j - i < SENTENCES or total < WORDS):
            i -= 1
            total += found[i][3]
        if j - i >= SENTENCES and total >= WORDS:
            runs.add((i, j))
        total -= found[j - 1][3]
    seen, out = set(), []
    for i, j in sorted(runs):
        h = xxhash.xxh3_64_intdigest("\n".join([s[2] for s in found[i:j]])) - (1 << 63)
        out.append((h, i, j, h not in seen))
        seen.add(h)
    return out


def spans_column(text: Column) -> Column:
    """The spans of a text column as an array of structs; empty for null."""

    @F.arrow_udf(SPAN)
    def sentence_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            h, i, j, f, ends = [], [], [], [], [0]
            for t in batch.to_pylist():
                for a, b, c, d in spans(t) if t else ():
                    h.append(a), i.append(b), j.append(c), f.append(d)
                ends.append(len(h))
            flat = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(f, pa.bool_())], fields=list(STRUCT))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return sentence_spans(text)


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """A text without the sentences of runs (first, end), and how many these are."""
    gone = {k for i, j in runs for k in range(i, j)}
    found = sentences(text)
    return "".join([text[a:b] for k, (a, b, _, _) in enumerate(found) if k not in gone]), sum(k < len(found) for k in gone)


def copy_column(text: Column) -> Column:
    """struct<text, n_removed> of a text without any of its spans: what is left of a copy."""

    @F.arrow_udf("struct<text:string,n_removed:int>")
    def cut_copies(texts: pa.Array) -> pa.Array:
        kept = [without(t, [x[1:3] for x in spans(t)]) if t else (t, 0) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int32())], names=["text", "n_removed"])

    return cut_copies(text)


def cut_column(text: Column, runs: Column) -> Column:
    """struct<text, n_removed> of a text and its removed runs."""

    @F.arrow_udf("struct<text:string,n_removed:int>")
    def cut_sentences(texts: pa.Array, runs: pa.Array) -> pa.Array:
        kept = [(t, 0) if not t or not r else without(t, [(x["i"], x["j"]) for x in r]) for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int32())], names=["text", "n_removed"])

    return cut_sentences(text, runs)


def merged(runs: Column) -> Column:
    """Sorted runs (i, j) with overlapping and touching ones made one."""

    def step(acc, r):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["i"].alias("i"), F.greatest(last["j"], r["j"]).alias("j"))))
        return F.when((F.size(acc) > 0) & (last["j"] >= r["i"]), grown).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<i:int,j:int>>"), step)


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text without repeated spans, n_removed sentences."""
    shared_dir(docs.sparkSession)
    key = ["v", "a", "b"]
    address = text_key(F.col(text))
    base = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(doc).cast("bigint"), F.lit(2**63 - 1)).alias("v"), address["a"].alias("a"), address["b"].alias("b"), F.col(text).alias("text"))
    rows = materialize(base.select(*key, F.inline(spans_column(F.col("text")))))
    # a span's first document; partial sums make one row for each task of a span that is everywhere
    shared = rows.filter("first").groupBy("h").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).filter("lo < hi").select("h", "lo")
    later = rows.filter("first").join(shared, "h").filter(F.struct(*key) > F.col("lo")).select(*key, "h").distinct()
    # a span that goes here goes at each of its places; of one that stays, the places after the first go
    whole = rows.join(later, [*key, "h"], "left_semi").select(*key, "i", "j")
    again = rows.filter("NOT first").select(*key, "i", "j")
    spots = whole.unionByName(again).distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("runs"))
    runs = materialize(spots.select(*key, merged(F.col("runs")).alias("runs")))
    # the runs are broadcast only if all of them together are few; else texts and runs meet by a shuffle
    few = (runs.agg(F.sum(F.size("runs") + 4)).first()[0] or 0) <= BROADCAST_RUNS
    runs = F.broadcast(runs) if few else runs.hint("merge")
    copies = materialize(base.filter("text <> ''").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"))
    result = ["doc_id", F.col("c.text").alias("text"), F.col("c.n_removed").alias("n_removed")]
    if not copies.limit(1).count():
        return base.join(runs, key, "left").withColumn("c", cut_column(F.col("text"), F.col("runs"))).select(*result)
    copies = broadcast_if_small(copies)
    alone = base.join(copies, key, "left_anti").join(runs, key, "left").withColumn("c", cut_column(F.col("text"), F.col("runs")))
    # rows of the same id and text become one, which is cut as the first of them, and the others as copies
    one = materialize(base.join(copies, key).groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("n").alias("n")))
    first = one.join(runs, key, "left").withColumn("c", cut_column(F.col("text"), F.col("runs")))
    others = one.select("doc_id", copy_column(F.col("text")).alias("c"), "n").select("doc_id", "c", F.explode(F.sequence(F.lit(2), F.col("n"))))
    return alone.select(*result).unionByName(first.select(*result)).unionByName(others.select(*result))
