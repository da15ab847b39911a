"""Uniform sharding by a hypergeometric communication matrix, in DataFrame functions only.

A uniformly random order of N rows, cut into shards whose sizes are fixed beforehand, sends from each block of rows a
random number to each shard: these numbers follow the multivariate hypergeometric law. So the matrix of block to
shard counts is drawn exactly (on the driver; it has one row of counts for each block, not for each row of data),
rows are permuted within their block and dealt to shards by the drawn counts, exchanged, and permuted again within
their shard. Every row then has a shard and a gapless slot, sizes are at most one apart, and the order is uniform.

Blocks and the sub-ranges in which a shard is permuted grow in number with the rows, so that a task sorts BLOCK_ROWS
rows on average (a few numbers each, no texts); beyond MOST_BLOCKS blocks, at 13e9 rows, blocks grow instead, since
the driver draws a row of counts for each. Rows equal in id and text are told apart by a number, so that they spread
over blocks however many they are. All random choices come from hashes of the row's content and that number under a
seed, so a retried task decides as before.

Cases: null ids and null texts are values like others; rows equal in id and text are interchangeable and get slots of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm._common import materialize

#: Rows of a block, and of a sub-range of a shard, on average.
BLOCK_ROWS = 200_000
#: Bounds on the number of blocks: the matrix that the driver draws and every task gets has one row for each.
LEAST_BLOCKS, MOST_BLOCKS = 64, 65_536
#: Copies of a row that one task numbers at a time.
COPIES = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good. The ratio-of-uniforms method for large counts, inversion from the mode's side for small ones; any size that a float's log-gamma resolves."""
    total = good + bad
    if draws <= 0 or good <= 0:
        return 0
    if draws >= total:
        return good
    if bad <= 0:
        return draws
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    if 2 * draws > total:
        return good - hypergeometric(rng, good, bad, total - draws)
    if min(good, draws) <= 20:
        picked, left = 0, total
        g = good if draws <= good else draws  # symmetric in good and draws
        for _ in range(min(good, draws)):
            if rng.random() * left < g - picked:
                picked += 1
            left -= 1
        return picked
    p = good / total
    mean = draws * p
    sd = math.sqrt((total - draws) * draws * p * (1 - p) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    lg = math.lgamma
    mode = (draws + 1) * (good + 1) // (total + 2)
    weight = lambda k: lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1)
    top, last = weight(mode), min(min(draws, good) + 1, math.floor(mean + 0.5 + 16 * sd))
    while True:
        u = rng.random()
        if not u:
            continue
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if 0 <= k < last and 2 * math.log(u) <= top - weight(k):
            return k


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts from each block to each shard, with row sums ``sizes`` and column sums at most one apart."""
    rng, n = random.Random(seed), sum(sizes)
    open_ = [n // shards + (s < n % shards) for s in range(shards)]
    out, left = [], n
    for size in sizes:
        row, need, rest = [], size, left
        for s in range(shards):
            k = hypergeometric(rng, open_[s], rest - open_[s], need)
            rest -= open_[s]
            need -= k
            row.append(k)
        open_ = [o - k for o, k in zip(open_, row, strict=True)]
        left -= size
        out.append(row)
    return out


def assign(rows: DataFrame, shards: int = 16, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have a column ``__h`` (any 64-bit hash of their content)."""
    spark = rows.sparkSession
    total = rows.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(total / block_rows)))
    local = F.xxhash64(F.lit(seed), "__h")
    dealt = rows.withColumns({"__b": F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(blocks)).cast("int"), "__r": local})
    sizes = {r["__b"]: r["n"] for r in dealt.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    drawn = matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    ends = [(b, [sum(row[: s + 1]) for s in range(shards)]) for b, row in enumerate(drawn)]
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"b": b, "e": e} for b, e in ends])), "array<struct<b:int,e:array<bigint>>>")).alias("x")).select(F.col("x.b").alias("__b"), F.col("x.e").alias("__ends"))
    # permute locally, then deal: the shard of local rank r is the first whose running count exceeds r
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__b").orderBy("__r", "__h")) - 1)
    sent = ranked.join(F.broadcast(plan), "__b").withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
    # exchange and permute again: sub-ranges of a fresh hash, each sorted by it, one after another
    subs = max(8, math.ceil(total / shards / block_rows))
    again = F.xxhash64(F.lit(seed + 2), "__h", "__rank", "__b")
    placed = sent.drop("__ends", "__r").withColumn("__o", again).withColumn("__sub", F.floor((F.col("__o") / F.lit(2.0**64) + 0.5) * subs).cast("int"))
    placed = materialize(placed.drop("__b", "__rank"))
    counts = placed.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    before = counts.select("shard", "__sub", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    ordered = placed.withColumn("__k", F.row_number().over(Window.partitionBy("shard", "__sub").orderBy("__o", "__h")) - 1)
    return ordered.join(before, ["shard", "__sub"]).withColumn("slot", (F.col("__before") + F.col("__k")).cast("bigint")).drop("__o", "__sub", "__k", "__before", "__h")


def spread(rows: DataFrame) -> DataFrame:
    """Rows with a column ``__h`` that is the same for equal rows, to rows in which it differs: equal rows are counted, and come out again under the hash of their number."""
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")))
    parts = counted.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / COPIES))))
    if counted.filter(F.col("__n") > COPIES).limit(1).count():
        parts = parts.repartition("__h", "__c")
    numbers = F.sequence(F.col("__c") * COPIES, F.least(F.col("__n"), (F.col("__c") + 1) * COPIES) - 1)
    return parts.withColumn("__i", F.explode(numbers)).withColumn("__h", F.xxhash64("__h", "__i")).select(*rows.columns)


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``). Texts are read once and do not move."""
    raw = utf8(F.col(text))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(F.col(key), F.col(text)).alias("__h"))
    out = assign(materialize(spread(rows)), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write rows shard by shard in slot order, as ``shard=N`` folders. Ids must be unique."""
    named = assigned.select(F.col("doc_id").alias("__id"), F.col("shard").alias("shard"), F.col("slot").alias("slot"))
    rows = docs.join(named, docs[key] == F.col("__id")).drop("__id")
    rows.repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS)).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
