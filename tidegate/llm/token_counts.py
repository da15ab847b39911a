"""Delta-maintained token counts by source, language and tokenizer version.

Changes arrive in batches of signed rows: an insert adds (+1 document, +tokens), a delete takes both away, a revised
count takes the old tokens away and adds the new ones. Within a batch the rows are summed to one signed delta for
each (source, language, tokenizer version), and only these few rows are committed, into a folder named after the
batch. A batch that is there already is not written again, so a replayed commit changes nothing, and a writer that
died half-way leaves a folder without its _SUCCESS mark, which is ignored and overwritten by the retry. Totals are the
sums over the committed deltas; groups whose documents and tokens both come to zero vanish.

Cases: null texts count 0 tokens and 1 document; null sources and languages form groups of their own; repeated rows
count each time; an empty batch commits no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe
from tidegate.llm._common import scratch_path, shared_dir

DELTA = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint, d_chars bigint"
KEYS = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """One row for each document and tokenizer version: source, lang, tokenizer, tokens, chars. ``tokenizers`` has a tokenizer file's text by version; the version ``words-1`` with no text counts runs of other than white space."""
    base = docs.select("source", "lang", "text")
    versions = []
    for name, spec in tokenizers.items():
        n = bpe.count(F.col("text"), spec) if spec else F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))
        versions.append(F.struct(F.lit(name).alias("tokenizer"), n.cast("bigint").alias("tokens")))
    sized = base.select("source", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"), F.array(*versions).alias("v"))
    return sized.select("source", "lang", "chars", F.inline_outer("v"))  # for inline the optimiser adds a filter that counts once more


def inserts(rows: DataFrame) -> DataFrame:
    """Signed deltas of counted rows that are new."""
    return rows.select(*KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("tokens").alias("d_tokens"), F.col("chars").alias("d_chars"))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed deltas of counted rows that are gone."""
    return rows.select(*KEYS, F.lit(-1).cast("bigint").alias("d_docs"), (-F.col("tokens")).alias("d_tokens"), (-F.col("chars")).alias("d_chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed deltas of counted rows whose count, source or language changed."""
    return deletes(old).unionByName(inserts(new))


def rolled(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"), F.sum("d_chars").alias("d_chars"))


class Rollup:
    """Committed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, batch: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Commit a batch once; False if it is there already. One row per group, so one file is enough."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._there(batch):
            return False
        rolled(deltas).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """Documents, tokens and characters of each group over the committed batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        paths = [f"{self.path}/{x}" for x in found if x.startswith("batch=") and self._there(x[6:])]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rolled(rows).select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"), F.col("d_chars").alias("n_chars"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], batch: str = "all", path: str | None = None) -> DataFrame:
    """Commit documents as one batch of inserts and return the totals. Without a path the roll-up goes when the application ends."""
    spark = docs.sparkSession
    shared_dir(spark)
    store = Rollup(spark, path or scratch_path(spark))
    store.commit(batch, inserts(counted(docs, tokenizers)))
    return store.totals()
