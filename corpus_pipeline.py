"""A corpus pipeline of five stages: language ID, MinHash near-dedup, benchmark decontamination, secret scans, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet
and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontam, lang_id, near_dedup, queries, secrets
from tidegate.llm._common import broadcast_if_small, materialize, scratch, shared_dir, table, text_key


#: Languages that stay; None: all that the labelled documents teach.
LANGUAGES: tuple[str, ...] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language (of LANGUAGES, if these are named) stay, those without a letter (``und``) go; a null ``lang`` becomes the language recognised."""
    shared_dir(spark)
    model = lang_id.train(docs)
    # a filter is not pushed below an explode, where it would predict once more
    found = docs.withColumn("__p", F.explode_outer(F.array(lang_id.predicted(F.col("text"), model)))).filter(F.col("__p.lang") != "und")
    if LANGUAGES is not None:
        found = found.filter(F.col("__p.lang").isin(*LANGUAGES))
    return found.select(*[F.coalesce("lang", "__p.lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates stays: one row of the class's least id and text."""
    found = materialize(near_dedup.classes(docs))
    own = F.col("a").eqNullSafe(F.col("ca")) & F.col("b").eqNullSafe(F.col("cb"))
    texts = found.groupBy("a", "b").agg(F.max(own).alias("own"), F.min("cv").alias("v"), F.count("*").alias("n"), F.count_if(F.col("v") == F.col("cv")).alias("same"))
    # only texts that have copies or are near ones: the others stay without being listed
    touched = materialize(texts.filter("n > 1 OR NOT own").select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.when(F.col("own"), F.col("v")).alias("__stay"), F.col("same").alias("__n")))
    key = near_dedup.address(F.col("text"))
    rows = docs.withColumns({"__v": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(near_dedup.LAST)), "__a": key["a"], "__b": key["b"]})
    out = rows.join(broadcast_if_small(touched), ["__a", "__b"], "left").filter("__n IS NULL OR __v = __stay")
    if not touched.filter("__n > 1 AND __stay IS NOT NULL").limit(1).count():
        return out.select(*docs.columns)
    # of rows of the same id and text, the least by all columns
    one = out.filter("__n > 1").groupBy("__v", "__a", "__b").agg(F.min(F.struct(*docs.columns)).alias("__r")).select("__r.*")
    return out.filter("coalesce(__n, 1) = 1").select(*docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    hits = decontam.hits_by_text(docs, table(spark, sf_dir, "benchmark"))
    hits = materialize(hits.select(F.col("a").alias("__a"), F.col("b").alias("__b")))
    key = text_key(F.col("text"))
    rows = docs.withColumns({"__a": key["a"], "__b": key["b"]})
    return rows.join(broadcast_if_small(hits), ["__a", "__b"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked."""
    found = secrets.scan_documents(docs.withColumns({"__text": F.col("text")}), [*docs.columns, "__text"], names=("__address", "__secrets"))
    text = secrets.redact(F.col("__text"), F.col("__secrets"))
    n = F.when(F.size("__secrets") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return found.select(*[text.alias("text") if c == "text" else n.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the texts that these decode to."""
    shared_dir(spark)
    return queries.bpe_digests(docs.withColumn("text", F.coalesce("text", F.lit(""))))


STAGES = [("language_id", language), ("near_dedup", near_dedup_stage), ("decontamination", decontaminate), ("secrets", redact_secrets), ("bpe", encode)]

#: Models and signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder. What a stage wrote on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
