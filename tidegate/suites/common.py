"""Derived tables that the queries share, and the SQL twins of small expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.text import to_bytes
from tidegate.session import ship_package, spread, table
from tidegate.sources import transactions as tx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return run

    return put


def document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.text as argument q: (tx_id, value_seq, arrived, target, key, data, inert)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("tx_id"), F.lit(0).alias("value_seq"), F.lit(1).alias("arrived"), F.lit("ARGS").alias("target"), F.lit("q").alias("key"), to_bytes(F.col("text")).alias("data"), F.lit(False).alias("inert"))


def page_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as GET requests with their html as response."""
    p = spread(table(spark, sf_dir, "pages"))
    return tx.transactions(p.select(F.col("page_id").alias("tx_id"), to_bytes(tx.url_target(F.col("url"))).alias("target"), F.lit(200).alias("response_status"), F.encode("html", "UTF-8").alias("response_body")))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as POST requests whose JSON body is props."""
    e = spread(table(spark, sf_dir, "events"))
    head = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("application/json").alias("value")))
    return tx.transactions(e.select(F.col("event_id").alias("tx_id"), "ts", F.lit("POST").alias("method"), F.lit("/events").alias("target"), head.alias("headers"), F.encode("props", "UTF-8").alias("body")))


def words_sql(items) -> str:
    """A SQL list of strings."""
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The target of pages.url, in SQL.
TARGET = "(CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END)"
URLS = f"u AS (SELECT page_id, {TARGET} AS target FROM (SELECT page_id, split_part(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#', 1) AS r FROM pages))"
