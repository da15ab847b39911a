"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.session import ship_package, table  # noqa: F401

#: Most bytes and rows that a side may have to be broadcast; beyond either the join shuffles.
BROADCAST_BYTES, BROADCAST_ROWS = 64_000_000, 500_000

#: Rows of an Arrow batch, at most: batches of texts are held by the executor and by its Python workers at once.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500

#: Tables that ``materialize`` wrote and nothing has deleted yet.
_WRITTEN: list[str] = []

#: The temporary folder of a local application that names no shared one; the setting itself cannot be changed in a session.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names. A session without one gets a temporary folder, on a local master only."""
    ship_package(spark)
    if int(spark.conf.get(ARROW_ROWS, "10000")) > BATCH_ROWS:  # texts can be long
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
        import tempfile

        path = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidegate-")
        _LOCAL[spark.sparkContext.applicationId] = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark).rstrip('/')}/tidegate/{sc.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(at):
        fs.deleteOnExit(at)
    return f"{top}/{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to a table in the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession)
    out = _write(df, path)
    _WRITTEN.append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete what is materialised inside at the end; only tables written by the function that this yields stay."""
    first = len(_WRITTEN)
    try:
        yield lambda df: _write(df, scratch_path(df.sparkSession))
    finally:
        for path in _WRITTEN[first:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _WRITTEN[first:]


def _bytes(kind: T.DataType, value: Column | None) -> Column | int:
    """About how many bytes a value takes in memory; an int if all values of the type take the same."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        inner = _bytes(kind.elementType, None) if not isinstance(kind.elementType, (T.StringType, T.BinaryType)) else 64
        return F.greatest(F.size(value), F.lit(0)) * F.lit(inner) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, None if value is None else value[f.name]) for f in kind.fields), 16)
    return 16


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a materialised frame whose counted rows and bytes stay under the bounds; else leave the join to shuffle."""
    widths = [_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields]
    fixed, varying = sum((w for w in widths if isinstance(w, int)), 16), [w for w in widths if not isinstance(w, int)]
    rows = min(rows, size // fixed)
    if not varying:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
    found = df.agg(F.count("*").alias("n"), F.sum(sum(varying, F.lit(fixed)).cast("bigint")).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["b"] or 0) <= size else df.hint("merge")


def text_key(col):
    """A 128-bit content address of a text, as two longs in a struct."""
    return F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit(0x7465787431), col).alias("b"))


def let(value, body):
    """``body`` of a value that is computed once: inside a lambda, a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
