"""Live traffic: the same plans on streams, chunked response bodies, and telemetry in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.analytics import snapshot
from tidegate.operators.decide import all_decisions, decide
from tidegate.operators.match import match
from tidegate.plans.model import Plan, RuleError, compile_rules, rules_from_frame
from tidegate.session import scratch_folder
from tidegate.sources.transactions import MAX_BODY, explode_values

CHUNK = "tx_id bigint, seq int, last boolean, data binary, ts timestamp"


def hits_stream(tx: DataFrame, plan: Plan) -> DataFrame:
    """Hits of a stream of transactions: a stateless map, every row being a whole transaction."""
    return match(explode_values(tx), plan)


ASSEMBLED = "tx_id bigint, body binary, status string"
#: What is kept of a body whose chunks are still coming; ``done`` holds nothing but that chunks are to be ignored.
OPEN = "size bigint, last int, done boolean, seqs array<int>, data array<binary>"


def assembled(chunks: DataFrame, watermark: str = "10 minutes", timeout: str = "5 minutes", max_body: int = MAX_BODY) -> DataFrame:
    """Bodies of chunked responses (CHUNK): tx_id, body, status (ok, limit_exceeded, unfinished). Chunks may come in any order and more than once; late chunks beyond the watermark are dropped. On a stream a body comes out as soon as it is whole or over the limit, or when no chunk came for the timeout, and its state never holds more than the limit; a table is grouped in sessions."""
    if chunks.isStreaming:
        return _assembled_stream(chunks, watermark, timeout, max_body)
    part = F.struct("seq", "last", "data")
    g = chunks.groupBy("tx_id", F.session_window("ts", timeout).alias("w"))
    # the size comes first, so that the chunks of a body over the limit are not gathered
    sized = g.agg(F.sum(F.octet_length("data")).alias("size"))
    small = chunks.join(sized.filter(F.col("size") <= max_body).select("tx_id").distinct(), "tx_id", "left_semi")
    rows = small.groupBy("tx_id", F.session_window("ts", timeout).alias("w")).agg(F.array_sort(F.collect_set(part)).alias("parts"), F.sum(F.octet_length("data")).alias("size")).filter(F.col("size") <= max_body)
    whole = (F.size("parts") == F.element_at("parts", -1)["seq"] + 1) & F.element_at("parts", -1)["last"]
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")
    rows = rows.select("tx_id", F.unhex(hexed).alias("body"), F.when(whole, "ok").otherwise("unfinished").alias("status"))
    over = sized.filter(F.col("size") > max_body).select("tx_id", F.lit(None).cast("binary").alias("body"), F.lit("limit_exceeded").alias("status"))
    return rows.unionByName(over)


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def _assembled_stream(chunks: DataFrame, watermark: str, timeout: str, max_body: int) -> DataFrame:
    import pandas as pd

    wait = _milliseconds(timeout)

    def step(key, batches, state):
        size, last, done, held = 0, -1, False, {}
        if state.exists:
            size, last, done, seqs, data = state.get
            held = dict(zip(seqs, data, strict=True))
        out = lambda body, status: pd.DataFrame({"tx_id": [key[0]], "body": [body], "status": [status]})
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield out(b"".join(held[k] for k in sorted(held)), "unfinished")
            return
        latest = 0
        for batch in batches:
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            for seq, ends, data in zip(batch["seq"], batch["last"], batch["data"], strict=True):
                if done or int(seq) in held:
                    continue
                size += len(data)
                if size > max_body:
                    done, held = True, {}
                    yield out(None, "limit_exceeded")
                    continue
                held[int(seq)] = bytes(data)
                if ends:
                    last = int(seq)
        if not done and last >= 0 and len(held) == last + 1:
            yield out(b"".join(held[k] for k in range(last + 1)), "ok")
            done, held = True, {}
        seqs = sorted(held)
        state.update((size, last, done, seqs, [held[k] for k in seqs]))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait)

    rows = chunks.withWatermark("ts", watermark).groupBy("tx_id")
    return rows.applyInPandasWithState(step, ASSEMBLED, OPEN, "append", "EventTimeTimeout")


def windowed_telemetry(decisions: DataFrame, ts: str = "ts", watermark: str = "10 minutes", size: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Telemetry counters in tumbling (or, with a slide, sliding) windows of event time."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = decisions.withWatermark(ts, watermark) if decisions.isStreaming else decisions
    return snapshot(rows, [w.alias("w")]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "blocked", "allowed", "exhausted", "errors", "undeclared")


def session_telemetry(decisions: DataFrame, key: str, ts: str = "ts", gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Counters of sessions of a key."""
    rows = decisions.withWatermark(ts, watermark) if decisions.isStreaming else decisions
    return snapshot(rows, [F.col(key), F.session_window(ts, gap).alias("w")]).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "blocked")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over the input there is and return what it made, as a written table: results go from the executors to files, none through the driver."""
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark)}/{name}"
    out, writer = f"{folder}/rows", stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(out)
    else:  # of a whole result, each batch replaces the one before
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)


def ruled(rules: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], **how) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: decisions of a batch of transactions under the rules that their table holds now. The table is read again for each batch, so a changed rule set counts from the next batch on; one that does not compile leaves the last good one in place."""
    kept: dict[str, Plan] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            kept["plan"] = compile_rules(rules_from_frame(rules()))
        except RuleError:
            if "plan" not in kept:
                raise
        write(all_decisions(batch, decide(match(explode_values(batch), kept["plan"]), **how)), batch_id)

    return run


def to_sinks(stream: DataFrame, checkpoint: str, *writers) -> object:
    """Several writers of each micro-batch, each a function (frame, batch id); rows are kept while they run."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
