"""Structured Streaming jobs: event-time counters, deduplication, sessions, rate limits, micro-batch upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.io import is_folder, make_folder, shared_checkpoints


def read(spark: SparkSession, folder: str, name: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """A stream over a stored table, which is a file or a folder of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", f"{name}*").parquet(folder)


def hourly_counts(events: DataFrame, ts: str, *keys: str, late: str = "7 days") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, ts: str, key: str, ttl: str | None = "7 days") -> DataFrame:
    """Each key once within the time to live; once at all, however late, without one (the state then holds every key)."""
    if ttl is None:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def limiter(allowed: int, window_s: float, block_s: float) -> Callable:
    """The rule of one key: state (count, window end, blocked until), time -> (new state, accepted).

    A window starts at its first message; too many block the key, and the message that ends a block counts as the first.
    """
    def step(state, at: float):
        n, end, blocked = state
        if blocked and at < blocked:
            return state, False
        if blocked or at >= end:
            return (1, at + window_s, 0.0), True
        if n + 1 > allowed:
            return (n + 1, end, at + block_s), False
        return (n + 1, end, 0.0), True

    return step


def limited(events: DataFrame, key: str, ts: str, allowed: int = 100, window_s: float = 30, block_s: float = 300, late: str = "1 hour") -> DataFrame:
    """(key, accepted, rejected) per key and batch; keyed state on a stream, which a key keeps until its window and block are over."""
    step = limiter(allowed, window_s, block_s)
    kind = events.schema[key].dataType.simpleString()

    def fold(k, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0.0, 0.0)
        ok = bad = 0
        for f in frames:
            for at in sorted(f["at"]):
                now, good = step(tuple(now), at)
                ok, bad = ok + good, bad + (not good)
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(int(1000 * (max(now[1], now[2]) + window_s + block_s)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "accepted": [ok], "rejected": [bad]})

    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("_t")).withWatermark("_t", late)
    e = e.select(key, "_t", (F.unix_micros("_t").cast("double") / 1e6).alias("at"))
    return e.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, accepted long, rejected long", "n long, until double, blocked double", "update", "EventTimeTimeout")


def batch_writer(folder: str, whole: bool = False) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number: one that is run again replaces itself, so that no row comes twice. whole: each batch is the whole result."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'whole' if whole else number}")

    return write


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table in the shared folder, and reads that."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    q = df.writeStream.outputMode(mode).foreachBatch(batch_writer(f"{base}/out", mode == "complete")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    make_folder(spark, f"{base}/out")  # a stream without rows has written none
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def upsert_each_batch(stream: DataFrame, key: str, order: Column, sink: Callable[[DataFrame], None], checkpoint: str):
    """Micro-batches of latest rows per key handed to a sink; a failed batch is replayed from the checkpoint."""
    def write(batch: DataFrame, _: int) -> None:
        from fathomline.io import latest

        sink(latest(batch, key, order))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
