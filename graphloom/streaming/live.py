"""Structured Streaming over the event table: windows, sessions, duplicates, limits, incremental upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Fixed value: how many messages a session keeps.
RING = 40
#: Horizon for a table replayed whole, whose files may come in any order: no row is late.
WHOLE = "36500 days"


def events(spark: SparkSession, sf_dir: str, per_trigger: int = 64) -> DataFrame:
    """The event files as a stream, with event time."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", per_trigger).parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    got = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("day"), "event_type", "n")


def sessions(stream: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], late: str = "60 days") -> DataFrame:
    """First of equal keys within the horizon; state older than it is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_flags(stream: DataFrame, limit: int, size: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests per client and window, and whether they pass the limit."""
    got = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("blocked"))


def session_totals(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Per user the number of messages so far, with a ring of the last RING event ids as state that ends when event time is a day past its last message."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, ring, last = *(state.get if state.exists else (0, [])), 0
        for pdf in parts:
            ids = pdf.sort_values(["ts", "event_id"])["event_id"].tolist()
            n, ring = n + len(ids), (list(ring) + ids)[-RING:]
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((n, ring))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [ring[-1] if len(ring) else None]})

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last long", "n long, ring array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_each(stream: DataFrame, merge: Callable[[DataFrame, int], None], folder: str):
    """Run merge on each micro-batch until the input that is there is used up; batches replay with the same number."""
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/offsets-{uuid.uuid4().hex}").trigger(availableNow=True).outputMode("update").start()
    query.awaitTermination()
    return query


def run_once(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """What the stream gives for the input that is there: a table in the shared folder, one part per micro-batch.

    A part is overwritten when its batch is replayed; in complete mode only the last one counts.
    """
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-offsets").trigger(availableNow=True).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
