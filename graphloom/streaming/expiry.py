"""Streams whose state ends: first-seen keys within bounds, and a cache with an expiry.

State is kept by the stateful processor with a time to live or a bounded ring, so that it stops
growing with the stream's length.  Both need the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Most keys that duplicates are told by, keys kept when there are more, and a cached answer's life in seconds.
MOST, KEPT, LIFE = 200_000, 100_000, 86_400


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _FirstSeen(StatefulProcessor):
    """Keys of one shard in the order of their first mention; beyond `most` only the last `kept` stay known."""

    def __init__(self, most: int, kept: int):
        self.most, self.kept = most, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "at long")
        self.ring = handle.getMapState("ring", "at long", "key string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, nxt = self.ends.get() if self.ends.exists() else (0, 0)
        out = []
        for pdf in rows:
            for k, seq in sorted(zip(pdf["key"], pdf["seq"], strict=True), key=lambda x: (x[1], x[0])):
                if self.known.containsKey((k,)):
                    continue
                out.append((k, seq))
                self.known.updateValue((k,), (nxt,))
                self.ring.updateValue((nxt,), (k,))
                nxt += 1
                if nxt - first > self.most:
                    while nxt - first > self.kept:
                        self.known.removeKey(self.ring.getValue((first,)))
                        self.ring.removeKey((first,))
                        first += 1
        self.ends.update((first, nxt))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq"])

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, seq: str, shards: int = 16, most: int = MOST, kept: int = KEPT) -> DataFrame:
    """key and seq of rows whose key isn't known: state is at most `most` keys a shard, whatever the stream's length.

    Keys are dealt to shards by a hash, so a shard forgets a key once `kept` others have come
    after it there.  Within a micro-batch rows go by seq.
    """
    use_rocksdb(stream.sparkSession)
    each = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq")).where("key IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return each.groupBy("shard").transformWithStateInPandas(_FirstSeen(most, kept), "key string, seq long", "Append", "None")


class _Cache(StatefulProcessor):
    """When a key was last fetched; a request within its life is answered from the cache."""

    def __init__(self, life: int, ignored: frozenset[int]):
        self.life, self.ignored = life, ignored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fetched = handle.getValueState("fetched", "at double")
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        at = self.fetched.get()[0] if self.fetched.exists() else None
        for t, request, status in sorted((x for pdf in rows for x in zip(pdf["at"], pdf["request"], pdf["status"], strict=True)), key=lambda x: x[:2]):
            hit = at is not None and at <= t < at + self.life
            if not hit and status not in self.ignored:
                at = t
            out.append((key[0], request, hit))
        if at is not None:
            self.fetched.update((at,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((at + self.life) * 1000))
        yield pd.DataFrame(out, columns=["key", "request", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fetched.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached(stream: DataFrame, key: str, time: str, request: str, status: str | None = None, late: str = "1 day", life: int = LIFE, ignored: tuple[int, ...] = (429, 500, 502, 503, 504)) -> DataFrame:
    """key, request and hit: whether a request is answered by one of the same key fetched less than `life` seconds before.

    Answers of an ignored status aren't kept.  A timer clears a key once event time passes its
    life, so the state holds the keys of one life and the lateness only.
    """
    use_rocksdb(stream.sparkSession)
    code = F.coalesce(F.col(status).cast("int"), F.lit(200)) if status else F.lit(200)
    each = stream.withWatermark(time, late).where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(F.col(time)).cast("double").alias("micros"), F.col(request).cast("long").alias("request"), code.alias("status"))
    return each.withColumn("at", F.col("micros") / 1e6).groupBy("key").transformWithStateInPandas(_Cache(life, frozenset(ignored)), "key string, request long, hit boolean", "Append", "EventTime")
