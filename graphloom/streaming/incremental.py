"""Incremental load: new documents to a knowledge graph, batch by batch, exactly once.

Each micro-batch is cleaned, judged and shredded to triples, and written as two parts of tables
that carry the batch's number: its documents (one row for each text, with the first and last
mention and how many) and the triples of texts that no earlier batch had.  A batch that is run
again overwrites its own parts and reads those of earlier batches only, so a job killed half way
leaves nothing double.  The graph is a view over the parts: every measure in it is a minimum,
maximum or sum over mentions, so it doesn't depend on how files are dealt to batches or in which
order they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "digest string, head string, seq long, last long, n long, reason string"
TRIPLES = "digest string, head string, rel string, tail string, confidence double"


def window_seconds(since: str) -> int:
    """Seconds of a window written as 90m, 12h, 7d or 2w; a bare number is days."""
    unit = {"m": 60, "h": 3600, "d": 86400, "w": 604800}
    text = since.strip().lower()
    number, per = (text[:-1], unit[text[-1]]) if text[-1:] in unit else (text, 86400)
    return int(float(number) * per)


def recent(docs: DataFrame, column: str, since: str, now: Column | None = None) -> DataFrame:
    """Rows of the window that ends now; rows without a time are of no window."""
    end = F.current_timestamp() if now is None else now
    return docs.where(F.col(column).cast("timestamp") > F.timestamp_seconds(F.unix_seconds(end.cast("timestamp")) - window_seconds(since)))


class GraphLoad:
    """A load into the folder `path`: `clean` gives the text to keep, `reason` its verdict ('ok' stays), `triples` its rel, tail and confidence."""

    def __init__(self, spark: SparkSession, path: str, clean: Callable[[Column], Column], reason: Callable[[Column], Column], triples: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.clean, self.reason, self.triples = spark, path, clean, reason, triples

    def _parts(self, name: str, schema: str) -> DataFrame:
        """All parts of a table with their batch; empty before the first one."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def merge(self, batch: DataFrame, number: int) -> None:
        """One batch of rows head, seq (order or time of the mention) and text."""
        text = self.clean(F.coalesce("text", F.lit("")))
        rows = batch.select("head", "seq", text.alias("text")).withColumn("digest", F.md5(F.concat_ws("\n", F.coalesce("head", F.lit("")), "text")))
        each = rows.groupBy("digest").agg(F.first("head").alias("head"), F.first("text").alias("text"), F.min("seq").alias("seq"), F.max("seq").alias("last"), F.count("*").alias("n"))
        held = f"{self.path}/held/batch={number}"
        each.withColumn("reason", self.reason(F.col("text"))).write.mode("overwrite").parquet(held)
        each = self.spark.read.parquet(held)
        each.select("digest", "head", "seq", "last", "n", "reason").write.mode("overwrite").parquet(f"{self.path}/documents/batch={number}")
        before = self._parts("documents", DOCUMENTS).where(F.col("batch") < number).select("digest")
        new = each.where("reason = 'ok'").join(before, "digest", "left_anti")
        self.triples(new).select("digest", "head", "rel", "tail", "confidence").write.mode("overwrite").parquet(f"{self.path}/triples/batch={number}")

    def run(self, stream: DataFrame) -> None:
        """Take in what the stream's source has now; the next call goes on from there, in this process or another."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.path}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()

    def documents(self) -> DataFrame:
        """digest, head, first and last mention, mentions, and the verdict of every text so far."""
        seen = self._parts("documents", DOCUMENTS)
        return seen.groupBy("digest").agg(F.first("head").alias("head"), F.min("seq").alias("seq"), F.max("last").alias("last"), F.sum("n").alias("n"), F.first("reason").alias("reason"))

    def graph(self) -> DataFrame:
        """source, rel, target: the highest confidence, first and last mention, and how many texts state it."""
        each = self._parts("triples", TRIPLES).drop("head", "batch").distinct()
        at = each.join(self.documents().where("reason = 'ok'"), "digest")
        edges = at.groupBy(F.col("head").alias("source"), "rel", F.col("tail").alias("target"))
        return edges.agg(F.max("confidence").alias("confidence"), F.min("seq").alias("created"), F.max("last").alias("updated"), F.count_distinct("digest").alias("texts"))

    def counters(self) -> DataFrame:
        """Texts and mentions by verdict."""
        return self.documents().groupBy("reason").agg(F.count("*").alias("texts"), F.sum("n").alias("mentions"))
