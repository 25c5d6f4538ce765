"""Token ids in Parquet list columns.

Rows are dealt by ranges of doc_id and sorted, tokenised, and written by Spark's
Parquet writer with format version 2 pages: id lists and numbers in dictionary
or delta encoding, row groups and pages of a set size, and the column and offset
indexes that let readers skip pages by doc_id and read metadata without tokens.
Each row carries its file's range number and its first id's place within it, so a
prefix sum over one total a range gives global places.

Defined cases: a null text is empty and yields the end id alone; a text of any
length is encoded whole and is one row; rows with equal doc_id, null included, keep
an order by a hash of their texts, then the texts, so repeated rows stand side by
side; a null doc_id sorts first; an empty table gives an empty table.  Only doc_id
and text are read, so other columns may have any names.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

#: Parquet settings: bytes of a row group and a page, rows of a page, writer version.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(1 << 20), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
END_ID = 0
STORED = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int = END_ID) -> None:
    """Write doc_id, part, start_in_part, n_tokens and tokens in ascending doc_id order."""
    C.ship(docs.sparkSession)

    def run(batches):
        enc, part, place = encoder(vocab), TaskContext.get().partitionId(), 0
        for batch in C.pieces(batches, 2048):
            ids = enc.encode(batch.column(1))
            n = np.array([len(x) + 1 for x in ids], np.int64)
            flat = np.full(int(n.sum()), end_id, np.int32)
            ends = np.cumsum(n)
            for x, e in zip(ids, ends.tolist(), strict=True):
                flat[e - 1 - len(x) : e - 1] = x
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(place + ends - n), pa.array(n), lists], ["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
            place += int(ends[-1]) if len(ends) else 0

    rows, key = docs.select("doc_id", "text"), [F.col("doc_id")]
    if not rows.where(F.col("doc_id").isNull()).isEmpty():  # these would all be of one range
        key.append(F.xxhash64("text"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, STORED).write.options(**LAYOUT).parquet(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the files."""
    stored = spark.read.schema(STORED).parquet(path)
    # one row a range: the ids of all ranges before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def check(batches):
        for batch in C.pieces(batches, 2048):
            lists = batch.column(3)
            flat, at = np.asarray(lists.values).astype("<u4"), lists.offsets.to_numpy()
            raw = memoryview(flat).cast("B") if len(flat) else b""
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array([crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    got = stored.select("doc_id", "part", "start_in_part", "tokens").mapInArrow(check, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(totals), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")  # a row for each shuffle partition


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "tokens")
    write_tokens(C.documents(spark, sf_dir), path, vocabulary())
    return read_digest(spark, path)
