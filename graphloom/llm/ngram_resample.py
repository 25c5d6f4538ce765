"""Importance resampling towards a target, over n-grams coded by an integer word dictionary.

A task takes its texts in blocks of bounded bytes.  In a block distinct words get integer ids,
n-grams are tuples of ids (one integer, the ids as its digits), and the bytes of each distinct
tuple are put together from the dictionary and hashed once; the tuples' counts are joined back
to the bucket, and every feature finds its bucket by its tuple's place.  What goes to a table is
a row for each document with the sorted buckets of its features as differences, so that texts
are split and hashed once.

Bucket counts of all documents and all target texts (a row for each bucket) give the gains; the
table is read again to add up each document's gains.  The draw orders by score with Gumbel noise
from a hash of the id.  Ranks are global, yet no task sorts all: rows are dealt by ranges of the
order, sorted and written, and a row's rank is its place in the range plus the rows before it.

The dictionary is one of a block and not of the corpus: on invented prose nearly every second
pair of words is new, and reconstructing each distinct pair of a corpus from a shared dictionary
takes two joins that move all pairs with their words, several times the input, to save hashing
a pair once more in another block.

Defined cases: a null or empty text, or one without a word, has no features and weight 0; fewer
words than n give the shorter runs only; a text of any length counts whole; repeated rows count
each; a null doc_id hashes as the empty text and is last among equal scores; an empty table gives
an empty one, and an empty target gives gains of all buckets alike.  Only doc_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS, NGRAMS = 10_000, 2
#: Bytes of text that share a dictionary.
BLOCK = 8 << 20
#: Letters A-Z to small ones; all ASCII but digits and small letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CODED = "doc_id long, n_words long, n_features long, buckets binary"


def code_block(texts: list[str], ngrams: int = NGRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; the text of each feature and its bucket, both in one order."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words = [np.fromiter(map(ids.__getitem__, x), np.int64, len(x)) for x in (t.encode("utf-8", "replace").translate(_FOLD).split() for t in texts)]
    n = np.array([len(x) for x in words], np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), n)
    name, base = list(ids), max(1, len(ids))
    whose, bucket = [], []
    tuples, top = flat, base
    for run in range(1, ngrams + 1):
        if run > 1:
            if top * base >= 1 << 62:  # the digits would overflow, so the tuples so far are numbered anew
                distinct, tuples = np.unique(tuples, return_inverse=True)
                top = len(distinct)
            # runs at the same places one word longer; those that end in another text are left out below
            tuples, top = tuples[: max(0, len(flat) - run + 1)] * base + flat[run - 1 :], top * base
        at = np.flatnonzero(text_of[: len(tuples)] == text_of[run - 1 :])
        _, first, place = np.unique(tuples[at], return_index=True, return_inverse=True)
        columns = [flat[at[first] + k].tolist() for k in range(run)]
        hashed = [crc32(b" ".join([name[i] for i in t])) for t in zip(*columns, strict=True)] if run > 1 else [crc32(name[i]) for i in columns[0]]
        bucket.append((np.array(hashed, np.int64) % buckets)[place])
        whose.append(text_of[at])
    return n, np.concatenate(whose), np.concatenate(bucket)


def pack(sorted_buckets: np.ndarray) -> bytes:
    """Ascending buckets as differences in 16 bits."""
    return np.diff(sorted_buckets, prepend=0).astype("<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2"), dtype=np.int64)


def coded(texts: DataFrame, name: str) -> DataFrame:
    """doc_id, n_words, n_features and packed buckets of every row (doc_id, text); written and read again."""

    def run(batches):
        held_ids, held, size = [], [], 0

        def done() -> pa.RecordBatch:
            n, whose, bucket = code_block(held)
            features = np.bincount(whose, minlength=len(held))
            ends = np.cumsum(features)
            bucket = np.sort(whose * BUCKETS + bucket) % BUCKETS
            packed = [pack(bucket[e - k : e]) for e, k in zip(ends.tolist(), features.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(held_ids, pa.int64()), pa.array(n), pa.array(features.astype(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

        for batch in C.pieces(batches, 256):
            for doc_id, text in zip(batch.column(0).to_pylist(), C.texts_of(batch, "text"), strict=True):
                held_ids.append(doc_id)
                held.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield done()
                    held_ids, held, size = [], [], 0
        if held:
            yield done()

    C.ship(texts.sparkSession)
    return C.save(texts.mapInArrow(run, CODED), name, compression="zstd")[0]


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all rows: added up by task, then over tasks; a row for each bucket reaches the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(unpack(raw), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    summed = table.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in summed.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    s, t = (np.array([x.get(b, 0) for b in range(buckets)], np.float64) for x in (source, target))
    return np.floor(1000 * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).astype(np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a row's features."""

    def run(batches):
        for batch in C.pieces(batches, 1024):
            sums = [int(gain[unpack(raw)].sum()) for raw in batch.column(3).to_pylist()]
            n = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s // k if k else 0 for s, k in zip(sums, n, strict=True)], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    C.ship(table.sparkSession)
    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = 25, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and rank of the drawn ones: `percent` of the rows with at least `least_words` words."""
    source = coded(docs.select("doc_id", "text"), "coded")
    aim = coded(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "coded-target")
    got = weights(source, gains(bucket_counts(source), bucket_counts(aim)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    got = got.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))
    rows, _ = C.save(got, "scored")
    fit = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"]
    # a row's place: the task it was dealt to in the upper bits, its place there in the lower 33
    ranged = rows.where(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed, _ = C.save(ranged, "placed")
    part = F.shiftrightunsigned("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row for each range
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    draw = percent * rows.where(fit).count() // 100
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
    return ranked.unionByName(rows.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_ngram_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
