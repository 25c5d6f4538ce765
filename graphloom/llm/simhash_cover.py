"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: a product of perfect binary Golay codes
(23 bits, 4096 words, covering radius 3), one for each block of the fingerprint's
64 bits.  Two blocks cover 46 bits and give 2^24 anchors; a third one takes the other
18 and gives 2^36, for corpora of many billions of fingerprints, at more visits each
(`blocks`; the comparison sees all 64 bits either way).  A fingerprint's home is its
nearest anchor.  It is replicated to every anchor within covering radius plus
threshold, with the threshold's flips shared out over the blocks: those are the homes
of all fingerprints within the threshold, about 60 with two blocks.  At each anchor
visitors are compared with the fingerprints at home, so no linked pair is missed.
Because the code is linear, the anchors to visit are a table by the block's syndrome.

Equal fingerprints are one node (grouped before any comparison), so groups of
copies don't multiply.  Links are closed to components by alternating large and small
stars, in rounds logarithmic in the length of chains, over tables in the shared
folder; nothing but counts and sums reaches the driver.

Defined cases: a null text is empty; a text without words has fingerprint zero and
links like any other; one or two words are one shingle; a text of any length counts
whole; repeated rows share a fingerprint; a document without id links like any other,
and component_id is the smallest id there is in its class (null if there is none); an
empty table gives an empty table.  Only doc_id and text are read, so other columns may
have any names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C

WIDTH, THRESHOLD = 23, 2
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_POLY = 0b110001110101


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The majority of the shingles' XXH64 bits, as an unsigned number."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes.lower() maps A-Z only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: len(parts) - words + 1].tolist()
    end = end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, end, strict=True)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def make(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": np.array([fingerprint(t) for t in C.texts_of(batch, "text")], np.uint64).view(np.int64)}

    return C.per_batch(docs.select("doc_id", "text"), make, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Syndrome tables of two byte-wise halves, coset leaders, and for each syndrome the steps to anchors reached by one flip and by two."""

    def syndrome(x: int) -> int:
        for bit in range(WIDTH - 1, 10, -1):
            if x >> bit & 1:
                x ^= _POLY << (bit - 11)
        return x

    of_bit = np.array([syndrome(1 << b) for b in range(WIDTH)], np.int64)
    table = np.zeros((2, 1 << 12), np.int64)
    for half in range(2):
        for b in range(12):
            if 12 * half + b < WIDTH:
                step = 1 << b
                table[half, step : 2 * step] = table[half, :step] ^ of_bit[12 * half + b]
    leader = np.full(1 << 11, -1, np.int64)
    leader[0] = 0
    bits = range(WIDTH)
    flips = [[1 << a for a in bits], [1 << a | 1 << b for a in bits for b in range(a)], [1 << a | 1 << b | 1 << c for a in bits for b in range(a) for c in range(b)]]
    code = lambda x: int(table[0, x & 4095] ^ table[1, x >> 12])
    for group in flips:
        for e in group:
            leader[code(e)] = e
    one, two = [], []
    e1, e2 = np.array(flips[0]), np.array(flips[1])
    s1, s2 = np.array([code(e) for e in flips[0]]), np.array([code(e) for e in flips[1]])
    for s in range(1 << 11):
        near = np.unique(e1 ^ leader[s ^ s1] ^ leader[s])
        near = near[near != 0]
        far = np.setdiff1d(np.unique(e2 ^ leader[s ^ s2] ^ leader[s]), np.append(near, 0))
        one.append(near)
        two.append(far)
    flat = lambda x: (np.concatenate(x), np.concatenate([[0], np.cumsum([len(v) for v in x])]))
    return table, leader, *flat(one), *flat(two)


def _ragged(flat: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its entries: (index of the key's row, entry)."""
    n = at[keys + 1] - at[keys]
    row = np.repeat(np.arange(len(keys)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, flat[np.repeat(at[keys], n) + inside]


def anchors_home(fp: np.ndarray, blocks: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchors of unsigned fingerprints, and the syndromes of their blocks; the last of three blocks is the 18 bits that are left."""
    table, leader, *_ = _golay()
    full, syn = np.zeros(len(fp), np.int64), []
    for k in range(blocks):
        x = (fp >> np.uint64(WIDTH * k)).astype(np.int64) & ((1 << WIDTH) - 1)
        s = table[0, x & 4095] ^ table[1, x >> 12]
        # a block's anchor stands for its 12 highest bits: the code is systematic, so they tell its words apart
        full |= (x ^ leader[s]) >> 11 << (12 * k)
        syn.append(s)
    return full, syn


def anchors(fp: np.ndarray, blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors of unsigned fingerprints, and visits as (row, anchor); the home itself is a visit too."""
    _, _, one, one_at, two, two_at = _golay()
    full, syn = anchors_home(fp, blocks)
    rows, at = [np.arange(len(fp))], [full]
    singles = [_ragged(one, one_at, s) for s in syn]
    move = lambda step, k: step >> 11 << (12 * k)
    for k in range(blocks):
        for row, step in (singles[k], _ragged(two, two_at, syn[k])):
            rows.append(row)
            at.append(full[row] ^ move(step, k))
    # one flip in each of two blocks
    for j in range(blocks):
        row_j, step_j = singles[j]
        for k in range(j + 1, blocks):
            row, step_k = _ragged(one, one_at, syn[k][row_j])
            rows.append(row_j[row])
            at.append(full[row_j[row]] ^ move(step_j[row], j) ^ move(step_k, k))
    return full, np.concatenate(rows), np.concatenate(at)


def links(nodes: DataFrame, blocks: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints (column fp, each once) that differ in 1 to THRESHOLD bits."""

    def homes(batches):
        for batch in C.pieces(batches, 1 << 14):
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(anchors_home(fp, blocks)[0]), batch.column(0)], ["home", "fp"])

    def visits(batches):
        for batch in C.pieces(batches, 1 << 12):
            fp = batch.column(0).to_numpy()
            _, row, at = anchors(fp.view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fp[row])], ["anchor", "other"])

    C.ship(nodes.sparkSession)
    at_home = nodes.select("fp").mapInArrow(homes, "home long, fp long")
    visiting = nodes.select("fp").mapInArrow(visits, "anchor long, other long")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).between(1, THRESHOLD) & (F.col("fp") < F.col("other"))
    return visiting.join(at_home.hint("shuffle_hash"), (F.col("anchor") == F.col("home")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node in a pair (a, b).

    A large star gives each node's greater neighbours to its least one, a small star its lesser
    ones; alternating, they turn every component into one star around its least node.
    """
    edges, path = C.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    total = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = total(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = C.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        C.remove(edges.sparkSession, path)
        edges, path = new, new_path
        state = total(edges)
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = state


def classes(docs: DataFrame, blocks: int = 2) -> DataFrame:
    """doc_id, fp, label (the least fingerprint of its class) and component_id of every row."""
    rows, _ = C.save(fingerprints(docs), "fingerprints")
    nodes, _ = C.save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    linked = nodes.join(components(links(nodes, blocks)), F.col("fp") == F.col("node")).select("fp", "label", "rep")
    smallest = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_fp = nodes.join(linked.join(smallest, "label").select("fp", "label", "component_id"), "fp", "left")
    of_fp = of_fp.select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(of_fp, "fp").select("doc_id", "fp", "label", "component_id")


def one_of_each(docs: DataFrame, blocks: int = 2) -> DataFrame:
    """The rows whose document is the smallest doc_id of its class, once each, with all their columns.

    Of rows with that doc_id the one with the least text stays.  Rows without doc_id go if their
    class has a document with one; of a class without ids the row with the least text stays.
    """
    got = classes(docs, blocks)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # the columns may have any names
    least = F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")
    kept = got.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    own = docs.where(F.col("doc_id").isNotNull()).select(whole, "doc_id", "text").join(kept, "doc_id", "left_semi")
    out = own.groupBy("doc_id").agg(least).select("row.*")
    nameless = docs.where(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return out

    def run(batches):
        for batch in C.pieces(batches):
            fp = np.array([fingerprint(t) for t in C.texts_of(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, "fp"])

    held = nameless.select(whole, "text")
    held = held.mapInArrow(run, StructType([*held.schema.fields, StructField("fp", LongType())]))
    alone = got.where(F.col("component_id").isNull()).select("fp", "label").distinct()
    return out.unionByName(held.join(alone, "fp").groupBy("label").agg(least).select("row.*"))


def op5_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classes(C.documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
