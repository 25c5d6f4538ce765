"""MinHash near-duplicates with odd sketches.

A document is its set of distinct word shingles.  K MinHash samples give band keys, and are
folded into a parity bitmap (an odd sketch): every sample flips one bit, so equal samples of two
documents cancel out in the XOR of their bitmaps, whose population count says how many differ.
That estimate is sharp where most samples agree, which is where the links are.

Equal sets are one node, so copies never meet.  Nodes meet in the bands' buckets, in two steps
that don't make a bucket's pairs:

1. Every node of a bucket goes to the bucket's two stars (its least and its greatest node).  Pairs
   whose sketches allow the similarity are confirmed on full sets; components of these links put
   a group of near copies into one class with about two pairs a node.
2. Nodes of buckets that still hold several classes get a wider sketch (2,040 samples in 4,096 bits),
   and those of different classes are compared by set sizes and wide sketches within the join; only
   pairs that pass come out, are confirmed and close the components.  Nodes of one class are never
   compared again.

So every two nodes that share a bucket are in one class, or were compared.  With 51 bands of 5
samples two sets of similarity 0.8 share no bucket with probability 2e-9; the sketch turns down
one such pair in some hundred thousands (4.5 standard deviations), fewer the more alike they are.
The confirmation counts the shingles' 64-bit hashes.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle are one shingle; a text of any length counts whole; repeated
rows have equal sets; a row without doc_id is linked like any other, component_id is the least
id there is in its class (null if there is none) and such a row is kept only in a class without
ids; an empty table gives an empty table.  Only doc_id and text are read, so other columns may
have any names.
"""

from __future__ import annotations

from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .simhash_cover import components

#: Bands, samples of a band, samples folded into a sketch, longs of a sketch.
BANDS, ROWS, K, LONGS = 51, 5, 510, 16
#: The same of a wide sketch.
WIDE_K, WIDE_LONGS = 2040, 64
#: Nodes whose ids may go to every task.
SENT = 500_000
_RNG = np.random.default_rng(12)
_MUL = (_RNG.integers(0, 1 << 32, WIDE_K, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_XOR = _RNG.integers(0, 1 << 32, WIDE_K, np.uint64).astype(np.uint32)[:, None]
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = _RNG.integers(0, 1 << 63, WIDE_K, np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "doc_id long, row long, digest binary, n long, keys array<long>, sketch array<long>"


def shingles(text: str, words: int = 4) -> np.ndarray:
    """The distinct shingles' XXH64, ascending."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes.lower() maps A-Z only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)), np.uint64, len(start)))


def samples(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    step = max(1, 512 * K // k)
    for at in range(0, len(low), step):
        x = (low[at : at + step] ^ _XOR[:k]) * _MUL[:k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """A key for each band from its samples; equal for equal bands only, but for hash collisions."""
    x = (sample[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def odd_sketch(sample: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """The parity bitmap of the samples, as longs."""
    x = (sample.astype(np.uint64) + np.uint64(1)) * _SKETCH[: len(sample)]
    bit = ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)
    odd = np.bincount((bit % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(">u8").astype(np.uint64)


def most_differing_bits(similarity: float, k: int = K, longs: int = LONGS, deviations: float = 4.5) -> int:
    """XOR bits that a pair of the similarity doesn't exceed, but for that many standard deviations.

    Each differing sample flips two of the bits; f flips leave half the bits * (1 - exp(-2 f / bits)) odd, as
    some meet: about f * f / 2 / bits pairs of them, each costing two odd bits.
    """
    bits, flips, spread = 64 * longs, 2 * k * (1 - similarity), 2 * sqrt(k * similarity * (1 - similarity))
    left = exp(-2 * flips / bits)
    return int(bits / 2 * (1 - left) + deviations * sqrt((spread * left) ** 2 + 2 * flips * flips / bits))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the set, its size, band keys and odd sketch of every row; empty sets have null keys."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"digest": [], "n": [], "keys": [], "sketch": []}
        for text in C.texts_of(batch, "text"):
            h = shingles(text)
            sample = samples(h) if len(h) else None
            out["n"].append(len(h))
            out["digest"].append(xxhash.xxh3_128_digest(h.tobytes()))
            out["keys"].append(None if sample is None else band_keys(sample).view(np.int64))
            out["sketch"].append(None if sample is None else odd_sketch(sample).view(np.int64))
        return out | {"doc_id": batch.column(0), "row": batch.column(1)}

    return C.save(C.per_batch(docs.select("doc_id", row_key().alias("row"), "text"), make, SIGNED), "signed")[0]


def alike(n: Column, other_n: Column, sketch: list[Column], other: list[Column], percent: int, k: int = K) -> Column:
    """Set sizes and sketches (of k samples) allow a similarity of `percent`."""
    bits = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(sketch, other, strict=True)), F.lit(0))
    return (100 * n >= percent * other_n) & (100 * other_n >= percent * n) & (bits <= most_differing_bits(percent / 100, k, len(sketch)))


def row_key() -> Column:
    """What finds a row's text again: its id, or a hash of the text where there is none."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the nodes wanted (column node, each once); written and read again."""
    wanted, _ = C.save(nodes.join(wanted, "node").select("node", "digest", "row"), "wanted")

    def own(batches):
        # rows with equal ids may hold other texts, and a row may stand there twice
        seen: set[int] = set()
        for batch in C.pieces(batches, 256):
            good = []
            for node, digest, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                good.append(node not in seen and xxhash.xxh3_128_digest(shingles(text or "").tobytes()) == digest)
                if good[-1]:
                    seen.add(node)
            yield batch.select(["node", "text"]).filter(pa.array(good, pa.bool_()))

    if wanted.count() <= SENT:  # about 60 bytes each
        wanted = F.broadcast(wanted)
    texts = docs.select(row_key().alias("row"), "text").join(wanted, "row").select("node", "digest", "text")
    return C.save(texts.mapInArrow(own, "node long, text string"), "texts", compression="zstd")[0]


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those with 100 * intersection >= percent * union, counted on full sets; texts: node, text.

    Texts move, not sets: eight bytes a shingle are more than a compressed text.
    """
    left = pairs.join(texts.withColumnRenamed("node", "a"), "a").select("b", "a", F.col("text").alias("x"))
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def count(batches):
        star, held = None, None  # rows with one b mostly stand together
        for batch in C.pieces(batches, 64):
            good = []
            for b, x, y in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
                if b != star:
                    star, held = b, shingles(y)
                u = shingles(x)
                common = len(np.intersect1d(u, held, assume_unique=True))
                good.append(100 * common >= percent * (len(u) + len(held) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return C.save(both.mapInArrow(count, "a long, b long"), "links")[0]


def wide_sketches(texts: DataFrame) -> DataFrame:
    """node and wide sketch of each text; written and read again."""

    def make(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "wide": [odd_sketch(samples(shingles(t), WIDE_K), WIDE_LONGS).view(np.int64) for t in C.texts_of(batch, "text")]}

    return C.save(C.per_batch(texts.select("node", "text"), make, "node long, wide array<long>"), "wide")[0]


def crowded(nodes: DataFrame) -> DataFrame:
    """key, band, node, and the key's number of nodes c, its least node low and its greatest high, of the buckets of two nodes and more."""
    bands = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    size = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return C.save(bands.join(size, "key").select("key", "band", "node", "c", "low", "high"), "buckets", compression="zstd")[0]


def met_at_stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the least and the greatest node of its buckets."""
    met = buckets.select("node", F.explode(F.array("low", "high")).alias("star")).where("node <> star")
    return met.select(F.greatest("node", "star").alias("a"), F.least("node", "star").alias("b")).distinct()


def mixed(buckets: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """key, band, node and label of the buckets of several classes and more than two nodes: the others are done."""
    classed = nodes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    many = buckets.where("c > 2").select("key", "band", "node").join(classed, "node")
    keys = many.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
    return C.save(many.join(keys, "key").select("key", "band", "node", "label"), "mixed")[0]


def met_across(rows: DataFrame, nodes: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that share a mixed bucket and pass by set sizes and wide sketches, each in the first band that they share."""
    columns = ["node", "label", "band", "n", "keys", *(f"s{i}" for i in range(WIDE_LONGS))]
    info = nodes.select("node", "n", "keys").join(wide, "node").select("node", "n", "keys", *(F.col("wide")[i].alias(f"s{i}") for i in range(WIDE_LONGS)))
    near = rows.join(info, "node").select("key", *columns)
    left, right = (near.select("key", *(F.col(c).alias(f"{end}_{c}") for c in columns)) for end in "ab")
    sketch = lambda end: [F.col(f"{end}_s{i}") for i in range(WIDE_LONGS)]
    test = alike(F.col("a_n"), F.col("b_n"), sketch("a"), sketch("b"), percent, WIDE_K)
    before = lambda end: F.slice(f"{end}_keys", F.lit(1), F.col("a_band"))
    first = F.size(F.array_intersect(before("a"), before("b"))) == 0
    met = left.join(right, "key").where((F.col("a_label") != F.col("b_label")) & (F.col("b_node") < F.col("a_node")) & test & first)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    info = nodes.select("node", "n", "sketch")
    of = lambda c: info.select(F.col("node").alias(c), F.struct("n", "sketch").alias("i" + c))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    longs = lambda c: [F.col(f"i{c}.sketch")[i] for i in range(LONGS)]
    return both.where(alike(F.col("ia.n"), F.col("ib.n"), longs("a"), longs("b"), percent)).select("a", "b")


def classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = signed(docs)
    least = F.min("row").alias("row")
    nodes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), least, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes, _ = C.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = crowded(nodes)
    first, _ = C.save(passing(met_at_stars(buckets), nodes, percent), "candidates")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = confirmed(first, texts_of(ends(first), nodes, docs), percent)
    labels, _ = C.save(components(links), "labels")
    rows_left = mixed(buckets, nodes, labels)
    if not rows_left.isEmpty():
        texts = texts_of(rows_left.select("node").distinct(), nodes, docs)
        more, _ = C.save(met_across(rows_left, nodes, wide_sketches(texts), percent).join(first, ["a", "b"], "left_anti"), "candidates")
        if not more.isEmpty():
            links = links.unionByName(confirmed(more, texts, percent))
            labels, _ = C.save(components(links), "labels")
    held = nodes.select("node", "digest", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = held.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_digest = held.join(smallest, "label").select("digest", "component_id")
    got = rows.select("doc_id", "n", "digest").join(of_digest, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op12_minhash_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.documents(spark, sf_dir))


SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 s AS (SELECT DISTINCT rid, array_to_string(w[i : i + 3], ' ') AS sh FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid), p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON r.other = e.a), m AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.other GROUP BY r.rid)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.rid = d.rid JOIN m ON m.rid = d.rid"""
