"""Quality classifier: a factorisation machine.

Inputs of a score are the text and its length: hashed words, buckets of
structure statistics, and the stored length as metadata.  Pairwise interactions
of all features are scored in linear time by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Defined cases: a null text counts as empty; an empty text has structure
features only and gets a score; a text of any length counts whole; repeated rows get
equal scores, and a score of just 0.3 is predicted 1; without labelled training rows
every score is 0.5, and with one class alone the score is that class's smoothed share;
an empty table gives an empty table.  Only doc_id, text and n_chars are read, so other
columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORD_BITS, STATS, STEPS = 16, 12, 16
N_FEATURES = (1 << WORD_BITS) + (STATS + 1) * STEPS
_SYMBOLS, _UPPER, _DIGITS = list(b"#*$%&|<>"), list(range(65, 91)), list(range(48, 58))


@dataclass
class FM:
    bias: float
    w: np.ndarray
    v: np.ndarray


def _step(x: float) -> int:
    """A share from 0 to 1, in 16 steps that are finer near 0."""
    return min(STEPS - 1, int((x**0.5) * STEPS)) if x > 0 else 0


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's features."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, seen, size = len(words), set(words), max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    stats = (
        min(STEPS - 1, n.bit_length()),
        _step(len(seen) / n) if n else 0,
        _step(sum(map(eq, words, words[1:])) / n) if n else 0,
        _step(hist[_UPPER].sum() / letters),
        _step(hist[_SYMBOLS].sum() / size),
        _step(hist[33] / size),
        _step(hist[_DIGITS].sum() / size),
        _step(hist[124] / size),
        min(STEPS - 1, int(size / n)) if n else 0,
        _step(1 - len(set(lines)) / len(lines)),
        min(STEPS - 1, int(n / len(lines)).bit_length()),
        _step(hist[128:].sum() / size),
    )
    meta = 0 if n_chars is None or n_chars < 0 else min(STEPS - 1, 1 + int(n_chars).bit_length() // 2)
    idx = np.fromiter(map(crc32, seen), np.int64, len(seen)) & ((1 << WORD_BITS) - 1)
    own = (1 << WORD_BITS) + np.arange(STATS + 1) * STEPS + np.array([*stats, meta])
    val = np.full(len(idx), 1 / max(1, len(idx)) ** 0.5, np.float32)
    return np.concatenate([idx, own]).astype(np.int32), np.concatenate([val, np.full(STATS + 1, 0.5, np.float32)])


def score_batch(model: FM, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of several documents at once, linear in their features."""
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
    x = model.v[idx] * val[:, None]
    s = np.add.reduceat(x, at, axis=0)
    pairs = 0.5 * (s * s - np.add.reduceat(x * x, at, axis=0)).sum(1)
    z = model.bias + np.add.reduceat(model.w[idx] * val, at) + pairs
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(rows: list[tuple[int, float, np.ndarray, np.ndarray]], rank: int = 8, epochs: int = 4, rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> FM:
    """AdaGrad on the weighted logistic loss; rows: (label, weight, indices, values)."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, rank)).astype(np.float32)
    gw, gv = np.full(N_FEATURES, 1e-3, np.float32), np.full((N_FEATURES, rank), 1e-3, np.float32)
    total = sum(r[1] for r in rows) or 1.0
    share = (sum(r[0] * r[1] for r in rows) + 1) / (total + 2)
    bias = float(np.log(share / (1 - share)))
    if len({r[0] for r in rows}) < 2:
        return FM(bias if rows else 0.0, np.zeros_like(w), np.zeros_like(v))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, weight, i, x = rows[k]
            vi = v[i]
            s = x @ vi
            z = bias + w[i] @ x + 0.5 * float((s * s).sum() - ((x[:, None] * vi) ** 2).sum())
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            dw, dv = g * x + l2 * w[i], g * x[:, None] * (s - x[:, None] * vi) + l2 * vi
            gw[i] += dw * dw
            gv[i] += dv * dv
            w[i] -= rate * dw / np.sqrt(gw[i])
            v[i] -= rate * dv / np.sqrt(gv[i])
            bias -= 0.01 * g
    return FM(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000, fold: int = 5) -> FM:
    """Train on at most about rows_per_class labelled documents of each class, drawn by a hash of the id.

    Rows of fold 0 are never read.  Of repeated labels of an id the lowest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (C.crc_mod("doc_id", fold) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = known.where(C.hash_fraction("doc_id", 11) < C.rate_by("quality", counts, rows_per_class))
    # at most about 2 x rows_per_class ids
    there = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(picked), "doc_id")

    def make(batch: pa.RecordBatch) -> dict:
        got = [features(t, n) for t, n in zip(C.texts_of(batch, "text"), batch.column(batch.schema.get_field_index("n_chars")).to_pylist(), strict=True)]
        return {"doc_id": batch.column(0), "quality": batch.column(batch.schema.get_field_index("quality")), "i": [g[0].tobytes() for g in got], "x": [g[1].tobytes() for g in got]}

    sample = C.per_batch(there, make, "doc_id long, quality int, i binary, x binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["i"]))
    drawn = {q: sum(r["quality"] == q for r in sample) for q in counts}
    all_rows = sum(counts.values())
    rows = [(r["quality"], counts[r["quality"]] / drawn[r["quality"]] * len(sample) / all_rows, np.frombuffer(r["i"], np.int32), np.frombuffer(r["x"], np.float32)) for r in sample]
    return train(rows)


def score(docs: DataFrame, model: FM) -> DataFrame:
    """doc_id and score of every row."""

    def make(batch: pa.RecordBatch) -> dict:
        n = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
        out = []
        texts = C.texts_of(batch, "text")
        for at in range(0, len(texts), 128):
            out += score_batch(model, [features(t, k) for t, k in zip(texts[at : at + 128], n[at : at + 128], strict=True)]).tolist()
        return {"doc_id": batch.column(0), "score": out}

    return C.per_batch(docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), make, "doc_id long, score double")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model)
    return got.select("doc_id", (C.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
