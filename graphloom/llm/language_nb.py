"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; n-grams of 1 to 3 code points fall into hashed buckets.
The log-probability matrix (buckets x languages, a fixed bound) is broadcast, and the
sparse count matrix of a batch of texts is multiplied with it by gathering the rows of
all their n-grams and adding them up by text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
null languages aren't learned; without training rows every text is ``und``, and an empty
table gives an empty table.  A text of any length counts whole, in blocks.  Ties go to
the language first by code point.  Repeated rows get equal results.  Only doc_id, text
and (to learn) lang are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS, ORDERS, BLOCK = 15, (1, 2, 3), 1 << 18
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@dataclass
class NaiveBayes:
    langs: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # buckets x languages


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def buckets(text: str):
    """Arrays of the buckets of a whole text's n-grams, in blocks of bounded size."""
    low = text.lower()
    for at in range(0, len(low), BLOCK):
        c = np.frombuffer(low[at : at + BLOCK + 2].encode("utf-32-le", "replace"), np.uint32)
        own = min(BLOCK, len(low) - at)
        h = np.zeros(len(c), np.uint32)
        for n in ORDERS:
            if n > len(c):
                break
            h = (h[: len(c) - n + 1] * np.uint32(31)) ^ (c[n - 1 :] * _MIX[n - 1])
            g = h[:own]
            yield ((g ^ (g >> np.uint32(15))) * np.uint32(668265263)) >> np.uint32(32 - BITS)


def fit(docs: DataFrame, keep, rows_per_lang: int = 4000, alpha: float = 0.1) -> NaiveBayes:
    """Learn from about rows_per_lang documents of each language at most, drawn by a hash of the id among those where keep holds."""
    known = docs.where(keep & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    drawn = known.where(C.hash_fraction("doc_id", 4, "text") < C.rate_by("lang", counts, rows_per_lang)).select("text", "lang")
    place = {x: k for k, x in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            for text, lang in zip(C.texts_of(batch, "text"), batch.column(1).to_pylist(), strict=True):
                for b in buckets(text):
                    total[place[lang]] += np.bincount(b, minlength=1 << BITS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], ["k", "b", "n"])

    table = np.full((1 << BITS, max(1, len(langs))), alpha)
    if langs:
        summed = drawn.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
        table[summed["b"].to_numpy(), summed["k"].to_numpy()] += summed["n"].to_numpy()
    log_p = np.log(table) - np.log(table.sum(0))
    n = np.array([counts[x] for x in langs] or [1], float)
    return NaiveBayes(langs, np.log((n + 1) / (n.sum() + len(n))), log_p.astype(np.float32))


def log_joint(texts: list[str], log_p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log of prior times likelihood, texts x languages: the n-grams' rows of a batch, added up by text."""
    z = np.tile(prior, (len(texts), 1))
    held, row, many = [], [], 0

    def add():
        at = np.cumsum([0, *map(len, held)])[:-1]
        np.add.at(z, row, np.add.reduceat(log_p.take(np.concatenate(held), axis=0), at, axis=0, dtype=np.float64))

    for i, text in enumerate(texts):
        for b in buckets(text):
            held.append(b)
            row.append(i)
            many += len(b)
            if many > BLOCK:
                add()
                held, row, many = [], [], 0
    if held:
        add()
    return z


def identify(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.log_p, model.prior, model.langs))  # 2^BITS rows, a column a language

    def make(batch: pa.RecordBatch) -> dict:
        log_p, prior, langs = sent.value
        texts = C.texts_of(batch, "text")
        known = [bool(langs) and has_letter(t) for t in texts]
        z = log_joint([t for t, k in zip(texts, known, strict=True) if k], log_p, prior)
        best, share = z.argmax(1).tolist(), (1 / np.exp(z - z.max(1, keepdims=True)).sum(1)).tolist()
        got = iter(zip(best, share, strict=True))
        rows = [next(got) if k else None for k in known]
        return {"doc_id": batch.column(0), "lang_pred": ["und" if r is None else langs[r[0]] for r in rows], "score": [0.0 if r is None else r[1] for r in rows]}

    return C.per_batch(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def op4_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs, C.crc_mod("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", (C.crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
