"""Quality rules by line labelling: a linear-chain conditional random field.

Each line with a word is content (1) or boilerplate (0).  Only documents are labelled, so
the lines' labels are latent: in turns, weights of binary line features and label transitions are
fitted by gradient ascent on the CRF's log-likelihood over a bounded sample, and the sample's lines
are labelled anew by Viterbi decoding under what is known of their document, that content
lines hold at least half of a good document's words and less of a bad one's.  So a good
document's notices and repeated lines are boilerplate, a bad one's prose is content, and
transitions learn where the labels change.  Viterbi decoding then labels the lines of every
document, and a document is kept if content lines hold at least half of its words.  A base rule rejects documents with fewer than 20
words or with over 30 % of their words in repeated 8-word windows.

Defined cases: a null text has no words; a text without words fails the base
rule; a text of any length counts whole; repeated rows get equal results; ties between
label sequences go to content, and a share of just one half keeps a document; without
labelled rows of both classes the fixed prior weights below serve; an empty table gives
an empty table.  Only doc_id and text are read, and keep_good() keeps all columns,
whatever their names.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FEATURES = ("bias", "few_words", "many_words", "some_symbols", "many_symbols", "upper", "adjacent_repeats", "pipes", "seen_before", "sentence_end", "short_words", "long_words", "digits", "few_distinct", "exclaims", "notice")
_N = len(FEATURES)
#: Fixed prior weights (content minus boilerplate), in the order of FEATURES.
PRIOR = np.array([1.0, -0.3, 0.5, -1.0, -3.0, -2.5, -3.0, -3.0, -1.0, 1.0, 0.0, -1.0, -1.0, -1.5, -2.5, -2.0])
#: Words that mark notices, lower case.
NOTICES = (b"licensed", b"license", b"copyright", b"cookie", b"subscribe", b"reserved")
_LETTERS, _SYM, _LOW = bytes(range(65, 91)), b"#*$%&|<>", bytes(range(97, 123))


def _share(line: bytes, chars: bytes) -> int:
    return len(line) - len(line.translate(None, chars))


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of binary features for each line; all lines have a word."""
    out, seen = np.zeros((len(lines), _N), np.float32), set()
    for k, line in enumerate(lines):
        words = line.split()
        n, size = len(words), len(line)
        symbols, upper, lower = _share(line, _SYM), _share(line, _LETTERS), _share(line, _LOW)
        last = words[-1][-1:]
        low = line.lower()
        out[k] = (
            1, n < 4, n > 15, symbols > 0.03 * size, symbols > 0.12 * size, upper > lower and upper > 3,
            n > 3 and sum(map(eq, words, words[1:])) > 0.3 * n, line.count(b"|") > 0.2 * n, line in seen, last in b".!?", size < 3.2 * n,
            size > 14 * n, _share(line, b"0123456789") > 0.3 * size, n > 7 and len(set(words)) < 0.4 * n, line.count(b"!") > 0.4 * n, any(x in low for x in NOTICES),
        )
        seen.add(line)
    return out


def viterbi(emission: np.ndarray, trans: np.ndarray) -> list[int]:
    """The best label sequence; emission: lines x 2, trans[a][b]: score of b after a.  Ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    rows = emission.tolist()
    s0, s1 = rows[0]
    back = []
    for e0, e1 in rows[1:]:
        b0, b1 = int(s1 + t10 >= s0 + t00), int(s1 + t11 >= s0 + t01)
        s0, s1 = e0 + max(s0 + t00, s1 + t10), e1 + max(s0 + t01, s1 + t11)
        back.append((b0, b1))
    label = [int(s1 >= s0)]
    for b in reversed(back):
        label.append(b[label[-1]])
    return label[::-1]


def _sums(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward log-sums of a document's emissions, and the log partition function."""
    n = len(e)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = e[0]
    for i in range(1, n):
        a[i] = e[i] + np.logaddexp(a[i - 1][0] + trans[0], a[i - 1][1] + trans[1])
    for i in range(n - 2, -1, -1):
        m = e[i + 1] + b[i + 1]
        b[i] = np.logaddexp(trans[:, 0] + m[0], trans[:, 1] + m[1])
    return a, b, float(np.logaddexp(*a[-1]))


def likelihood(x: np.ndarray, y: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """One document's log-likelihood and its gradients: the labels' counts less their expectations."""
    e = x @ w
    n = len(e)
    a, b, z = _sums(e, trans)
    gold = np.eye(2)[y]
    value, gt = float(e[np.arange(n), y].sum() - z), np.zeros((2, 2))
    if n > 1:
        pair = np.exp(a[:-1, :, None] + trans + (e[1:] + b[1:])[:, None, :] - z)
        gt = np.einsum("ni,nj->ij", gold[:-1], gold[1:]) - pair.sum(0)
        value += float(trans[y[:-1], y[1:]].sum())
    return value, x.T @ (gold - np.exp(a + b - z)), gt


def labels_within(x: np.ndarray, words: np.ndarray, quality: int, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Viterbi labels, turned at the least certain lines until the share of words in content lines is what the quality says."""
    e = x @ w
    y = np.array(viterbi(e, trans))
    a, b, z = _sums(e, trans)
    content = np.exp(a[:, 1] + b[:, 1] - z)
    half = words.sum() / 2
    for k in np.argsort(-content if quality else content, kind="stable"):
        if (words[y == 1].sum() >= half) == bool(quality):
            break
        y[k] = quality
    return y


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], turns: int = 3, epochs: int = 3, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights from documents' (quality, line features, words of each line).

    At first a line is labelled as its document, but for a good one's notices, repeated lines and
    lines with pipes throughout; each turn fits the weights and labels the lines anew.
    """
    w, trans = np.stack([-PRIOR / 2, PRIOR / 2], 1), np.array([[0.5, -0.5], [-0.5, 0.5]])
    if len({r[0] for r in rows}) < 2:
        return w, trans
    junk = [FEATURES.index(f) for f in ("notice", "pipes", "seen_before")]
    labels = [np.where(x[:, junk].any(1), 0, q).astype(int) for q, x, _ in rows]
    rng = np.random.default_rng(3)
    for turn in range(turns):
        if turn:
            labels = [labels_within(x.astype(float), n, q, w, trans) for q, x, n in rows]
        gw, gt = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                x, y = rows[k][1], labels[k]
                _, dw, dt = likelihood(x.astype(float), y, w, trans)
                dw, dt = dw / len(y) - l2 * w, dt / len(y) - l2 * trans
                gw += dw * dw
                gt += dt * dt
                w, trans = w + rate * dw / np.sqrt(gw), trans + rate * dt / np.sqrt(gt)
    return w, trans


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, first ones included; exact, by doubling ranks of 1, 2, 4, 8 words."""
    n = len(words) - 7
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    rank = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    if len(place) == len(words):
        return 0
    for step in (1, 2, 4):
        pair = rank[:-step] * np.int64(len(words) + 1) + rank[step:]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(count) == len(pair):
            return 0
    starts = np.flatnonzero(count[rank] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + 8, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str, w: np.ndarray, trans: np.ndarray) -> dict:
    """The measures, the share of words in content lines and the verdict of a whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out = {"n_words": n, "word_chars": len(text) - _share(raw, b" \t\n\v\f\r"), "n_symbols": _share(raw, _SYM), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words)}
    out["base_failed"] = n < 20 or 100 * out["n_repeat_words"] > 30 * n
    out["content_share"] = 0.0
    if n and not out["base_failed"]:
        label = viterbi(line_features(lines) @ w, trans)
        out["content_share"] = sum(len(x.split()) for x, y in zip(lines, label, strict=True) if y) / n
    out["kept"] = not out["base_failed"] and out["content_share"] >= 0.5
    return out


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights from about rows_per_class labelled documents of each class, drawn by a hash of the id."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return train([])
    picked = known.where(C.hash_fraction("doc_id", 12) < C.rate_by("quality", counts, rows_per_class))
    there = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most about 2 x rows_per_class ids

    def make(batch: pa.RecordBatch) -> dict:
        lines = [[x for x in t.encode("utf-8", "replace").split(b"\n") if x.strip()] for t in C.texts_of(batch, "text")]
        return {"doc_id": batch.column(0), "quality": batch.column(batch.schema.get_field_index("quality")), "x": [np.packbits(line_features(x).astype(bool)).tobytes() for x in lines], "n": [[len(x.split()) for x in doc] for doc in lines]}

    got = sorted(C.per_batch(there, make, "doc_id long, quality int, x binary, n array<int>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    return train([(r["quality"], np.unpackbits(np.frombuffer(r["x"], np.uint8), count=len(r["n"]) * _N).reshape(-1, _N), np.array(r["n"])) for r in got if r["n"]])


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def apply_rules(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, the measures and the verdict of every row."""
    w, trans = model

    def make(batch: pa.RecordBatch) -> dict:
        got = [judge(t, w, trans) for t in C.texts_of(batch, "text")]
        return {"doc_id": batch.column(0)} | {k: [g[k] for g in got] for k in got[0]}

    return C.per_batch(docs.select("doc_id", "text"), make, "doc_id long, " + _SCHEMA)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows whose verdict is to keep, with all their columns."""
    w, trans = model
    C.ship(docs.sparkSession)

    def run(batches):
        for batch in C.pieces(batches):
            yield batch.filter(pa.array([judge(t, w, trans)["kept"] for t in C.texts_of(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return apply_rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
