"""Entity tagging by a linear-chain conditional random field, trained over partitions.

Texts are cut into windows of tokens with tags B-, I- and O.  Each evaluation of the likelihood is
one pass of the examples: a task adds up the gradients of its windows by forward and backward
sums, and the tasks' sums are added in groups of FAN until few are left, as a tree.  The driver
holds weights and gradients (buckets x tags) and runs L-BFGS over them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from graphloom.session import ship

WIDTH, BUCKETS, PER_TOKEN, FAN = 16, 1 << 12, 7, 32
EXAMPLES = "key string, place int, tokens array<string>, tags array<int>"
_TOKEN = re.compile(r"\S+")


def tag_names(kinds: list[str]) -> list[str]:
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]


def examples(docs: DataFrame, key: str, text: str, patterns: list[tuple[str, str]], width: int = WIDTH) -> DataFrame:
    """key, place and up to `width` tokens with the numbers of their tags: the windows of a text, one after the other.

    A token that a pattern's match begins in has its B tag, one that it goes on in its I tag; earlier
    patterns win.  A null or empty text has no window.
    """
    compiled = [re.compile(p) for _, p in patterns]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"key": [], "place": [], "tokens": [], "tags": []}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [m.span() for m in _TOKEN.finditer(t or "")]
                tags = [0] * len(spans)
                for n, p in enumerate(compiled):
                    at = 0
                    for m in p.finditer(t or ""):
                        while spans[at][1] <= m.start():
                            at += 1
                        here = at
                        while here < len(spans) and spans[here][0] < m.end():
                            tags[here] = tags[here] or 1 + 2 * n + (here > at)
                            here += 1
                for a in range(0, len(spans), width):
                    for name, v in zip(out, (k, a // width, [t[x:y] for x, y in spans[a : a + width]], tags[a : a + width]), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.string()), ("place", pa.int32()), ("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int32()))]))

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, EXAMPLES)


def _shape(token: str) -> str:
    """Runs of capitals, small letters and digits as one mark each, other characters as they are."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_A-Z]", "x", re.sub(r"[A-Z]", "X", token))))


def features(tokens: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Hashed features of each token: itself, its ends, its shape, the shapes beside it, and one that all have."""
    shapes = ["<", *map(_shape, tokens), ">"]
    rows = []
    for k, t in enumerate(tokens):
        low = t.lower()
        rows.append([crc32(f.encode("utf-8", "replace")) % buckets for f in ("w" + low, "p" + low[:2], "s" + low[-3:], "h" + shapes[k + 1], "b" + shapes[k], "a" + shapes[k + 2], "1")])
    return np.array(rows, np.int64).reshape(-1, PER_TOKEN)


def likelihood(windows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of (features, tags) windows and its gradients, all windows at once, shorter ones masked."""
    n_tags, size = trans.shape[0], max(len(y) for _, y in windows)
    length = np.array([len(y) for _, y in windows])
    index = np.zeros((len(windows), size, PER_TOKEN), np.int64)
    gold = np.zeros((len(windows), size), np.int64)
    for k, (x, y) in enumerate(windows):
        index[k, : len(y)], gold[k, : len(y)] = x, y
    there = np.arange(size) < length[:, None]
    e = w[index].sum(2) * there[..., None]
    log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    ahead, behind = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = e[:, 0]
    for t in range(1, size):
        step = log_sum(ahead[:, t - 1, :, None] + trans, 1) + e[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    for t in range(size - 2, -1, -1):
        step = log_sum(trans + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    z = log_sum(ahead[:, -1], 1)
    rows = np.arange(len(windows))
    share = np.exp(ahead + behind - z[:, None, None]) * there[..., None]
    one = np.eye(n_tags)[gold] * there[..., None]
    value = float((e[rows[:, None], np.arange(size), gold] * there).sum() - z.sum())
    both = there[:, 1:]
    value += float((trans[gold[:, :-1], gold[:, 1:]] * both).sum())
    pair = np.exp(ahead[:, :-1, :, None] + trans + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
    d_trans = np.einsum("bti,btj->ij", one[:, :-1] * both[..., None], one[:, 1:]) - pair.sum((0, 1))
    left = np.repeat((one - share).reshape(-1, n_tags), PER_TOKEN, axis=0)
    d_w = np.stack([np.bincount(index.ravel(), left[:, k], len(w)) for k in range(n_tags)], 1)
    return value, d_w, d_trans


def _added(parts: DataFrame) -> list:
    """The sum of rows (part, value, gradient bytes), added in groups of FAN as long as there are more."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in table["gradient"].to_pylist()], axis=0)
        part = table["part"][0].as_py()
        return pa.table({"part": pa.array([part], pa.int32()), "value": pa.array([sum(table["value"].to_pylist())], pa.float64()), "gradient": pa.array([total.tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.groupBy(F.pmod("part", F.lit(n)).cast("int").alias("g")).applyInArrow(add, parts.schema)
    return parts.collect()


def gradient(rows: DataFrame, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of all examples and its gradient as one vector."""

    def run(batches):
        value, total = 0.0, np.zeros(w.size + trans.size)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                windows = [(features(x, len(w)), np.array(y)) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if x]
                if windows:
                    v, dw, dt = likelihood(windows, w, trans)
                    value += v
                    total += np.concatenate([dw.ravel(), dt.ravel()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "value": [value], "gradient": [total.tobytes()]})

    got = _added(rows.select("tokens", "tags").mapInArrow(run, "part int, value double, gradient binary"))
    return sum(r["value"] for r in got), np.sum([np.frombuffer(r["gradient"]) for r in got], axis=0) if got else np.zeros(w.size + trans.size)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking steps; f gives value and gradient."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            kept.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).max())
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        slope, step = -(g @ q), 1.0
        while True:
            new, (v, h) = x - step * q, f(x - step * q)
            if v <= value + 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        if v >= value:
            return x
        if (new - x) @ (h - g) > 1e-10:
            pairs = [*pairs, (new - x, h - g)][-memory:]
        done = value - v < 1e-5 * abs(value)
        x, value, g = new, v, h
        if done:
            break
    return x


@dataclass
class Tagger:
    w: np.ndarray
    trans: np.ndarray

    def best(self, tokens: list[str]) -> list[int]:
        """The tags of the best sequence."""
        e = self.w[features(tokens, len(self.w))].sum(1)
        s, back = e[0], []
        for row in e[1:]:
            m = s[:, None] + self.trans
            back.append(m.argmax(0))
            s = m.max(0) + row
        out = [int(s.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def tagged(self, rows: DataFrame) -> DataFrame:
        """rows with `predicted` tags."""

        def run(batches):
            for batch in batches:
                got = [self.best(x) if x else [] for x in batch.column(batch.schema.get_field_index("tokens")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], [*batch.schema.names, "predicted"])

        ship(rows.sparkSession)
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("predicted", ArrayType(IntegerType()))]))


def fit(rows: DataFrame, n_tags: int, rounds: int = 20, l2: float = 0.1, buckets: int = BUCKETS) -> Tagger:
    """A tagger from examples: maximum likelihood with a Gaussian prior."""
    ship(rows.sparkSession)
    cut = buckets * n_tags

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = gradient(rows, x[:cut].reshape(buckets, n_tags), x[cut:].reshape(n_tags, n_tags))
        return -value + l2 / 2 * float(x @ x), l2 * x - g

    x = minimised(f, np.zeros(cut + n_tags * n_tags), rounds)
    return Tagger(x[:cut].reshape(buckets, n_tags), x[cut:].reshape(n_tags, n_tags))


def spans(tags: str) -> Column:
    """The spans (start, end, kind's number) of an array column of tags: a B tag and the I tags of its kind behind it."""
    at = F.sequence(F.lit(0), F.greatest(F.size(tags) - 1, F.lit(0)))
    begins = F.filter(at, lambda i: (F.size(tags) > 0) & (F.get(F.col(tags), i) % 2 == 1))
    ends = lambda i: F.coalesce(F.array_min(F.filter(at, lambda j: (j > i) & (F.get(F.col(tags), j) != F.get(F.col(tags), i) + 1))), F.size(tags))
    return F.transform(begins, lambda i: F.struct(i.alias("start"), ends(i).alias("end"), F.floor((F.get(F.col(tags), i) - 1) / 2).cast("int").alias("kind")))


def span_scores(rows: DataFrame) -> DataFrame:
    """kind with precision, recall and F1 of its predicted spans, whole spans only, and all kinds together (null)."""
    got = rows.select(F.explode(F.array(F.struct(F.lit("gold").alias("of"), spans("tags").alias("s")), F.struct(F.lit("found").alias("of"), spans("predicted").alias("s")), F.struct(F.lit("both").alias("of"), F.array_intersect(spans("tags"), spans("predicted")).alias("s")))).alias("x")).select("x.of", F.explode("x.s").alias("s"))
    n = got.groupBy(F.col("s.kind").alias("kind")).agg(*(F.count_if(F.col("of") == c).alias(c) for c in ("gold", "found", "both")))
    n = n.unionByName(n.agg(*(F.sum(c).alias(c) for c in ("gold", "found", "both"))).select(F.lit(None).cast("int").alias("kind"), "gold", "found", "both"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return n.select("kind", "gold", "found", ratio(F.col("both"), F.col("found")).alias("precision"), ratio(F.col("both"), F.col("gold")).alias("recall"), ratio(2 * F.col("both"), F.col("gold") + F.col("found")).alias("f1"))
