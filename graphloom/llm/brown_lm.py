"""Language-model scoring: Brown class-based n-grams.

Counts come from all training texts, and every word of them is put into a class by
exchange: a word goes to the class that raises the bigram likelihood most.  The CORE
most frequent words are exchanged one by one, in sweeps until none moves.  Then the
HEAD most frequent words enter against the class bigrams so far and are exchanged in
two more sweeps, half of them at a time; then every other word enters against the class
bigrams of the head.  While a word has no class it stands in its neighbours' contexts
as one class of its own, so no word is without context.  The end token is a class of its
own.  A text's probability is the product of smoothed class transitions, counted over
all words, and of word emissions ``(c + 1) / (n_class + v_class + 1)``.

Scale: texts are read twice, to count words and to turn them into numbers of head words
beside the strings of the others; all further passes read these numbers.  Counts and
classes of words are tables, never a map on the driver: a word outside the head meets its
count and class in a shuffle join, and none of them is frequent enough (a share under
1 / HEAD) to make a hot key.  The driver holds the head's words and classes, at most
(CORE + 2) squared pairs, and class bigrams.

Defined cases: a null text is empty and has the end token alone; a text of any length
counts whole; repeated rows are scored each; ties go to the class of least number, and
words of equal count are ordered by their bytes; without training rows, as with an empty
table, every count is 0; a null doc_id counts as the empty text where folds are concerned;
a word that training lacks may come from any class, each of which keeps a count of 1 for
it, so its chance is the sum over classes.  Only the columns named are read, so others may
have any names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Words exchanged one by one, classes, words sent to the executors.
CORE, CLASSES, HEAD = 1024, 48, 60_000
_HELD, _KEYS = 300_000, 2_000_000


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()  # maps A-Z only; splits on the contract's six characters


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c over all texts."""
    C.ship(docs.sparkSession)

    def run(batches):
        held: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in C.pieces(batches):
            for text in C.texts_of(batch, "text"):
                held.update(tokens(text))
            if len(held) > _HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int) -> list:
    """About the `most` most frequent words with their counts, by falling count; never a sort of all words.

    Words are counted by 64 buckets a power of two; of the bucket that no longer fits a share is drawn by a hash.
    """
    bucket = F.floor(F.log2("c") * 64)
    sizes = {r["b"]: r["n"] for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 64 * 63 rows
    room, chosen, drawn = most, F.lit(False), F.lit(False)
    for b in sorted(sizes, reverse=True):
        if sizes[b] > room:
            share = int(0.9 * room / sizes[b] * (1 << 20))  # nine tenths of the room, so that the draw keeps to it
            drawn = (bucket == b) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)
            break
        room, chosen = room - sizes[b], bucket >= b
    return sorted(counts.where(chosen | drawn).collect(), key=lambda r: (-r["c"], r["word"].encode()))  # at most about `most` rows


def numbered(docs: DataFrame, keep: Column, head: dict[bytes, int]) -> DataFrame:
    """A table of row, doc_id, train, units (numbers of head words, -1 for others) and rare (the others) for each document."""

    def make(batch: pa.RecordBatch) -> dict:
        units, rare, n_rare = [], [], [0]
        for text in C.texts_of(batch, "text"):
            words = tokens(text)
            u = list(map(head.get, words, repeat(-1)))
            units.append(np.array(u, np.int32))
            if -1 in u:
                rare += [w.decode("utf-8", "replace") for w, k in zip(words, u, strict=True) if k < 0]
            n_rare.append(len(rare))
        at = np.cumsum([0, *map(len, units)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(units)))
        return {"row": batch.column(0), "doc_id": batch.column(1), "train": batch.column(2), "units": lists, "rare": pa.ListArray.from_arrays(pa.array(np.array(n_rare, np.int32)), pa.array(rare, pa.string()))}

    # a key that tells repeated rows apart, fixed once the table is written
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(keep, F.lit(False)).alias("train"), "text")
    return C.save(C.per_batch(keyed, make, "row long, doc_id long, train boolean, units array<int>, rare array<string>", 512), "units")[0]


def joined(lists: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists' numbers one after another with the end token before each and after all, and the places of those before each."""
    n = lists.value_lengths().to_numpy()
    at = np.cumsum(n + 1) - n - 1
    out = np.full(int(n.sum()) + len(n) + 1, end, np.int64)
    inside = np.ones(len(out), bool)
    inside[at] = inside[-1] = False
    out[inside] = lists.flatten().to_numpy()
    return out, at


def summed(units: DataFrame, keys, size: int, columns: str, small: int = 0) -> DataFrame:
    """Partial times of each key that keys(numbers) gives over the training documents, as two numbers: quotient and rest by `size`.

    With small, the first array of keys holds numbers under it, at most `size`, which are counted in place.
    """

    def run(batches):
        held, many, counted = [], 0, np.zeros(small, np.int64)

        def flush(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key // size), pa.array(key % size), pa.array(n)], columns.split())

        for batch in C.pieces(batches, 1024):
            new = keys(batch.column(0))
            if small:
                counted += np.bincount(new.pop(0), minlength=small)
            held += new
            many += sum(map(len, new))
            if many > _KEYS:
                yield flush(*np.unique(np.concatenate(held), return_counts=True))
                held, many = [], 0
        if many:
            yield flush(*np.unique(np.concatenate(held), return_counts=True))
        there = np.flatnonzero(counted)
        if len(there):
            yield flush(there, counted[there])

    a, b, n = columns.split()
    return units.where("train").select("units").mapInArrow(run, f"{a} long, {b} long, {n} long")


def core_classes(units: DataFrame, size: int, core: int, classes: int) -> np.ndarray:
    """Classes of the core's words, by exchange over the bigrams of core words, the end token and all others as one."""
    at = np.full(size + 2, core + 1)  # the last one is that of -1
    at[:core], at[size], width = np.arange(core), core, core + 2

    def keys(lists):
        c = at[joined(lists, size)[0]]
        return [c[:-1] * width + c[1:]]

    got = summed(units, keys, width, "a b n").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # at most width squared
    pairs = np.zeros((width, width), np.int64)
    pairs[got["a"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    return exchange(pairs, core, classes)[:core]


def contexts(units: DataFrame, of: np.ndarray, k: int, moving: np.ndarray) -> tuple[np.ndarray, DataFrame, str]:
    """Class bigrams of all tokens, and a table (with its path) of word, x, n: parts of how often class d follows (x is d) and precedes (x is k + d) each moving word."""
    size, wide = len(of) - 2, max(k * k, 2 * k)
    move = np.append(moving, [False, False])  # the end token, and -1

    def keys(lists):
        seq, _ = joined(lists, size)
        c, at = of[seq], np.flatnonzero(move[seq])
        # number 0 holds the bigrams, word w has number w + 1
        return [c[:-1] * k + c[1:], (seq[at] + 1) * wide + c[at + 1], (seq[at] + 1) * wide + k + c[at - 1]]

    got, path = C.save(summed(units, keys, wide, "word x n", k * k), "contexts")
    n = np.zeros(k * k)
    for r in got.where("word = 0").groupBy("x").agg(F.sum("n").alias("n")).collect():  # at most k squared
        n[r["x"]] = r["n"]
    return n.reshape(k, k), got.where("word > 0").select((F.col("word") - 1).alias("word"), F.col("x").cast("int").alias("x"), F.lit(-1).alias("y"), "n"), path


def best(n: np.ndarray, classes: int, old: np.ndarray, word: np.ndarray, code: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most, against class bigrams n that hold it in class old (-1: nowhere).

    A word's contexts are rows (word, code, times), words in rising order: code d is class d after
    the word, code len(n) + d is class d before it.  Words of a call don't see each other move.
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    k, gain = len(n), np.zeros((len(old), classes))
    base = np.concatenate([n[:classes].T, n[:, :classes]])  # by code, then class
    known = f(base)
    once = f(base + 1.0) - known  # most words of the tail meet a code once
    for at in range(0, len(word), 100_000):
        w, c, t = word[at : at + 100_000], code[at : at + 100_000], times[at : at + 100_000].astype(float)
        up, more = once[c], np.flatnonzero(t != 1)
        up[more] = f(base[c[more]] + t[more, None]) - known[c[more]]
        own = np.flatnonzero(old[w] >= 0)
        o = old[w[own]]
        up[own, o] = known[c[own], o] - f(base[c[own], o] - t[own])
        first = np.flatnonzero(np.diff(w, prepend=-1))
        if len(first):
            gain[w[first]] += np.add.reduceat(up, first)
    for side, total in ((code < k, n.sum(1)[:classes]), (code >= k, n.sum(0)[:classes])):
        m = np.bincount(word[side], times[side], len(old))
        sizes, which = np.unique(m, return_inverse=True)
        cost = (f(total + sizes[:, None]) - f(total))[which]
        own = np.flatnonzero(old >= 0)
        cost[own, old[own]] = f(total)[old[own]] - f(total[old[own]] - m[own])
        gain -= cost
    new = gain.argmax(1)
    own = np.flatnonzero(old >= 0)
    new[own] = np.where(gain[own, new[own]] > gain[own, old[own]] + 1e-6, new[own], old[own])
    return new


def placed(rows: DataFrame, n: np.ndarray, classes: int, kind: str, now: np.ndarray | None = None) -> DataFrame:
    """word, k (its best class) and c (its count) from rows of word, x, y and n: n times the codes x and y (-1: none).

    Rows meet by word, in order, and a word's codes are added up as they stream by, of which there
    are at most twice as many as classes; now: classes of words that are numbers.
    """
    width = 2 * len(n)
    C.ship(rows.sparkSession)

    def run(batches):
        def judged(words: pa.Array, word: np.ndarray, code: np.ndarray, times: np.ndarray):
            old = np.full(len(words), -1) if now is None else now[words.to_numpy()]
            k, after = best(n, classes, old, word, code, times), code < len(n)
            c = np.bincount(word[after], times[after], len(words))
            return pa.RecordBatch.from_arrays([words, pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], ["word", "k", "c"])

        last, rest = None, ()  # the last word, which may go on in the next batch, with its codes and their times
        for batch in C.pieces(batches, 1 << 15):
            words, m = batch.column(0), batch.num_rows
            first = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, m - 1)).to_numpy(zero_copy_only=False)])
            group, names = np.cumsum(first) - 1, words.filter(pa.array(first))
            x, y, times = (batch.column(i).to_numpy() for i in (1, 2, 3))
            two = y >= 0
            keys, many = [group * width + x, group[two] * width + y[two]], [times, times[two]]
            if last is not None and names[0] == last[0]:
                keys, many = [rest[0], *keys], [rest[1], *many]
            elif last is not None:
                yield judged(last, np.zeros(len(rest[0]), np.int64), *rest)
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            word, code = np.divmod(key[begin], width)
            times = np.add.reduceat(np.concatenate(many)[order], begin)
            cut = np.searchsorted(word, len(names) - 1)
            if cut:
                yield judged(names.slice(0, len(names) - 1), word[:cut], code[:cut], times[:cut])
            last, rest = names.slice(len(names) - 1), (code[cut:], times[cut:])
        if last is not None:
            yield judged(last, np.zeros(len(rest[0]), np.int64), *rest)

    return rows.select("word", "x", "y", "n").repartition("word").sortWithinPartitions("word").mapInArrow(run, f"word {kind}, k int, c long")


def head_classes(units: DataFrame, size: int, classes: int, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the head's words, of the end token and of -1 (all other words, as one class), and the bigrams of these classes."""
    core, k = min(CORE, size), classes + 2
    of = np.full(size + 2, classes + 1)
    of[size] = classes
    of[:core] = core_classes(units, size, core, classes)
    number = np.arange(size)
    for moving in [number >= core] * (size > core) + [number % 2 == s % 2 for s in range(sweeps * (size > core))]:
        n, rows, path = contexts(units, of, k, moving)
        now = np.where(of[:size] < classes, of[:size], -1)
        got = placed(rows, n, classes, "long", now).select("word", "k").toArrow()  # at most HEAD rows
        of[got["word"].to_numpy()] = got["k"].to_numpy()
        C.remove(units.sparkSession, path)
    n, _, path = contexts(units, of, k, np.zeros(size, bool))
    C.remove(units.sparkSession, path)
    return of, n


def rare_places(units: DataFrame, of: np.ndarray) -> DataFrame:
    """A row for each word outside the head in a document: row, pos, train, word and the classes before (l) and after (r) it, the last class for another such word."""
    size = len(of) - 2

    def run(batches):
        for batch in C.pieces(batches, 1024):
            seq, begin = joined(batch.column(2), size)
            at = np.flatnonzero(seq < 0)
            doc = np.searchsorted(begin, at, "right") - 1
            c = of[seq].astype(np.int32)
            here = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(here), pa.array((at - begin[doc]).astype(np.int32)), batch.column(1).take(here), batch.column(3).flatten(), pa.array(c[at - 1]), pa.array(c[at + 1])], ["row", "pos", "train", "word", "l", "r"])

    return units.select("row", "train", "units", "rare").mapInArrow(run, "row long, pos int, train boolean, word string, l int, r int")


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = 6) -> np.ndarray:
    """A class for each unit; the first `movable` units are clustered, each other one keeps a class of its own."""
    size = len(pairs)
    classes = max(1, min(classes, movable))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)]) if movable else np.arange(size)
    if not movable:
        return of
    k = int(of.max()) + 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    n = np.zeros((k, k))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            old = of[w]
            self_ = float(pairs[w, w])
            right, left = np.bincount(of, pairs[w], k), np.bincount(of, pairs[:, w], k)
            right[old] -= self_
            left[old] -= self_
            n[old] -= right
            n[:, old] -= left
            n[old, old] -= self_
            # whichever class w takes, its neighbours' totals hold their pairs with it
            a, row, col = np.arange(classes), n.sum(1) + left, n.sum(0) + right
            big = n[a] + right  # class c with w's right neighbours
            tall = n[:, a].T + left
            both = n[a, a] + right[a] + left[a] + self_
            gain = (f(big) - f(n[a])).sum(1) + (f(tall) - f(n[:, a].T)).sum(1)
            gain += f(both) - f(n[a, a]) - (f(big[a, a]) - f(n[a, a])) - (f(tall[a, a]) - f(n[a, a]))
            gain -= f(row[a] + right.sum() + self_) - f(row[a]) + f(col[a] + left.sum() + self_) - f(col[a])
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-6 else int(old)
            n[new] += right
            n[:, new] += left
            n[new, new] += self_
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of


@dataclass
class Brown:
    number: dict[bytes, int]  # of frequent words
    of: np.ndarray  # their classes, then the end token's, then that of a word outside the head
    transition: np.ndarray  # log10 of class given class before; the last one is an unseen word's
    base: np.ndarray  # log10 of each class's denominator
    log: np.ndarray  # log10(c + 1) of frequent words, then of the end token
    n: int
    v: int


def fit(docs: DataFrame, keep: Column) -> tuple[Brown, DataFrame, DataFrame, DataFrame]:
    """The model from all rows where keep holds; word, k and c of all words; and what score() needs of all documents.

    The last two are the tables of numbered(), and of words outside the head with their class, count
    and the class before (another such word's, too).
    """
    counts, counts_path = C.save(word_counts(docs.where(keep).select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = head_words(counts, HEAD)
    C.remove(docs.sparkSession, counts_path)
    head = {r["word"].encode(): k for k, r in enumerate(top)}
    size, classes = len(head), max(1, min(CLASSES, len(head)))
    units = numbered(docs, keep, head)
    ends = units.where("train").count()
    of, n = head_classes(units, size, classes)
    other = classes + 1
    places = rare_places(units, of)
    # no word outside the head is a hot key, so all rows of a word may meet in a task
    seen = places.where("train").select("word", F.col("r").alias("x"), (F.col("l") + len(n)).alias("y"), F.lit(1).cast("long").alias("n"))
    rare, _ = C.save(placed(seen, n, classes, "string"), "rare")
    by = Window.partitionBy("row").orderBy("pos")
    own = places.join(rare, "word", "left").withColumn("k", F.coalesce("k", F.lit(other)))
    own = own.withColumn("l", F.when(F.col("l") == other, F.lag("k").over(by)).otherwise(F.col("l"))).select("row", "train", "l", "r", "k", "c")
    own, _ = C.save(own, "own")
    # bigrams of the classes of all words: those of the head, and those that a word outside it begins or ends
    n = n[:other, :other].copy()
    parts = F.array_compact(F.array(F.struct(F.col("l").alias("a"), F.col("k").alias("b")), F.when(F.col("r") != other, F.struct(F.col("k").alias("a"), F.col("r").alias("b")))))
    for r in own.where("train").select(F.explode(parts).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n")).collect():  # at most classes squared
        n[r["a"], r["b"]] += r["n"]
    v_class = np.bincount(of[:size], minlength=other).astype(float)
    v_class[classes] = 1
    for r in rare.groupBy("k").agg(F.count("*").alias("v")).collect():
        v_class[r["k"]] += r["v"]
    t = (n + 0.1) / (n.sum(1, keepdims=True) + 0.1 * len(n))
    base = n.sum(0) + v_class + 1
    mix = (n.sum(0) + 1) / base
    t = np.block([[t, (t / base).sum(1, keepdims=True)], [mix @ t / mix.sum(), (mix @ t / mix.sum() / base).sum()]])
    log = np.log10(np.array([*[r["c"] for r in top], ends]) + 1.0)
    model = Brown(head, of, np.log10(t), np.log10(np.append(base, 1.0)), log, int(total["n"] + ends), int(total["v"] + (ends > 0)))
    known = docs.sparkSession.createDataFrame([(r["word"], int(k), r["c"]) for r, k in zip(top, of, strict=False)], "word string, k int, c long")
    return model, known.unionByName(rare), units, own


def score(units: DataFrame, own: DataFrame, model: Brown) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of every document of the two tables."""
    size, k = len(model.number), len(model.base)

    def make(batch: pa.RecordBatch) -> dict:
        seq, begin = joined(batch.column(3), size)
        c = model.of[seq]
        doc = np.searchsorted(begin, np.arange(1, len(seq)), "left") - 1  # an end token closes the document before it
        a, b, u = c[:-1], c[1:], seq[1:]
        inside = u >= 0
        both = inside & (seq[:-1] >= 0)
        many = len(begin)
        log = np.where(inside, model.log[u], 0.0)
        step = np.where(both, model.transition[a, b], 0.0) - np.where(inside, model.base[b], 0.0)
        known = np.bincount(doc[inside], minlength=many) - (0 if model.log[-1] > 0 else 1)
        return {"row": batch.column(0), "doc_id": batch.column(1), "train": batch.column(2), "n_tokens": np.bincount(doc, minlength=many), "head_known": known, "head_sum": np.bincount(doc, log, many), "class_sum": np.bincount(doc, step, many)}

    parts = C.per_batch(units.select("row", "doc_id", "train", "units"), make, "row long, doc_id long, train boolean, n_tokens long, head_known long, head_sum double, class_sum double", 1024)

    def rest(batch: pa.RecordBatch) -> dict:
        before, after, own_k = (batch.column(i).to_numpy() for i in (1, 2, 3))
        c = batch.column(4).to_numpy(zero_copy_only=False)  # a count, or NaN for a word that training lacks
        step = model.transition[before, own_k] - model.base[own_k] + np.where(after < k - 1, model.transition[own_k, after], 0.0)
        return {"row": batch.column(0), "known": (~np.isnan(c)).astype(np.int64), "log": np.log10(np.nan_to_num(c) + 1), "step": step}

    found = C.per_batch(own.select("row", "l", "r", "k", F.col("c").cast("double").alias("c")), rest, "row long, known long, log double, step double", 1 << 16)
    found = found.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("log").alias("more_sum"), F.sum("step").alias("more_class"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.col("head_sum") + zero("more_sum")
    return parts.join(found, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("head_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (total - F.col("n_tokens") * F.lit(log10(model.n + model.v + 1))).alias("base_score"), (total + F.col("class_sum") + zero("more_class")).alias("score"),
    )


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model, _, units, own = fit(docs, C.crc_mod("doc_id", 7) != 2)
    got = score(units, own, model)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
