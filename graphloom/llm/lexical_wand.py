"""Ranked lexical search: WAND over shards of documents.

Items (the stated query set) are taken in blocks of bounded bytes, so that a block's
vocabulary can go to every task.  For each block the documents are read once: a row keeps its
length and the frequencies of the block's terms.  Document frequencies and lengths over all
rows give the terms' weights.  A shard is what one task reads; it is indexed in parts of about
a million postings, each with its terms' maximum impacts, and searched by WAND: cursors sorted
by document, the pivot is the first document at which the maximum impacts of the terms up to
there can reach the threshold, and cursors before it jump to it, so that documents between are
never scored.  The heap of an item goes on from part to part; the shards' heaps are merged by
two ranks, the first within 64 groups of shards.

The threshold needn't start at zero: a first look scores the documents that hold an item's
rarest terms.  The k-th best of these is no higher than the k-th best of all, so WAND can start
from it everywhere and still finds every document of the result; equal scores go on, as ids
decide between them.

Defined cases: a null or empty text, or one without a term, is no document of the collection;
a null item text has no result; a text of any length counts whole; repeated rows are documents
of their own; rows without doc_id are ranked, last among equal scores; items with equal item_id
are ranked each; empty tables give an empty result.  Only doc_id and text, item_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common as C

#: Bytes of a block's item texts, postings of an index part, groups of shards at the first merge.
BLOCK_BYTES, PART, GROUPS = 4 << 20, 1 << 20, 64
#: Letters A-Z to small ones; all ASCII but digits and letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LAST = (1 << 63) - 1
POSTINGS = "doc_id long, n long, terms array<int>, tf array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items (item_id, text) in lists of about `most` bytes of text; one list at a time is on the driver."""
    held, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the frequencies of the vocabulary's terms, of each row that has a term; written and read again."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "tf": []}
        find = vocabulary.get
        for doc_id, text in zip(batch.column(0).to_pylist(), C.texts_of(batch, "text"), strict=True):
            words = terms_of(text)
            if words:
                count = Counter(map(find, words))
                count.pop(None, None)
                for name, value in zip(out, (doc_id, len(words), list(count), list(count.values())), strict=True):
                    out[name].append(value)
        return out

    return C.save(C.per_batch(docs.select("doc_id", "text"), make, POSTINGS), "postings")[0]


class Part:
    """An inverted index over some rows: for each term its documents (ascending places), impacts and maximum impact."""

    def __init__(self, ids: list, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        names, starts = np.unique(term[order], return_index=True)
        self.at: dict[int, tuple[int, int, int]] = {}
        if len(names):
            ends, most = [*starts[1:].tolist(), len(term)], np.maximum.reduceat(self.impact, starts)
            self.at = {t: (a, b, x) for t, a, b, x in zip(names.tolist(), starts.tolist(), ends, most.tolist(), strict=True)}
        self.lists: dict[int, tuple[list[int], list[int]]] = {}

    def cursor_lists(self, term: int) -> tuple[list[int], list[int]]:
        if term not in self.lists:
            a, b, _ = self.at[term]
            self.lists[term] = self.doc[a:b].tolist(), self.impact[a:b].tolist()
        return self.lists[term]

    def score(self, doc: np.ndarray, query: list[tuple[int, int]]) -> np.ndarray:
        """Scores of stated documents."""
        out = np.zeros(len(doc), np.int64)
        for term, w in query:
            if term in self.at:
                a, b, _ = self.at[term]
                at = np.searchsorted(self.doc[a:b], doc)
                at[at == b - a] = 0
                out += np.where(self.doc[a:b][at] == doc, w * self.impact[a:b][at], 0)
        return out


def offer(heap: list, k: int, score: int, doc_id: int | None) -> None:
    """Keep the k best by score, then by smaller id, null last."""
    entry = (score, -(_LAST if doc_id is None else doc_id), doc_id is None)
    if len(heap) < k:
        heappush(heap, entry)
    elif entry > heap[0]:
        heapreplace(heap, entry)


def wand(part: Part, query: list[tuple[int, int]], heap: list, k: int, floor: int = 1) -> int:
    """Offer the part's documents that can be among the k best to the heap; how many were scored."""
    cursors = []  # document, place, documents, impacts, most it can add, weight
    for term, w in query:
        if term in part.at and w > 0:
            docs, impacts = part.cursor_lists(term)
            cursors.append([docs[0], 0, docs, impacts, w * part.at[term][2], w])
    by_doc, scored = itemgetter(0), 0
    threshold = max(1, floor, heap[0][0] if len(heap) == k else 0)
    while cursors:
        cursors.sort(key=by_doc)
        reach = 0
        for p, c in enumerate(cursors):
            reach += c[4]
            if reach >= threshold:
                break
        else:
            return scored  # no document that is left can reach it
        pivot, spent = cursors[p][0], False
        if cursors[0][0] == pivot:
            score, scored = 0, scored + 1
            for c in cursors:
                if c[0] != pivot:
                    break
                score += c[5] * c[3][c[1]]
                c[1] += 1
                if c[1] < len(c[2]):
                    c[0] = c[2][c[1]]
                else:
                    spent, c[0] = True, -1
            if score >= threshold:
                offer(heap, k, score, part.ids[pivot])
                if len(heap) == k:
                    threshold = max(threshold, heap[0][0])
        else:
            for c in cursors[:p]:
                if c[0] < pivot:
                    c[1] = bisect_left(c[2], pivot, c[1])
                    if c[1] < len(c[2]):
                        c[0] = c[2][c[1]]
                    else:
                        spent, c[0] = True, -1
        if spent:
            cursors = [c for c in cursors if c[0] >= 0]
    return scored


def parts(batches, n_docs: int, n_terms: int, most: int = PART) -> Iterator[Part]:
    """A task's rows as index parts of about `most` postings."""
    ids, n, doc, term, tf, size = [], [], [], [], [], 0

    def made() -> Part:
        m = 25 + 75 * np.concatenate(n) * n_docs // n_terms if n else np.zeros(0, np.int64)
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return Part(ids, m, cat(doc), cat(term), cat(tf))

    for batch in C.pieces(batches, 4096):
        lists, counts = batch.column(2), batch.column(3)
        own = np.diff(lists.offsets.to_numpy())
        doc.append(np.repeat(np.arange(len(own)) + len(ids), own))
        flat = slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py())
        term.append(np.asarray(lists.values)[flat]), tf.append(np.asarray(counts.values)[flat])
        n.append(batch.column(1).to_numpy())
        ids += batch.column(0).to_pylist()
        size += int(own.sum())
        if size >= most:
            yield made()
            ids, n, doc, term, tf, size = [], [], [], [], [], 0
    if ids:
        yield made()


def shard_heaps(table: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int, floors: list[int] | None = None, probes: list[list[int]] | None = None) -> DataFrame:
    """item (its place), shard, doc_id and score of each shard's k best; with probes only documents that hold an item's probe terms count."""

    def run(batches):
        heaps: list[list] = [[] for _ in queries]
        for part in parts(batches, n_docs, n_terms):
            for j, (query, heap) in enumerate(zip(queries, heaps, strict=True)):
                if probes is None:
                    wand(part, query, heap, k, floors[j] if floors else 1)
                else:
                    held = [part.doc[slice(*part.at[t][:2])] for t in probes[j] if t in part.at]
                    if held:
                        docs = np.unique(np.concatenate(held))
                        for d, s in zip(docs.tolist(), part.score(docs, query).tolist(), strict=True):
                            if s > 0:
                                offer(heap, k, s, part.ids[d])
        rows = [(j, None if null else -x, s) for j, heap in enumerate(heaps) for s, x, null in heap]
        shard = TaskContext.get().partitionId()
        item, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([shard] * len(rows), pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item", "shard", "doc_id", "score"])

    C.ship(table.sparkSession)
    return table.mapInArrow(run, "item int, shard int, doc_id long, score long")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank: first within groups of shards, then of those."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = F.row_number().over(Window.partitionBy("item", F.pmod("shard", F.lit(GROUPS))).orderBy(*best))
    some = heaps.withColumn("rank", near).where(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    out = []
    for block in blocks(items, block_bytes):
        vocabulary: dict[bytes, int] = {}
        asked = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)) for _, text in block]
        table = postings(docs, vocabulary)
        n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        # a row for each term of the block
        df = {r["t"]: r["n"] for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = [[(t, c * weight[t]) for t, c in q.items() if weight.get(t)] for q in asked]
        probes = []
        for query in queries:
            rare, seen = [], 0
            for n, t in sorted((df[t], t) for t, _ in query):
                if seen >= 8 * k:
                    break
                rare.append(t)
                seen += n
            probes.append(rare)
        first = merged(shard_heaps(table, queries, n_docs, n_terms, k, probes=probes), k)
        floors = [1] * len(block)
        for r in first.where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
            floors[r["item"]] = r["score"]
        best = merged(shard_heaps(table, queries, n_docs, n_terms, k, floors), k)
        names = spark.createDataFrame([(j, item_id) for j, (item_id, _) in enumerate(block)], StructType([StructField("item", best.schema["item"].dataType), StructField("item_id", id_type)]))
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block's items
    if out:
        return reduce(DataFrame.unionByName, out)
    return spark.createDataFrame([], StructType([StructField("item_id", id_type)])).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score").where("false")


def op11_lexical_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents), n AS (SELECT rid, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
 s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM n), q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
 f AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, nd),
 m AS (SELECT rid, doc_id, 25 + (75 * n * nd) // nt AS m FROM n, s),
 x AS (SELECT item_id, m.doc_id, rid, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL)
 SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
