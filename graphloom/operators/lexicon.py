"""Dictionary search with tables of terms: leftmost, longest, non-overlapping matches.

Terms go to the tasks as a broadcast of a bounded block, from which each worker builds one
automaton; texts are read once for each block.  With several blocks a text's longest match at each
place is gathered over the blocks before the non-overlapping ones are chosen, so that a term of one
block gives way to that of another as if there were one dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import ship, stored

#: Characters of a block's terms.
BLOCK_CHARS = 8_000_000


def chosen(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (start, length), one a start in ascending order, those that don't overlap one chosen before."""
    out, upto = [], 0
    for start, n in spans:
        if start >= upto:
            out.append((start, n))
            upto = start + n
    return out


@lru_cache(maxsize=2)
def _automaton(terms: Broadcast):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for t in terms.value:
        found.add_word(t)
    found.make_automaton()
    return found


def _longest_at(text: str, terms: Broadcast) -> list[tuple[int, int]]:
    """(start, length) of the longest match at each place where there is one."""
    best: dict[int, int] = {}
    for end, n in _automaton(terms).iter(text):
        if n > best.get(end - n + 1, 0):
            best[end - n + 1] = n
    return sorted(best.items())


def matches(docs: DataFrame, key: str, text: str, terms: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, start (from 1), term: leftmost and longest matches of the terms (column term) in the texts.

    Rows of docs are told apart by key; a null text has no match; null, empty and repeated terms don't
    count.  The terms of one block (about `block_chars` characters, dealt by a hash) are on the driver
    at a time.
    """
    spark = ship(docs.sparkSession)
    terms = stored(terms.select("term").where("term <> ''").distinct(), "terms")
    size = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_chars))
    of_key = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    found = []
    for block in range(n_blocks):
        sent = spark.sparkContext.broadcast([r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == block).collect()])

        def run(batches, sent=sent, whole=n_blocks == 1):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows, starts, lengths, names = [], [], [], []
                    for i, t in enumerate(part.column(1).to_pylist()):
                        spans = _longest_at(t, sent) if sent.value else []
                        for a, n in chosen(spans) if whole else spans:
                            rows.append(i), starts.append(a), lengths.append(n), names.append(t[a : a + n])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(names, pa.string())], ["key", "start", "length", "term"])

        found.append(own.mapInArrow(run, f"key {of_key}, start int, length int, term string"))
    got = reduce(DataFrame.unionByName, found)
    if n_blocks > 1:
        longest = got.groupBy("key", "start").agg(F.max(F.struct("length", "term")).alias("m")).select("key", "start", "m.length", "m.term")

        def pick(table: pa.Table) -> pa.Table:
            table = table.sort_by("start")
            kept = {a for a, _ in chosen(zip(table["start"].to_pylist(), table["length"].to_pylist(), strict=True))}
            return table.filter(pa.array([a in kept for a in table["start"].to_pylist()], pa.bool_()))

        got = longest.groupBy("key").applyInArrow(pick, longest.schema)  # a text's matches at most
    return got.select(F.col("key").alias(key), (F.col("start") + 1).alias("start"), "term")


def supervised(mentions: DataFrame, entities: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, head, tail, their places and the relation: sentences that name both ends of a fact, as samples of its relation.

    mentions: keys, start, term; entities: term, id, type; facts: source, rel, target.  Two neighbouring
    mentions of different entities that no fact joins are samples of no relation (NA).  Facts lead from
    a sentence's mentions to one another, so no sentence's pairs are all made.
    """
    own = mentions.join(entities, "term")
    end = lambda c: own.select(*keys, F.col("id").alias(c), F.col("start").alias(f"{c}_at"))
    known = facts.select("source", "rel", "target").distinct()
    yes = end("source").join(known, "source").join(end("target"), [*keys, "target"]).where("source <> target")
    yes = yes.groupBy(*keys, "source", "rel", "target").agg(F.min(F.struct(F.abs(F.col("source_at") - F.col("target_at")).alias("d"), "source_at", "target_at")).alias("m"))
    yes = yes.select(*keys, "source", "target", "m.source_at", "m.target_at", "rel")
    w = Window.partitionBy(*keys).orderBy("start", "id")
    pair = own.select(*keys, F.col("id").alias("source"), F.col("start").alias("source_at"), F.lead("id").over(w).alias("target"), F.lead("start").over(w).alias("target_at")).where("source <> target")
    turned = known.select(F.col("target").alias("source"), F.col("source").alias("target"))
    joined = known.select("source", "target").unionByName(turned).distinct()
    no = pair.join(joined, ["source", "target"], "left_anti").groupBy(*keys, "source", "target").agg(F.min(F.struct("source_at", "target_at")).alias("m"))
    return yes.unionByName(no.select(*keys, "source", "target", "m.source_at", "m.target_at", F.lit("NA").alias("rel")))
