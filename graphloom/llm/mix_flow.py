"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow network routes each pattern's words to the quotas of its sources; a
pattern offers its words once for each allowed repetition, at costs that rise with
the repetition, so no text is repeated while fresh text of the source is left.
Documents are then selected whole, in the order of a seeded hash, until their
pattern's flow is used.

Scale: the driver sees a row per pattern.  Selection needs no sort of a source: sizes are
summed by the first bits of the hash (a map-side combine), then by the next bits within the bin
where the flow ends, until that bin holds at most WALK documents, which are walked through one
by one.  The document at which the flow ends doesn't fit; those behind it that are no longer than
what is left are summed again in the same way, so that an outsized document costs a further pass
and not the source's target.  What is taken are a few ranges of the hash for each pattern.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; a text of any length counts whole; repeated rows
count as documents, and rows equal in id and text share a hash, so it doesn't matter which of them
are taken; an empty table gives an empty table.  Reruns on the same rows agree.  Only doc_id, text and the source are read, so
other columns may have any names.

Bounds: a row per pattern and per source reaches the driver.  The query's documents have
one source each, so there a pattern is a source; overlapping ones come in by `members`.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Bits of a level's bins; documents of a bin that are walked; a part is met once less than its 2,000th is left.
LEVEL, WALK, NEAR = 12, 64, 2000
_OPEN = "size > 0 AND size <= part_limit AND (key > low_key OR (key = low_key AND row > low_row)) AND (NOT by_row OR key = at_key)"
Source = str | None


def order(sources: Iterable[Source]) -> list[Source]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[Source, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, total: int | None = None) -> dict[Source, float]:
    """Shares of `share` times all words by the repeating weights; none above `most` times its source, the excess reshared by weight."""
    names = order(sizes)
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    out: dict[Source, float] = {}
    rest, open_ = share * (sum(sizes.values()) if total is None else total), list(names)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = most * float(sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow of each arc (from, to, capacity, cost >= 0) of a cheapest maximal flow, by successive shortest paths with potentials."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        via, dist[source] = [-1] * n, 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                if cap[e] and (x := d + cost[e] + potential[u] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if via[sink] < 0:
            return [cap[2 * k + 1] for k in range(len(arcs))]
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: dict[str, int], quotas: dict[Source, int], repeats: int = 2) -> dict[str, dict[Source, int]]:
    """Words that each pattern (a JSON list of sources) gives to each source; the r-th use of a text costs r * r."""
    pats, names = sorted(patterns), order(quotas)
    place = {s: 1 + len(pats) + k for k, s in enumerate(names)}
    sink = 1 + len(pats) + len(names)
    arcs, routes = [], []
    for k, p in enumerate(pats):
        arcs += [(0, 1 + k, patterns[p], r * r) for r in range(1, repeats + 1)]
    for k, p in enumerate(pats):
        for s in order(set(json.loads(p))):
            routes.append((len(arcs), p, s))
            arcs.append((1 + k, place[s], repeats * patterns[p], 0))
    arcs += [(place[s], sink, quotas[s], 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    out: dict[str, dict[Source, int]] = {p: {} for p in pats}
    for k, p, s in routes:
        out[p][s] = flow[k]
    return out


def sized(docs: DataFrame, members: Column, seed: int = 0) -> DataFrame:
    """doc_id, pattern, size, key (the seeded order) and row (tells equal keys apart) of every row; read again, not computed again."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text")
    size = F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long")
    return C.save(docs.select("doc_id", F.to_json(F.array_sort(members)).alias("pattern"), size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "sized")[0]


@dataclass
class Pick:
    """Where the selection of a pattern stands."""

    left: int  #: words still to be taken
    limit: int  #: longer documents are passed over
    low: tuple[int, int] = (-(1 << 63), -1)  #: documents up to here are settled
    depth: int = 0  #: level of the search for the end, and the bins chosen on the levels before
    bin: int = 0
    key: int = 0
    ranges: list[tuple] = field(default_factory=list)  #: (after, before, no longer than) of what is taken
    passed: tuple[int, int, int] | None = None  #: the shortest document passed over: size, key, row

    def shift(self) -> int:
        return max(0, 64 - LEVEL - LEVEL * (self.depth % 6))

    def settle(self, end: tuple[int, int, int] | None) -> None:
        """Take what lies before the document at which it ends, all if none."""
        self.ranges.append((*self.low, *(end[:2] if end else ((1 << 63) - 1, (1 << 63) - 1)), self.limit))
        if end:
            self.low, self.limit, self.depth = end[:2], self.left, 0
            if self.passed is None or end[2] < self.passed[0]:
                self.passed = (end[2], *end[:2])
        else:
            self.limit = 0


def choose(rows: DataFrame, parts: dict[str, int]) -> dict[str, Pick]:
    """For each pattern the ranges whose documents hold about its part of words: in order, each that fits what is left."""
    spark = rows.sparkSession
    picks = {p: Pick(n, n) for p, n in parts.items()}
    state = "pattern string, part_limit long, low_key long, low_row long, by_row boolean, shift int, above int, bin long, at_key long"
    while open_ := {p: x for p, x in picks.items() if x.limit > 0 and x.left * NEAR > parts[p]}:
        # a row for each pattern
        now = spark.createDataFrame([(p, x.limit, *x.low, x.depth >= 6, x.shift(), 64 if x.depth % 6 == 0 else x.shift() + (LEVEL if x.depth % 6 < 5 else 4), x.bin, x.key) for p, x in open_.items()], state)
        held = rows.join(F.broadcast(now), "pattern").where(_OPEN).withColumn("at", F.expr("CASE WHEN by_row THEN row ELSE key END"))
        inside = held.where("above = 64 OR shiftright(at, above) = bin").withColumn("b", F.expr("shiftright(at, shift)"))
        bins = inside.groupBy("pattern", "b").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        left = spark.createDataFrame([(p, x.left) for p, x in open_.items()], "pattern string, left_over long")
        upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("b"))  # at most 2^LEVEL bins
        ends = bins.withColumn("upto", upto).join(F.broadcast(left), "pattern")
        found = ends.groupBy("pattern").agg(F.min(F.when(F.col("upto") > F.col("left_over"), F.struct("b", "n", "upto", "docs"))).alias("end"), F.sum("n").alias("all")).collect()
        few = []
        for r in found:
            p, x = r["pattern"], open_.pop(r["pattern"])
            if r["end"] is None:  # all that is open fits
                x.left -= r["all"]
                x.settle(None)
                continue
            x.left -= r["end"]["upto"] - r["end"]["n"]
            if x.left * NEAR <= parts[p]:  # the bins before are enough
                start = r["end"]["b"] << x.shift()
                x.ranges.append((*x.low, *((x.key, start) if x.depth >= 6 else (start, -(1 << 63))), x.limit))
                x.limit = 0
            elif r["end"]["docs"] <= WALK:
                few.append((p, x.limit, *x.low, x.depth >= 6, x.shift(), r["end"]["b"], x.key))
            else:
                x.bin = r["end"]["b"]
                x.key = x.bin if x.depth == 5 else x.key
                x.depth += 1
        for x in open_.values():  # nothing is open that fits
            x.limit = 0
        if few:
            now = spark.createDataFrame(few, "pattern string, part_limit long, low_key long, low_row long, by_row boolean, shift int, bin long, at_key long")
            near = rows.join(F.broadcast(now), "pattern").where(f"{_OPEN} AND shiftright(CASE WHEN by_row THEN row ELSE key END, shift) = bin")
            walked: dict[str, list] = {}
            for r in near.select("pattern", "key", "row", "size").collect():  # at most WALK of a pattern
                walked.setdefault(r["pattern"], []).append((r["key"], r["row"], r["size"]))
            for p, docs in walked.items():
                for doc in sorted(docs):
                    if doc[2] > picks[p].left:
                        picks[p].settle(doc)
                        break
                    picks[p].left -= doc[2]
    for x in picks.values():
        if x.passed and 2 * x.left > x.passed[0]:  # nearer to the part with it than without
            size, key, row = x.passed
            x.ranges.append((key, row - 1, key, row + 1, size))
    return picks


def mix(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> tuple[DataFrame, dict[Source, int], dict[Source, float]]:
    """Rows of sized() with `taken`, and the sources' sizes and targets."""
    spark = rows.sparkSession
    patterns = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    sizes: dict[Source, int] = {}
    for p, n in patterns.items():
        for s in set(json.loads(p)):
            sizes[s] = sizes.get(s, 0) + n
    aim = targets(sizes, weights, share, float(repeats), sum(patterns.values()))
    flow = {p: sum(f.values()) for p, f in route(patterns, {s: round(t) for s, t in aim.items()}, repeats).items()}
    # every document `whole` times, and documents of `part` words once more
    picks = choose(rows, {p: f % max(1, patterns[p]) for p, f in flow.items()})
    kind = "pattern string, whole long, ranges array<struct<after_key:long,after_row:long,before_key:long,before_row:long,longest:long>>"
    plan = spark.createDataFrame([(p, f // max(1, patterns[p]), picks[p].ranges) for p, f in flow.items()], kind)
    more = F.expr("exists(ranges, r -> size <= r.longest AND (key > r.after_key OR (key = r.after_key AND row > r.after_row)) AND (key < r.before_key OR (key = r.before_key AND row < r.before_row)))")
    held = rows.join(F.broadcast(plan), "pattern")  # a row for each pattern
    return held.select("doc_id", "pattern", "size", (F.col("size") * (F.col("whole") + more.cast("long"))).alias("taken")), sizes, aim


def op2_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sizes, aim = mix(sized(C.documents(spark, sf_dir), F.array("source")))
    each = spark.createDataFrame([(json.dumps([s], ensure_ascii=False, separators=(",", ":")), sizes[s], aim[s]) for s in order(sizes)], "pattern string, source_size long, target double")
    return rows.join(F.broadcast(each), "pattern").select("doc_id", "size", "source_size", "target", "taken")  # a row per source
