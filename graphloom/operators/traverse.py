"""Traversal: ego networks, simple paths, shortest paths.

The only driver loops are over depth, which is at most a small constant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import stored

from .graph import both_ways


def ego(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """id and depth (the fewest steps from the start, at most `depth`), undirected."""
    spark = edges.sparkSession
    step = both_ways(edges).select("node", "other").distinct()
    seen = spark.createDataFrame([(start, 0)], "id string, depth int")
    front = seen.select("id")
    for d in range(1, depth + 1):
        front = step.join(front.withColumnRenamed("id", "node"), "node").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen


def limited(reached: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The nearest `limit` nodes (ties by id), and whether any was dropped."""
    kept = reached.orderBy("depth", "id").limit(limit)
    return kept, reached.agg((F.count("*") > limit).alias("truncated"))


def _grown(step: DataFrame, start: str, hops: int, never: str) -> list[DataFrame]:
    """Simple paths of 0, 1, ... hops from the start as (at, path), none through `never`.

    A hop's paths stand in a table, so its size is known and the next one can broadcast it if it is small.
    """
    out = [F.broadcast(step.sparkSession.createDataFrame([(start, [start])], "at string, path array<string>"))]  # one row
    for _ in range(hops):
        out.append(stored(_onward(out[-1].where(F.col("at") != never), step), "paths"))
    return out


def _onward(paths: DataFrame, step: DataFrame) -> DataFrame:
    """Paths one hop longer; repeated mentions of an edge count once."""
    grown = paths.join(step, F.col("at") == F.col("node")).where(~F.array_contains("path", F.col("other")))
    return grown.select(F.col("other").alias("at"), F.concat("path", F.array("other")).alias("path")).distinct()


def paths(edges: DataFrame, start: str, end: str, max_hops: int = 3, max_paths: int | None = None) -> DataFrame:
    """All simple undirected paths, as arrays of ids, with their number of hops; the first `max_paths` by hops and ids.

    Paths grow from both ends and meet in the middle: none is longer than half the way before
    it is known to go on to the other end.  The last hop of an odd way takes only edges to nodes
    that the other side has reached.  edges: source and target, which may be repeated, as only those
    at the paths' ends are looked at; no step deals out all of them unless a hop's paths are too many
    to be broadcast.
    """
    step = both_ways(edges.select("source", "target")).select("node", "other").where("node <> other")
    half = max_hops // 2
    behind = _grown(step, end, half, start)
    ahead = _grown(step, start, half, end)
    out = []
    for hops in range(1, max_hops + 1):
        far = behind[hops // 2]
        if hops % 2 and hops // 2 == half:
            reached = far.select(F.col("at").alias("other")).distinct()
            near = _onward(ahead[half].where(F.col("at") != end), step.join(reached, "other", "left_semi").select("node", "other"))
        else:
            near = ahead[(hops + 1) // 2]
        met = near.join(far.select("at", F.reverse("path").alias("rest")), "at").select("path", F.slice("rest", 2, hops).alias("rest"))
        out.append(met.where(~F.arrays_overlap("path", "rest")).select(F.concat("path", "rest").alias("path"), F.lit(hops).alias("hops")))
    every = reduce(DataFrame.unionByName, out)
    return every.orderBy("hops", "path").limit(max_paths) if max_paths else every


def steps(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Each path's steps with the first edge (by mention, then relation) between neighbours, in either direction; edges may be repeated.

    Only the steps' own edges are compared: the paths go to a table, whose pairs are looked up first.
    """
    found = stored(found, "found")
    pairs = found.select("path", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("step", "x")).select("path", "step", F.col("x.a").alias("node"), F.col("x.b").alias("other"))
    pairs = stored(pairs, "steps")
    first = both_ways(edges).join(pairs.select("node", "other").distinct(), ["node", "other"], "left_semi").groupBy("node", "other").agg(F.min(F.struct("seq", "rel", "direction")).alias("e"))
    return pairs.join(first, ["node", "other"]).select(F.array_join("path", ">").alias("path"), "step", "node", "other", F.col("e.rel").alias("rel"), F.col("e.direction").alias("direction"))


def _levels(step: DataFrame, start: str, depth: int, ahead: bool) -> list[DataFrame]:
    """Nodes at 0, 1, ... steps from the start with the first path by ids between, from the start on or up to it."""
    front = step.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    out, seen = [front], front.select("id")
    for _ in range(depth):
        own = F.array(F.col("other"))
        met = front.join(step, F.col("id") == F.col("node")).select(F.col("other").alias("id"), (F.concat("path", own) if ahead else F.concat(own, F.col("path"))).alias("path"))
        front = met.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti")
        out.append(front)
        seen = seen.unionByName(front.select("id"))
    return out


def shortest(edges: DataFrame, start: str, end: str, max_hops: int = 4) -> DataFrame:
    """The first shortest path by ids, if there is one of at most max_hops: breadth-first from both ends, with one path a node."""
    step = both_ways(edges).select("node", "other").distinct()
    ahead, behind = _levels(step, start, (max_hops + 1) // 2, True), _levels(step, end, max_hops // 2, False)
    met = [ahead[(h + 1) // 2].join(behind[h // 2].select("id", F.slice("path", 2, max_hops).alias("rest")), "id").select(F.concat("path", "rest").alias("path"), F.lit(h).alias("hops")) for h in range(max_hops + 1)]
    return reduce(DataFrame.unionByName, met).orderBy("hops", "path").limit(1)
