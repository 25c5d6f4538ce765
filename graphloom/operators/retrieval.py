"""Retrieval over facts: routes, ranking, quotas, diversity, guard and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways

#: Facts per relation slot, others 1.
SLOT_QUOTAS = {"HAS_SYMPTOM": 4, "TREATED_BY": 3, "USES_DRUG": 3, "BELONGS_TO": 2, "NEEDS_CHECK": 3, "HAS_COMPLICATION": 2, "DIFFERENTIAL_WITH": 2, "AFFECTS": 2}
#: Weight of each recall route.
ROUTE_WEIGHT = {"kg_1hop": 1.0, "kg_2hop": 0.92, "kg_similar": 0.85, "kg_reasoned": 0.8}
#: Places kept for each category of facts.
RESERVE = {"related": 2, "kg_2hop": 2, "kg_reasoned": 1}
#: What a violation of each severity costs.
SEVERITY_COST = {"critical": 0.30, "high": 0.12, "medium": 0.05, "low": 0.02}


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    """A small fixed map as a CASE expression."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def slot_facts(edges: DataFrame) -> DataFrame:
    """Direct facts of every entity, as many per relation as its slot's quota."""
    w = Window.partitionBy("source", "rel").orderBy(F.desc("confidence"), "target")
    return edges.withColumn("slot_rank", F.row_number().over(w)).where(F.col("slot_rank") <= lookup(SLOT_QUOTAS, F.col("rel"), 1))


def union_routes(*routes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Facts of all routes; of equal facts (of each question) the more confident, then the more direct route's."""
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r)
    order = F.struct((-F.col("confidence")).alias("c"), (-lookup(ROUTE_WEIGHT, F.col("route"), 0.5)).alias("w"), "route")
    best = out.groupBy(*by, "head", "rel", "tail").agg(F.min(order).alias("m"))
    return best.select(*by, "head", "rel", "tail", (-F.col("m.c")).alias("confidence"), F.col("m.route").alias("route"))


def scored(facts: DataFrame, prior: Column, proximity: Column, degree_share: Column) -> DataFrame:
    """Facts with their score, rounded to four digits."""
    s = lookup(ROUTE_WEIGHT, F.col("route"), 0.5) * (0.45 * F.col("confidence") + 0.30 * prior + 0.15 * proximity + 0.10 * degree_share)
    return facts.withColumn("score", F.round(s, 4))


def confident(facts: DataFrame, by: str, least: float = 0.55, at_least: int = 3) -> DataFrame:
    """Facts of at least that confidence, where at_least of them are left; else all."""
    n = F.count_if(F.col("confidence") >= least).over(Window.partitionBy(by))
    return facts.withColumn("_n", n).where((F.col("confidence") >= least) | (F.col("_n") < at_least)).drop("_n")


def diverse(facts: DataFrame, by: str, category: Column, top_k: int = 12) -> DataFrame:
    """The best facts with places kept for some categories, numbered by rank as KG-1, KG-2, ..."""
    order = [F.desc("score"), F.desc("confidence"), "head", "rel", "tail"]
    inside = F.row_number().over(Window.partitionBy(by, "category").orderBy(*order))
    kept = facts.withColumn("category", category).withColumn("reserved", (inside <= lookup(RESERVE, F.col("category"), 0)).cast("int"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("reserved"), *order))
    chosen = kept.withColumn("_place", place).where(F.col("_place") <= top_k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return chosen.withColumn("evidence", F.concat(F.lit("KG-"), rank)).drop("_place")


def guard_score(violations: DataFrame, by: str) -> DataFrame:
    """One less the cost of the distinct violations, within 0 and 1, rounded to three digits; n of them."""
    cost = violations.select(by, "kind", "severity").distinct().groupBy(by).agg(F.count("*").alias("n"), F.sum(lookup(SEVERITY_COST, F.col("severity"), 0.0)).alias("c"))
    return cost.select(by, "n", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("c"))), 3).alias("guard"))


def answer_confidence(intent: Column, evidence: Column, guard: Column, n_facts: Column, critical: Column) -> Column:
    """Blend of intent, evidence and guard, capped without facts or with a critical violation."""
    raw = 0.35 * intent + 0.35 * evidence + 0.30 * guard
    return F.when(n_facts == 0, F.least(raw, F.lit(0.25))).when(critical, F.least(raw, F.lit(0.45))).otherwise(raw)


def asked(edges: DataFrame, rel: str, most: int = 2) -> DataFrame:
    """question, entity: what a question names beside its main entity, the `most` most confident targets of a relation."""
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "target"))
    return edges.where(F.col("rel") == rel).withColumn("k", k).where(F.col("k") <= most).select(F.col("source").alias("question"), F.col("target").alias("entity"))


def turned(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """question, head, rel, tail, confidence: edges that end in an entity of the question."""
    return entities.join(edges.withColumnRenamed("target", "entity"), "entity").select("question", F.col("source").alias("head"), "rel", F.col("entity").alias("tail"), "confidence")


def by_way(first: DataFrame, onward: DataFrame, goals: DataFrame, rel: str = "RELATED_TO", cap: int = 6) -> DataFrame:
    """Two-step paths from an entity against an edge to its head and onward to a goal of the question.

    first: turned(); onward: edges; goals: question, goal.  A path's confidence is the lesser of its
    steps', a pair's that of its best path; the best `cap` of a question.
    """
    step = onward.select(F.col("source").alias("head"), F.col("target").alias("goal"), F.col("confidence").alias("c2"))
    met = first.join(step, "head").join(goals, ["question", "goal"]).groupBy("question", "tail", "goal").agg(F.max(F.least("confidence", "c2")).alias("confidence"))
    k = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("confidence"), "tail", "goal"))
    return met.withColumn("k", k).where(F.col("k") <= cap).select("question", F.col("tail").alias("head"), F.lit(rel).alias("rel"), F.col("goal").alias("tail"), "confidence")


def of_like_names(names: DataFrame, most: int = 3) -> DataFrame:
    """question, id, score: for every name the `most` others that begin with it (0.94), end with it (0.88) or hold it (0.8), then by degree and id.

    names: id, name (short: each gives all its parts), degree.  A part that many names hold keeps its
    best few before names meet parts, so nothing grows with the square of a common part.
    """
    n = F.length("name")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.struct(F.substring("name", i, m).alias("part"), F.when(i == 1, 0.94).when(i + m - 1 == n, 0.88).otherwise(0.8).alias("score")))))
    each = names.where(n > 0).select("id", "degree", F.explode(parts).alias("x")).groupBy("x.part", "id").agg(F.max("x.score").alias("score"), F.first("degree").alias("degree"))
    order = [F.desc("score"), F.desc("degree"), "id"]
    # one more, as a name is among those of its own part
    best = each.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("k") <= most + 1)
    met = names.select(F.col("id").alias("question"), F.col("name").alias("part")).join(best, "part").where("question <> id")
    return met.withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where(F.col("k") <= most).select("question", "id", "score")


def with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """question beside facts that have it as head or tail; entities: question."""
    ends = facts.withColumn("question", F.explode(F.array_distinct(F.array("head", "tail"))))
    return ends.join(entities.select("question").distinct(), "question", "left_semi")


def proximity(facts: DataFrame, entities: DataFrame, near: DataFrame) -> DataFrame:
    """Facts with `proximity`: 1 if an end is the question itself, 0.8 if one of its entities (question, entity), 0.55 if a neighbour (question, entity), else 0.3."""
    level = entities.withColumn("level", F.lit(0.8)).unionByName(near.withColumn("level", F.lit(0.55))).groupBy("question", "entity").agg(F.max("level").alias("level"))
    for end in ("head", "tail"):
        facts = facts.join(level.select("question", F.col("entity").alias(end), F.col("level").alias(f"{end}_level")), ["question", end], "left")
    own = (F.col("question") == F.col("head")) | (F.col("question") == F.col("tail"))
    got = F.when(own, 1.0).otherwise(F.greatest(F.coalesce("head_level", F.lit(0.3)), F.coalesce("tail_level", F.lit(0.3))))
    return facts.withColumn("proximity", got).drop("head_level", "tail_level")


def degree_share(facts: DataFrame, degrees: DataFrame) -> DataFrame:
    """Facts with `degree_share`, the larger degree of their ends as a share of the largest; degrees: id, degree."""
    top = degrees.agg(F.max("degree").alias("top"))
    for end in ("head", "tail"):
        facts = facts.join(degrees.select(F.col("id").alias(end), F.col("degree").alias(f"{end}_degree")), end, "left")
    best = F.greatest(F.coalesce("head_degree", F.lit(0)), F.coalesce("tail_degree", F.lit(0)))
    return facts.crossJoin(F.broadcast(top)).withColumn("degree_share", F.least(F.lit(1.0), best / F.greatest("top", F.lit(1)))).drop("head_degree", "tail_degree", "top")  # one row


def ranked(facts: DataFrame, by: str, most: int) -> DataFrame:
    """The best `most` facts of each group by score, confidence, then the fact."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc("confidence"), "head", "rel", "tail"))
    return facts.withColumn("k", k).where(F.col("k") <= most).drop("k")


def chains(edges: DataFrame, starts: list[str], stops: list[str], each: int = 2, cap: int = 6) -> DataFrame:
    """Two-step paths start, mid, stop between stated nodes, in either direction; the best `each` of a pair, `cap` of all.

    A step's confidence is its best edge's, a path's the lesser of its steps'.
    """
    both = both_ways(edges).groupBy("node", "other").agg(F.max("confidence").alias("c"))
    one = both.where(F.col("node").isin(starts)).select(F.col("node").alias("start"), F.col("other").alias("mid"), F.col("c").alias("c1"))
    two = both.where(F.col("other").isin(stops)).select(F.col("node").alias("mid"), F.col("other").alias("stop"), F.col("c").alias("c2"))
    got = one.join(two, "mid").where("start <> stop").select("start", "mid", "stop", F.least("c1", "c2").alias("confidence"))
    k = F.row_number().over(Window.partitionBy("start", "stop").orderBy(F.desc("confidence"), "mid"))
    return got.withColumn("k", k).where(F.col("k") <= each).drop("k").orderBy(F.desc("confidence"), "start", "stop", "mid").limit(cap)


def similar(nodes: DataFrame, seeds: list[str], most: int = 3, least: float = 0.45) -> DataFrame:
    """seed, id, score: the `most` nodes most like each seed name, itself excluded, by tiers (starts with, ends with, holds) and similarity."""
    from graphloom.functions.text import similarity

    asked = F.broadcast(nodes.sparkSession.createDataFrame([(x,) for x in seeds], "seed string"))  # the stated query set
    low, ask = F.lower("name"), F.lower("seed")
    tier = F.when(low.startswith(ask), 0.94).when(low.endswith(ask), 0.88).when(low.contains(ask), 0.8)
    each = nodes.select("id", "name").crossJoin(asked).where("name <> seed").withColumn("tier", tier)
    scored_ = each.withColumn("score", F.round(F.coalesce("tier", similarity(F.when(F.col("tier").isNull(), F.col("name")), F.col("seed"))), 3)).where(F.col("score") >= least)
    k = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))
    return scored_.withColumn("k", k).where(F.col("k") <= most).select("seed", "id", "score")


def facts_of_similar(edges: DataFrame, near: DataFrame, each: int = 20, cap: int = 12, factor: float = 0.95) -> DataFrame:
    """seed, head, rel, tail, confidence: outgoing facts of the similar nodes (seed, id), at a lower confidence; `each` of a node, `cap` of a seed."""
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "rel", "target"))
    first = edges.join(near.select(F.col("id").alias("source")).distinct(), "source", "left_semi").withColumn("k", k).where(F.col("k") <= each).drop("k")
    got = first.join(near.select("seed", F.col("id").alias("source")), "source")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("confidence"), "source", "rel", "target"))
    return got.withColumn("k", place).where(F.col("k") <= cap).select("seed", F.col("source").alias("head"), "rel", F.col("target").alias("tail"), (F.col("confidence") * factor).alias("confidence"))


def slot_summary(facts: DataFrame, order: list[str]) -> DataFrame:
    """source, rel, its tails in the order of confidence as one text, and the relation's place in a fixed order (others last).

    facts are slot_facts(), so a group holds no more rows than its slot's quota.
    """
    tails = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "target")))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("rel"))
    return facts.groupBy("source", "rel").agg(F.array_join(F.transform(tails, lambda x: x["target"]), "、").alias("tails")).withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def entities_text(entities: DataFrame, by: str, most: int) -> DataFrame:
    """The first `most` entities (type, name) of each group, by name, as one text."""
    k = F.row_number().over(Window.partitionBy(by).orderBy("name"))
    kept = entities.withColumn("k", k).where(F.col("k") <= most)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "type", "name"))), lambda x: F.concat(x["type"], F.lit("："), x["name"])), "；").alias("entities"))


def evidence(mentions: DataFrame, key: list[str], reference: str, most: int) -> DataFrame:
    """Each fact's first `most` distinct references, numbered; repeats go before the ranks."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(reference)).cast("long")
    return mentions.select(*key, reference).distinct().withColumn("k", k).where(F.col("k") <= most)


def deduplicated(mentions: DataFrame, by: str) -> DataFrame:
    """Mentions (start, type, term, score) once a place, then once a type and term: the best score, ties by type, then the earliest place."""
    spot = mentions.groupBy(by, "start").agg(F.min(F.struct((-F.col("score")).alias("s"), "type", "term")).alias("m"))
    spot = spot.select(by, "start", "m.type", "m.term", (-F.col("m.s")).alias("score"))
    best = spot.groupBy(by, "type", "term").agg(F.min(F.struct((-F.col("score")).alias("s"), "start")).alias("m"))
    return best.select(by, F.col("m.start").alias("start"), "type", "term", (-F.col("m.s")).alias("score"))
