"""Graph operators over nodes and edges: building, lookup, neighbours, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source", "rel", "target")


def first_wins(edges: DataFrame) -> DataFrame:
    """Edges without empty ends, loops and repeats; of repeats the first mention stays."""
    sound = edges.where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    # min over a struct combines before the shuffle; a window wouldn't
    best = sound.groupBy(*KEY).agg(F.min(F.struct("seq", "confidence")).alias("b"))
    return best.select(*KEY, F.col("b.confidence").alias("confidence"), F.col("b.seq").alias("seq"))


def max_confidence(edges: DataFrame) -> DataFrame:
    """Upsert policy: a repeated edge keeps its highest confidence, its first and last mention."""
    return edges.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.min("seq").alias("created"), F.max("seq").alias("updated"))


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, and the edge, in both directions."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *rest, F.lit("out").alias("direction")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), *rest, F.lit("in").alias("direction")))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its number of edge ends; 0 for isolated ones."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.join(ends, "id", "left").select(*nodes.columns, F.coalesce("n", F.lit(0)).alias("degree"))


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name and n: how many nodes of each type, edges of each relation, and of either in all."""
    each = lambda df, kind, by: df.groupBy(F.lit(kind).alias("kind"), F.col(by).alias("name")).agg(F.count("*").alias("n"))
    kinds = each(nodes, "node", "type").unionByName(each(edges, "edge", "rel"))
    total = kinds.groupBy(F.lit("total").alias("kind"), F.concat("kind", F.lit("s")).alias("name")).agg(F.sum("n").alias("n"))
    return kinds.unionByName(total)


def triples_of(edges: DataFrame, entity: Column, rels: list[str] | None = None, direction: str = "both", limit: int = 20) -> DataFrame:
    """An entity's edges by falling confidence."""
    ends = {"out": F.col("source") == entity, "in": F.col("target") == entity, "both": (F.col("source") == entity) | (F.col("target") == entity)}[direction]
    got = edges.where(ends)
    if rels:
        got = got.where(F.col("rel").isin(*rels))
    return got.orderBy(F.desc("confidence"), *KEY).limit(limit)


#: About as many names of a group meet in one key.
DEALT = 512


def pairs_within(members: DataFrame, group: str, name: str) -> DataFrame:
    """a < b and n, the groups that hold both names; members: distinct (group, name).

    The result grows with the square of a group.  Two names share several groups only if both are in
    several; these pairs are counted, the others come out as they are made.  A group's names are
    dealt over as many keys as it has DEALT names.
    """
    m = members.select(F.col(group).alias("k"), F.col(name).alias("name")).dropna()
    each = m.groupBy("name").agg((F.count("*") > 1).alias("several"))
    size = m.groupBy("k").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    kept = m.join(each, "name").join(size, "k")
    left = kept.select("k", F.col("name").alias("a"), F.col("several").alias("sa"), F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"))
    right = kept.select("k", F.col("name").alias("b"), F.col("several").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = lambda x, y: x.join(y, ["k", "part"]).where("a < b")
    one = met(left, right).where("NOT (sa AND sb)").select("a", "b", F.lit(1).cast("long").alias("n"))
    many = met(left.where("sa"), right.where("sb")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return one.unionByName(many)


def keep_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types, and edges both of whose ends stay."""
    kept = nodes.where(F.col("type").isin(*types))
    return kept, induced(edges, kept)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = kept.select(F.col("id"))
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def top_facts(edges: DataFrame, quota: Column) -> DataFrame:
    """Per source and relation the best edges, as many as the quota says, numbered by rank."""
    w = Window.partitionBy("source", "rel").orderBy(F.desc("confidence"), "target")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)


def labelled(label: Column, rel: Column, labels: dict[str, str]) -> Column:
    """An edge's own label, else that of its relation, else the relation."""
    return F.coalesce(label, F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[rel], rel)


def known_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """alias and canonical from ord, alias, canonical: those that differ and whose canonical name is a node; of equal aliases the first."""
    sound = aliases.where(F.col("alias") != F.col("canonical")).join(nodes.select(F.col("name").alias("canonical")), "canonical", "left_semi")
    best = sound.groupBy("alias").agg(F.min(F.struct("ord", "canonical")).alias("m"))
    return best.select("alias", F.col("m.canonical").alias("canonical"))


def _marks(c: Column, least: float) -> Column:
    """The rarest of a text's characters, each with the number of its occurrence: one of them is in every text of a ratio of at least `least`.

    A ratio of r needs r / 2 * (own length + other length) equal characters, and other length is at
    least r / (2 - r) * own length; of a text's n marks in an order that all texts share, two texts
    with m in common have one in common among the first n - m + 1 of each.
    """
    bare = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    n = F.length(bare)
    letters = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(bare, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    nth = F.transform(letters, lambda x, i: F.struct((-F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x))).alias("k"), x.alias("x")))
    need = F.ceil(F.lit(least / (2 - least) - 1e-9) * n).cast("int")
    return F.slice(F.array_sort(nth), F.lit(1), F.greatest(F.lit(0), n - need + 1))


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """text of left and name of right (each once) with their similarity, where it is at least `least`; no pair is missed.

    Candidates share one of the marks, or the first three letters of the one are in the other.
    """
    from graphloom.functions.text import similarity

    part = lambda c, i: F.substring(c, i, F.lit(3))
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n)))
    grams_of = lambda c: F.explode(F.array_distinct(F.concat(grams(F.trim(c), 1), grams(F.trim(c), 2), grams(F.trim(c), 3))))
    first = lambda c: part(F.trim(c), F.lit(1))
    a, b = left.select("text").distinct(), right.select("name").distinct()
    near = a.select("text", F.explode(_marks(F.col("text"), least)).alias("m")).join(b.select("name", F.explode(_marks(F.col("name"), least)).alias("m")), "m").select("text", "name")
    holds = a.select("text", grams_of(F.col("text")).alias("g")).join(b.select("name", first(F.col("name")).alias("g")), "g").select("text", "name").where(F.contains(F.trim("text"), F.trim("name")))
    held = a.select("text", first(F.col("text")).alias("g")).join(b.select("name", grams_of(F.col("name")).alias("g")), "g").select("text", "name").where(F.contains(F.trim("name"), F.trim("text")))
    pairs = near.unionByName(holds).unionByName(held).distinct()
    return pairs.withColumn("score", similarity(F.col("text"), F.col("name"))).where(F.col("score") >= least)


def resolve(queries: DataFrame, nodes: DataFrame, alias: DataFrame, least: float = 0.62) -> DataFrame:
    """Names to node ids: exact, then alias without case, then the most similar name of at least `least`.

    queries: text; nodes: id, name; alias: alias, canonical.  Only names that no earlier
    tier found reach the similarity tier, and there every name of that similarity is found.
    """
    exact = queries.join(nodes, queries["text"] == nodes["name"]).select("text", "id", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    by_alias = queries.join(alias, F.lower("text") == F.lower("alias")).join(nodes, F.col("canonical") == F.col("name")).select("text", "id", F.lit(2).alias("tier"), F.lit(0.95).alias("score"))
    known = exact.unionByName(by_alias)
    left = queries.join(known.select("text").distinct(), "text", "left_anti").where(F.length("text") > 0)
    fuzzy = alike(left, nodes, least).join(nodes, "name").select("text", "id", F.lit(3).alias("tier"), "score")
    best = known.unionByName(fuzzy).groupBy("text").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("text", F.col("b.id").alias("id"), F.col("b.tier").alias("tier"), (-F.col("b.s")).alias("score"))
