"""Graph queries over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import traverse as T
from graphloom.operators.analytics import top
from graphloom.sources import tables as S

from .base import EDGES, NODES, PLACES, RAW, query


def edges(spark, d, *rels):
    """Edges of the relations, all if none is named."""
    return G.first_wins(S.raw_edges(spark, d, *rels))


@query("g_edges_first_wins", f"WITH {EDGES} SELECT source, rel, target, round(confidence, 6) AS confidence FROM e")
def _(spark, d):
    return edges(spark, d).select("source", "rel", "target", F.round("confidence", 6).alias("confidence"))


@query("g_edges_max_conf", f"WITH {RAW} SELECT source, rel, target, round(max(confidence), 6) AS confidence, min(l_orderkey)::BIGINT AS first_order, max(l_orderkey)::BIGINT AS last_order FROM raw GROUP BY ALL")
def _(spark, d):
    got = G.max_confidence(S.raw_edges(spark, d))
    return got.select("source", "rel", "target", F.round("confidence", 6).alias("confidence"), F.col("created.l_orderkey").alias("first_order"), F.col("updated.l_orderkey").alias("last_order"))


_DEGREE = f"WITH {EDGES}, {NODES}, k AS (SELECT id, count(*) AS c FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id), dg AS (SELECT n.id, n.type, n.name, coalesce(c, 0)::BIGINT AS degree FROM n LEFT JOIN k ON n.id = k.id)"


@query("g_degree", _DEGREE + " SELECT * FROM dg")
def _(spark, d):
    return G.degree(S.nodes(spark, d), edges(spark, d))


@query("g_hubs", _DEGREE + " SELECT id, degree FROM dg WHERE degree >= 60")
def _(spark, d):
    return G.degree(S.nodes(spark, d), edges(spark, d)).where("degree >= 60").select("id", "degree")


@query("g_isolated", f"WITH {RAW}, {NODES} SELECT id, type FROM n WHERE rtrim(type) <> '' AND id NOT IN (SELECT source FROM raw WHERE rel = 'HAS_SYMPTOM') AND type = 'Disease'")
def _(spark, d):
    have = S.raw_edges(spark, d, "HAS_SYMPTOM").select(F.col("source").alias("id"))
    return S.nodes(spark, d).where(F.col("type") == "Disease").join(have, "id", "left_anti").select("id", "type")


@query("g_stats", f"WITH {EDGES}, {NODES} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT type) FROM n) AS types, (SELECT count(DISTINCT rel) FROM e) AS relations, (SELECT count(*) FROM n WHERE type = 'Disease') AS diseases")
def _(spark, d):
    n = S.nodes(spark, d).agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types"), F.count_if(F.col("type") == "Disease").alias("diseases"))
    e = edges(spark, d).agg(F.count("*").alias("edges"), F.count_distinct("rel").alias("relations"))
    return n.crossJoin(e)  # one row each


@query("g_type_legend", f"WITH {NODES} SELECT t.ord, t.type, count(n.id)::BIGINT AS n FROM (VALUES (1, 'Disease'), (2, 'Symptom'), (3, 'Drug'), (4, 'Department'), (5, 'Check'), (6, 'Category')) t(ord, type) LEFT JOIN n ON n.type = t.type GROUP BY 1, 2")
def _(spark, d):
    dim = spark.createDataFrame(list(enumerate(["Disease", "Symptom", "Drug", "Department", "Check", "Category"], 1)), "ord int, type string")
    return dim.join(S.nodes(spark, d).groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("ord", "type", F.coalesce("n", F.lit(0)).alias("n"))


@query("g_rel_histogram", f"WITH {EDGES} SELECT rel, count(*) AS n FROM e GROUP BY rel ORDER BY n DESC, rel LIMIT 15")
def _(spark, d):
    return top(edges(spark, d), "rel", 15).withColumnRenamed("name", "rel")


@query("g_neighbors", f"WITH {PLACES} SELECT other AS id FROM u WHERE node = 'N3'")
def _(spark, d):
    return G.both_ways(S.place_edges(spark, d)).where(F.col("node") == "N3").select(F.col("other").alias("id")).distinct()


for _way, _sql in (("out", "source = 'C7'"), ("in", "target = 'P7'"), ("both", "source = 'S7' OR target = 'S7'")):

    @query(f"g_triples_{_way}", f"WITH {EDGES} SELECT source, rel, target, round(confidence, 6) AS confidence FROM e WHERE {_sql} ORDER BY e.confidence DESC, source, rel, target LIMIT 20")
    def _(spark, d, way=_way):
        who = F.lit({"out": "C7", "in": "P7", "both": "S7"}[way])
        return G.triples_of(edges(spark, d), who, direction=way).select("source", "rel", "target", F.round("confidence", 6).alias("confidence"))


@query("g_type_filter_no_dangling", f"WITH {EDGES}, {NODES}, k AS (SELECT id FROM n WHERE type IN ('Disease', 'Drug')) SELECT source, rel, target FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def _(spark, d):
    return G.keep_types(S.nodes(spark, d), edges(spark, d), ["Disease", "Drug"])[1].select("source", "rel", "target")


_EGO = PLACES + """, r0 AS (SELECT 'N3' AS id, 0 AS depth), r1 AS (SELECT id, depth FROM r0 UNION ALL SELECT DISTINCT other, 1 FROM u WHERE node = 'N3' AND other <> 'N3'),
 r2 AS (SELECT id, depth FROM r1 UNION ALL SELECT DISTINCT other, 2 FROM u JOIN r1 ON node = id WHERE other NOT IN (SELECT id FROM r1))"""


@query("g_ego_depth1", f"WITH {_EGO} SELECT id, depth FROM r1")
def _(spark, d):
    return T.ego(S.place_edges(spark, d), "N3", 1)


@query("g_ego_depth2_limited", f"WITH {_EGO} SELECT id, depth FROM r2 ORDER BY depth, id LIMIT 40")
def _(spark, d):
    return T.limited(T.ego(S.place_edges(spark, d), "N3", 2), 40)[0]


@query("g_induced_edges", f"WITH {_EGO}, k AS (SELECT id FROM r2 ORDER BY depth, id LIMIT 40) SELECT source, rel, target FROM p WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def _(spark, d):
    e = S.place_edges(spark, d)
    return G.induced(e, T.limited(T.ego(e, "N3", 2), 40)[0]).select("source", "rel", "target")


#: All simple paths of up to three steps from C1 to C2 over all edges; e: edges.
_PATHS = f"""WITH {EDGES}, u AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e), a AS (SELECT other FROM u WHERE node = 'C1' AND other <> 'C2'), z AS (SELECT node AS other FROM u WHERE other = 'C2' AND node <> 'C1'),
 w AS (SELECT ['C1', 'C2'] AS path FROM u WHERE node = 'C1' AND other = 'C2' UNION ALL SELECT ['C1', a.other, 'C2'] FROM a JOIN z ON a.other = z.other UNION ALL SELECT ['C1', a.other, z.other, 'C2'] FROM a JOIN u ON u.node = a.other JOIN z ON z.other = u.other WHERE a.other <> z.other)"""


@query("g_paths_le3", _PATHS + " SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM w")
def _(spark, d):
    return T.paths(S.raw_edges(spark, d), "C1", "C2", 3).select(F.array_join("path", ">").alias("path"), "hops")


@query("g_paths_first", _PATHS + " SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM w ORDER BY len(path), w.path LIMIT 20")
def _(spark, d):
    return T.paths(S.raw_edges(spark, d), "C1", "C2", 3, 20).select(F.array_join("path", ">").alias("path"), "hops")


@query("g_path_steps", _PATHS + """, s AS (SELECT path, i - 1 AS step, path[i] AS node, path[i + 1] AS other FROM w, unnest(range(1, len(path))) t(i)),
 d AS (SELECT source AS node, target AS other, rel, 'out' AS direction, l_orderkey, l_linenumber FROM e UNION ALL SELECT target, source, rel, 'in', l_orderkey, l_linenumber FROM e),
 f AS (SELECT * FROM d WHERE node IN (SELECT node FROM s) QUALIFY row_number() OVER (PARTITION BY node, other ORDER BY l_orderkey, l_linenumber, rel, direction) = 1)
 SELECT array_to_string(path, '>') AS path, step::INT AS step, s.node, s.other, rel, direction FROM s JOIN f ON f.node = s.node AND f.other = s.other""")
def _(spark, d):
    e = S.raw_edges(spark, d)  # of repeated mentions the first counts here, too
    return T.steps(T.paths(e, "C1", "C2", 3), e)


@query("g_shortest_path", _PATHS + " SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM w ORDER BY len(path), w.path LIMIT 1")
def _(spark, d):
    return T.shortest(edges(spark, d), "C1", "C2").select(F.array_join("path", ">").alias("path"), "hops")


@query("g_facts_by_relation", f"WITH {EDGES} SELECT source, rel, string_agg(target, ',' ORDER BY target) AS targets, count(*) AS n FROM e WHERE source LIKE 'C%' GROUP BY source, rel")
def _(spark, d):
    return edges(spark, d).where(F.col("source").startswith("C")).groupBy("source", "rel").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"), F.count("*").alias("n"))


@query("g_collect_topk", f"WITH {EDGES}, k AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM e WHERE rel = 'USES_DRUG') SELECT source, string_agg(target, ',' ORDER BY target) AS targets FROM k WHERE k <= 5 GROUP BY source")
def _(spark, d):
    e = edges(spark, d, "USES_DRUG").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where("k <= 5")
    return e.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))


@query("g_reverse_lookup", f"WITH {EDGES} SELECT source, round(max(confidence), 6) AS confidence FROM e WHERE rel = 'HAS_SYMPTOM' AND target IN ('P1', 'P2', 'P3', 'P4', 'P5') GROUP BY source")
def _(spark, d):
    e = edges(spark, d, "HAS_SYMPTOM").where(F.col("target").isin("P1", "P2", "P3", "P4", "P5"))
    return e.groupBy("source").agg(F.round(F.max("confidence"), 6).alias("confidence"))


@query("g_multi_hit", f"WITH {EDGES} SELECT source, count(DISTINCT target) AS hits FROM e WHERE rel = 'HAS_SYMPTOM' AND substr(target, -1) = '7' GROUP BY source HAVING count(DISTINCT target) >= 3")
def _(spark, d):
    e = edges(spark, d, "HAS_SYMPTOM").where(F.col("target").endswith("7"))
    return e.groupBy("source").agg(F.count_distinct("target").alias("hits")).where("hits >= 3")


@query("g_optional_match", "SELECT c_custkey, c_name, coalesce(n, 0)::BIGINT AS orders, coalesce(round(total, 2), 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, d):
    # the many side is aggregated before the join, so nothing fans out
    o = S.table(spark, d, "orders").where(F.col("o_orderstatus") == "O").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = S.table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce(F.round("t", 2), F.lit(0.0)).alias("total"))


@query("g_anti_missing", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    c, o = S.table(spark, d, "customer"), S.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("g_relation_alternation", f"WITH {EDGES} SELECT source, rel, count(*) AS n FROM e WHERE rel IN ('USES_DRUG', 'BELONGS_TO') GROUP BY source, rel")
def _(spark, d):
    return edges(spark, d, "USES_DRUG", "BELONGS_TO").groupBy("source", "rel").agg(F.count("*").alias("n"))


@query("g_disjunctive", f"WITH {EDGES} SELECT source, rel, target FROM e WHERE source IN ('C1', 'C2', 'S3') OR target IN ('C1', 'C2', 'S3')")
def _(spark, d):
    ids = ["C1", "C2", "S3"]
    return edges(spark, d).where(F.col("source").isin(ids) | F.col("target").isin(ids)).select("source", "rel", "target")


@query("g_theta_pairs", "WITH s AS (SELECT DISTINCT s_nationkey AS k, s_name AS name FROM supplier) SELECT a.name AS a, b.name AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.name < b.name GROUP BY 1, 2")
def _(spark, d):
    s = S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name")).distinct()
    return G.pairs_within(s, "k", "name")


@query("g_resolve_cascade", f"WITH {NODES}, q AS (SELECT n_name AS text FROM nation UNION ALL SELECT lower(r_name) FROM region) SELECT q.text, n.id, 1 AS tier FROM q JOIN n ON q.text = n.name WHERE n.type IN ('Department', 'Category') UNION ALL SELECT q.text, n.id, 2 FROM q JOIN n ON q.text <> n.name AND q.text = lower(n.name) WHERE n.type = 'Category'")
def _(spark, d):
    n = S.nodes(spark, d).where(F.col("type").isin("Department", "Category")).select("id", "name")
    q = S.table(spark, d, "nation").select(F.col("n_name").alias("text")).unionByName(S.table(spark, d, "region").select(F.lower("r_name").alias("text")))
    alias = S.table(spark, d, "region").select(F.col("r_name").alias("alias"), F.col("r_name").alias("canonical"))
    return G.resolve(q, n, alias).select("text", "id", "tier")


@query("g_resolve_names")
def _(spark, d):
    """Suppliers' names, and parts' names with letters changed, among parts and suppliers."""
    n = S.nodes(spark, d).where(F.col("type").isin("Symptom", "Drug")).select("id", "name")
    q = S.table(spark, d, "supplier").select(F.col("s_name").alias("text")).unionByName(S.table(spark, d, "part").select(F.translate("p_name", "ae", "oi").alias("text"))).distinct()
    alias = spark.createDataFrame([], "alias string, canonical string")
    return G.resolve(q, n, alias).select("text", "id", "tier", F.round("score", 6).alias("score"))


@query("s_entity_search", f"""WITH {EDGES}, {NODES}, k AS (SELECT id, count(*) AS c FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id),
 s AS (SELECT n.id, n.name, coalesce(c, 0)::BIGINT AS degree, CASE WHEN lower(name) = '12' THEN 1.0 WHEN starts_with(lower(name), '12') THEN 0.94 WHEN ends_with(lower(name), '12') THEN 0.88 WHEN contains(lower(name), '12') THEN 0.8 ELSE 0 END AS score FROM n LEFT JOIN k ON n.id = k.id)
 SELECT id, name, degree, score::DOUBLE AS score FROM s WHERE score >= 0.45 ORDER BY score DESC, degree DESC, id LIMIT 20""")
def _(spark, d):
    n = G.degree(S.nodes(spark, d), edges(spark, d)).withColumn("low", F.lower("name"))
    score = F.when(F.col("low") == "12", 1.0).when(F.col("low").startswith("12"), 0.94).when(F.col("low").endswith("12"), 0.88).when(F.col("low").contains("12"), 0.8).otherwise(0.0)
    return n.withColumn("score", score).where("score >= 0.45").orderBy(F.desc("score"), F.desc("degree"), "id").limit(20).select("id", "name", "degree", "score")


@query("s_paged_search", "WITH h AS (SELECT p_partkey, p_name, CASE WHEN starts_with(p_name, 'a') THEN 0.93 ELSE 0.72 END AS score FROM part WHERE contains(p_name, 'a')), k AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS k FROM h) SELECT p_partkey, p_name, score::DOUBLE AS score, total, k FROM k WHERE k BETWEEN 13 AND 18")
def _(spark, d):
    hits = S.table(spark, d, "part").where(F.col("p_name").contains("a")).withColumn("score", F.when(F.col("p_name").startswith("a"), 0.93).otherwise(0.72))
    # a page is the tail of a bounded top-k; the total is a count beside it
    page = hits.orderBy(F.desc("score"), "p_name", "p_partkey").limit(18)
    k = F.row_number().over(Window.orderBy(F.desc("score"), "p_name", "p_partkey")).cast("long")
    total = hits.agg(F.count("*").alias("total"))
    return page.withColumn("k", k).where("k >= 13").crossJoin(F.broadcast(total)).select("p_partkey", "p_name", "score", "total", "k")


@query("s_hot_terms", f"WITH {EDGES}, t AS (SELECT target AS term, count(*) AS n FROM e WHERE rel = 'HAS_SYMPTOM' GROUP BY 1), a AS (SELECT 'P1' AS term, 0 AS pri, 0 AS n UNION ALL SELECT 'P2', 0, 0 UNION ALL SELECT term, 1, n FROM t), f AS (SELECT term, min(pri) AS pri, max(n) AS n FROM a GROUP BY term) SELECT term FROM f ORDER BY pri, n DESC, term DESC LIMIT 6")
def _(spark, d):
    t = edges(spark, d, "HAS_SYMPTOM").groupBy(F.col("target").alias("term")).agg(F.count("*").alias("n"))
    first = spark.createDataFrame([("P1", 0, 0), ("P2", 0, 0)], "term string, pri int, n long")
    got = first.unionByName(t.select("term", F.lit(1).alias("pri"), "n")).groupBy("term").agg(F.min("pri").alias("pri"), F.max("n").alias("n"))
    return got.orderBy("pri", F.desc("n"), F.desc("term")).limit(6).select("term")


@query("g_node_degrees", f"WITH {EDGES}, {NODES}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e), g AS (SELECT id, count(*) AS degree FROM x GROUP BY id) SELECT n.id, n.type, n.name, coalesce(degree, 0) AS degree FROM n LEFT JOIN g ON n.id = g.id")
def _(spark, d):
    """Nodes with their degree written back."""
    return G.degree(S.nodes(spark, d).select("id", "type", "name"), edges(spark, d))


@query("g_status", f"WITH {EDGES}, {NODES} SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e")
def _(spark, d):
    return G.status(S.nodes(spark, d), edges(spark, d))
