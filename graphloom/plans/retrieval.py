"""Retrieval and conversation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import retrieval as Q
from graphloom.session import stored
from graphloom.sources import tables as S

from .base import EDGES, query
from .graph import edges
from .rules import DRIVEN as _INFERRED
from .rules import inferred_facts

_QUOTA = "CASE rel WHEN 'HAS_SYMPTOM' THEN 4 WHEN 'USES_DRUG' THEN 3 WHEN 'BELONGS_TO' THEN 2 ELSE 1 END"
_FACTS = f"WITH {EDGES}, sl AS (SELECT source, rel, target, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, rel ORDER BY confidence DESC, target) AS k FROM e WHERE source LIKE 'C%') WHERE k <= {_QUOTA})"


def customer_facts(spark, d):
    return edges(spark, d).where(F.col("source").startswith("C"))


@query("q_rank_quota", _FACTS + " SELECT source, rel, target, round(confidence, 6) AS confidence FROM sl")
def _(spark, d):
    return Q.slot_facts(customer_facts(spark, d)).select("source", "rel", "target", F.round("confidence", 6).alias("confidence"))


@query("q_confident", _FACTS + ", c AS (SELECT *, sum(CASE WHEN confidence >= 0.95 THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS k FROM sl) SELECT source, rel, target FROM c WHERE confidence >= 0.95 OR k < 3")
def _(spark, d):
    return Q.confident(Q.slot_facts(customer_facts(spark, d)), "source", 0.95).select("source", "rel", "target")


#: What five routes recall for each customer as a question that names its two surest symptoms.
_ROUTES = _FACTS + f""", {_INFERRED}, rz AS (SELECT source, rel, target, confidence FROM dr ORDER BY confidence DESC, source, rel, target LIMIT 60),
 ak AS (SELECT source AS question, target AS entity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS k FROM e WHERE rel = 'HAS_SYMPTOM') WHERE k <= 2),
 tu AS (SELECT question, source AS head, entity AS tail, confidence FROM ak JOIN e ON rel = 'HAS_SYMPTOM' AND target = entity),
 gd AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id),
 sn AS (SELECT 'C' || c_custkey AS id, regexp_extract(c_name, '[1-9][0-9]*$') AS name, coalesce(degree, 0) AS degree FROM customer LEFT JOIN gd ON gd.id = 'C' || c_custkey),
 ne AS (SELECT a.id AS question, b.id FROM sn a JOIN sn b ON a.id <> b.id AND a.name <> '' AND contains(b.name, a.name) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN starts_with(b.name, a.name) THEN 0.94 WHEN ends_with(b.name, a.name) THEN 0.88 ELSE 0.8 END DESC, b.degree DESC, b.id) <= 3),
 nf AS (SELECT source, rel, target, confidence FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, rel, target) <= 20),
 sf AS (SELECT question, source AS head, rel, target AS tail, confidence * 0.95 AS confidence FROM ne JOIN nf ON source = id QUALIFY row_number() OVER (PARTITION BY question ORDER BY confidence DESC, source, rel, target) <= 12),
 mh AS (SELECT question, tu.tail AS head, n.target AS tail, max(least(tu.confidence, n.confidence)) AS confidence FROM tu JOIN e n ON n.source = head AND n.rel = 'BELONGS_TO' JOIN e o ON o.source = question AND o.rel = 'BELONGS_TO' AND o.target = n.target GROUP BY ALL),
 rt AS (SELECT source AS question, source AS head, rel, target AS tail, confidence, 'kg_1hop' AS route, 1.0 AS w FROM sl
 UNION ALL SELECT question, head, 'HAS_SYMPTOM', tail, confidence, 'kg_1hop', 1.0 FROM tu
 UNION ALL SELECT question, head, 'RELATED_TO', tail, confidence, 'kg_2hop', 0.92 FROM (SELECT * FROM mh QUALIFY row_number() OVER (PARTITION BY question ORDER BY confidence DESC, head, tail) <= 6)
 UNION ALL SELECT question, head, rel, tail, confidence, 'kg_similar', 0.85 FROM sf
 UNION ALL SELECT 'C' || c_custkey, source, rel, target, confidence, 'kg_reasoned', 0.8 FROM rz JOIN customer ON 'C' || c_custkey IN (source, target)),
 un AS (SELECT question, head, rel, tail, confidence, route, w FROM rt QUALIFY row_number() OVER (PARTITION BY question, head, rel, tail ORDER BY confidence DESC, w DESC, route) = 1)"""


def _recall(spark, d):
    """All edges, the entities that each question names, and the facts of five routes: direct, turned, by way of others, of similar names, inferred."""
    e = stored(edges(spark, d), "edges")
    fact = lambda x, route: x.select("question", "head", "rel", "tail", "confidence", F.lit(route).alias("route"))
    mine = e.where(F.col("source").startswith("C"))
    direct = Q.slot_facts(mine).select(F.col("source").alias("question"), F.col("source").alias("head"), "rel", F.col("target").alias("tail"), "confidence")
    entities = Q.asked(mine, "HAS_SYMPTOM")
    back = Q.turned(e.where("rel = 'HAS_SYMPTOM'"), entities)
    home = e.where("rel = 'BELONGS_TO'")
    paths = Q.by_way(back, home, home.select(F.col("source").alias("question"), F.col("target").alias("goal")))
    people = S.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.regexp_extract("c_name", "[1-9][0-9]*$", 0).alias("name"))
    near = Q.of_like_names(G.degree(people, e)).select(F.col("question").alias("seed"), "id")
    similar = Q.facts_of_similar(e, near).withColumnRenamed("seed", "question")
    inferred = inferred_facts(spark, d, 60).select(F.col("source").alias("head"), "rel", F.col("target").alias("tail"), "confidence")
    reasoned = Q.with_names(inferred, people.select(F.col("id").alias("question")))
    union = Q.union_routes(fact(direct, "kg_1hop"), fact(back, "kg_1hop"), fact(paths, "kg_2hop"), fact(similar, "kg_similar"), fact(reasoned, "kg_reasoned"), by=("question",))
    return e, entities, union


def _routes(spark, d):
    return _recall(spark, d)[2]


@query("q_five_way_union", _ROUTES + " SELECT question, head, rel, tail, round(confidence, 6) AS confidence, route FROM un")
def _(spark, d):
    return _routes(spark, d).withColumn("confidence", F.round("confidence", 6))


_PRIOR = "CASE rel WHEN 'HAS_SYMPTOM' THEN 1.0 WHEN 'USES_DRUG' THEN 0.35 WHEN 'BELONGS_TO' THEN 0.7 ELSE 0.5 END"
_SCORED = _ROUTES + f""", lv AS (SELECT question, entity, max(level) AS level FROM (SELECT question, entity, 0.8 AS level FROM ak UNION ALL SELECT source, target, 0.55 FROM e WHERE source LIKE 'C%' UNION ALL SELECT question, head, 0.55 FROM tu) GROUP BY 1, 2),
 px AS (SELECT un.*, CASE WHEN un.question IN (head, tail) THEN 1.0 ELSE greatest(coalesce(a.level, 0.3), coalesce(b.level, 0.3)) END AS prox, least(1.0, greatest(coalesce(x.degree, 0), coalesce(y.degree, 0)) / (SELECT max(degree) FROM gd)) AS dsh
 FROM un LEFT JOIN lv a ON a.question = un.question AND a.entity = head LEFT JOIN lv b ON b.question = un.question AND b.entity = tail LEFT JOIN gd x ON x.id = head LEFT JOIN gd y ON y.id = tail),
 so AS (SELECT question, head, rel, tail, confidence, route, round(w * (0.45 * confidence + 0.30 * {_PRIOR} + 0.15 * prox + 0.10 * dsh) + 1e-9, 4) AS score, sum((confidence >= 0.55)::INT) OVER (PARTITION BY question) AS sure FROM px),
 sc AS (SELECT * FROM so WHERE confidence >= 0.55 OR sure < 3 QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, confidence DESC, head, rel, tail) <= 32)"""


def _scored(spark, d):
    """The best 32 facts of each question, those of low confidence left out where three others are."""
    e, entities, facts = _recall(spark, d)
    near = e.where(F.col("source").startswith("C")).select(F.col("source").alias("question"), F.col("target").alias("entity")).unionByName(Q.turned(e.where("rel = 'HAS_SYMPTOM'"), entities).select("question", F.col("head").alias("entity")))
    degrees = e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    facts = Q.degree_share(Q.proximity(facts, entities, near), degrees)
    prior = Q.lookup({"HAS_SYMPTOM": 1.0, "USES_DRUG": 0.35, "BELONGS_TO": 0.7}, F.col("rel"), 0.5)
    s = Q.lookup(Q.ROUTE_WEIGHT, F.col("route"), 0.5) * (0.45 * F.col("confidence") + 0.30 * prior + 0.15 * F.col("proximity") + 0.10 * F.col("degree_share"))
    return Q.ranked(Q.confident(facts.withColumn("score", F.round(s + 1e-9, 4)), "question"), "question", max(4 * 8, 24))


@query("q_fact_score", _SCORED + " SELECT question, head, rel, tail, route, score FROM sc")
def _(spark, d):
    return _scored(spark, d).select("question", "head", "rel", "tail", "route", "score")


_DIVERSE = _SCORED + """, ca AS (SELECT *, CASE WHEN route = 'kg_similar' OR route = 'kg_1hop' AND head <> question THEN 'related' WHEN route = 'kg_1hop' THEN 'primary' ELSE route END AS category FROM sc),
 rs AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY question, category ORDER BY score DESC, confidence DESC, head, rel, tail) <= CASE category WHEN 'related' THEN 2 WHEN 'kg_2hop' THEN 2 WHEN 'kg_reasoned' THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS reserved FROM ca),
 pl AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY reserved DESC, score DESC, confidence DESC, head, rel, tail) AS place FROM rs),
 dv AS (SELECT question, head, rel, tail, 'KG-' || row_number() OVER (PARTITION BY question ORDER BY score DESC, confidence DESC, head, rel, tail) AS evidence FROM pl WHERE place <= 8)"""


def _diverse(spark, d):
    turned = (F.col("route") == "kg_1hop") & (F.col("head") != F.col("question"))
    category = F.when((F.col("route") == "kg_similar") | turned, "related").when(F.col("route") == "kg_1hop", "primary").otherwise(F.col("route"))
    return Q.diverse(_scored(spark, d), "question", category, 8).select("question", "head", "rel", "tail", "evidence")


@query("q_diverse", _DIVERSE + " SELECT * FROM dv")
def _(spark, d):
    return _diverse(spark, d)


@query("q_route_counts", _ROUTES + " SELECT route, count(*) AS n FROM un GROUP BY route")
def _(spark, d):
    return _routes(spark, d).groupBy("route").agg(F.count("*").alias("n"))


_VIOL = """WITH v AS (SELECT conv_id, turn, CASE WHEN NOT contains(text, 'tion') THEN 'missing_citation' END AS a, CASE WHEN regexp_matches(text, 'en[ .]') THEN 'dose' END AS b, CASE WHEN contains(text, 'the ') THEN 'absolute' END AS c FROM conversations WHERE role = 'assistant'),
 w AS (SELECT conv_id, turn, 'missing_citation' AS kind, 0.12 AS cost FROM v WHERE a IS NOT NULL UNION ALL SELECT conv_id, turn, 'dose', 0.30 FROM v WHERE b IS NOT NULL UNION ALL SELECT conv_id, turn, 'absolute', 0.05 FROM v WHERE c IS NOT NULL),
 g AS (SELECT conv_id, count(*) AS n, round(greatest(0, least(1, 1 - sum(cost))), 3) AS guard FROM (SELECT DISTINCT conv_id, kind, cost FROM w) GROUP BY conv_id)"""


def _guard(spark, d):
    v = S.table(spark, d, "conversations").where(F.col("role") == "assistant")
    rule = lambda cond, kind, severity: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(rule(~F.col("text").contains("tion"), "missing_citation", "high"), rule(F.col("text").rlike("en[ .]"), "dose", "critical"), rule(F.col("text").contains("the "), "absolute", "medium")))
    return Q.guard_score(v.select("conv_id", F.inline(found)), "conv_id")


@query("q_guard_score", _VIOL + " SELECT conv_id, n, guard::DOUBLE AS guard FROM g")
def _(spark, d):
    return _guard(spark, d)


@query("q_confidence", _VIOL + ", t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT t.conv_id, round(CASE WHEN turns < 3 THEN least(0.35 * 0.8 + 0.35 * 0.9 + 0.30 * coalesce(guard, 1), 0.45) ELSE 0.35 * 0.8 + 0.35 * 0.9 + 0.30 * coalesce(guard, 1) END, 4)::DOUBLE AS confidence FROM t LEFT JOIN g ON t.conv_id = g.conv_id")
def _(spark, d):
    t = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    c = Q.answer_confidence(F.lit(0.8), F.lit(0.9), F.coalesce("guard", F.lit(1.0)), F.lit(1), F.col("turns") < 3)
    return t.join(_guard(spark, d), "conv_id", "left").select("conv_id", F.round(c, 4).alias("confidence"))


@query("q_history_last6", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 6")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return S.table(spark, d, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 6").select("conv_id", "turn", "role")


@query("q_slots", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) SELECT conv_id, string_agg(split_part(text, ' ', 1), '|' ORDER BY turn, text) AS slots FROM u WHERE k <= 6 AND role = 'user' GROUP BY conv_id")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    last = S.table(spark, d, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 6 AND role = 'user'")
    got = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))  # at most six a conversation
    return got.select("conv_id", F.array_join(F.transform("x", lambda s: F.split_part(s["text"], F.lit(" "), F.lit(1))), "|").alias("slots"))


@query("q_bio_islands", "WITH t AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS island FROM t) SELECT conv_id, island::BIGINT AS island, min(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn FROM g GROUP BY conv_id, island")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    begins = (~F.lag("role").over(w).eqNullSafe(F.col("role"))).cast("long")
    t = S.table(spark, d, "conversations").withColumn("b", begins)
    run = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("island", F.sum("b").over(run)).groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("x_softmax_intent", """WITH s AS (SELECT conv_id, turn, (contains(text, 'the'))::INT * 5.0 + (contains(text, 'and'))::INT * 3.0 AS a, (contains(text, 'ing'))::INT * 4.5 AS b, (contains(text, 'tion'))::INT * 4.0 AS c FROM conversations WHERE role = 'user'),
 x AS (SELECT conv_id, turn, a + b + c AS t, exp(a / 1.6) AS ea, exp(b / 1.6) AS eb, exp(c / 1.6) AS ec FROM s)
 SELECT conv_id, turn, CASE WHEN t <= 0 THEN 0.55 ELSE round(ea / (ea + eb + ec), 4) END AS p_a, CASE WHEN t <= 0 THEN 0.15 ELSE round(eb / (ea + eb + ec), 4) END AS p_b, CASE WHEN t <= 0 THEN 0.15 ELSE round(ec / (ea + eb + ec), 4) END AS p_c FROM x""")
def _(spark, d):
    has = lambda s, w: F.when(F.contains("text", F.lit(s)), w).otherwise(0.0)
    s = S.table(spark, d, "conversations").where(F.col("role") == "user").select("conv_id", "turn", (has("the", 5.0) + has("and", 3.0)).alias("a"), has("ing", 4.5).alias("b"), has("tion", 4.0).alias("c"))
    total = F.exp(F.col("a") / 1.6) + F.exp(F.col("b") / 1.6) + F.exp(F.col("c") / 1.6)
    p = lambda c, default: F.when(F.col("a") + F.col("b") + F.col("c") <= 0, default).otherwise(F.round(F.exp(F.col(c) / 1.6) / total, 4))
    return s.select("conv_id", "turn", p("a", 0.55).alias("p_a"), p("b", 0.15).alias("p_b"), p("c", 0.15).alias("p_c"))
