"""Dashboard, risk and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import analytics as A
from graphloom.operators import risk as M
from graphloom.operators.graph import both_ways
from graphloom.sources import tables as S

from .base import EDGES, NODES, query
from .graph import edges


@query("a_topn", f"WITH {EDGES} SELECT target AS name, count(*) AS n FROM e WHERE rel = 'HAS_SYMPTOM' GROUP BY 1 ORDER BY n DESC, name LIMIT 12")
def _(spark, d):
    return A.top(edges(spark, d, "HAS_SYMPTOM"), "target", 12)


@query("a_overview", "SELECT (SELECT count(*) FROM customer) AS diseases, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS categories, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS treatment_types, (SELECT count(DISTINCT p_brand) FROM part) AS brands")
def _(spark, d):
    one = lambda t, *a: S.table(spark, d, t).agg(*a)
    return one("customer", F.count("*").alias("diseases"), F.count_distinct("c_mktsegment").alias("categories")).crossJoin(one("orders", F.count_distinct("o_orderpriority").alias("treatment_types"))).crossJoin(one("part", F.count_distinct("p_brand").alias("brands")))  # one row each


@query("a_share", f"WITH {NODES} SELECT type AS name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM n GROUP BY type")
def _(spark, d):
    return A.shares(S.nodes(spark, d), F.col("type"))


@query("a_bar", "SELECT coalesce(c_mktsegment, 'uncategorised') AS name, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return S.table(spark, d, "customer").groupBy(F.coalesce("c_mktsegment", F.lit("uncategorised")).alias("name")).agg(F.count("*").alias("n"))


@query("a_flag_ratio", "SELECT 'yes' AS name, count(*) FILTER (WHERE c_acctbal < 0) AS value FROM customer UNION ALL SELECT 'no', count(*) FILTER (WHERE NOT c_acctbal < 0) FROM customer UNION ALL SELECT 'total', count(*) FROM customer")
def _(spark, d):
    c = S.table(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("yes"), F.count_if(~(F.col("c_acctbal") < 0)).alias("no"), F.count("*").alias("total"))
    return c.unpivot([], ["yes", "no", "total"], "name", "value")


@query("a_dept", "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def _(spark, d):
    n = S.table(spark, d, "nation")
    return A.top(S.table(spark, d, "customer").join(n, F.col("c_nationkey") == n["n_nationkey"]), "n_name", 10)


def people(spark, d):
    """Customers as persons: measurements from their numbers, some of them missing."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return S.table(spark, d, "customer").select(
        "c_custkey", (20 + k % 70).alias("age"), (k % 2).alias("male"), F.when(k % 5 != 0, 18 + k % 20).alias("bmi"), F.when(k % 3 != 0, 100 + k % 80).alias("systolic_bp"), F.lit(None).cast("double").alias("diastolic_bp"),
        F.when(b > 0, 4 + b / 2000).alias("fasting_glucose"), F.lit(None).cast("double").alias("total_cholesterol"), F.lit(None).cast("double").alias("ldl"), F.lit(None).cast("double").alias("hdl"), F.lit(None).cast("double").alias("triglycerides"),
        (k % 7 == 0).cast("int").alias("smoking"), (k % 11 == 0).cast("int").alias("drinking"), (k % 3).alias("family_history"), (k % 4 / 2).alias("symptom_score"), (k % 6 == 0).cast("int").alias("low_activity"),
    )


_X = {"age": "20 + c_custkey % 70", "male": "c_custkey % 2", "bmi": "CASE WHEN c_custkey % 5 <> 0 THEN 18 + c_custkey % 20 ELSE 23.5 END", "systolic_bp": "CASE WHEN c_custkey % 3 <> 0 THEN 100 + c_custkey % 80 ELSE 122 END", "diastolic_bp": "76", "fasting_glucose": "CASE WHEN c_acctbal > 0 THEN 4 + c_acctbal / 2000 ELSE 5.2 END", "total_cholesterol": "4.8", "ldl": "2.9", "hdl": "1.3", "triglycerides": "1.4", "smoking": "(c_custkey % 7 = 0)::INT", "drinking": "(c_custkey % 11 = 0)::INT", "family_history": "c_custkey % 3", "symptom_score": "c_custkey % 4 / 2.0", "low_activity": "(c_custkey % 6 = 0)::INT"}
_MODELS = ", ".join(f"('{k}', {i}::DOUBLE, [{', '.join(f'{x}::DOUBLE' for x in w)}])" for k, (i, w) in M.MODELS.items())
_RISK = f"WITH x AS (SELECT c_custkey, [{', '.join(f'({_X[f]})::DOUBLE' for f in M.FEATURES)}] AS x FROM customer), m(disease, b, w) AS (VALUES {_MODELS}), z AS (SELECT c_custkey, disease, b + list_sum(list_transform(range(1, {len(M.FEATURES) + 1}), lambda i: w[i] * x[i])) AS z, w, x FROM x, m), r AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, z)))) AS risk FROM z)"


@query("m_risk", _RISK + " SELECT c_custkey, disease, round(risk, 6) AS risk, CASE WHEN risk >= 0.75 THEN 'very_high' WHEN risk >= 0.5 THEN 'high' WHEN risk >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM r")
def _(spark, d):
    return M.predict(people(spark, d), "c_custkey").withColumn("risk", F.round("risk", 6))


@query("m_health", _RISK + " SELECT c_custkey, round(greatest(0, least(100, 100 * (1 - 0.95 * (0.55 * max(risk) + 0.45 * avg(risk))))), 4) AS health FROM r GROUP BY c_custkey")
def _(spark, d):
    return M.health(M.predict(people(spark, d), "c_custkey"), "c_custkey").withColumn("health", F.round("health", 4))


@query("m_risk_top6", _RISK + " SELECT c_custkey, disease, k FROM (SELECT c_custkey, disease, row_number() OVER (PARTITION BY c_custkey ORDER BY round(risk, 9) DESC, disease) AS k FROM r) WHERE k <= 6")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_custkey").orderBy(F.desc(F.round("risk", 9)), "disease")
    return M.predict(people(spark, d), "c_custkey").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 6").select("c_custkey", "disease", "k")


_NAMES = ", ".join(f"'{f}'" for f in M.FEATURES)


@query("m_loo", _RISK + f", f AS (SELECT c_custkey, disease, unnest([{_NAMES}]) AS feature, unnest(range(1, {len(M.FEATURES) + 1})) AS i, z, w, x, risk FROM r), dr AS (SELECT c_custkey, disease, feature, greatest(0, risk - 1 / (1 + exp(-greatest(-30, least(30, z - w[i] * x[i]))))) AS dr FROM f), sh AS (SELECT *, coalesce(dr / nullif(sum(dr) OVER (PARTITION BY c_custkey, disease), 0), 0) AS share FROM dr), rk AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, disease ORDER BY round(share, 9) DESC, feature) AS rank FROM sh) SELECT c_custkey, disease, feature, round(share, 6) AS share, rank FROM rk WHERE rank <= 5 AND c_custkey % 10 < 10")
def _(spark, d):
    return M.contributions(people(spark, d), "c_custkey").select("c_custkey", "disease", "feature", F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"))


def judged(spark, d):
    """Labelled documents with a score in [0, 1] from their length."""
    n = S.table(spark, d, "documents").select("doc_id", "n_chars")
    return S.table(spark, d, "labels").join(n, "doc_id").withColumn("score", F.round(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), 6)).withColumn("predicted", (F.col("score") >= 0.2).cast("int"))


_J = "WITH j AS (SELECT l.doc_id, quality, toxic, round(least(1.0, n_chars / 4000.0), 6)::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id), g AS (SELECT *, (score >= 0.2)::INT AS predicted FROM j)"


@query("m_confusion_prf", _J + ", c AS (SELECT label, count(*) FILTER (WHERE quality = label AND predicted = label) AS tp, count(*) FILTER (WHERE quality <> label AND predicted = label) AS fp, count(*) FILTER (WHERE quality = label AND predicted <> label) AS fn FROM g, (VALUES (0), (1)) t(label) GROUP BY label) SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c")
def _(spark, d):
    got = A.prf(judged(spark, d), "quality", "predicted")
    return got.select("label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("m_auc", _J + ", n AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM g GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp FROM n) SELECT round(sum((tp - pos / 2) * neg) / (sum(pos) * sum(neg)), 6) AS auc FROM c")
def _(spark, d):
    return A.auc(judged(spark, d), "quality", "score").select(F.round("auc", 6).alias("auc"))


@query("m_brier", _J + " SELECT round(avg((score - quality) * (score - quality)), 6) AS brier, round(avg((predicted = quality)::INT), 6) AS accuracy FROM g")
def _(spark, d):
    g = judged(spark, d)
    return g.agg(F.round(F.avg((F.col("score") - F.col("quality")) * (F.col("score") - F.col("quality"))), 6).alias("brier"), F.round(F.avg((F.col("predicted") == F.col("quality")).cast("int")), 6).alias("accuracy"))


@query("m_youden", _J + ", n AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM g GROUP BY score), c AS (SELECT score, round(sum(pos) OVER w / (SELECT sum(pos) FROM n) - sum(neg) OVER w / (SELECT sum(neg) FROM n), 9) AS j FROM n WINDOW w AS (ORDER BY score DESC)) SELECT score AS threshold, j FROM c ORDER BY j DESC, score DESC LIMIT 1")
def _(spark, d):
    return A.youden(judged(spark, d), "quality", "score")


@query("m_percentile_idx", "WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents), p(p) AS (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) SELECT p, n_chars AS value FROM p JOIN o ON i = least(floor(n * p), n - 1)")
def _(spark, d):
    return A.index_percentiles(S.table(spark, d, "documents"), "n_chars", [0.5, 0.9, 0.99, 1.0])


@query("m_span_prf", "WITH g AS (SELECT conv_id, turn, role AS type FROM conversations), p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS type FROM conversations) SELECT type, count(*) AS hits FROM (SELECT conv_id, turn, type FROM g INTERSECT SELECT conv_id, turn, type FROM p) GROUP BY type")
def _(spark, d):
    c = S.table(spark, d, "conversations")
    gold, got = c.select("conv_id", "turn", F.col("role").alias("type")), c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("type"))
    return gold.intersect(got).groupBy("type").agg(F.count("*").alias("hits"))


def vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


@query("m_neighbor_mean", "WITH u AS (SELECT vec_id AS node, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS other FROM embeddings UNION ALL SELECT (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings), vec_id FROM embeddings) SELECT node, round(avg(embedding[1]::DOUBLE), 5) AS x1, round(avg(embedding[64]::DOUBLE), 5) AS x64 FROM u JOIN embeddings ON vec_id = other GROUP BY node")
def _(spark, d):
    v = vectors(spark, d)
    n = v.agg(F.count("*").alias("n"))
    e = v.select("id").crossJoin(F.broadcast(n)).select(F.col("id").alias("source"), ((F.col("id") * 7 + 1) % F.col("n")).alias("target"))  # one row
    return A.neighbour_mean(both_ways(e), v, 64).select("node", F.round(F.get("vector", F.lit(0)), 5).alias("x1"), F.round(F.get("vector", F.lit(63)), 5).alias("x64"))


@query("m_cosine_topk", "WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings WHERE vec_id <> q), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS k FROM s) SELECT q, id, round(s, 5) AS similarity, k FROM k WHERE k <= 5")
def _(spark, d):
    v = vectors(spark, d)
    return A.nearest(v, v.where(F.col("id") % 100 == 0), 5).select("q", "id", F.round("s", 5).alias("similarity"), "k")


@query("m_class_prevalence", "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1, 2")
def _(spark, d):
    from pyspark.sql import Window

    got = S.table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("m_ablation", _J + ", a AS (SELECT 'low' AS config, avg(((score >= 0.1)::INT = quality)::INT) AS acc FROM g UNION ALL SELECT 'high', avg(((score >= 0.4)::INT = quality)::INT) FROM g) SELECT round(l.acc, 6) AS base, round(h.acc, 6) AS other, round(h.acc - l.acc, 6) AS gain, round((h.acc - l.acc) / l.acc, 6) AS relative FROM a l, a h WHERE l.config = 'low' AND h.config = 'high'")
def _(spark, d):
    hit = lambda t: F.avg(((F.col("score") >= t).cast("int") == F.col("quality")).cast("int"))
    a = judged(spark, d).agg(hit(0.1).alias("l"), hit(0.4).alias("h"))
    return a.select(F.round("l", 6).alias("base"), F.round("h", 6).alias("other"), F.round(F.col("h") - F.col("l"), 6).alias("gain"), F.round((F.col("h") - F.col("l")) / F.col("l"), 6).alias("relative"))


@query("m_prf_average", _J + ", c AS (SELECT label, count(*) FILTER (WHERE quality = label AND predicted = label) AS tp, count(*) FILTER (WHERE quality <> label AND predicted = label) AS fp, count(*) FILTER (WHERE quality = label AND predicted <> label) AS fn FROM g, (VALUES (0), (1)) t(label) GROUP BY label), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c) SELECT round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS micro_recall, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS accuracy FROM p")
def _(spark, d):
    return A.averaged(A.prf(judged(spark, d), "quality", "predicted"))


@query("m_pr_auc", _J + ", n AS (SELECT score, sum(quality) AS pos, count(*) AS all_ FROM g GROUP BY score), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(all_) OVER (ORDER BY score DESC) AS k, sum(pos) OVER () AS total FROM n) SELECT round(sum(pos / total * (tp / k)), 6) AS pr_auc FROM c")
def _(spark, d):
    return A.pr_auc(judged(spark, d), "quality", "score").select(F.round("pr_auc", 6).alias("pr_auc"))


@query("m_sens_spec", _J + " SELECT round(count(*) FILTER (WHERE quality = 1 AND predicted = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS sensitivity, round(count(*) FILTER (WHERE quality = 0 AND predicted = 0) / nullif(count(*) FILTER (WHERE quality = 0), 0), 6) AS specificity FROM g")
def _(spark, d):
    share = lambda v: F.round(F.try_divide(F.count_if((F.col("quality") == v) & (F.col("predicted") == v)).cast("double"), F.count_if(F.col("quality") == v)), 6)
    return judged(spark, d).agg(share(1).alias("sensitivity"), share(0).alias("specificity"))


@query("m_dialogue_report", """WITH o AS (SELECT length(text) AS x, text, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM conversations WHERE role = 'assistant'),
 p(name, p) AS (VALUES ('min', 0.0::DOUBLE), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p95', 0.95), ('max', 1.0))
 SELECT name, x::BIGINT AS value FROM p JOIN o ON i = least(floor(n * p), n - 1) UNION ALL SELECT 'samples', count(*) FROM o
 UNION ALL SELECT 'outputs_with_dose_words', count(*) FROM o WHERE contains(text, 'mg') OR contains(text, '毫克') OR contains(text, '每日') OR contains(text, '一天') OR contains(text, '片/次') OR contains(text, 'tid') OR contains(text, 'bid')
 UNION ALL SELECT 'outputs_without_kg_citation', count(*) FROM o WHERE NOT contains(text, '[KG-') UNION ALL SELECT 'outputs_without_disclaimer', count(*) FROM o WHERE NOT contains(text, '不能替代执业医师')""")
def _(spark, d):
    c = S.table(spark, d, "conversations").where("role = 'assistant'")
    return A.dialogue_report(c.select(F.lit("").alias("instruction"), F.col("text").alias("output")))


@query("m_features", "SELECT c_custkey, 23.5::DOUBLE AS bmi, CASE WHEN c_acctbal < 0 THEN 122.0::DOUBLE ELSE round(c_acctbal / 100, 2)::DOUBLE END AS systolic_bp, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS male, least(length(c_name) - length(replace(c_name, '0', '')), 4)::DOUBLE AS family_history, (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS low_activity FROM customer")
def _(spark, d):
    """Requests made of customers: the balance stands for pressure and is missing where negative, zeros of the name for relatives."""
    c = S.table(spark, d, "customer")
    zeros = F.regexp_count("c_name", F.lit("0"))
    asked = c.select(
        "c_custkey", F.lit(40).alias("age"), F.when(F.col("c_mktsegment") == "BUILDING", "male").alias("gender"), F.lit(None).cast("double").alias("bmi"), F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") / 100, 2)).alias("systolic_bp"),
        F.array_repeat(F.lit("x"), zeros).alias("family_history"), F.when(F.col("c_mktsegment") == "MACHINERY", "Low").alias("physical_activity"),
    )
    return M.features(asked).select("c_custkey", "bmi", "systolic_bp", "male", "family_history", "low_activity")
