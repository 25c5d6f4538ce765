"""Queries of keywords, answer checks, context texts, splits and small views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import analytics as A
from graphloom.operators import assembly as B
from graphloom.operators import graph as G
from graphloom.operators import training as L
from graphloom.session import stored
from graphloom.sources import seeds
from graphloom.sources import tables as S

from .base import EDGES, NODES, query
from .corpus import docs
from .graph import edges
from .retrieval import _ROUTES, _routes

_STOP = ["a", "i", "th", "he"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("t_tokens", f"WITH a AS (SELECT doc_id, regexp_extract_all(text, '[a-z]') AS o FROM documents), b AS (SELECT doc_id, list_filter(list_concat(o, [o[i] || o[i + 1] FOR i IN range(1, len(o))]), lambda w: NOT list_contains({_LIST(_STOP)}, w)) AS w FROM a) SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS digest FROM b")
def _(spark, d):
    """Lower-case letters stand for the script's characters."""
    w = T.tokens(F.col("text"), "a-z", _STOP)
    return docs(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_LEXICON = {"symptom": ["the", "there", "ther"], "treatment": ["tion", "here", "ation"], "check": ["er", "on"]}
_FOLD, _COUNTS = "text", []
for _k, _ws in _LEXICON.items():
    for _w in T._longest(_ws):
        _COUNTS.append((_k, _w, _FOLD))
_STEPS, _PREV = [], "SELECT doc_id, text AS t0 FROM documents"
for _i, (_k, _w, _) in enumerate(_COUNTS):
    _STEPS.append(f"s{_i} AS (SELECT *, replace(t{_i}, '{_w}', repeat(chr(57344), {len(_w)})) AS t{_i + 1}, (length(t{_i}) - length(replace(t{_i}, '{_w}', ''))) AS c{_i} FROM {'(' + _PREV + ')' if _i == 0 else f's{_i - 1}'})")
_SUMS = {k: " + ".join(f"c{i}" for i, (c, _, _) in enumerate(_COUNTS) if c == k) for k in _LEXICON}
_CLASSES = f"WITH {', '.join(_STEPS)}, z AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _SUMS.items())} FROM s{len(_COUNTS) - 1})"


@query("t_keyword_class", _CLASSES + " SELECT doc_id, CASE WHEN greatest(symptom, treatment, \"check\") = 0 OR symptom = greatest(symptom, treatment, \"check\") THEN 'symptom' WHEN treatment = greatest(symptom, treatment, \"check\") THEN 'treatment' ELSE 'check' END AS class, symptom + treatment + \"check\" AS taken FROM z")
def _(spark, d):
    got = docs(spark, d).select("doc_id", T.keyword_state(F.col("text"), _LEXICON).alias("s"))
    taken = F.aggregate("s.hits", F.lit(0).cast("long"), lambda a, h: a + h["n"] * F.length(h["word"]))
    return got.select("doc_id", T.keyword_class(F.col("s.hits"), _LEXICON).alias("class"), taken.alias("taken"))


_ANY = sorted({w for ws in _LEXICON.values() for w in ws})


@query("m_attention", f"""WITH a AS (SELECT conv_id, turn, role, string_split(text, ' ') AS w FROM conversations), b AS (SELECT *, len(w) AS n, (len(w) - 1) / 2.0 AS c FROM a),
 r AS (SELECT *, [1.35 * ((CASE WHEN n <= 1 THEN 0.5 ELSE 0.6 * (1.0 - abs(i - 1 - c) / greatest(c, 1e-6)) END) + (CASE WHEN {' OR '.join(f"contains(w[i], '{x}')" for x in _ANY)} THEN 1.0 ELSE 0.0 END))::DOUBLE FOR i IN range(1, n + 1)] AS x FROM b)
 SELECT conv_id, turn, role, n::BIGINT AS n, round(1 / list_sum([exp(v - list_max(x)) FOR v IN x]), 6) AS top FROM r""")
def _(spark, d):
    c = S.table(spark, d, "conversations").withColumn("w", F.split("text", " "))
    return c.select("conv_id", "turn", "role", F.size("w").cast("long").alias("n"), F.round(F.array_max(T.attention(F.col("w"), _LEXICON, None, 1.35)), 6).alias("top"))


@query("v_domain", "SELECT conv_id, turn, role, trim(text) <> '' AND (contains(trim(text), 'tion') OR contains(trim(text), 'ment') OR regexp_matches(trim(text), '(?:wh(?:at|en)|how) ')) AS asks FROM conversations")
def _(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", "role", T.of_domain(F.col("text"), ["tion", "ment"], "(?:wh(?:at|en)|how) ").alias("asks"))


_TERMS = ["the", "there", "her", "ten", "tenth", "and", "hand"]


@query("t_longest_match", f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{'|'.join(T._longest(_TERMS))}')) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.dictionary_matches(F.col("text"), _TERMS)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("v_entity_names", "SELECT c_custkey, CASE WHEN trim(c_name) = trim(c_mktsegment) THEN trim(c_name) ELSE concat_ws('|', nullif(trim(c_name), ''), nullif(trim(c_mktsegment), '')) END AS names FROM customer")
def _(spark, d):
    names = T.entity_names(F.array("c_name", F.lit(" ")), F.lit(None).cast("array<string>"), F.array(F.concat(F.lit(" "), "c_mktsegment"), "c_name"))
    return S.table(spark, d, "customer").select("c_custkey", F.array_join(names, "|").alias("names"))


_RULES = {"entity": ["[a-z]{2,10}tion"], "dose": ["[0-9]+ ?mg"], "absolute": "never|always|must", "diagnosis": "zzzz", "safe": ["no "], "disclaimer": "advice", "particles": ("é",)}


def _checked(spark, d):
    c = S.table(spark, d, "conversations").select(F.struct("conv_id", "turn", "role").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"names": F.array(F.lit("the"), F.lit("and")), "n": F.lit(3)})
    return B.check(c, "id", "text", "names", "n", ["sta"], **_RULES)


@query("q_guard_kinds")
def _(spark, d):
    """Violations of each kind, over all turns; its sentence rule has no plain SQL, so a test holds it against brute force."""
    return _checked(spark, d).groupBy("kind", "severity").agg(F.count("*").alias("n"))


_PARTS = {"primary": "主实体", "kg_reasoned": "推理", "kg_2hop": "多跳", "kg_similar": "相关"}


@query("q_context", _ROUTES + """, ck AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY confidence DESC, head, rel, tail, route) AS k, CASE route WHEN 'kg_1hop' THEN 'primary' ELSE route END AS part FROM un),
 cl AS (SELECT *, '[KG-' || k || '] ' || head || ' —' || rel || '→ ' || tail AS line FROM ck WHERE k <= 8),
 cp AS (SELECT question, k, CASE WHEN part = 'primary' THEN 0 ELSE min(k) OVER (PARTITION BY question, part) END AS place, CASE WHEN row_number() OVER (PARTITION BY question, part ORDER BY k) = 1 THEN chr(10) || '■ ' || CASE part WHEN 'primary' THEN '主实体' WHEN 'kg_reasoned' THEN '推理' WHEN 'kg_2hop' THEN '多跳' ELSE '相关' END || chr(10) || chr(10) ELSE '' END || rpad(line, greatest(38, length(line) + 2)::INT, ' ') || '（置信度 ' || printf('%.2f', confidence) || '）' AS line FROM cl)
 SELECT question, md5('【知识图谱事实 —— 共 ' || count(*) || ' 条，编号与回答中的 [KG-n] 引用一一对应】' || chr(10) || string_agg(line, chr(10) ORDER BY place, k)) AS digest FROM cp GROUP BY question""")
def _(spark, d):
    w = Window.partitionBy("question").orderBy(F.desc("confidence"), "head", "rel", "tail", "route")
    part = F.when(F.col("route") == "kg_1hop", "primary").otherwise(F.col("route"))
    top = _routes(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 8").withColumn("part", part)
    return B.context_text(top, "question", _PARTS).select("question", F.md5("text").alias("digest"))


@query("q_link_bonus", f"WITH {EDGES}, {NODES}, g AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1) SELECT n.id, round(least(0.999, 0.85 + least(0.06, coalesce(g.n, 0) / 400.0) + CASE WHEN length(n.id) <= 4 * 0.5 THEN 0.05 ELSE 0 END + CASE type WHEN 'Disease' THEN 0.04 WHEN 'Symptom' THEN 0.02 WHEN 'Department' THEN 0.01 WHEN 'Drug' THEN 0.01 ELSE 0 END), 6)::DOUBLE AS score FROM n LEFT JOIN g ON n.id = g.id")
def _(spark, d):
    n = G.degree(S.nodes(spark, d), edges(spark, d))
    return n.select("id", F.round(B.link_score(F.lit(0.85), F.col("degree"), F.length("id"), F.lit(4), F.col("type")), 6).alias("score"))


@query("q_best_match")
def _(spark, d):
    """Suppliers and nations against the regions' names; similarity has no SQL, so a test holds it against brute force."""
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    texts = S.table(spark, d, "nation").select(F.col("n_name").alias("text")).unionByName(S.table(spark, d, "supplier").select(F.col("s_name").alias("text")))
    return B.best_match(texts, names)


@query("t_sealed_fields", "SELECT c_custkey, c_name, c_name || ';' || c_mktsegment AS joined FROM customer")
def _(spark, d):
    key = F.lit("k" * 32)
    c = S.table(spark, d, "customer").select("c_custkey", B.sealed(F.col("c_name"), key).alias("a"), B.sealed(F.array_join(F.array("c_name", "c_mktsegment"), ";"), key).alias("b"))
    return c.select("c_custkey", B.opened(F.col("a"), key).alias("c_name"), B.opened(F.col("b"), key).alias("joined"))


@query("v_allowed_health", "SELECT c_custkey, c_acctbal AS bmi, CASE WHEN regexp_full_match(c_mktsegment, '[A-Za-z_]{2,20}') THEN c_mktsegment ELSE '' END AS gender, c_custkey % 2 = 1 AS smoking, substr(c_name || c_name || c_name, 1, 30) AS symptoms FROM customer")
def _(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bmi"), F.col("c_mktsegment").alias("gender"), (F.col("c_custkey") % 2).alias("smoking"), F.array(F.concat("c_name", "c_name", "c_name")).alias("symptoms"))
    return B.allowed_health(c, "c_custkey", ["bmi"], ["gender"], ["smoking"], ["symptoms"]).withColumn("symptoms", F.array_join("symptoms", "|"))


@query("m_factor_labels", "SELECT c_custkey, unnest(['年龄 ' || (20 + c_custkey % 70) || ' 岁', 'BMI ' || (18 + c_custkey % 20) || '.0', '吸烟', '家族史（命中 ' || (c_custkey % 3) || ' 项）', 'other']) AS label FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    pair = lambda f, v: F.struct(F.lit(f).alias("f"), v.cast("double").alias("v"))
    each = S.table(spark, d, "customer").select("c_custkey", F.inline(F.array(pair("age", 20 + k % 70), pair("bmi", 18 + k % 20), pair("smoking", F.lit(1)), pair("family_history", k % 3), pair("other", F.lit(0)))))
    return each.select("c_custkey", B.factor_label(F.col("f"), F.col("v")).alias("label"))


@query("q_evidence_chain", """WITH f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), a AS (SELECT l_partkey, l_suppkey, string_agg(ref, '|' ORDER BY ref) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY ref) AS k FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey AS ref FROM lineitem WHERE l_discount < 0.02)) WHERE k <= 3 GROUP BY 1, 2),
 b AS (SELECT l_partkey, string_agg(ref, '|' ORDER BY ref) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY ref) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey AS ref FROM lineitem WHERE l_discount < 0.04)) WHERE k <= 3 GROUP BY 1)
 SELECT f.l_partkey, f.l_suppkey, coalesce(a.refs, b.refs, '') AS refs, CASE WHEN a.refs IS NOT NULL THEN 1 WHEN b.refs IS NOT NULL THEN 2 ELSE 0 END AS level FROM f LEFT JOIN a ON f.l_partkey = a.l_partkey AND f.l_suppkey = a.l_suppkey LEFT JOIN b ON f.l_partkey = b.l_partkey""")
def _(spark, d):
    x = S.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount", F.col("l_orderkey").alias("ref"))
    facts = x.select("l_partkey", "l_suppkey").distinct()
    got = B.evidence_chain(facts, (x.where("l_discount < 0.02"), ["l_partkey", "l_suppkey"]), (x.where("l_discount < 0.04"), ["l_partkey"]))
    return got.select("l_partkey", "l_suppkey", F.array_join(F.transform("refs", lambda r: r.cast("string")), "|").alias("refs"), "level")


@query("e_alias_edges", "SELECT c_name AS source, 'HAS_ALIAS' AS rel, alias AS target, 0.99::DOUBLE AS confidence FROM (SELECT DISTINCT c_name, unnest([lower(c_name), 'c' || c_custkey]) AS alias FROM customer) UNION ALL SELECT DISTINCT c_name, 'BELONGS_TO', n_name, 0.98 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c, n = S.table(spark, d, "customer"), S.table(spark, d, "nation")
    nested = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_name").alias("name"), F.array("n_name").alias("department"), F.array(F.lower("c_name"), F.concat(F.lit("c"), "c_custkey"), F.lit(" ")).alias("alias"))
    return seeds.with_aliases(nested).select("source", "rel", "target", "confidence")


@query("t_stratified_split", "WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, k <= floor(0.15 * n) AS is_dev FROM h")
def _(spark, d):
    return seeds.stratified_split(S.table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.15)


@query("a_dept_total", "SELECT count(*) AS departments, sum(n)::BIGINT AS diseases, max(n) AS most FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def _(spark, d):
    n = S.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("departments"), F.sum("n").alias("diseases"), F.max("n").alias("most"))


@query("a_share_insight", f"WITH {NODES}, s AS (SELECT type, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS p FROM n GROUP BY type), k AS (SELECT *, row_number() OVER (ORDER BY p DESC, type) AS k FROM s) SELECT string_agg(type || ' ' || printf('%.2f', p) || '%', '、' ORDER BY k) AS insight FROM k WHERE k <= 3")
def _(spark, d):
    top = A.shares(S.nodes(spark, d), F.col("type")).orderBy(F.desc("percent"), "name").limit(3)  # one row a type
    x = F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("p"), "name")))
    return top.agg(F.array_join(F.transform(x, lambda s: F.concat(s["name"], F.lit(" "), F.format_string("%.2f%%", -s["p"]))), "、").alias("insight"))


@query("g_theta_two", "WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS name FROM lineitem) SELECT a.name AS a, b.name AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    """Suppliers that share two orders or more; an order has few lines, so few pairs."""
    s = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("name")).distinct()
    return s.select("k", F.col("name").alias("a")).join(s.select("k", F.col("name").alias("b")), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")


@query("g_disjunctive_top", f"WITH {EDGES} SELECT source, rel, target FROM e WHERE source IN ('C1', 'C2', 'S3') OR target IN ('C1', 'C2', 'S3') ORDER BY confidence DESC, source, rel, target LIMIT 12")
def _(spark, d):
    ids = ["C1", "C2", "S3"]
    return edges(spark, d).where(F.col("source").isin(ids) | F.col("target").isin(ids)).orderBy(F.desc("confidence"), "source", "rel", "target").limit(12).select("source", "rel", "target")


@query("v_detail", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, ''), nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), p_name) AS department FROM part")
def _(spark, d):
    p = S.table(spark, d, "part")
    blank = lambda n, c: F.nullif(F.when(F.col("p_size") % n == 0, "").otherwise(F.col(c)), F.lit(""))
    return p.select("p_partkey", F.coalesce(blank(3, "p_brand"), blank(2, "p_type"), "p_name").alias("department"))


@query("m_boosted")
def _(spark, d):
    """Labelled documents' quality by trees over measures of their texts, evaluated on documents that neither trees nor curve saw."""
    known = S.table(spark, d, "labels").where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    size = F.greatest(F.length("text"), F.lit(1))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / size
    x = S.table(spark, d, "documents").join(known, "doc_id").where(F.col("text").isNotNull())
    x = x.select("doc_id", "label", F.length("text").cast("double").alias("size"), share(r"[#*$%&|<>!]").alias("symbols"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"), (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("distinct"))
    x = stored(x, "measures")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    model = L.fit(x.where(part < 6), x.where(part.between(6, 7)), ["size", "symbols", "digits", "capitals", "distinct"], "label", rounds=8, depth=3)
    return L.evaluate(model.score(x.where(part > 7)), "label")
