"""Queries around answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import answers as A
from graphloom.operators import risk as M
from graphloom.sources import tables as S

from .base import EDGES, query
from .graph import edges

_ASK = {"HAS_SYMPTOM": ["Which symptoms has {e}?", "How does {e} show?"], "USES_DRUG": ["Which drugs go with {e}?", "What is {e} treated with?"], "BELONGS_TO": ["Which department sees {e}?"]}
_REST = ["Which department sees C1?", "What is a symptom?", "What is a drug?"]
_ASK_SQL = ", ".join(f"('{rel}', {k}, '{q}')" for rel, qs in _ASK.items() for k, q in enumerate(qs))
_REST_SQL = ", ".join(f"({k}, '{q}')" for k, q in enumerate(_REST))


@query("q_follow_ups", f"""WITH {EDGES}, i AS (SELECT source AS id, rel, l_orderkey AS o, l_linenumber AS l FROM e UNION ALL SELECT target, rel, l_orderkey, l_linenumber FROM e),
 f AS (SELECT id, rel, row_number() OVER (PARTITION BY id ORDER BY min(o * 1000 + l), rel) AS k FROM i WHERE rel IN ('HAS_SYMPTOM', 'USES_DRUG', 'BELONGS_TO') GROUP BY id, rel),
 a AS (SELECT id, k, t, replace(q, '{{e}}', id) AS q FROM f JOIN (VALUES {_ASK_SQL}) v(rel, t, q) USING (rel) UNION ALL SELECT id, 99, t, q FROM (SELECT DISTINCT id FROM f), (VALUES {_REST_SQL}) w(t, q)),
 b AS (SELECT id, q, min(k * 100 + t) AS p FROM a GROUP BY id, q), c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM b)
 SELECT id, string_agg(q, '|' ORDER BY p) AS questions FROM c WHERE r <= 5 GROUP BY id""")
def _(spark, d):
    return A.follow_ups(edges(spark, d), _ASK, _REST).select("id", F.array_join("questions", "|").alias("questions"))


@query("q_main_entity", "WITH m AS (SELECT l_suppkey AS supplier, o_custkey AS head, count(*) AS n, min(l_orderkey * 1000 + l_linenumber) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey) SELECT supplier, head, n FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY n DESC, p, head DESC) AS k FROM m) WHERE k = 1")
def _(spark, d):
    p = S.purchases(spark, d).select(F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("head"), "seq")
    return A.main_entity(p, "supplier", "head", "seq")


@query("v_template_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_brand), 'eco') OR contains(lower(p_type), 'eco')")
def _(spark, d):
    t = S.table(spark, d, "part").withColumn("tags", F.split("p_type", " "))
    return A.with_keyword(t, "ECO", ["p_name", "p_brand"], "tags").select("p_partkey", "p_name")


@query("v_chat", """WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Be brief.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || text || CASE WHEN turn > 0 THEN chr(10) || chr(10) || 'Also: turn ' || turn ELSE '' END || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || answer || '<|eot_id|>' AS chat
 FROM t WHERE role = 'user' AND next = 'assistant' AND text IS NOT NULL AND answer IS NOT NULL""")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = S.table(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)})
    t = t.where((F.col("role") == "user") & (F.col("next") == "assistant") & F.col("text").isNotNull() & F.col("answer").isNotNull())
    extra = F.when(F.col("turn") > 0, F.concat(F.lit("turn "), F.col("turn")))
    return t.select("conv_id", "turn", A.chat_text(F.lit("Be brief."), F.col("text"), extra, F.col("answer")).alias("chat"))


_ESCAPED = "'## ' || role || chr(10) || '**' || text || '** <a href=\"x\"> [KG-' || turn || ']'"
for _a, _b in A.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b}')"
for _a, _b in A.MARKS:
    _ESCAPED = f"regexp_replace({_ESCAPED}, '{_a.replace('(?dm)', '(?m)').replace('(?d)', '')}', '{_b.replace('$1', chr(92) + '1')}', 'g')"


@query("v_markdown", f"SELECT conv_id, turn, {_ESCAPED} AS html FROM conversations WHERE text IS NOT NULL")
def _(spark, d):
    c = S.table(spark, d, "conversations").where(F.col("text").isNotNull())
    md = F.concat(F.lit("## "), F.col("role"), F.lit("\n**"), F.col("text"), F.lit('** <a href="x"> [KG-'), F.col("turn"), F.lit("]"))
    return c.select("conv_id", "turn", A.markdown_html(md).alias("html"))


_RULE = "CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' le ') THEN 'fr' ELSE 'es' END"


@query("m_confusion_pairs", f"WITH p AS (SELECT lang AS gold, {_RULE} AS predicted, count(*) AS n FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) SELECT gold, predicted, n, (SELECT sum(CASE WHEN gold = predicted THEN n ELSE 0 END)::DOUBLE / sum(n) FROM p) AS accuracy FROM p WHERE gold <> predicted ORDER BY n DESC, gold, predicted LIMIT 8")
def _(spark, d):
    rows = S.table(spark, d, "documents").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return A.confusions(rows.select(F.col("lang").alias("gold"), F.expr(_RULE).alias("predicted")), "gold", "predicted")


@query("t_fuzzy_mentions")
def _(spark, d):
    c = S.table(spark, d, "conversations").withColumn("place", F.concat_ws(":", "conv_id", "turn"))
    return A.fuzzy_mentions(c, "place", "text", ["whention", "erstation", "thereing", "anthouse", "ofering"])


@query("t_first_named", "SELECT doc_id, CASE WHEN contains(h, 'ement') THEN 'ement' WHEN contains(h, 'ation') THEN 'ation' WHEN contains(h, 'heit') THEN 'heit' WHEN contains(h, 'The') THEN 'The' END AS head FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 200) AS h FROM documents)")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", A.first_named(F.col("text"), ["ement", "ation", "heit", "The"]).alias("head"))


_TEMPLATES = [("user", 1, "u_short", 0, 60, None), ("user", 2, "u_words", 0, 0, ["tion", "ough"]), ("user", 3, "u_long", 150, 0, None), ("assistant", 1, "a_words", 40, 0, ["here"]), ("assistant", 2, "a_any", 0, 0, [])]


@query("v_template_select", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN length(t) <= 60 THEN 'u_short' WHEN contains(t, 'tion') OR contains(t, 'ough') THEN 'u_words' WHEN length(t) >= 150 THEN 'u_long' END
 WHEN role = 'assistant' THEN CASE WHEN length(t) >= 40 AND contains(t, 'here') THEN 'a_words' ELSE 'a_any' END END AS id FROM (SELECT *, coalesce(text, '') AS t FROM conversations)""")
def _(spark, d):
    t = spark.createDataFrame(_TEMPLATES, "intent string, place int, id string, min_len int, max_len int, keyword_any array<string>")
    return A.select_template(S.table(spark, d, "conversations").withColumnRenamed("role", "intent"), F.broadcast(t), ["conv_id", "turn"], "text")  # a parameter table


@query("m_symptom_score", """SELECT l_orderkey, round(least(5.0, sum(CASE WHEN p_name = 'small widget' THEN 0.6 WHEN p_name = 'cold' THEN 1.0 WHEN contains(p_name, 'small widget') OR contains('small widget', p_name) THEN 0.48 WHEN contains(p_name, 'cold') OR contains('cold', p_name) THEN 0.8 ELSE 0.3 END))::DOUBLE, 3) AS score
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def _(spark, d):
    named = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(S.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    lists = named.groupBy("l_orderkey").agg(F.collect_list("p_name").alias("names"))  # lines of one order
    return lists.select("l_orderkey", M.symptom_score(F.col("names"), {"small widget": 0.6, "cold": 1.0}).alias("score"))


@query("t_viterbi")
def _(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = F.transform(words, lambda w: F.array(F.lit(0.0), F.length(w) / 6.0 - 1, F.when(F.contains(w, F.lit(".")), 1.0).otherwise(-1.0)))
    c = S.table(spark, d, "conversations").select("conv_id", "turn", A.viterbi(rows, [0.0, 0.1, -9.0], [[0.2, 0.0, -9.0], [0.0, 0.1, 0.4], [0.3, 0.0, 0.2]], [0.0, -0.1, 0.1]).alias("tags"))
    return c.select("conv_id", "turn", F.array_join(F.transform("tags", lambda x: x.cast("string")), "").alias("tags"))
