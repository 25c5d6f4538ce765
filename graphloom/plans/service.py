"""Queries of the service edge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import service as V
from graphloom.operators import sqlgate
from graphloom.operators.graph import degree
from graphloom.sources import tables as S

from .analytics import people
from .base import EDGES, NODES, query
from .graph import edges


@query("c_graph_sql", f"WITH {EDGES}, {NODES} SELECT n.type, count(*) AS n, count(DISTINCT e.target) AS targets FROM n JOIN e ON e.source = n.id GROUP BY n.type")
def _(spark, d):
    return sqlgate.run(S.nodes(spark, d), edges(spark, d), "SELECT n.type, count(*) AS n, count(DISTINCT e.target) AS targets FROM nodes n JOIN edges e ON e.source = n.id GROUP BY n.type")


@query("c_label_contains", f"WITH {EDGES}, {NODES}, k AS (SELECT id, count(*) AS c FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT name, type, coalesce(c, 0)::BIGINT AS degree FROM n LEFT JOIN k ON n.id = k.id WHERE lower(type) = 'drug' AND contains(name, '1') ORDER BY degree DESC, name LIMIT 200")
def _(spark, d):
    n = S.nodes(spark, d).where((F.lower("type") == "drug") & F.col("name").contains("1"))
    return degree(n, edges(spark, d)).select("name", "type", "degree").orderBy(F.desc("degree"), "name").limit(200)


@query("v_since", """WITH e AS (SELECT event_id, abs(value)::INT AS n, CASE event_type WHEN 'click' THEN 'h' WHEN 'view' THEN 'm' WHEN 'error' THEN 'x' ELSE 'd' END AS u FROM events)
 SELECT event_id, CASE u WHEN 'd' THEN greatest(1, n) WHEN 'h' THEN greatest(1, ceil(n / 24.0)) WHEN 'm' THEN greatest(1, ceil(n / 1440.0)) END::BIGINT AS days FROM e""")
def _(spark, d):
    """An event's value as a duration, the unit by its type; one type's isn't a unit."""
    kind = F.col("event_type")
    unit = F.when(kind == "click", "h").when(kind == "view", "m").when(kind == "error", "x").otherwise("d")
    n = F.rint(F.abs("value")).cast("int")  # half to even, as the SQL's cast
    return S.table(spark, d, "events").select("event_id", V.since_days(F.concat(n.cast("string"), unit)).alias("days"))


@query("v_template", "SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ': ' AS body FROM customer")
def _(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", V.rendered(F.lit("Dear {name} of {segment}: {rest}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("body"))


@query("v_snippet", "WITH p AS (SELECT doc_id, text, coalesce(least(nullif(strpos(text, 'tion'), 0), nullif(strpos(text, 'und'), 0)), 1) AS f FROM documents), q AS (SELECT *, greatest(1, f - 40) AS s FROM p) SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, 200) || CASE WHEN s + 200 <= length(text) THEN '…' ELSE '' END AS snippet FROM q")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", V.snippet(F.col("text"), ["tion", "und"]).alias("snippet"))


@query("v_safety", "SELECT conv_id, turn, CASE WHEN contains(text, 'tion') OR contains(text, 'ble') THEN 'dose_guard' WHEN contains(text, 'the') THEN 'emergency' ELSE 'none' END AS template FROM conversations")
def _(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", V.first_rule(F.col("text"), [("dose_guard", ["tion", "ble"]), ("emergency", ["the"])], "none").alias("template"))


@query("v_validate", "SELECT c_custkey, CASE WHEN NOT 20 + c_custkey % 70 BETWEEN 0 AND 80 THEN 'age' WHEN c_custkey % 5 <> 0 AND NOT 18 + c_custkey % 20 BETWEEN 10 AND 35 THEN 'bmi' ELSE 'ok' END AS reason FROM customer")
def _(spark, d):
    return people(spark, d).select("c_custkey", V.reject_reason({"age": (0, 80), "bmi": (10, 35)}).alias("reason"))


@query("v_char_ids", "SELECT n_nationkey, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN i > length(n_name) THEN 0 WHEN strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(n_name, i::INT, 1)) > 0 THEN strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(n_name, i::INT, 1)) + 1 ELSE 1 END), ',') AS ids FROM nation")
def _(spark, d):
    ids = V.char_ids(F.col("n_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 12)
    return S.table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("v_cards", f"WITH {EDGES}, f AS (SELECT source, rel, string_agg(target, ',' ORDER BY target) FILTER (WHERE k <= 12) AS first, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, rel ORDER BY target) AS k FROM e WHERE source LIKE 'C%' AND rel <> 'BELONGS_TO') GROUP BY source, rel) SELECT source, rel, first, n FROM f")
def _(spark, d):
    e = edges(spark, d, "HAS_SYMPTOM", "USES_DRUG")
    # ranks before lists, so that none holds more than its twelve
    k = F.row_number().over(Window.partitionBy("source", "rel").orderBy("target"))
    first = e.withColumn("k", k).where("k <= 12").groupBy("source", "rel").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("first"))
    return first.join(e.groupBy("source", "rel").agg(F.count("*").alias("n")), ["source", "rel"])


@query("v_authority_url", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN url ELSE '' END, ''), 'urn:' || sha256(url)) AS address FROM pages")
def _(spark, d):
    from graphloom.sources.formats import source_url

    p = S.table(spark, d, "pages")
    return p.select("page_id", source_url(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(""), F.lit(""), F.col("url")).alias("address"))
