"""Rules driven together, recall routes, mentions, summaries and texts made of facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import corpus as P
from graphloom.operators import graph as G
from graphloom.operators import retrieval as Q
from graphloom.operators import rules as R
from graphloom.sources import tables as S

from .base import EDGES, NODES, RAW, query
from .corpus import docs
from .graph import edges
from .retrieval import _FACTS, customer_facts
from .rules import _SYM, DRIVEN, customer_ids, inferred_facts, symptoms


#: tr: every treatment of a customer; the rule file's R2 leaves none out, and here each supplier has more customers than the shared-neighbour rules' cut.
_TREATMENTS = f"WITH {RAW}, tr AS (SELECT DISTINCT source, target FROM raw WHERE rel = 'USES_DRUG'), pt AS (SELECT a.source AS a, b.source AS b, count(*) AS n FROM tr a JOIN tr b ON a.target = b.target AND a.source < b.source GROUP BY 1, 2)"


@query("r_shared_treatment", f"{_TREATMENTS} SELECT a, b, n, round(least(0.95, 0.66 + 0.06 * (n - 1)), 6)::DOUBLE AS confidence FROM pt")
def _(spark, d):
    """Pairs are counted over the customers' keys, which take less room than their ids; a < b holds for the ids."""
    got = R.shared(S.purchases(spark, d).select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target")), 1, 0.66, hub=None)
    return customer_ids(got).select("a", "b", "n", F.round("confidence", 6).alias("confidence"))


_DEPT = "s AS (SELECT 'C' || c_custkey AS source, c_nationkey || '/' || c_mktsegment AS target FROM customer UNION SELECT 'C' || c_custkey, c_nationkey || '#' || floor(c_acctbal / 1000)::INT FROM customer), h AS (SELECT target FROM s GROUP BY target HAVING count(*) BETWEEN 2 AND 40), k AS (SELECT s.source, s.target FROM s JOIN h ON s.target = h.target), pr AS (SELECT a.source AS a, b.source AS b, count(*) AS n FROM k a JOIN k b ON a.target = b.target AND a.source < b.source GROUP BY 1, 2)"


@query("r_shared_departments", f"WITH {_DEPT} SELECT a, b, n, round(least(0.95, 0.55 + 0.06 * (n - 2)), 6)::DOUBLE AS confidence FROM pr WHERE n >= 2")
def _(spark, d):
    """Customers are of two departments: nation with segment, and nation with the thousands of their balance."""
    c = S.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.array(F.concat_ws("/", "c_nationkey", "c_mktsegment"), F.concat_ws("#", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).cast("int"))).alias("t"))
    return R.shared(c.select("source", F.explode("t").alias("target")), 2, 0.55).withColumn("confidence", F.round("confidence", 6))


@query("r_top_pairs", _SYM + " SELECT a, b, n FROM pr WHERE n >= 2 ORDER BY n DESC, a, b LIMIT 20")
def _(spark, d):
    return R.pairs_by_shared(symptoms(spark, d)).where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(20)


@query("r_emergency_any", f"WITH {EDGES} SELECT DISTINCT source FROM e WHERE rel = 'USES_DRUG' AND target IN ('S3', 'S4')")
def _(spark, d):
    return edges(spark, d, "USES_DRUG").where(F.col("target").isin("S3", "S4")).select("source").distinct()


@query("r_driver", f"WITH {EDGES}, {DRIVEN} SELECT source, rel, target, confidence FROM dr ORDER BY confidence DESC, source, rel, target LIMIT 500")
def _(spark, d):
    return inferred_facts(spark, d, 500)


_LEGAL = [("Disease", "HAS_SYMPTOM", "Symptom"), ("Disease", "USES_DRUG", "Drug"), ("Disease", "BELONGS_TO", "Department"), ("Department", "PART_OF", "Category")]


@query("r_type_mask", f"WITH {EDGES}, {NODES} SELECT e.source, e.rel, e.target FROM e JOIN n a ON e.source = a.id JOIN n b ON e.target = b.id JOIN (VALUES {', '.join(map(str, _LEGAL))}) l(h, r, t) ON a.type = l.h AND e.rel = l.r AND b.type = l.t")
def _(spark, d):
    return R.legal(edges(spark, d), S.nodes(spark, d), _LEGAL).select("source", "rel", "target")


@query("q_multihop_recall", f"""WITH {EDGES}, u AS (SELECT source AS node, target AS other, max(confidence) AS c FROM e GROUP BY 1, 2 UNION ALL SELECT target, source, max(confidence) FROM e GROUP BY 1, 2),
 p AS (SELECT a.node AS start, a.other AS mid, b.other AS stop, least(a.c, b.c) AS confidence FROM u a JOIN u b ON a.other = b.node WHERE a.node IN ('C1', 'C2', 'C4') AND b.other IN ('N1', 'N2', 'N3') AND a.node <> b.other),
 k AS (SELECT *, row_number() OVER (PARTITION BY start, stop ORDER BY confidence DESC, mid) AS k FROM p) SELECT start, mid, stop, round(confidence, 6) AS confidence FROM k WHERE k <= 2 ORDER BY k.confidence DESC, start, stop, mid LIMIT 6""")
def _(spark, d):
    return Q.chains(edges(spark, d), ["C1", "C2", "C4"], ["N1", "N2", "N3"]).select("start", "mid", "stop", F.round("confidence", 6).alias("confidence"))


@query("q_similar")
def _(spark, d):
    """Facts of the three names most like each of two seeds; similarity has no SQL, so a test holds it against brute force."""
    e, n = edges(spark, d), S.nodes(spark, d)
    near = Q.similar(n, ["Customer#000000012", "Supplier#000000003"])
    rels = ["HAS_SYMPTOM", "USES_DRUG", "BELONGS_TO"]
    return Q.facts_of_similar(e.where(F.col("rel").isin(rels)), near).select("seed", "head", "rel", "tail", F.round("confidence", 6).alias("confidence"))


@query("q_neighbour_names", f"WITH {EDGES}, {NODES}, v AS (SELECT other, l_orderkey, l_linenumber, rel FROM (SELECT source AS node, target AS other, rel, l_orderkey, l_linenumber FROM e UNION ALL SELECT target, source, rel, l_orderkey, l_linenumber FROM e) WHERE node IN ('C7', 'S5') ORDER BY l_orderkey, l_linenumber, rel, other LIMIT 400) SELECT DISTINCT n.name FROM v JOIN n ON v.other = n.id")
def _(spark, d):
    seen = G.both_ways(edges(spark, d)).where(F.col("node").isin("C7", "S5")).orderBy("seq", "rel", "other").limit(400)
    n = S.nodes(spark, d)
    return n.join(seen.select(F.col("other").alias("id")).distinct(), "id", "left_semi").select("name").distinct()


_ORDER = ["USES_DRUG", "HAS_SYMPTOM", "BELONGS_TO"]


@query("q_slot_summary", _FACTS + " SELECT source, rel, string_agg(target, '、' ORDER BY confidence DESC, target) AS tails, CASE rel WHEN 'USES_DRUG' THEN 1 WHEN 'HAS_SYMPTOM' THEN 2 WHEN 'BELONGS_TO' THEN 3 ELSE 4 END AS place FROM sl GROUP BY source, rel")
def _(spark, d):
    return Q.slot_summary(Q.slot_facts(customer_facts(spark, d)), _ORDER)


@query("q_chain_text", "SELECT 'C' || c_custkey || ' —BELONGS_TO→ N' || n_nationkey || ' —PART_OF→ R' || n_regionkey AS chain FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    n = S.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = S.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    step = lambda rel, letter, key: F.struct(F.lit(rel).alias("relation"), F.concat(F.lit(letter), key).alias("to"))
    return c.select(X.chain_text(F.concat(F.lit("C"), "c_custkey"), F.array(step("BELONGS_TO", "N", "n_nationkey"), step("PART_OF", "R", "n_regionkey"))).alias("chain"))


@query("q_entities_text", "WITH k AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS k FROM (SELECT DISTINCT s_nationkey, trim(s_name) AS s_name FROM supplier) WHERE s_name <> '') SELECT s_nationkey, string_agg('Drug：' || s_name, '；' ORDER BY k) AS entities FROM k WHERE k <= 8 GROUP BY 1")
def _(spark, d):
    s = S.table(spark, d, "supplier").select("s_nationkey", F.lit("Drug").alias("type"), F.trim("s_name").alias("name")).where("name <> ''").distinct()
    return Q.entities_text(s, "s_nationkey", 8)


@query("g_evidence", f"WITH {RAW}, k AS (SELECT DISTINCT source, rel, target, l_orderkey FROM raw WHERE rel = 'USES_DRUG'), r AS (SELECT *, row_number() OVER (PARTITION BY source, rel, target ORDER BY l_orderkey) AS k FROM k) SELECT source, rel, target, l_orderkey, k FROM r WHERE k <= 3")
def _(spark, d):
    raw = S.raw_edges(spark, d, "USES_DRUG").select("source", "rel", "target", F.col("seq.l_orderkey").alias("l_orderkey"))
    return Q.evidence(raw, ["source", "rel", "target"], "l_orderkey", 3)


@query("g_edge_projection", f"WITH {EDGES} SELECT source, target, rel, CASE rel WHEN 'HAS_SYMPTOM' THEN '症状' WHEN 'USES_DRUG' THEN '用药' ELSE rel END AS label FROM e")
def _(spark, d):
    return edges(spark, d).select("source", "target", "rel", G.labelled(F.lit(None).cast("string"), F.col("rel"), {"HAS_SYMPTOM": "症状", "USES_DRUG": "用药"}).alias("label"))


_MENTIONS = [("the", "article", 0.9), ("the", "word", 0.8), ("and", "conjunction", 0.7), ("and", "word", 0.9), ("for", "word", 0.5)]
_W = "w AS (SELECT doc_id, lower(w) AS w, start FROM (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w, generate_subscripts(string_split_regex(text, '[^A-Za-z]+'), 1) AS start FROM documents))"


@query("q_mention_dedup", f"WITH {_W}, c AS (SELECT doc_id, start, type, term, score FROM w JOIN (VALUES {', '.join(map(str, _MENTIONS))}) t(term, type, score) ON w = term), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY score DESC, type) AS k FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, term ORDER BY score DESC, start) AS j FROM a WHERE k = 1) SELECT doc_id, start::INT AS start, type, term, score::DOUBLE AS score FROM b WHERE j = 1")
def _(spark, d):
    terms = F.broadcast(spark.createDataFrame(_MENTIONS, "term string, type string, score double"))  # a fixed table
    words = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "[^A-Za-z]+")).alias("start", "w")).select("doc_id", (F.col("start") + 1).alias("start"), F.lower("w").alias("term"))
    return Q.deduplicated(words.join(terms, "term"), "doc_id").select("doc_id", "start", "type", "term", "score")


_ALIASES = ["the", "there", "then", "and", "hand", "tion", "ation"]
_SPANS = " UNION ALL ".join(f"SELECT doc_id, '{a}' AS alias, instr(text, '{a}') AS start, instr(text, '{a}') + {len(a)} AS stop FROM documents" for a in _ALIASES)


@query("t_alias_spans", f"WITH s AS (SELECT * FROM ({_SPANS}) WHERE start > 0), u AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS upto FROM s) SELECT doc_id, alias, start::INT AS start, stop::INT AS stop FROM u WHERE start >= upto")
def _(spark, d):
    return P.longest_first(P.first_spans(docs(spark, d), "doc_id", "text", _ALIASES), "doc_id").select("doc_id", "alias", "start", "stop")


@query("t_alias_filter", f"WITH {NODES}, a AS (SELECT 1 AS ord, lower(n_name) AS alias, n_name AS canonical FROM nation UNION ALL SELECT 2, lower(substr(n_name, 1, 3)), n_name FROM nation UNION ALL SELECT 3, r_name, r_name FROM region UNION ALL SELECT 4, 'x' || r_name, 'x' || r_name || 'y' FROM region), k AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY ord, canonical) AS k FROM a WHERE alias <> canonical AND canonical IN (SELECT name FROM n)) SELECT alias, canonical FROM k WHERE k = 1")
def _(spark, d):
    n, r = S.table(spark, d, "nation"), S.table(spark, d, "region")
    part = lambda df, ord_, alias, canonical: df.select(F.lit(ord_).alias("ord"), alias.alias("alias"), canonical.alias("canonical"))
    every = [part(n, 1, F.lower("n_name"), F.col("n_name")), part(n, 2, F.lower(F.substring("n_name", 1, 3)), F.col("n_name")), part(r, 3, F.col("r_name"), F.col("r_name")), part(r, 4, F.concat(F.lit("x"), "r_name"), F.concat(F.lit("x"), "r_name", F.lit("y")))]
    return G.known_aliases(reduce(lambda x, y: x.unionByName(y), every), S.nodes(spark, d))


@query("v_category_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 6")
def _(spark, d):
    return S.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").orderBy("c_name").limit(6).select("c_custkey", "c_name")


@query("t_clean_punct", r"SELECT doc_id, md5(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clean_punct(F.col("text"))).alias("digest"))


_CLEAN = [r"<[^>]+>", r"(?i)(?:function|var|let|const|window\.|document\.)\s*[\p{L}\p{N}_]*", r"https?://[^\s]+", r"[^\s]+@[^\s]+\.[^\s]+", r"(?i)(?:版权所有|Copyright|©|\(c\)\s*20[0-9][0-9]|京ICP备)[^\s]*", r"\[\s*[0-9]+(?:\s*[-,]\s*[0-9]+)*\s*\]"]
_CLEAN_SQL = "text"
for _p in _CLEAN:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_p}', ' ', 'g')"
_CLEAN_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace({_CLEAN_SQL}, '[¹²³⁰-\x{{209f}}]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[\s\v\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
for _m in "。！？；，、":
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_m}{{2,}}', '{_m}', 'g')"


@query("t_clean_text", f"SELECT doc_id, md5({_CLEAN_SQL}) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("digest"))


_TERM_MAP = {"the": "article", "tion": "ness", "there": "here", "and": "also"}


@query("t_normalize_terms", f"SELECT doc_id, md5({reduce(lambda s, kv: f'replace({s}, {kv[0]!r}, {kv[1]!r})', sorted(_TERM_MAP.items(), key=lambda kv: (-len(kv[0]), kv[0])), 'text')}) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalize_terms(F.col("text"), _TERM_MAP)).alias("digest"))


_ONCE = "CASE WHEN length({0}) > 2 AND substr({0}, 1, 1) IN ('T', 't', 'h', 'a') THEN substr({0}, 2) ELSE {0} END"


@query("t_trim_lead", f"WITH a AS (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents), b AS (SELECT doc_id, {_ONCE.format('w')} AS w FROM a) SELECT doc_id, {_ONCE.format('w')} AS term FROM b")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.trim_lead(F.split_part("text", F.lit(" "), F.lit(1)), ("T", "t", "h", "a")).alias("term"))


@query("t_clean_name", r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(substr(text, 1, 80), '[（(].*?[)）]', '', 'g'), '(?:的症状|是什么|简介|概述|-医学百科| - 医学百科)$', '')), 1, 40) AS name FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.clean_name(F.substring("text", 1, 80)).alias("name"))


# protected spans are found in the JVM; the rules look behind, which DuckDB's patterns can't, so a test holds it against brute force
@query("t_mask_protected")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(P.masked_outside(F.col("text"))).alias("digest"))
