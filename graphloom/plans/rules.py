"""Rule inference and link prediction over the purchase graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import rules as R
from graphloom.sources import tables as S

from .base import EDGES, query
from .graph import edges

_PAIRS = """h AS (SELECT target FROM s GROUP BY target HAVING count(*) BETWEEN 2 AND 40), k AS (SELECT s.source, s.target FROM s JOIN h ON s.target = h.target),
 pr AS (SELECT a.source AS a, b.source AS b, count(*) AS n FROM k a JOIN k b ON a.target = b.target AND a.source < b.source GROUP BY 1, 2)"""
_SYM = f"WITH {EDGES}, s AS (SELECT DISTINCT source, target FROM e WHERE rel = 'HAS_SYMPTOM'), {_PAIRS}"


def symptoms(spark, d):
    return edges(spark, d, "HAS_SYMPTOM")


def symptom_keys(spark, d):
    """source and target of the symptom edges as the tables' keys, which take less room than ids; repeated ones included."""
    return S.purchases(spark, d).select(F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target")).dropna()


def customer_ids(pairs):
    """Pairs of customers' keys as pairs of their ids, a < b."""
    a, b = F.concat(F.lit("C"), "a"), F.concat(F.lit("C"), "b")
    return pairs.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})


@query("r_shared", _SYM + " SELECT a, b, n, round(least(0.95, 0.72 + 0.06 * (n - 2)), 6)::DOUBLE AS confidence FROM pr WHERE n >= 2")
def _(spark, d):
    return customer_ids(R.shared(symptom_keys(spark, d), 2, 0.72)).withColumn("confidence", F.round("confidence", 6))


#: tr: a customer's treatment, the supplier of its dearest line; pt: pairs of customers with a common one, hubs left out.
TREATED = """bt AS (SELECT o_custkey AS c, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 tr AS (SELECT 'C' || c AS source, 'S' || l_suppkey AS target FROM bt WHERE k = 1), th AS (SELECT target FROM tr GROUP BY target HAVING count(*) BETWEEN 2 AND 40),
 pt AS (SELECT a.source AS a, b.source AS b, count(*) AS n FROM tr a JOIN tr b ON a.target = b.target AND a.source < b.source WHERE a.target IN (SELECT target FROM th) GROUP BY 1, 2)"""


def treatment_keys(spark, d):
    """source and target as the tables' keys: each customer with the supplier of its dearest line."""
    bought = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    dearest = bought.groupBy("o_custkey").agg(F.max(F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")).alias("m"))
    return dearest.select(F.col("o_custkey").alias("source"), F.col("m.l_suppkey").alias("target")).dropna()


#: What the rules infer together, without loops and known edges; e: edges.
DRIVEN = f"""s AS (SELECT DISTINCT source, target FROM e WHERE rel = 'HAS_SYMPTOM'), {_PAIRS}, {TREATED}, i AS (SELECT a AS source, 'RELATED_TO' AS rel, b AS target, round(least(0.95, 0.72 + 0.06 * (n - 2)), 6)::DOUBLE AS confidence FROM pr WHERE n >= 2
 UNION ALL SELECT a, 'RELATED_TO', b, round(least(0.95, 0.66 + 0.06 * (n - 1)), 6)::DOUBLE FROM pt
 UNION ALL SELECT a.source, 'BELONGS_TO', b.target, 0.64 FROM e a JOIN e b ON a.target = b.source WHERE a.rel = 'BELONGS_TO' AND b.rel = 'PART_OF'
 UNION ALL SELECT 'C' || c_custkey, 'NEEDS_ISOLATION', 'isolation', 0.9 FROM customer WHERE c_acctbal < 0),
 dr AS (SELECT source, rel, target, max(confidence) AS confidence FROM i WHERE source <> target AND NOT EXISTS (SELECT 1 FROM e WHERE e.rel = i.rel AND ((e.source = i.source AND e.target = i.target) OR (e.source = i.target AND e.target = i.source))) GROUP BY 1, 2, 3)"""


def inferred_facts(spark, d, limit):
    """The rules' best conclusions over all edges: source, rel, target, confidence."""
    pair = lambda df, least, base: customer_ids(R.shared(df, least, base)).select(F.col("a").alias("source"), F.lit("RELATED_TO").alias("rel"), F.col("b").alias("target"), F.round("confidence", 6).alias("confidence"))
    up = R.composed(edges(spark, d, "BELONGS_TO"), edges(spark, d, "PART_OF"), "BELONGS_TO", 0.64)
    people = S.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), "c_acctbal")
    conclusions = [pair(symptom_keys(spark, d), 2, 0.72), pair(treatment_keys(spark, d), 1, 0.66), up, R.flagged(people, F.col("c_acctbal") < 0, "NEEDS_ISOLATION", "isolation", 0.9)]
    # of the relations that the rules conclude only this one has edges
    return R.drive(conclusions, edges(spark, d, "BELONGS_TO"), limit)


@query("r_transitive", f"WITH {EDGES} SELECT DISTINCT a.source, 'MAY_CAUSE_SYMPTOM' AS rel, b.target, 0.64::DOUBLE AS confidence FROM e a JOIN e b ON a.target = b.source WHERE a.rel = 'BELONGS_TO' AND b.rel = 'PART_OF' AND a.source <> b.target")
def _(spark, d):
    return R.composed(edges(spark, d, "BELONGS_TO"), edges(spark, d, "PART_OF"), "MAY_CAUSE_SYMPTOM", 0.64)


@query("r_flag", "SELECT 'C' || c_custkey AS source, 'NEEDS_ISOLATION' AS rel, 'isolation' AS target, 0.9::DOUBLE AS confidence FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    n = S.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), "c_acctbal")
    return R.flagged(n, F.col("c_acctbal") < 0, "NEEDS_ISOLATION", "isolation", 0.9)


@query("r_cross_topk", f"WITH {EDGES}, a AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM e WHERE rel = 'USES_DRUG'), b AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM e WHERE rel = 'HAS_SYMPTOM') SELECT a.source, a.target AS head, 'DRUG_RISK_ALERT' AS rel, b.target AS tail, 0.5::DOUBLE AS confidence FROM a JOIN b ON a.source = b.source WHERE a.k <= 6 AND b.k <= 3")
def _(spark, d):
    return R.crossed(edges(spark, d, "USES_DRUG"), edges(spark, d, "HAS_SYMPTOM"), 6, 3, "DRUG_RISK_ALERT", 0.5)


_DIFF = "df AS (SELECT 'P' || l_partkey AS source, 'DIFFERENTIAL_WITH' AS rel, 'P' || (l_suppkey % 50 + 1) AS target FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)"


def _differentials(spark, d):
    got = S.table(spark, d, "lineitem").where("l_linenumber = 1")
    return got.select(F.concat(F.lit("P"), "l_partkey").alias("source"), F.lit("DIFFERENTIAL_WITH").alias("rel"), F.concat(F.lit("P"), F.col("l_suppkey") % 50 + 1).alias("target")).distinct()


@query("r_symmetric", f"WITH {_DIFF} SELECT DISTINCT target AS source, rel, source AS target FROM df a WHERE NOT EXISTS (SELECT 1 FROM df b WHERE b.source = a.target AND b.target = a.source)")
def _(spark, d):
    return R.symmetric(_differentials(spark, d))


@query("r_second_order", f"WITH {_DIFF} SELECT DISTINCT a.source, 'SECOND_ORDER' AS rel, b.target, 0.45::DOUBLE AS confidence FROM df a JOIN df b ON a.target = b.source WHERE a.source <> b.target AND NOT EXISTS (SELECT 1 FROM df c WHERE c.source = a.source AND c.target = b.target)")
def _(spark, d):
    e = _differentials(spark, d)
    return R.composed(e, e, "SECOND_ORDER", 0.45).join(e.select("source", "target"), ["source", "target"], "left_anti")


@query("r_emergency", f"WITH {EDGES} SELECT source FROM e WHERE rel = 'USES_DRUG' AND target IN ('S1', 'S2') GROUP BY source HAVING count(DISTINCT target) = 2")
def _(spark, d):
    e = edges(spark, d, "USES_DRUG")
    one = lambda t: e.where(F.col("target") == t).select("source")
    return one("S1").join(one("S2"), "source", "left_semi").distinct()


@query("r_authority", f"WITH {EDGES}, a AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING') SELECT source, rel, target, round(least(1.0, confidence + CASE WHEN source IN (SELECT id FROM a) THEN 0.05 ELSE 0 END), 6) AS confidence FROM e WHERE rel = 'USES_DRUG'")
def _(spark, d):
    a = S.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.lit(0.05).alias("boost"))
    e = edges(spark, d, "USES_DRUG").join(a, "source", "left")
    return e.select("source", "rel", "target", F.round(F.least(F.lit(1.0), F.col("confidence") + F.coalesce("boost", F.lit(0.0))), 6).alias("confidence"))


@query("r_novel", f"WITH {_DIFF}, i AS (SELECT DISTINCT a.source, 'DIFFERENTIAL_WITH' AS rel, b.target FROM df a JOIN df b ON a.target = b.source WHERE a.source <> b.target) SELECT source, rel, target FROM i WHERE NOT EXISTS (SELECT 1 FROM df WHERE (df.source = i.source AND df.target = i.target) OR (df.source = i.target AND df.target = i.source))")
def _(spark, d):
    e = _differentials(spark, d)
    return R.novel(R.composed(e, e, "DIFFERENTIAL_WITH", 0.45), e).select("source", "rel", "target")


#: All pairs with a common symptom: their measures are the result.
_METRICS = _SYM + """, g AS (SELECT source, count(*) AS sz FROM s GROUP BY 1), tg AS (SELECT target, count(*) AS dg FROM s GROUP BY 1),
 aa AS (SELECT a.source AS a, b.source AS b, count(*) AS i, sum(CASE WHEN dg > 2 THEN 1 / ln(dg) ELSE 0 END) AS aa FROM s a JOIN s b ON a.target = b.target AND a.source < b.source JOIN tg ON tg.target = a.target GROUP BY 1, 2),
 l AS (SELECT aa.a, aa.b, aa.aa, i / (ga.sz + gb.sz - i) AS jac, i / least(ga.sz, gb.sz) AS ov FROM aa JOIN g ga ON ga.source = aa.a JOIN g gb ON gb.source = aa.b)"""


@query("l_adamic_adar", _METRICS + " SELECT a, b, round(aa, 6) AS aa FROM l")
def _(spark, d):
    return customer_ids(R.link_scores(symptom_keys(spark, d), ("aa",))).select("a", "b", F.round("aa", 6).alias("aa"))


@query("l_jaccard_overlap", _METRICS + " SELECT a, b, round(jac, 6) AS jaccard, round(ov, 6) AS overlap FROM l")
def _(spark, d):
    return customer_ids(R.link_scores(symptom_keys(spark, d), ("jaccard", "overlap"))).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


#: w: neighbours of customers in both directions (symptoms, the dearest line's supplier, the nation); known: an order's customer and the one its first line names.
_NEAR = TREATED + """,
 ed AS (SELECT source, target FROM s UNION SELECT source, target FROM tr UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
 bo AS (SELECT source AS node, target AS z FROM ed UNION SELECT target, source FROM ed), dz AS (SELECT node AS z, CASE WHEN count(*) > 2 THEN 1 / ln(count(*)) ELSE 0 END AS aa FROM bo GROUP BY 1),
 w AS (SELECT node, bo.z, aa, (bo.z LIKE 'P%')::INT AS ty FROM bo JOIN dz ON dz.z = bo.z WHERE node LIKE 'C%'), sz AS (SELECT node, count(*) AS n, sum(ty) AS st FROM w GROUP BY node),
 kn AS (SELECT DISTINCT 'C' || o_custkey AS a, 'C' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
 pp AS (SELECT x.node AS source, y.node AS target, count(*) AS c, sum(x.ty) AS t, sum(x.aa) AS aa FROM w x JOIN w y ON x.z = y.z AND x.node <> y.node GROUP BY 1, 2),
 sc AS (SELECT source, target, aa, c / (a.n + b.n - c) AS jaccard, CASE WHEN least(a.st, b.st) > 0 THEN t / least(a.st, b.st) ELSE 0 END AS overlap FROM pp JOIN sz a ON a.node = source JOIN sz b ON b.node = target),
 rw AS (SELECT *, round(0.45 * least(aa / 3, 1) + 0.25 * jaccard + 0.30 * overlap, 9) AS raw FROM sc),
 rl AS (SELECT source, rel, target, aa, jaccard, overlap, raw FROM rw, (VALUES ('RELATED_TO'), ('DIFFERENTIAL_WITH')) v(rel) WHERE raw >= 0.15 AND NOT (rel = 'RELATED_TO' AND EXISTS (SELECT 1 FROM kn WHERE (kn.a = source AND kn.b = target) OR (kn.a = target AND kn.b = source)))),
 tk AS (SELECT *, least(0.88, 0.5 + 0.45 * raw) AS confidence FROM rl QUALIFY row_number() OVER (PARTITION BY source, rel ORDER BY raw DESC, target) <= 10)"""


#: A key with its table's letter as one number, key * 8 + place; ids of nodes of several tables, but no texts.
_LETTERS = "CPSN"


def _number(letter, key):
    return F.col(key).cast("long") * 8 + _LETTERS.index(letter)


def _named(c):
    """The id of a number."""
    return F.concat(F.substring(F.lit(_LETTERS), c.bitwiseAND(7).cast("int") + 1, F.lit(1)), F.shiftright(c, 3))


def _predicted(spark, d):
    """Ten partners a customer over its symptoms, treatment and nation; the customer that an order's first line names is known to be related."""
    line, orders = S.table(spark, d, "lineitem"), S.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    of = lambda letter, key: F.concat(F.lit(letter), key)
    bought = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lambda df, a, ka, b, kb: df.select(_number(a, ka).alias("source"), _number(b, kb).alias("target")).dropna()
    e = ends(symptom_keys(spark, d), "C", "source", "P", "target").unionByName(ends(treatment_keys(spark, d), "C", "source", "S", "target")).unionByName(ends(S.table(spark, d, "customer"), "C", "c_custkey", "N", "c_nationkey"))
    known = bought.where("l_linenumber = 1").select(of("C", "o_custkey").alias("source"), F.lit("RELATED_TO").alias("rel"), of("C", "l_suppkey").alias("target")).distinct()
    ids = lambda name, letter, key: S.table(spark, d, name).select(_number(letter, key).alias("id"))
    return R.predicted(e, ids("customer", "C", "c_custkey"), ids("part", "P", "p_partkey"), known, ("RELATED_TO", "DIFFERENTIAL_WITH"), 10, named=_named)


_DIGITS = ("aa", "jaccard", "overlap", "raw", "confidence")


@query("l_score", f"{_SYM}, {_NEAR} SELECT source, rel, target, {', '.join(f'round({c}, 6) AS {c}' for c in _DIGITS)} FROM tk")
def _(spark, d):
    return _predicted(spark, d).select("source", "rel", "target", *(R.rounded(F.col(c), 6).alias(c) for c in _DIGITS))


@query("r_hybrid", f"""{_SYM}, {_NEAR}, un AS (SELECT a, b, round(least(0.95, 0.72 + 0.06 * (n - 2)), 6)::DOUBLE AS c, 'rule' AS origin FROM pr WHERE n >= 2
 UNION ALL SELECT least(source, target), greatest(source, target), round(confidence, 6), 'link' FROM tk WHERE rel = 'RELATED_TO'), rk AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c DESC, origin) AS rn FROM un) SELECT a, b, c AS confidence, origin FROM rk WHERE rn = 1""")
def _(spark, d):
    rule = customer_ids(R.shared(symptom_keys(spark, d), 2, 0.72)).select("a", "b", F.round("confidence", 6).alias("confidence"), F.lit("rule").alias("origin"))
    link = _predicted(spark, d).where("rel = 'RELATED_TO'").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), R.rounded(F.col("confidence"), 6).alias("confidence"), F.lit("link").alias("origin"))
    return R.merged(rule, link)
