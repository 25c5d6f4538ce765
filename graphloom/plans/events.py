"""Event queries in batch form, and source/sink round trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators.graph import max_confidence
from graphloom.operators.pacing import pauses, retry_delay
from graphloom.sources import tables as S
from graphloom.session import shared_dir
from graphloom.sources.formats import shred, upsert
from graphloom.streaming import live

from .base import query


def events(spark, d):
    return S.table(spark, d, "events")


@query("e_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("e_sliding", "WITH x AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])::TIMESTAMP AS day, user_id FROM events) SELECT day, count(*) AS n, count(DISTINCT user_id) AS users FROM x GROUP BY day")
def _(spark, d):
    return events(spark, d).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("day"), "n", "users")


@query("e_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts)::TIMESTAMP AS started, count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    return events(spark, d).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


@query("e_rate_limit", "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*) > 2 AS blocked FROM events GROUP BY 1, 2")
def _(spark, d):
    got = events(spark, d).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("hour"), "n", (F.col("n") > 2).alias("blocked"))


@query("e_dedup_first", "SELECT user_id, event_type, min(ts)::TIMESTAMP AS first_seen FROM events GROUP BY 1, 2")
def _(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))


@query("e_last_k", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 40")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 40").select("user_id", "event_id")


@query("e_laps", "SELECT event_id, round(coalesce(epoch(ts) - epoch(lag(ts) OVER w), 0), 3)::DOUBLE AS lap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events(spark, d).select("event_id", F.round(F.coalesce(t - F.lag(t).over(w), F.lit(0.0)), 3).alias("lap"))


@query("e_status_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def _(spark, d):
    got = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("e_pauses", """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, k, CASE event_type WHEN 'error' THEN 5.0::DOUBLE * 1.8 ELSE 5.0::DOUBLE END AS pause FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.event_type = 'error' THEN least(f.pause * 1.8, 120) WHEN o.event_type IN ('view', 'click') THEN greatest(f.pause * 0.9, 5) ELSE f.pause END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
 SELECT event_id, round(pause, 6) AS pause FROM f""")
def _(spark, d):
    """An error counts as a refusal, views and clicks as answers."""
    e = events(spark, d)
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type").isin("view", "click"), 200).otherwise(304)
    got = pauses(e.select(F.col("user_id").alias("client"), F.struct("ts", "event_id").alias("seq"), "event_id", status.alias("status")), "event_id")
    return got.select("event_id", F.round("pause", 6).alias("pause"))


@query("e_retries", "SELECT event_id, CASE WHEN event_type = 'error' AND k < 3 THEN 2.0::DOUBLE ** k END AS delay FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def _(spark, d):
    e = events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", retry_delay(F.when(F.col("event_type") == "error", 503).otherwise(200), F.col("k")).alias("delay"))


@query("e_json_roundtrip", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    row = F.to_json(F.struct("event_id", "event_type", "value"))
    back = F.from_json(row, "event_id long, event_type string, value double")
    return events(spark, d).select(back.alias("r")).select("r.*")


@query("e_upsert", "WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) END AS name, -1.0 AS v FROM customer WHERE c_custkey % 5 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.v, o.v)::DOUBLE AS v FROM o FULL JOIN n ON o.id = n.id")
def _(spark, d):
    c = S.table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    new = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).alias("name"), F.lit(-1.0).alias("v"))
    return upsert(old, new, ["id"])


@query("e_edge_upsert", "SELECT user_id, event_type, round(max(value), 6) AS best, min(event_id) AS created, max(event_id) AS updated FROM events GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("source"), F.col("event_type").alias("rel"), F.lit(0).alias("target"), F.col("value").alias("confidence"), F.col("event_id").alias("seq"))
    return max_confidence(e).select(F.col("source").alias("user_id"), F.col("rel").alias("event_type"), F.round("confidence", 6).alias("best"), "created", "updated")


@query("e_shred", "SELECT c_name AS source, 'HAS_SYMPTOM' AS rel, p_name AS target FROM customer JOIN part ON p_partkey = c_custkey UNION SELECT c_name, 'BELONGS_TO', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    c, p, n = S.table(spark, d, "customer"), S.table(spark, d, "part"), S.table(spark, d, "nation")
    nested = c.join(p, c["c_custkey"] == p["p_partkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_name").alias("name"), F.array_compact(F.array("p_name")).alias("symptoms"), F.array_compact(F.array("n_name", "n_name")).alias("department"))
    return shred(nested, {"symptoms": ("HAS_SYMPTOM", 0.97), "department": ("BELONGS_TO", 0.95)}).select("source", "rel", "target")


@query("e_stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    got = live.run_once(live.tumbling(live.events(spark, d), "1 day"), shared_dir(spark), "complete")
    return got.select("day", "event_type", "n")


@query("e_stream_dedup", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    return live.run_once(live.deduplicated(live.events(spark, d), ["event_id"], live.WHOLE).select("event_id"), shared_dir(spark), "append")


@query("e_stream_sessions", "SELECT user_id, count(*) AS n, count(*) // 2 AS turns FROM events GROUP BY 1")
def _(spark, d):
    got = live.run_once(live.session_totals(live.events(spark, d), live.WHOLE), shared_dir(spark), "update")
    return got.groupBy("user_id").agg(F.max("n").alias("n")).select("user_id", "n", F.floor(F.col("n") / 2).alias("turns"))
