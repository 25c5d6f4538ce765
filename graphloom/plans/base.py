"""Registration of queries with their SQL, and SQL fragments for the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: raw: all mentions; e: first mention of each edge; x: edges with highest confidence.
RAW = """raw AS (
 SELECT 'C' || o_custkey AS source, 'HAS_SYMPTOM' AS rel, 'P' || l_partkey AS target, 1 - l_discount AS confidence, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT 'C' || o_custkey, 'USES_DRUG', 'S' || l_suppkey, 1 - l_discount, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT 'C' || c_custkey, 'BELONGS_TO', 'N' || c_nationkey, 1.0, 0, 0 FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'BELONGS_TO', 'N' || s_nationkey, 1.0, 0, 0 FROM supplier
 UNION ALL SELECT 'N' || n_nationkey, 'PART_OF', 'R' || n_regionkey, 1.0, 0, 0 FROM nation)"""
EDGES = RAW + """, e AS (SELECT source, rel, target, confidence, l_orderkey, l_linenumber FROM (
 SELECT *, row_number() OVER (PARTITION BY source, rel, target ORDER BY l_orderkey, l_linenumber, confidence) AS rn FROM raw) WHERE rn = 1)"""
NODES = """n AS (SELECT 'C' || c_custkey AS id, 'Disease' AS type, c_name AS name FROM customer
 UNION ALL SELECT 'P' || p_partkey, 'Symptom', p_name FROM part UNION ALL SELECT 'S' || s_suppkey, 'Drug', s_name FROM supplier
 UNION ALL SELECT 'N' || n_nationkey, 'Department', n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Category', r_name FROM region)"""
PLACES = """p AS (SELECT 'C' || c_custkey AS source, 'BELONGS_TO' AS rel, 'N' || c_nationkey AS target FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'BELONGS_TO', 'N' || s_nationkey FROM supplier
 UNION ALL SELECT 'N' || n_nationkey, 'PART_OF', 'R' || n_regionkey FROM nation),
 u AS (SELECT DISTINCT source AS node, target AS other FROM p UNION SELECT target, source FROM p)"""
