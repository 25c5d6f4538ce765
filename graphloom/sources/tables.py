"""Readers, and the property graph that the star tables hold.

The graph is two frames: ``nodes(id, type, name)`` and ``edges(source, rel, target,
confidence, seq)``.  Customers stand for diseases, parts for symptoms, suppliers for
drugs and nations for departments; ids are ``<type letter><key>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity of the star tables."""
    kinds = [("customer", "C", "c_custkey", "c_name", "Disease"), ("part", "P", "p_partkey", "p_name", "Symptom"), ("supplier", "S", "s_suppkey", "s_name", "Drug"), ("nation", "N", "n_nationkey", "n_name", "Department"), ("region", "R", "r_regionkey", "r_name", "Category")]
    out = None
    for name, letter, key, label, kind in kinds:
        part = table(spark, sf_dir, name).select(_id(letter, key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mentions: customer, part, supplier, confidence and their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "l_suppkey", (1 - F.col("l_discount")).alias("confidence"), F.struct("l_orderkey", "l_linenumber").alias("seq"))


#: The star tables' edges: relation, table, its two ends as type letter and key.
_PLACES = [("BELONGS_TO", "customer", "C", "c_custkey", "N", "c_nationkey"), ("BELONGS_TO", "supplier", "S", "s_suppkey", "N", "s_nationkey"), ("PART_OF", "nation", "N", "n_nationkey", "R", "n_regionkey")]
_BOUGHT = [("HAS_SYMPTOM", "P", "l_partkey"), ("USES_DRUG", "S", "l_suppkey")]


def raw_edges(spark: SparkSession, sf_dir: str, *rels: str) -> DataFrame:
    """Edge mentions of the relations, all if none is named; repeated ones included.

    Only tables of the named relations are read.  Both edges of a purchase come from one join; a
    single one of them is a plain projection of it.
    """
    kept = [x for x in _BOUGHT if not rels or x[0] in rels]
    out = []
    if kept:
        ends = [F.struct(F.lit(rel).alias("rel"), _id(letter, key).alias("target")) for rel, letter, key in kept]
        edge = F.explode(F.array(*ends)) if len(ends) > 1 else ends[0]
        bought = purchases(spark, sf_dir).select(_id("C", "o_custkey").alias("source"), edge.alias("x"), "confidence", "seq")
        out.append(bought.select("source", "x.rel", "x.target", "confidence", "seq"))
    first = F.struct(F.lit(0).cast("long").alias("l_orderkey"), F.lit(0).alias("l_linenumber"))
    for rel, name, a, ka, b, kb in _PLACES:
        if not rels or rel in rels:
            out.append(table(spark, sf_dir, name).select(_id(a, ka).alias("source"), F.lit(rel).alias("rel"), _id(b, kb).alias("target"), F.lit(1.0).alias("confidence"), first.alias("seq")))
    return reduce(DataFrame.unionByName, out)


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small graph of places: customers and suppliers to nations, nations to regions."""
    return raw_edges(spark, sf_dir, "BELONGS_TO", "PART_OF")
