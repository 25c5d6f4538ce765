"""Read-only SQL over a graph's nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def is_query(spark: SparkSession, text: str) -> bool:
    """Whether the text parses to a plan without commands or writes; Spark's own parser decides."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:
        return False
    found = [plan]
    while found:
        node = found.pop()
        if any(k.getSimpleName() in ("Command", "ParsedStatement", "LeafParsedStatement", "UnaryParsedStatement", "InsertIntoStatement") for k in _kinds(node.getClass())):
            return False
        children = node.children()
        found += [children.apply(i) for i in range(children.size())]
    return True


def _kinds(cls) -> list:
    """The class, its ancestors and all their interfaces."""
    out, open_ = [], [cls]
    while open_:
        c = open_.pop()
        if c is not None:
            out.append(c)
            open_ += [c.getSuperclass(), *c.getInterfaces()]
    return out


def run(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """The query's result over the views `nodes` and `edges`; anything but a query is refused."""
    spark = nodes.sparkSession
    if not is_query(spark, text):
        raise ValueError("only read-only queries run here")
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    return spark.sql(text)
