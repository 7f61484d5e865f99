"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import cut, look_up, tasks_for

#: With a node of more neighbours than this, joins are dealt by node and a salt of the neighbour.
HOT_NODE = 1000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the smallest node that it reaches.

    Alternates two rounds until only stars are left: every node hands its larger neighbours to its smallest
    one, then its smaller ones (Kiveris et al. 2014, large star and small star). Each round is a window over the node's
    neighbours, or where a node has many, a min-aggregation and a salted join, so no large neighbourhood is gathered in one
    task; only the number of edges, the largest degree and whether more is to do go to the driver.

    Null ends, loops and repeated edges add nothing; nodes that only have loops are not returned.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.filter("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct())
    while True:
        # A forest of stars is done: each node has one edge to a smaller one, or is what others lead to.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(
            F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("degree")
        )
        found = ends.agg(
            F.sum("up").alias("edges"), F.max((F.col("up") + F.col("down") > 1).cast("int")).alias("more"), F.max("degree").alias("degree")
        ).first()
        tasks = tasks_for(found["edges"] or 0)
        edges = edges.coalesce(tasks)
        if not found["more"]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = found["degree"] > HOT_NODE
        joined = _with_least(both, hot, tasks).withColumn("m", F.least("u", "m"))
        large = joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.coalesce(tasks).distinct().coalesce(tasks))
        joined = _with_least(large, hot, tasks)
        small = joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = cut(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)


def _with_least(edges: DataFrame, hot: bool, tasks: int) -> DataFrame:
    """``edges`` (u, v) with the least v of each u as m."""
    if hot:
        return look_up(edges, edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "u", "v")
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u"))).coalesce(tasks)
