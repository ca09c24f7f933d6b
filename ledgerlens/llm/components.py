"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate and a join on node ids; the links between steps are
written to the shared checkpoint folder.  Ends when a round leaves the links as
they are; then each node is linked to the smallest node it can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of each node's neighbours (large: greater ones, of all; else not greater) to its least neighbour, written.

    The least neighbour of a node counts the node itself.  Nodes with a large share of all
    links join apart (``common.meet``).
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = C.keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")), "link-least")
    joined = C.meet(both, least, ["u"], links.count() * (2 if large else 1))
    if large:  # neighbours above u go to the least
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # links point down here: the node and all its neighbours go to the least
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return C.keep(out.filter("a <> b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node it reaches) of all nodes of links (a, b long); isolated nodes are absent."""
    cur = C.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = print_of(cur)
    while before[0]:
        cur = _star(_star(cur, True), False)
        now = print_of(cur)
        if now == before:
            break
        before = now
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
