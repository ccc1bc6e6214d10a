"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import checkpoint, release


TASK_EDGES = 1 << 18  # edges (16 bytes each) that one task takes; a graph of no more stays in one partition, which needs no exchange


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node that can be reached. Nodes are bigints.

    Large-star links each node's larger neighbours to its smallest one, small-star the smaller ones and itself; both only need a
    node's minimum, so no task holds a node's neighbours. They alternate until every edge leads to a root, which takes about the
    logarithm of the longest path. Loops and repeated edges are harmless; null ends are left out; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = checkpoint(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    pairs = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    small = pairs.count() <= TASK_EDGES and nodes.count() <= 2 * TASK_EDGES
    dealt = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    while True:
        pairs = dealt(pairs)
        both = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = checkpoint(small.filter("u <> v").distinct())
        # done when all edges lead to roots: every node has one edge, and no node that is led to has one itself
        led_to = pairs.select(F.col("v").alias("_v")).distinct()
        degree = pairs.groupBy("u").agg(F.count("*").alias("_n"))
        if degree.join(led_to, F.col("u") == F.col("_v"), "left").filter("_n > 1 OR _v IS NOT NULL").isEmpty():
            break
    release(edges.sparkSession)
    found, nodes = dealt(pairs).groupBy("u").agg(F.min("v").alias("comp")), dealt(nodes)
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("comp", "node").alias("comp"))
