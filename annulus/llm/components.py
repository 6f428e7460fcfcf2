"""Connected components of a link table by randomised contraction.

Each round gives every node the link partner of least random priority (itself, if it has the least), replaces
both ends of every link by these and drops loops and repeats. The number of nodes falls by a constant factor a
round whatever the shape, hubs and chains included. Only group minima and equi-joins are used: minima combine
before the shuffle, and each join shuffles both sides, so that adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.common import Scratch


def connected_components(spark: SparkSession, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``links(a long, b long)`` -> ``(node long, component long)``, the component being its smallest node.

    Links with a null end and loops are ignored; direction and repeats don't matter; nodes without a link to
    another node are absent from the result; no links give an empty result.
    """
    scratch = Scratch(spark, "components")
    both = links.where("a <> b").select("a", "b")
    edges = scratch.keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges0")
    labels, done = None, 0
    for done in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(done)).alias("p"), F.col(c).alias("v"))  # noqa: E731, B023
        to = edges.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a")).getField("v").alias("up"))
        to = scratch.keep(to, f"to{done}")
        moved = edges.join(to.withColumnRenamed("node", "a"), "a").select(F.col("up").alias("x"), "b")
        moved = moved.join(to.withColumnsRenamed({"node": "b", "up": "y"}), "b").where("x <> y")
        following = scratch.keep(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"edges{done + 1}")
        if labels is None:
            grown = to.withColumnRenamed("up", "root")
        else:
            grown = labels.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        previous, labels = done - 1, scratch.keep(grown, f"labels{done}")
        scratch.drop(f"edges{done}", f"to{done}", *([f"labels{previous}"] if previous >= 0 else []))
        edges = following
    else:
        raise RuntimeError(f"links remain after {max_rounds} rounds of contraction")
    scratch.drop(f"edges{done}")
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    least = scratch.keep(labels.groupBy("root").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "root").select("node", "component")
