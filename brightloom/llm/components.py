"""Connected components of a graph given by its edges, without any vertex or component passing through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, few_tasks, written


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours of u (those above it, or the rest) move to the least of them.

    The minimum is combined before its shuffle; the join back has one row for each u on the right, so that Spark can
    split a vertex of many edges over tasks.
    """
    both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.toDF("u", "v")
    low = few_tasks(both.groupBy("u").agg(F.min("v").alias("m")), rows).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = few_tasks(both.join(checkpointed(low), F.col("u") == F.col("w")), 2 * rows)
    if large:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.*").toDF("a", "b")
    return few_tasks(moved.where("a > b").distinct(), rows)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge; label is the least node of its component.

    edges: columns a and b of an orderable type, in any direction, repeats and loops allowed. Alternates large-star
    and small-star steps until nothing changes (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014); rounds grow with the logarithm of the longest path. Only a count and a checksum reach the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, rows = seen, seen[0]
        now = written(_star(checkpointed(_star(few_tasks(now, rows), rows, True)), rows, False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
