"""Consecutive numbers in a global order, without one task that holds a whole owner or table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.operators.dedup import checkpointed


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with name: the place from 1 of each row among those of its keys, in order (which must be total).

    Rows are dealt to range partitions and numbered inside them; what earlier partitions hold of a key is added. One
    row for each key and partition is summed in one place, and none of the data.
    """
    ranged = checkpointed(df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(starts, same).select(*df.columns, (F.col(name) + F.col("_start")).alias(name))
