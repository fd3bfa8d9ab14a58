"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id. A source that shall give `target` words takes whole passes over its documents and
then those whose hash lies under a threshold. Thresholds are found without sorting documents: sum the words by source
and hash bucket, find the bucket in which the budget ends, and look into that bucket alone with the next bits of the
hash. The budgets of the passes share one hash, so their thresholds are nested: what a small budget takes, a larger one
takes too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, free_name, named, read_table, word_count

HASH_BITS, STEP = 60, 12
#: Sources up to this number are broadcast (under 10 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def unit_hash(key: Column) -> Column:
    """60 bits of the MD5 of key as text; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Each source with its weight, by its place in code point order (null last), without one task that sees them all."""
    order = [F.col("src").isNull(), F.col("src")]
    dealt = checkpointed(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    return dealt.join(F.broadcast(starts), "part").select("src", "source_size", F.get(wheel, (place % len(weights)).cast("int")).alias("w"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, most: int = 2) -> DataFrame:
    """(src, source_size, target) from rows (src, size).

    Sources share ratio times all sizes by weight; a target stops at `most` times its source's size and the excess is
    shared among the others by weight, until none is above. Each round is one aggregate of three numbers.
    """
    known = checkpointed(_ranked(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), weights))
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * ratio
    cap, level = F.col("source_size") * float(most), 0.0
    while True:
        full = F.when(cap <= F.col("w") * level, True).otherwise(False)
        used, rest = known.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        raised = (total - used) / rest if rest else level
        if raised <= level:
            break
        level = raised
    return known.select("src", "source_size", F.least(cap, F.col("w") * level).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def budget_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(src, pass, threshold): documents of src whose hash is under the threshold come nearest to the budget.

    sized: (src, size, h); budgets: (src, pass, budget). One histogram for each STEP bits; each looks only into the
    bucket in which a budget ends. Documents of one hash are taken together or not at all.
    """
    n = budgets.count()
    ends = budgets.select("src", "pass", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"))
    done = None
    for low in range(HASH_BITS - STEP, -1, -STEP):
        at = F.shiftright("h", low + STEP)
        inside = sized.select(F.col("src").alias("s"), "size", at.alias("p"), F.shiftright("h", low).alias("bucket"))
        e = _small(ends.select("src", "pass", "prefix"), n)
        hist = (
            inside.join(e, inside["s"].eqNullSafe(e["src"]) & (inside["p"] == e["prefix"]))
            .groupBy("src", "pass", "bucket")
            .agg(F.sum("size").alias("words"))
        )
        w = W.partitionBy("src", "pass").orderBy("bucket")  # 2 ** STEP rows at most
        grown = hist.withColumn("through", F.sum("words").over(w))
        e = _small(ends.select(F.col("src").alias("s"), F.col("pass").alias("q"), "budget", "before"), n)
        placed = grown.join(e, grown["src"].eqNullSafe(e["s"]) & (grown["pass"] == e["q"]))
        over = placed.where(F.col("before") + F.col("through") > F.col("budget"))
        ends_next = checkpointed(
            over.groupBy("src", "pass", "budget").agg(F.min_by(F.struct("bucket", "words", (F.col("before") + F.col("through") - F.col("words")).alias("before")), "bucket").alias("x"))
            .select("src", "pass", "budget", F.col("x.bucket").alias("prefix"), F.col("x.before").alias("before"), F.col("x.words").alias("words"))
        )
        done = ends_next
        ends = ends_next.select("src", "pass", "budget", "prefix", "before")
    nearer = 2 * F.col("before") + F.col("words") <= 2 * F.col("budget")
    return done.select("src", "pass", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    ratio: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted).

    Those four replace columns of docs with such names, whatever their case. Null texts have size 0 and are taken 0
    words; a null source is a source. Rows that repeat an id are taken alike. An empty table gives an empty result.
    """
    size, h = word_count(named(text_col)), unit_hash(named(id_col))
    sized = checkpointed(docs.select(named(source_col).alias("src"), size.alias("size"), h.alias("h")))
    targets = checkpointed(source_targets(sized, weights, ratio, most))
    left = F.col("target") - F.col("pass") * F.col("source_size")
    budgets = targets.select("src", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    budgets = checkpointed(budgets.where(left > 0).select("src", "pass", F.least(left, F.col("source_size")).cast("double").alias("budget")))
    found = budget_thresholds(sized, budgets)
    every = 1 << HASH_BITS
    limits = (
        budgets.join(found.toDF("s", "q", "threshold"), budgets["src"].eqNullSafe(F.col("s")) & (budgets["pass"] == F.col("q")), "left")
        .groupBy("src")
        .agg(F.collect_list(F.coalesce("threshold", F.lit(every))).alias("thresholds"))
    )
    own = free_name(docs, "_plan")
    plan = targets.join(limits.withColumnRenamed("src", "s"), targets["src"].eqNullSafe(F.col("s")), "left").select(
        F.struct(F.col("src").alias("src"), "source_size", "target", F.coalesce("thresholds", F.array().cast("array<bigint>")).alias("thresholds")).alias(own)
    )
    plan = checkpointed(plan)
    wide = docs.join(_small(plan, plan.count()), named(source_col).eqNullSafe(F.col(f"{own}.src")))
    times = F.size(F.filter(f"{own}.thresholds", lambda t: t > h))
    new = {"size": size, "source_size": F.col(f"{own}.source_size"), "target": F.col(f"{own}.target"), "taken": size * times}
    old = [named(c) for c in docs.columns if c.lower() not in new]
    return wide.select(*old, *[c.alias(name) for name, c in new.items()])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB SQL for mix_sources over the relation docs; columns: those of docs to return."""
    return rf"""
WITH sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size_,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h_
  FROM {docs}),
src AS (
  SELECT source, sum(size_)::BIGINT AS source_size_,
         [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w
  FROM sized GROUP BY source),
fill AS (
  SELECT *, ((SELECT sum(source_size_) FROM src) * 1.5::DOUBLE - coalesce(sum(source_size_ * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM src WINDOW o AS (ORDER BY source_size_ * 2.0::DOUBLE / w, source NULLS LAST)),
targets AS (
  SELECT source, source_size_, least(source_size_ * 2.0::DOUBLE, w * (SELECT max(lvl) FROM fill)) AS target_
  FROM fill),
hashes AS (SELECT source, h_, sum(size_) AS g FROM sized GROUP BY ALL),
cums AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY h_) - g AS before FROM hashes),
times AS (
  SELECT c.source, c.h_, t.source_size_, t.target_,
         (SELECT count(*) FROM range(2) p(i)
          WHERE t.target_ - i * t.source_size_ > 0 AND 2 * c.before + c.g <= 2 * least(t.target_ - i * t.source_size_, t.source_size_)) AS n
  FROM cums c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source)
SELECT {columns}, size_ AS size, source_size_ AS source_size, target_ AS target, (size_ * n)::BIGINT AS taken
FROM sized s JOIN times x ON s.source IS NOT DISTINCT FROM x.source AND s.h_ = x.h_"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": mix_sql("documents", "doc_id")}
