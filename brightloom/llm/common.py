"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def named(column: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Only a local session may fall back to a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by way of the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df by way of a Parquet table in the shared checkpoint folder, for loops whose rounds join what they made before.

    A checkpoint keeps the planner's size estimate of df; a join multiplies the estimates of its sides, so their digits
    would double with every round until planning takes longer than the work. A table read has its true size. The
    tables of a loop are small (numbers of linked rows) and are left to the folder's own expiry.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of a few numbers that make a task worth starting.
TASK_ROWS = 50_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df on no more tasks than `rows` rows of a few numbers need; large inputs keep the partitions they have."""
    return df.coalesce(max(4, rows // TASK_ROWS + 1))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that stand for a row in joins on (id, text), as columns k1 and k2; never null.

    Rows that repeat both id and text share a key, which is what the callers want: such rows get the same result.
    """
    return [
        F.xxhash64(named(id_col), named(text_col)).alias("k1"),
        F.xxhash64(F.lit("second"), named(text_col), named(id_col)).alias("k2"),
    ]


def free_name(df: DataFrame, stem: str, also: Iterable[str] = ()) -> str:
    """stem, or stem with underscores before it where df (whatever the case) has such a column."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in also}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def words(text: Column) -> Column:
    """The words of text as an array: empty where there are none, null where text is null."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
