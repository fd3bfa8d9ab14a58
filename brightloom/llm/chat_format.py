"""Chat formatting after a cumulative-snapshot collapse.

A chat that is logged again after every turn leaves snapshots that prefix one another. A rolling hash over the turns
gives every prefix of every conversation a name; a conversation whose whole is the proper prefix of another is dropped
by an anti-join, and of equal conversations the one of least id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, read_table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hashes() -> list[Column]:
    """128 bits of a turn; a null role or text counts as different from an empty one."""
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit("second"), *parts).alias("r2")]


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, copies): conversations that prefix no longer one; copies counts the equal ones it stands for.

    turns: columns conv, turn, role, text. A window sorts the turns of one conversation in one task; Spark spills it.
    """
    hashed = turns.select("conv", "turn", "role", "text", *_turn_hashes()).dropDuplicates(["conv", "turn", "r1", "r2"])
    inside = W.partitionBy("conv")
    order = inside.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    placed = hashed.select("conv", "r1", "r2", F.row_number().over(order).alias("pos"), F.count("*").over(inside).alias("n"), "turn", "role", "text")
    # the hash of a prefix: exclusive or of its turns, each hashed with its place
    rolled = placed.select(
        "conv", "pos", "n",
        F.bit_xor(F.xxhash64("pos", "r1", "r2")).over(so_far).alias("p1"),
        F.bit_xor(F.xxhash64("r2", "pos", "r1")).over(so_far).alias("p2"),
    )
    whole = rolled.where("pos = n").groupBy("p1", "p2", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    longer = rolled.where("pos < n").select("p1", "p2", F.col("pos").cast("long").alias("n")).distinct()
    return whole.join(longer, ["p1", "p2", "n"], "left_anti").select("conv", F.col("n").alias("n_turns"), "copies")


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", start: str = OPEN, end: str = CLOSE
) -> DataFrame:
    """(conv, n_turns, copies, chat) for every maximal conversation of rows.

    Turns are taken by turn, then role, then text by code point, each with null first, whatever the order of the rows; a
    turn that is logged twice alike counts once. Texts are taken whole, whatever their length. Null roles and
    texts are rendered as empty. Rows without a conversation belong to none and give nothing. Of conversations that
    are equal turn by turn the least id stays. Other columns are not read; an empty table gives an empty result.
    """
    turns = rows.select(*[F.col(f"`{c}`").alias(a) for c, a in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))]).where("conv IS NOT NULL")
    kept = checkpointed(maximal_conversations(turns))
    one = F.struct("turn", "role", "text")
    told = turns.join(kept, "conv").groupBy("conv", "n_turns", "copies").agg(F.array_sort(F.collect_set(one)).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(end + "\n")))
    return told.select("conv", "n_turns", "copies", F.array_join(said, "").alias("chat"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chats(read_table(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "n_turns", "copies", F.sha2(F.col("chat"), 256).alias("chat_sha256"))


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {
    "op1_chat_format": f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, count(*) AS n, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said,
         string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat
  FROM turns GROUP BY 1),
pre AS (SELECT DISTINCT said[:k] AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM conv))
SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS copies, sha256(any_value(chat)) AS chat_sha256
FROM conv WHERE said NOT IN (SELECT said FROM pre) GROUP BY said"""
}
