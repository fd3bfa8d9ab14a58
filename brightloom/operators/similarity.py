"""Content fingerprints of postings and the join of near ones across companies."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from brightloom.functions.text import company_key
from brightloom.operators.dedup import checkpointed, dealt

BITS, MAX_BITS = 64, 5
#: Blocks of a fingerprint, least and most; two that differ in MAX_BITS bits agree on blocks - MAX_BITS of them (24 of 64
#: bits at least). More fingerprints take more blocks: longer keys, so that chance makes one candidate a key at most.
BLOCKS, MOST_BLOCKS = 8, 12
#: Pairs of one key beyond which its fingerprints are told apart by some of their other bits, too, and the parts of those.
HOT_PAIRS, PARTS = 4096, 8
#: Keys of fingerprints that one task takes. Fingerprints are packed so well that Spark would put millions into one.
TASK_KEYS = 500_000
#: Texts with fewer signs after cleaning, or fewer words than a shingle, have no fingerprint.
LEAST_TEXT, WIDTH = 200, 3


def plain_words(text: Column) -> Column:
    """Lower-case words of a description joined by blanks, without tags, entities and urls."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"<[^>]*>|&[a-z#0-9]+;", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"https?://\S+", " "), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(LongType())
def _voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def fold(text: str | None) -> int | None:
        if text is None or len(text) < LEAST_TEXT:
            return None
        raw = text.encode()
        blanks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
        if len(blanks) < WIDTH - 1:
            return None
        # words are joined by single blanks, so a shingle is a piece of the text
        begin = np.concatenate([[0], blanks + 1])[: len(blanks) + 2 - WIDTH].tolist()
        end = np.concatenate([blanks, [len(raw)]])[WIDTH - 1 :].tolist()
        digests = b"".join([sha1(raw[a:b]).digest() for a, b in zip(begin, end)])
        first = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 20)[:, :8]
        votes = np.unpackbits(first, axis=1).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * votes > len(first)).tobytes(), "big", signed=True)

    for texts in batches:
        yield pd.Series([fold(t) for t in texts], dtype="Int64")


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint): 64-bit vote over the first 8 bytes of the SHA-1 of every shingle of three words.

    A bit is set if more shingles have it than not. Texts of under 200 signs without tags, entities and urls, or of
    under three words, tell nothing and are left out. Texts are cleaned in the JVM and folded in Arrow batches, row by
    row and without a shuffle.
    """
    # nondeterministic: or Spark would push the filter below the fold and do it twice
    voted = _voted.asNondeterministic()
    return df.select(key, voted(plain_words(F.col(text))).alias("fingerprint")).where("fingerprint IS NOT NULL")


def _masks(bits: list[int], parts: int, size: int) -> list[int]:
    """One mask for each choice of `size` of the parts that bits are cut into."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    each = [sum(1 << x for x in bits[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(each, size)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The least number of blocks whose keys have a value for each of n fingerprints; MOST_BLOCKS at most."""
    return next((b for b in range(BLOCKS, MOST_BLOCKS) if n <= 1 << BITS * (b - max_bits) // b), MOST_BLOCKS)


def candidate_pairs(left: DataFrame, right: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(fa, fb, choice): unequal fingerprints (distinct, column fp) of left and right that agree on a choice of blocks that those
    within max_bits can't help sharing.

    A choice's key whose fingerprints would make over hot_pairs pairs is no key by itself: the bits that it leaves free are
    cut into PARTS parts, of which those within max_bits share PARTS - max_bits too, and these make the key longer.
    """
    if max_bits >= min(blocks, PARTS):
        raise ValueError("max_bits must be under the number of blocks and parts")
    masks = _masks(list(range(BITS)), blocks, blocks - max_bits)
    keys = F.inline(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)]))
    tasks = -(-max(left.count(), right.count()) * len(masks) // TASK_KEYS) or 1  # rounded up
    # dealt before the keys are made as well as by them, so that no task holds more than its share
    a, b = (df.select("fp").repartition(tasks, "fp").select("fp", keys).repartition(tasks, "choice", "value") for df in (left, right))
    tally = lambda df, n, m: df.groupBy("choice", "value").agg(F.count("*").alias(n)).withColumn(m, F.lit(0).cast("long"))
    sizes = tally(a, "na", "nb").unionByName(tally(b, "nb", "na")).groupBy("choice", "value").agg((F.sum("na") * F.sum("nb")).alias("pairs"), F.greatest(F.sum("na"), F.sum("nb")).alias("n"))
    counted = checkpointed(sizes.where(F.col("pairs") > hot_pairs).select("choice", "value", "n"))
    hot = counted.select("choice", "value")
    cold = lambda df: df.join(hot, ["choice", "value"], "left_anti")
    pairs = cold(a).withColumnRenamed("fp", "fa").join(dealt(cold(b).withColumnRenamed("fp", "fb")), ["choice", "value"]).where("fa <> fb").select("fa", "fb", "choice")
    met = counted.agg(F.sum("n")).first()[0]
    if met is None:
        return pairs
    free = [(i, _signed(m | more)) for i, m in enumerate(masks) for more in _masks([x for x in range(BITS) if not m >> x & 1], PARTS, PARTS - max_bits)]
    longer = F.broadcast(left.sparkSession.createDataFrame(free, "choice int, mask long"))  # as many rows as blocks and PARTS allow
    split = lambda df: df.join(hot, ["choice", "value"]).join(longer, "choice").select("fp", "choice", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    each = -(-met * len(free) // len(masks) // TASK_KEYS) or 1
    spread = lambda df: df.repartition(each, "choice", "mask", "value")
    more = spread(split(a)).withColumnRenamed("fp", "fa").join(dealt(spread(split(b)).withColumnRenamed("fp", "fb")), ["choice", "mask", "value"]).where("fa <> fb").select("fa", "fb", "choice")
    return pairs.union(more)


def near_fingerprints(left: DataFrame, right: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(fa, fb, distance): all distinct pairs of fingerprints (column fp, distinct) that differ in max_bits bits or fewer."""
    blocks = blocks or blocks_for(max(left.count(), right.count()), max_bits)
    distance = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    met = candidate_pairs(left, right, max_bits, blocks, hot_pairs)
    equal = left.join(right, "fp").select(F.col("fp").alias("fa"), F.col("fp").alias("fb"), F.lit(0).alias("distance"))
    return met.where(distance <= max_bits).select("fa", "fb", distance.alias("distance")).distinct().union(equal)


def cross_listings(new: DataFrame, seen: DataFrame, days: int = 90, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, other_id, distance): rows of seen of another company and url, at most `days` older, whose fingerprint
    differs in max_bits bits or fewer.

    Columns: id, company, url, fingerprint, seen_at; both tables are read several times, so hand over tables or checkpoints,
    not plans that make fingerprints. Near distinct fingerprints are found first; ids and companies join on to what is
    near. Rows that repeat a fingerprint make all their pairs here: near_fingerprints has one for each pair of texts.
    """
    distinct = lambda df: df.where("fingerprint IS NOT NULL").select(F.col("fingerprint").alias("fp")).distinct()
    near = near_fingerprints(checkpointed(distinct(new)), checkpointed(distinct(seen)), max_bits)
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("id", "url", "fingerprint", "seen_at")], company_key(F.col("company")).alias(p + "key"))
    a, b = side(new, "a_"), side(seen, "b_")
    met = a.join(near, F.col("a_fingerprint") == F.col("fa")).join(b, F.col("fb") == F.col("b_fingerprint"))
    age = F.datediff("a_seen_at", "b_seen_at")
    return met.where((F.col("a_key") != F.col("b_key")) & ~F.col("a_url").eqNullSafe(F.col("b_url")) & age.between(0, days)).select(
        F.col("a_id").alias("id"), F.col("b_id").alias("other_id"), "distance"
    )
