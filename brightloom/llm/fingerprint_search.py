"""Document fingerprints: SimHash over weighted terms, searched through permuted block tables.

Terms are words and pairs of consecutive words. Each term's 128-bit hash votes on every bit, for or against, with the
term's weight; the signs of the sums are the fingerprint. Bits differ with probability angle / pi, so the share of
differing bits estimates the cosine of two texts' term vectors.

To find all fingerprints within a radius, the bits are cut into blocks. Each choice of blocks - radius blocks is a table
in which these blocks come first; two fingerprints within the radius agree on the blocks of at least one table (Manku,
Jain and Das Sarma, "Detecting Near-Duplicates for Web Crawling", 2007). A table is a join key here; what shares a key is
verified by its Hamming distance, and a pair counts in the first table that it shares. A key that many fingerprints
share is cut into cells of CELL, so that no task takes a whole one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.llm.common import named, read_table, written

BITS, RADIUS, BLOCKS = 128, 3, 4
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Fingerprints of one key in one cell. It bounds a row, not what is found.
CELL = 2048


class Digests(dict):
    """Word to its 128-bit hash; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_128_digest(word)
        return found


_DIGESTS = Digests()


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their words, both as (n, 2) arrays of unsigned 64-bit numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None) -> bytes:
    """16 bytes; zeros where text has no word. A-Z are lower-cased.

    A term's weight is damped by the logarithm of its times and double for pairs. Weights are whole numbers, so that sums
    don't depend on their order.
    """
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return bytes(BITS // 8)
    words = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, found)), dtype=np.uint64).reshape(-1, 2)
    votes, total = np.zeros(BITS), 0.0
    for hashes, factor in ((words, 1), (pair_hashes(words[:-1], words[1:]), 2)):
        _, first, times = np.unique(hashes[:, 0], return_index=True, return_counts=True)
        weights = (factor * np.rint(16 * (1 + np.log(times)))).astype(np.float32)
        total += float(weights.sum(dtype=np.float64))
        for at in range(0, len(first), 1 << 12):  # a very long text needs no more memory than this for its bits
            bits = np.unpackbits(np.ascontiguousarray(hashes[first[at : at + (1 << 12)]]).view(np.uint8), axis=1)
            votes += weights[at : at + (1 << 12)] @ bits.astype(np.float32)  # under 2 ** 24, so exact
    return np.packbits(2 * votes > total).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated cosine of the term vectors behind two fingerprints, 0 to 1."""
    return max(0.0, math.cos(math.pi * (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS))


def _halves(fp: Column) -> list[Column]:
    """fp (binary) as two longs."""
    return [F.conv(F.hex(F.substring(fp, at, 8)), 16, -10).cast("long").alias(name) for at, name in ((1, "hi"), (9, "lo"))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row, fp as 16 bytes. Null and empty texts and texts without words have zeros; null ids and rows
    that repeat are kept; texts are read whole; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.binary())], ["id", "fp"])

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(high, low) masks, as signed longs, of the leading blocks of each table."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than blocks")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in (sum(c) for c in combinations(parts, blocks - radius))]


def near_counts(index: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """(fp, n_near) for each fingerprint of queries: how many rows of index lie within radius differing bits.

    index, queries: fp as 16 bytes; fingerprints may repeat (each row of index counts), null ones are left out. Equal ones
    are merged before anything is joined. A query that nothing is near has no row.
    """
    tables = block_tables(radius, blocks)

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        leading = F.array(*[F.struct(F.col("hi").bitwiseAND(F.lit(h)).alias("a"), F.col("lo").bitwiseAND(F.lit(x)).alias("b")) for h, x in tables])
        return df.select("hi", "lo", *more, F.posexplode(leading).alias("t", "k")).select("t", "k.*", "hi", "lo", *more)

    key = ["t", "a", "b"]
    asked = written(queries.where("fp IS NOT NULL").select(*_halves(F.col("fp"))).distinct())
    given = index.where("fp IS NOT NULL").select(*_halves(F.col("fp"))).groupBy("hi", "lo").agg(F.count("*").alias("n"))
    wanted = keyed(asked)
    met = written(keyed(given, "n").join(wanted.select(*key).distinct(), key, "left_semi"))
    sizes = met.groupBy(*key).agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    cells = met.join(sizes, key).groupBy(*key, F.pmod(F.xxhash64("hi", "lo"), F.col("cells")).alias("cell")).agg(F.collect_list(F.struct("hi", "lo", "n")).alias("all"))

    def within(x: Column) -> Column:
        hi, lo = x["hi"].bitwiseXOR(F.col("hi")), x["lo"].bitwiseXOR(F.col("lo"))
        first = F.lit(True)
        for i, (h, low) in enumerate(tables[:-1]):  # shares none of the tables before
            first = first & ((F.col("t") <= i) | (hi.bitwiseAND(F.lit(h)) != 0) | (lo.bitwiseAND(F.lit(low)) != 0))
        return (F.bit_count(hi) + F.bit_count(lo) <= radius) & first

    total = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + F.when(within(x), x["n"]).otherwise(0))
    found = wanted.join(cells, key).select("hi", "lo", total.alias("n")).groupBy("hi", "lo").agg(F.sum("n").alias("n_near")).where("n_near > 0")
    text = lambda c: F.lpad(F.hex(c), 16, "0")
    return found.select(F.unhex(F.concat(text("hi"), text("lo"))).alias("fp"), "n_near")


def edited_text(text: str | None, following: str | None) -> str:
    """text with its last third of code points replaced by the first as many (or all) of the following text."""
    text = text or ""
    third = len(text) // 3
    return text[: len(text) - third] + (following or "")[:third]


_PAIRED = "part int, head boolean, tail boolean, text string, id {}, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def _judged(text: str | None, fp: bytes, following: str | None, following_fp: bytes) -> tuple[int, str, bytes, bytes, float, float]:
    edited = edited_text(text, following)
    edited_fp = fingerprint(edited)
    return len(text or ""), hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, following_fp)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) for every row: its fingerprint against that of
    its edited_text and of the next document, in descending id; after the last comes the first.

    Rows are dealt to range partitions of the id and read in order; only the first and last row of each partition travel
    once more, to meet across the border. Null ids come last. Rows that repeat an id follow each other by descending text,
    null last; equal rows in any order, which makes no difference. A table of one row is its own next. Null texts are
    empty. Texts are read whole, one pair at a time. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    schema = _PAIRED.format(kind)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, first = None, True
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = []
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                fp = fingerprint(text)
                if last is not None:
                    # the first row of a partition is the next of another's last
                    rows.append((last[0], (part, first, False, last[1] if first else None), _judged(last[1], last[2], text, fp)))
                    first = False
                last = (ids.slice(at, 1), text, fp)
            if rows:
                yield _batch(rows, names)
        if last is not None:
            rows = [(last[0], (part, first, True, last[1]), (len(last[1] or ""), None, last[2], None, None, None))]
            yield _batch(rows, names)

    ranged = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).repartitionByRange(F.col("id").desc_nulls_last())
    ranged = written(ranged.sortWithinPartitions(F.col("id").desc_nulls_last(), F.col("text").desc_nulls_last()).mapInArrow(run, schema))
    heads = ranged.where("head").select("part", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    # a row for each partition, and none of the texts
    parts = ranged.where("tail").select("part").withColumn("next_part", F.lead("part").over(W.orderBy("part")))
    least = ranged.where("tail").agg(F.min("part").alias("least"))
    parts = parts.join(F.broadcast(least)).select("part", F.coalesce("next_part", "least").alias("next_part"))
    borders = ranged.where("tail").join(parts, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "fp", "next_text", "next_fp")
    done = names[4:]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column(0).slice(at, 1), (), _judged(*(batch.column(c)[at].as_py() for c in range(1, 5)))) for at in range(batch.num_rows)]
            if rows:
                yield _batch(rows, done)

    met = borders.select("id", "text", "fp", "next_text", "next_fp").mapInArrow(meet, schema.partition("text string, ")[2])
    return ranged.where("NOT tail").select(*done).union(met)


_KINDS = {"part": pa.int32(), "head": pa.bool_(), "tail": pa.bool_(), "text": pa.string(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fp": pa.binary(), "edited_fp": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """rows: (id as an array of one, what stands before the id, what stands after it)."""
    before, after = names[: names.index("id")], names[names.index("id") + 1 :]
    left = [pa.array([r[1][i] for r in rows], _KINDS[c]) for i, c in enumerate(before)]
    right = [pa.array([r[2][i] for r in rows], _KINDS[c]) for i, c in enumerate(after)]
    return pa.RecordBatch.from_arrays([*left, pa.concat_arrays([r[0] for r in rows]), *right], names)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds n_near: for ids divisible by 50, how many other documents have a fingerprint within RADIUS bits; else null."""
    found = written(edit_probe(read_table(spark, sf_dir, "documents")))
    asked = F.col("id") % 50 == 0
    near = near_counts(found.select("fp"), found.where(asked).select("fp")).withColumnRenamed("fp", "near_fp")
    shown = lambda c: F.lower(F.hex(c))
    found = found.where(asked).join(near, F.col("fp") == F.col("near_fp"), "left").drop("near_fp").withColumn("n_near", F.coalesce("n_near", F.lit(1)) - 1).union(
        found.where((F.col("id") % 50 != 0) | F.col("id").isNull()).withColumn("n_near", F.lit(None).cast("long"))
    )
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near"
    )


QUERIES = {"op12_fingerprints": op12_fingerprints}
ORACLES: dict[str, str] = {}
