"""Near-duplicate removal by SimHash: long fingerprints propose pairs, the exact Jaccard similarity of shingle sets decides.

Texts of equal shingle sets are one node. Its fingerprint is the SimHash of its distinct word shingles in LANES lanes of 64
bits. Two texts of Jaccard similarity s differ in a bit with probability p = arccos(2s / (1 + s)) / pi, 0.15 at 0.8: too
often for few keys that select by themselves. So a node has many short keys, and they are not what selects:

* a key is a choice of bits of all lanes but the first, as many as leave some OCCUPANCY unlike nodes with one value; there
  are as many keys as let a pair of the similarity miss all of them with probability MISS. Keys grow with the number
  of nodes to the power of 0.24, at 0.8;
* nodes of a key are compared in the first lane, which travels with the key: 0.2 % of unlike pairs pass at 0.8;
* what passes is compared in all lanes, and then exactly.

A node is first held against the one of its candidates that has the most itself. Pairs which that links are not looked at again,
so many copies of one text cost few comparisons. Keys of over GROUP nodes are linked by hubs and an exact search (minhash.py).
Links are followed to connected components by star steps (components.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, named, row_key, written
from brightloom.llm.components import component_labels
from brightloom.llm.minhash import linked_labels, row_components, shingle_hashes, shingle_sets, similar_pairs, without_copies
from brightloom.llm.simhash import BITS, _lanes

LANES = 16
#: Unlike nodes that share a key on average, at most.
OCCUPANCY = 16
#: Nodes of one key that are compared pair by pair. It decides how a group is linked, never whether.
GROUP = 64
#: Share of pairs at the similarity that no key proposes.
MISS = 0.001
#: Standard deviations by which a pair may differ in more bits than expected.
SLACK = 3.7
#: Shingles up to which bits of a pair differ more often than in longer texts, and by how much at most.
FEW, FEW_FACTOR = 32, 1.27


def bit_distance(similarity: float) -> float:
    """Share of bits in which long texts of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_apart(similarity: float, bits: int) -> int:
    """Bits of so many in which a pair of the similarity may differ."""
    p = bit_distance(similarity)
    return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES signed words: the bits that most of the distinct, sorted hashes have; the least hash decides ties."""
    if not len(hashes):
        return np.zeros(LANES, dtype=np.int64)
    votes, least = np.zeros(BITS * LANES, dtype=np.int64), None
    for at in range(0, len(hashes), 255):  # bytes hold the votes of so many
        bits = np.unpackbits(np.ascontiguousarray(_lanes(hashes[at : at + 255], LANES)).view(np.uint8), axis=1, bitorder="little")
        least = bits[0] if least is None else least
        votes += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes + least > len(hashes), bitorder="little").view(np.int64)


def key_plan(nodes: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a key, keys, keys of nodes of FEW shingles or fewer) for so many nodes."""
    bits = max(8, math.ceil(math.log2(max(nodes, 1) / OCCUPANCY)))
    share = lambda p: max(1e-9, (1 - p) ** bits)
    keys = [math.ceil(math.log(MISS) / math.log1p(-min(share(bit_distance(similarity) * f), 1 - 1e-9))) for f in (1, FEW_FACTOR)]
    return bits, *keys


def key_bits(bits: int, keys: int) -> np.ndarray:
    """(keys, bits): the fingerprint's bits of each key; all are used before one is used again."""
    rng, each = np.random.default_rng(5), (LANES - 1) * BITS // bits
    rounds = [rng.permutation((LANES - 1) * BITS)[: each * bits].reshape(each, bits) for _ in range(-(-keys // each))]
    return np.concatenate(rounds)[:keys] + BITS


def fingerprinted(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(k1, k2, id, h1, h2, size, fps) for every row: h1 and h2 stand for the shingle set, size is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, fps = [], [], []
            for t in batch.column(3):
                hashes = shingle_hashes(t.as_py(), width)
                names.append(np.frombuffer(xxhash.xxh128_digest(hashes.tobytes()), dtype=np.int64).tolist())
                sizes.append(len(hashes))
                fps.append(long_fingerprint(hashes).tolist())
            h1, h2 = (pa.array([n[i] for n in names], pa.int64()) for i in (0, 1))
            columns = [*batch.columns[:3], h1, h2, pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "id", "h1", "h2", "size", "fps"])

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(*row_key(id_col, text_col), named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, f"k1 long, k2 long, id {kind}, h1 long, h2 long, size long, fps array<bigint>")


def keyed_nodes(nodes: DataFrame, count: int, similarity: float) -> DataFrame:
    """(g, x, s): keys of nodes (v, size, fps) with the node's number and first lane."""
    bits, many, most = key_plan(count, similarity)
    at, weights = key_bits(bits, most), np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, len(whole), 1000):
                batch = whole.slice(part, 1000)
                words = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, LANES)
                found = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
                values = np.stack([found[:, key] @ weights for key in at], axis=1) * most + np.arange(most)
                some = np.where(batch.column(1).to_numpy() <= FEW, most, many)
                keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some)]).astype(np.int32), values[np.arange(most) < some[:, None]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words[:, 0]), keys], ["x", "s", "keys"])

    rows = nodes.select(F.col("v.h1").alias("x"), "size", "fps").mapInArrow(run, "x long, s long, keys array<bigint>")
    return rows.select(F.explode("keys").alias("g"), "x", "s")


def candidates(keyed: DataFrame, similarity: float, group: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) that share a key and are near in the first lane; and rows (g, x, n) of keys of over group nodes."""
    met = keyed.withColumn("n", F.count("*").over(W.partitionBy("g")))
    cold = met.where((F.col("n") > 1) & (F.col("n") <= group))
    other = cold.select(F.col("g").alias("h"), F.col("x").alias("y"), F.col("s").alias("t"))
    near = F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= bits_apart(similarity, BITS)
    pairs = cold.hint("merge").join(other, (F.col("g") == F.col("h")) & (F.col("x") > F.col("y")) & near)
    pairs = pairs.select("x", "y").distinct().select(F.lit(None).cast("long").alias("g"), "x", "y", F.lit(None).cast("long").alias("n"))
    hot = met.where(F.col("n") > group).select("g", "x", F.col("s").alias("y"), "n")
    found = written(pairs.union(hot))  # in one job, and s in both, so that the keys are shuffled once
    return found.where("g IS NULL").select("x", "y"), found.where("g IS NOT NULL").select("g", "x", "n")


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs (x, y) of nodes whose sizes and lanes allow the similarity."""
    side = lambda x, v, s, f: nodes.select(F.col("v.h1").alias(x), F.col("v").alias(v), F.col("size").alias(s), F.col("fps").alias(f))
    met = pairs.join(side("x", "a", "na", "fa"), "x").where("na > 0").join(side("y", "b", "nb", "fb"), "y")
    apart = sum((F.bit_count(F.get("fa", F.lit(i)).bitwiseXOR(F.get("fb", F.lit(i)))) for i in range(LANES)), F.lit(0))
    sized: Column = F.least("na", "nb") >= F.greatest("na", "nb") * (similarity - 1e-9)
    # short texts differ in more bits; exact sets decide
    far = F.when(F.greatest("na", "nb") <= FEW, BITS * LANES).otherwise(bits_apart(similarity, BITS * LANES))
    return met.where(sized & (apart <= far)).select("a", "b")


def near_labels(docs: DataFrame, nodes: DataFrame, count: int, id_col: str, text_col: str, width: int, similarity: float, group: int = GROUP) -> DataFrame:
    """(node, label) of the components of the pairs of nodes that fingerprints propose and that have the Jaccard similarity.

    nodes, which are count: v, size, fps, and the row_key of one of its rows.
    """
    pairs, hot = candidates(keyed_nodes(nodes, count, similarity), similarity, group)
    pairs = written(_likely(pairs, nodes, similarity))
    hot = hot.join(nodes.select(F.col("v.h1").alias("x"), "v"), "x").select("g", "v", "n")
    sets = written(shingle_sets(docs, _of(nodes, pairs.union(hot.select(F.col("v").alias("a"), F.col("v").alias("b")))), id_col, text_col, width))
    both = pairs.union(pairs.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    first = both.join(degree.toDF("b", "n"), "b").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    labels = component_labels(similar_pairs(first, sets, similarity))
    mine, theirs = labels.toDF("a", "la"), labels.toDF("b", "lb")
    rest = pairs.join(mine, "a", "left").join(theirs, "b", "left").where("la IS NULL OR lb IS NULL OR la <> lb").select("a", "b")
    return linked_labels(labels.toDF("a", "b").union(similar_pairs(rest, sets, similarity)), hot, sets, similarity)


def _of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    return nodes.join(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), "v", "left_semi")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, group: int = GROUP
) -> DataFrame:
    """(k1, k2, id, component) for every row: component is the least id that links reach.

    Null ids: they never name a component unless all of its ids are null. Repeated rows give repeated rows. Texts
    without words are alike. Other columns of docs are not read.
    """
    rows = checkpointed(fingerprinted(docs, id_col, text_col, width).withColumn("v", F.struct("h1", "h2")).drop("h1", "h2"))
    total = rows.count()
    one = F.min(F.struct("k1", "k2", "size", "fps"))  # any row of a node has its fingerprint
    nodes = checkpointed(rows.groupBy("v").agg(F.min("id").alias("id"), one.alias("one")).select("v", "id", "one.*"))
    labels = near_labels(docs, nodes, nodes.count(), id_col, text_col, width, similarity, group)
    return row_components(rows.drop("size", "fps"), nodes, labels, total)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, group: int = GROUP
) -> DataFrame:
    """docs without those that are near another of a smaller id; all columns stay.

    Of each component the document with the least id stays. Rows that repeat an id stay together; rows without an id
    go if any in their component has one, and else stay.
    """
    return without_copies(docs, near_components(docs, id_col, text_col, width, similarity, group), id_col, text_col)
