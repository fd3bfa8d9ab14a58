"""SimHash near-duplicate removal: pigeonhole blocks, joined and verified by Hamming distance.

A fingerprint is cut into blocks. Two fingerprints that differ in at most `max_bits` bits agree on all but `max_bits`
of the blocks, so they share the value of at least one choice of `blocks - max_bits` blocks. Each choice is a join key;
pairs that share one are verified by their Hamming distance. Groups of a key stay linear in their size:

* up to GROUP fingerprints are compared with each other inside the key (at most GROUP / 2 pairs each);
* beyond that, every choice of `max_bits` among the bits that the key leaves free is masked out instead. Fingerprints
  that agree on the rest differ in at most `max_bits` bits, so each is linked to the least of them: exact, and no pairs.

Links are followed to connected components by star steps (components.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, few_tasks, free_name, named, read_table, row_key
from brightloom.llm.components import component_labels

BITS = 64
#: Fingerprints of one key that are compared pair by pair. It only decides how a group is linked, never whether.
GROUP = 64


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(hashes, lanes): the hashes themselves, and for every further lane a mix of them with its number."""
    out = [hashes]
    for lane in range(1, lanes):
        x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << BITS) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ x >> np.uint64(31))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, width: int, lanes: int = 1) -> list[int]:
    """Signed 64-bit SimHash of the word shingles of text, one for each lane; zeros where text has no word."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return [0] * lanes
    shingles = map(b" ".join, zip(*(found[i:] for i in range(width)))) if len(found) >= width else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64)
    votes = np.zeros(BITS * lanes, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 12):  # a very long text needs no more memory than this
        part = np.ascontiguousarray(_lanes(hashes[at : at + (1 << 12)], lanes)).view(np.uint8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, lanes: int = 1) -> DataFrame:
    """(k1, k2, id, fps) for every row, fps as an array of longs; k1 and k2 are its common.row_key. Null and empty texts
    and texts without words have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), width, lanes) for t in batch.column(3)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["k1", "k2", "id", "fps"])

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(*row_key(id_col, text_col), named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, f"k1 long, k2 long, id {kind}, fps array<bigint>")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """One mask of kept bits for each choice of blocks - max_bits blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def near_links(fps: DataFrame, max_bits: int = 2, blocks: int = 5, group: int = GROUP) -> DataFrame:
    """Edges (a, b) whose components are those of all links at `max_bits` or fewer bits within a lane.

    fps: distinct rows (lane, fp); the ends of an edge are structs of both.
    """
    if not 0 < max_bits < blocks:
        raise ValueError("max_bits must be at least 1 and less than blocks")
    masks = block_masks(max_bits, blocks)
    rows = fps.count() * len(masks)
    key = ["lane", "choice", "block"]
    keyed = fps.select("lane", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "block"))
    sizes = checkpointed(few_tasks(keyed.groupBy(*key).agg(F.count("*").alias("n")), rows).where("n > 1"))
    met = checkpointed(few_tasks(keyed.join(sizes, key), rows))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits
    pairs = (
        met.where(F.col("n") <= group)
        .groupBy(*key)
        .agg(F.collect_list("fp").alias("fps"))
        .select("lane", F.explode("fps").alias("a"), "fps")
        .select("lane", "a", F.explode(F.filter("fps", lambda y: (y < F.col("a")) & near(y, F.col("a")))).alias("b"))
    )
    ends = lambda df: df.select(F.struct("lane", F.col("a").alias("fp")).alias("a"), F.struct("lane", F.col("b").alias("fp")).alias("b"))
    hot = met.where(F.col("n") > group)
    if hot.isEmpty():
        return ends(pairs)
    holes = fps.sparkSession.createDataFrame([(i, b) for i, m in enumerate(masks) for b in range(BITS) if not m >> b & 1], "choice int, bit int")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), bit)")
    dropped = holes.select("choice", bit.alias("drop"), F.col("bit").alias("last"))
    for _ in range(max_bits - 1):
        dropped = dropped.join(holes, "choice").where("bit > last").select("choice", F.col("drop").bitwiseOR(bit).alias("drop"), F.col("bit").alias("last"))
    # as many rows as max_bits and blocks allow, whatever the data
    dropped = dropped.select("choice", F.bitwise_not("drop").alias("mask"))
    masked = hot.join(F.broadcast(dropped), "choice").select("lane", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp").distinct()
    # at most 2 ** max_bits fingerprints agree on the rest
    chained = (
        masked.groupBy("lane", "mask", "rest")
        .agg(F.array_sort(F.collect_set("fp")).alias("fps"))
        .where(F.size("fps") > 1)
        .select("lane", F.explode(F.slice("fps", 2, 2**max_bits)).alias("a"), F.col("fps")[0].alias("b"))
    )
    return ends(pairs.union(chained))


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, blocks: int = 5, lanes: int = 1, group: int = GROUP
) -> DataFrame:
    """(k1, k2, id, fps, component) for every row: component is the least id that links reach.

    lanes: independent fingerprints of a text; two texts are linked if those of any lane are near. Null ids: they never
    name a component unless all of its ids are null. Repeated rows give repeated rows. Null or empty texts have
    fingerprint zero and link like any other. Other columns of docs are not read.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, width, lanes))
    total = rows.count()
    nodes = checkpointed(few_tasks(rows.groupBy("fps").agg(F.min("id").alias("id")), total))
    first = F.struct(F.lit(0).alias("lane"), F.get("fps", F.lit(0)).alias("fp"))
    each = nodes.select(first.alias("v0"), F.posexplode("fps").alias("lane", "fp"))
    used = each.groupBy("lane", "fp").agg(F.count("*").alias("n"))
    if lanes > 1:
        used = checkpointed(few_tasks(used, total * lanes))
    links = near_links(used.select("lane", "fp"), max_bits, blocks, group)
    if lanes > 1:  # what is linked or shared in another lane belongs to the node's own vertex
        links = checkpointed(links.distinct())
        touched = links.select("a.*").union(links.select("b.*")).union(used.where("n > 1").select("lane", "fp")).distinct()
        links = links.union(each.where("lane > 0").join(touched, ["lane", "fp"]).select(F.struct("lane", "fp").alias("a"), F.col("v0").alias("b")))
    labels = component_labels(links)
    placed = nodes.join(labels, first == labels["node"], "left").select("fps", "id", F.coalesce("label", first).alias("label"))
    placed = checkpointed(few_tasks(placed, total))
    least = checkpointed(few_tasks(placed.groupBy("label").agg(F.min("id").alias("component")), total))
    named = checkpointed(few_tasks(placed.select("fps", "label").join(least, "label").select("fps", "component"), total))
    return few_tasks(rows.join(named, "fps").select("k1", "k2", "id", "fps", "component"), total)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = 2, blocks: int = 4, lanes: int = 8, group: int = GROUP
) -> DataFrame:
    """docs without those that are near another of a smaller id; all columns stay.

    Of each component the document with the least id stays. Rows that repeat an id stay together; rows without an id
    go if any in their component has one, and else stay.
    """
    found = near_components(docs, id_col, text_col, width, max_bits, blocks, lanes, group)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("k1").alias("g1"), F.col("k2").alias("g2")).distinct()
    k1, k2 = (free_name(docs, x) for x in ("_k1", "_k2"))
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(id_col, text_col))))
    gone = checkpointed(gone)
    return keyed.join(gone, (keyed[k1] == gone["g1"]) & (keyed[k2] == gone["g2"]), "left_anti").drop(k1, k2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
