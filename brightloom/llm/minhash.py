"""Near-duplicate removal: banded MinHash proposes pairs, the exact Jaccard similarity of their word shingles decides.

Texts of equal shingle sets are one node. A node has BANDS keys, each of ROWS minima of its shingles; a pair of
similarity s shares one at least with probability 1 - (1 - s ** ROWS) ** BANDS: 99.7 % at 0.8, 99.99 % at 0.85. Nodes
that share a key are candidates:

* up to GROUP nodes of a key are compared with each other;
* beyond that, all are compared with one hub of the key, the node whose keys are the most shared, and linked to it if
  they are similar. Nodes that are not, and that no other link brings into the hub's component, are the query set of a
  search in all nodes of the hub, in blocks: no pair of a large group is lost, and none is made inside what a hub links.
  The Jaccard distance is a metric, so a node is only held against those whose distance from the hub differs by no
  more than 1 - similarity. A block compares what its nodes have apart from the hub, through an inverted index.

Links are followed to connected components by star steps (components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, few_tasks, free_name, named, row_key, written
from brightloom.llm.components import component_labels

BANDS, ROWS = 32, 8
#: Nodes of one key that are compared pair by pair. It decides how a group is linked, never whether.
GROUP = 16
#: Query nodes and other nodes of one block of the search; they bound a task's memory, not what is found.
QUERY_BLOCK, NODE_BLOCK = 512, 2048
#: Shingles of all hubs (32 MB) up to which they are broadcast; beyond, the join is a shuffle.
BROADCAST_SHINGLES = 4_000_000
_FACTORS = np.array([[xxhash.xxh32_intdigest(b"%d" % i, side) | 1 for i in range(BANDS * ROWS)] for side in (1, 2)], dtype=np.uint32)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of text; a shorter text is one shingle."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(width)))) if len(found) >= width else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; of no hashes, equal ones."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 1 << 10):  # a very long text needs no more memory than this
        part = low[at : at + (1 << 10), None] * _FACTORS[0]
        part += high[at : at + (1 << 10), None] * _FACTORS[1]
        np.minimum(least, part.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), 7) for b in least.reshape(BANDS, ROWS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(k1, k2, id, h1, h2, bands) for every row: h1 and h2 stand for the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bands = [], []
            for t in batch.column(3):
                hashes = shingle_hashes(t.as_py(), width)
                names.append(np.frombuffer(xxhash.xxh128_digest(hashes.tobytes()), dtype=np.int64).tolist())
                bands.append(band_keys(hashes))
            h1, h2 = (pa.array([n[i] for n in names], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], h1, h2, pa.array(bands, pa.list_(pa.int64()))], ["k1", "k2", "id", "h1", "h2", "bands"])

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(*row_key(id_col, text_col), named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, f"k1 long, k2 long, id {kind}, h1 long, h2 long, bands array<bigint>")


def _meeting(keyed: DataFrame) -> DataFrame:
    """keyed (g, v) with n, the nodes of its group g, where that is over one."""
    sizes = checkpointed(keyed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    return written(keyed.join(sizes, "g"))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a over b, of nodes of the groups of met."""
    listed = met.groupBy("g").agg(F.collect_list("v").alias("vs")).select(F.explode("vs").alias("a"), "vs")
    return listed.select("a", F.explode(F.filter("vs", lambda y: y < F.col("a"))).alias("b")).distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(v, s): the shingles of nodes (v, k1, k2); k1 and k2 are the row_key of one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_hashes(t.as_py(), width).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["v", "s"])

    needed = nodes.select("v", F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    rows = docs.select(*row_key(id_col, text_col), named(text_col).alias("text"))
    texts = rows.join(needed, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).select("v", "text").dropDuplicates(["v"])
    return texts.mapInArrow(run, "v struct<h1:bigint,h2:bigint>, s array<bigint>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    size = sets.select("v", F.size("s").alias("n"))
    # sizes first: sets move only for pairs that can reach the similarity
    able = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * (similarity - 1e-9))
    met = able.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    met = met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))
    return met.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= similarity).select("a", "b")


def _stars(hot: DataFrame) -> DataFrame:
    """(hub, v): every node of a group with its hub."""
    shared = hot.groupBy("v").agg(F.sum("n").alias("shared"))
    hubs = hot.join(shared, "v").groupBy("g").agg(F.max_by("v", F.struct("shared", "v")).alias("hub"))
    return hot.join(hubs, "g").where("v <> hub").select("hub", "v").distinct()


def _beside_hubs(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """stars with the sets of v and hub as s and t."""
    hubs = sets.join(stars.select(F.col("hub").alias("v")).distinct(), "v").toDF("hub", "t")
    bounded = (hubs.agg(F.sum(F.size("t"))).first()[0] or 0) <= BROADCAST_SHINGLES
    return stars.join(sets, "v").join(F.broadcast(hubs) if bounded else hubs, "hub")


def _block_links(block: pa.Table, similarity: float) -> list[tuple]:
    """(h1, h2, g1, g2): links of query nodes of a block with its other nodes, one for each component that they reach."""
    query = block.column("query").to_numpy(zero_copy_only=False).astype(bool)
    col = {c: block.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "label", "n", "n_hub", "both")}
    apart = [np.asarray(x) for x in block.column("apart").combine_chunks().to_numpy(zero_copy_only=False)]
    rest, out = np.flatnonzero(~query), []
    if not len(rest):
        return out
    values = np.concatenate([apart[i] for i in rest])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(rest)), [len(apart[i]) for i in rest])[order]
    n, lost, label = col["n"][rest], (col["n_hub"] - col["both"])[rest], col["label"][rest]
    for y in np.flatnonzero(query):
        low, high = np.searchsorted(values, apart[y], "left"), np.searchsorted(values, apart[y], "right")
        count = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(owner[at], minlength=len(rest))
        both = col["n_hub"][y] - lost - (col["n_hub"][y] - col["both"][y]) + shared
        near = np.flatnonzero((both / (n + col["n"][y] - both) >= similarity) & (label != col["label"][y]))
        for i in near[np.unique(label[near], return_index=True)[1]]:
            x = rest[i]
            out.append((int(col["h1"][y]), int(col["h2"][y]), int(col["h1"][x]), int(col["h2"][x])))
    return out


def _searched(star: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes that are far from their hub and outside its component, and others of that hub."""
    mine, theirs = labels.toDF("v", "label"), labels.toDF("hub", "hub_label")
    placed = star.join(mine, "v", "left").join(theirs, "hub", "left")
    label, hub_label = F.coalesce("label", "v"), F.coalesce("hub_label", "hub")
    step = F.floor((1 - F.col("both") / (F.col("n") + F.col("n_hub") - F.col("both"))) / (1 - similarity + 1e-9)).cast("int")
    placed = placed.select("hub", "v", "n", "n_hub", "both", F.xxhash64(label).alias("label"), step.alias("step"), (label != hub_label).alias("query"))
    placed = checkpointed(placed)
    asked = placed.where("query").select("*", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("ring"))
    given = placed.select("*", F.col("step").alias("ring"))
    many = asked.groupBy("hub", "ring").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    blocks = checkpointed(given.groupBy("hub", "ring").agg(F.ceil(F.count("*") / NODE_BLOCK).cast("int").alias("node_blocks")).join(many, ["hub", "ring"]))
    dealt = lambda of: F.pmod(F.xxhash64("v"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["hub", "v", "ring", "n", "n_hub", "both", "label"]
    left = asked.join(blocks, ["hub", "ring"]).select(*columns, F.lit(True).alias("query"), dealt("query_blocks").alias("qb"), every("node_blocks").alias("nb"))
    right = given.join(blocks, ["hub", "ring"]).select(*columns, F.lit(False).alias("query"), every("query_blocks").alias("qb"), dealt("node_blocks").alias("nb"))
    apart = _beside_hubs(placed.join(blocks.select("hub").distinct(), "hub").select("hub", "v"), sets)
    apart = checkpointed(apart.select("hub", "v", F.concat(F.array_except("s", "t"), F.array_except("t", "s")).alias("apart")))
    rows = left.union(right).join(apart, ["hub", "v"])
    rows = rows.select(F.xxhash64("hub", "ring", "qb", "nb").alias("block"), "query", F.col("v.h1").alias("h1"), F.col("v.h2").alias("h2"), "label", "n", "n_hub", "both", "apart")

    def run(block: pa.Table) -> pa.Table:
        out = _block_links(block, similarity)
        names = ["h1", "h2", "g1", "g2"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names)

    found = rows.groupBy("block").applyInArrow(run, "h1 long, h2 long, g1 long, g2 long")
    return found.select(F.struct("h1", "h2").alias("a"), F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2")).alias("b"))


def linked_labels(links: DataFrame, hot: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, label) of the components of links (a, b) and of all similar pairs in the groups of hot (g, v, n)."""
    if hot.isEmpty():
        return component_labels(links)
    star = _beside_hubs(checkpointed(_stars(hot)), sets)
    star = star.select("hub", "v", F.size("s").alias("n"), F.size("t").alias("n_hub"), F.size(F.array_intersect("s", "t")).alias("both"))
    star = written(star)
    near = F.col("both") / (F.col("n") + F.col("n_hub") - F.col("both")) >= similarity
    labels = component_labels(links.union(star.where(near).select(F.col("v").alias("a"), F.col("hub").alias("b"))))
    if star.where(~near).isEmpty():
        return labels
    return component_labels(labels.toDF("a", "b").union(_searched(star, sets, labels, similarity)))


def near_labels(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int, similarity: float, group: int = GROUP) -> DataFrame:
    """(node, label) of the components of all pairs of nodes that share a key and have at least that Jaccard similarity.

    nodes: v, bands, and the row_key of one of its rows.
    """
    keyed = nodes.select("v", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("g"), "v")
    met = _meeting(keyed)
    sets = written(shingle_sets(docs, nodes.join(met.select("v").distinct(), "v"), id_col, text_col, width))
    links = similar_pairs(_pairs(met.where(F.col("n") <= group)), sets, similarity)
    return linked_labels(links, met.where(F.col("n") > group), sets, similarity)


def row_components(rows: DataFrame, nodes: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(k1, k2, id, component) of rows (k1, k2, id, v), which are total, by labels of nodes (v, id)."""
    placed = nodes.join(labels, F.col("v") == F.col("node"), "left").select("v", "id", F.coalesce("label", "v").alias("label"))
    placed = checkpointed(few_tasks(placed, total))
    least = checkpointed(few_tasks(placed.groupBy("label").agg(F.min("id").alias("component")), total))
    named = checkpointed(few_tasks(placed.select("v", "label").join(least, "label").select("v", "component"), total))
    return few_tasks(rows.join(named, "v").select("k1", "k2", "id", "component"), total)


def without_copies(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs whose id is that of their component in found."""
    gone = found.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("k1").alias("g1"), F.col("k2").alias("g2")).distinct()
    k1, k2 = (free_name(docs, x) for x in ("_k1", "_k2"))
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(id_col, text_col))))
    gone = checkpointed(gone)
    return keyed.join(gone, (keyed[k1] == gone["g1"]) & (keyed[k2] == gone["g2"]), "left_anti").drop(k1, k2)


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, group: int = GROUP
) -> DataFrame:
    """(k1, k2, id, component) for every row: component is the least id that links reach.

    Null ids: they never name a component unless all of its ids are null. Repeated rows give repeated rows. Texts
    without words are alike. Other columns of docs are not read.
    """
    rows = checkpointed(signatures(docs, id_col, text_col, width).withColumn("v", F.struct("h1", "h2")).drop("h1", "h2"))
    total = rows.count()
    one = F.min(F.struct("k1", "k2", "bands"))  # any row of a node has its bands
    nodes = checkpointed(rows.groupBy("v").agg(F.min("id").alias("id"), one.alias("one")).select("v", "id", "one.*"))
    labels = near_labels(docs, nodes, id_col, text_col, width, similarity, group)
    return row_components(rows.drop("bands"), nodes, labels, total)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, group: int = GROUP
) -> DataFrame:
    """docs without those that are near another of a smaller id; all columns stay.

    Of each component the document with the least id stays. Rows that repeat an id stay together; rows without an id
    go if any in their component has one, and else stay.
    """
    return without_copies(docs, near_components(docs, id_col, text_col, width, similarity, group), id_col, text_col)
