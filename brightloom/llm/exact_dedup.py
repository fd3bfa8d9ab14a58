"""Exact dedup by recipes of content-defined chunks.

Texts are cut where a rolling hash of their last bytes says so, so equal texts are cut alike wherever they stand. A
chunk's text moves once, to be compared with the other chunks of its hash: what differs under one hash gets an
identifier of its own. A document is then the ordered list of its chunk identifiers, and only those short lists are
grouped; the documents themselves never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, named, read_table

#: About the mean, and the bounds, of a chunk in bytes.
MEAN, LEAST, MOST = 2048, 256, 16384
SPAN = 32
_GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def normalised(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes: A-Z only


def chunks(data: bytes) -> list[bytes]:
    """data cut after every place where the gear hash of the last SPAN bytes has its top bits clear."""
    if len(data) <= LEAST:
        return [data] if data else []
    rolled = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < SPAN:  # sum of gear[byte] << age over the last `width` bytes, by doubling
        older = rolled[:-width] << np.uint32(width)
        rolled[width:] += older
        width *= 2
    marks = np.flatnonzero(rolled < np.uint32((1 << 32) // MEAN)) + 1
    cuts, last = [0], 0
    for mark in marks.tolist():
        while mark - last > MOST:
            last += MOST
            cuts.append(last)
        if mark - last >= LEAST:
            last = mark
            cuts.append(last)
    while len(data) - last > MOST:
        last += MOST
        cuts.append(last)
    if last < len(data):
        cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _name(chunk: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)


def _recipes(rows: DataFrame, bits: int) -> DataFrame:
    """(rid, id, sha, recipe) for rows (rid, id, text): hashes of the chunks, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for text in batch.column(2):
                data = normalised(text.as_py())
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append([_name(c, bits) for c in chunks(data)])
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(r) for r in recipe])]).astype(np.int32),
                pa.array(np.array([h for r in recipe for h in r], dtype=np.uint64).view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.string()), lists], ["rid", "id", "sha", "recipe"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, id {kind}, sha string, recipe array<bigint>")


def _pieces(rows: DataFrame, bits: int, places: bool) -> DataFrame:
    """(h, chunk), repeats within a batch left out; or (sha, seq, h, chunk) with every place in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if places:
                    texts = {normalised(t.as_py()) for t in part.column(0)}
                    found = [(hashlib.sha256(t).hexdigest(), i, c) for t in texts for i, c in enumerate(chunks(t))]
                    shas, seq, cut = map(list, zip(*found)) if found else ([], [], [])
                else:
                    cut = list({c for t in part.column(0) for c in chunks(normalised(t.as_py()))})
                names = np.fromiter((_name(c, bits) for c in cut), dtype=np.uint64, count=len(cut)).view(np.int64)
                columns, labels = [pa.array(names), pa.array(cut, pa.binary())], ["h", "chunk"]
                if places:
                    columns, labels = [pa.array(shas, pa.string()), pa.array(seq, pa.int32()), *columns], ["sha", "seq", *labels]
                yield pa.RecordBatch.from_arrays(columns, labels)

    return rows.select("text").mapInArrow(run, ("sha string, seq int, " if places else "") + "h long, chunk binary")


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(rid, id, keep_id, group_size, kept, sha) for every row of docs.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty, and all empty texts are equal.
    Of equal texts the row of the largest id stays; among rows of that id, one (the last in the table's order). Null
    ids come before all others. bits: of the chunk hash; results do not depend on it. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), named(id_col).alias("id"), named(text_col).alias("text"))
    distinct = _pieces(rows, bits, False).distinct()
    clashes = checkpointed(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    listed = checkpointed(_recipes(rows, bits))
    if not clashes.isEmpty():  # different chunks of one hash: tell them apart by their rank
        ranked = checkpointed(
            distinct.join(clashes, "h").groupBy("h").agg(F.array_sort(F.collect_set("chunk")).alias("all")).select("h", F.posexplode("all").alias("rank", "chunk"))
        )
        placed = _pieces(rows, bits, True).join(ranked, ["h", "chunk"]).select("sha", "seq", "rank").distinct()
        ranks = checkpointed(placed.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("seq", "rank"))).alias("ranks")))
        by_seq = F.transform("recipe", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.try_element_at("ranks", i), F.lit(0)).alias("rank")))
        listed = checkpointed(listed.join(ranks, "sha", "left").select("rid", "id", "sha", by_seq.alias("recipe")))
    last = F.struct(F.col("id").alias("keep_id"), "rid")
    groups = listed.groupBy("recipe").agg(F.max(last).alias("last"), F.count("*").alias("group_size"))
    groups = checkpointed(groups.select(F.col("recipe").alias("same"), "last", "group_size"))
    found = listed.join(groups, F.col("recipe") == F.col("same"))
    return found.select("rid", "id", F.col("last.keep_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"), "sha")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = equal_texts(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY low) AS kept, sha256(low) AS text_sha256
FROM t"""
}
