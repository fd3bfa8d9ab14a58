"""Substring dedup: compressed FM-index shards, searched backwards for matching statistics of streamed documents.

A word goes if a window of WINDOW words covers it whose words also stand anywhere else. Equal windows must meet in one
shard, and no document shall visit every shard. So windows are routed by an anchor, the least hash among their grams of
GRAM words: equal windows have equal anchors. Consecutive windows of one anchor travel as one segment.

1. Places of anchors are counted (combined before the shuffle). Windows of an anchor with one place have no equal.
2. Segments of the other anchors are cut from the documents and sent to the shard of their anchor. A task takes its
   anchors in order, a bounded number of words at a time, builds the FM-index of those segments and streams them
   against it; windows whose matching statistic reaches WINDOW are reported as intervals of words.
3. Anchors with over HOT places (a passage that a great part of the corpus shares) would fill one task. Their segments
   are dealt by content instead: identical segments are merged and counted before the shuffle, the windows of what is
   distinct are counted likewise, and the answer for each segment is joined back to its places.
4. Intervals are merged for each document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import read_table, row_key
from brightloom.llm.fm_index import FMIndex

WINDOW, GRAM = 35, 8
#: Places of one anchor that one shard takes. It decides where windows meet, never whether they are found.
HOT = 4096
#: Words of a shard, above which it is closed at the next anchor.
SHARD_WORDS = 250_000
#: Windows of one segment at most; longer runs of one anchor are several segments.
LONGEST = 64
_MIX = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MIX, n, 1 << 64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes, by doubling."""
    done, done_len, part, part_len = None, 0, words, 1
    while True:
        if k & part_len:
            if done is None:
                done, done_len = part, part_len
            else:
                n = max(0, len(words) - done_len - part_len + 1)
                done, done_len = done[:n] * _power(part_len) + part[done_len : done_len + n], done_len + part_len
        if 2 * part_len > k:
            break
        n = max(0, len(part) - part_len)
        part, part_len = part[:n] * _power(part_len) + part[part_len : part_len + n], 2 * part_len
    done = (done ^ done >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ done >> np.uint64(32)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every run of width values, by doubling."""
    part, part_len = values, 1
    while 2 * part_len <= width:
        n = max(0, len(part) - part_len)
        part, part_len = np.minimum(part[:n], part[part_len : part_len + n]), 2 * part_len
    n = max(0, len(values) - width + 1)
    return np.minimum(part[:n], part[width - part_len : width - part_len + n])


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    empty = pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0
    if empty.any():  # white space at the ends of a text
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[~empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64), counts.astype(np.int64)


def segments(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor, places of the anchor) of every segment of texts; positions are words from
    the text's start. A segment in which the anchor stands twice may repeat a window by itself."""
    hashes, counts = _word_hashes(texts)
    grams = gram_hashes(hashes, gram) if len(hashes) >= window else np.zeros(0, np.uint64)
    anchors = sliding_least(grams, window - gram + 1) if len(grams) else grams
    ends, owner = np.cumsum(counts), np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(anchors))
    at = at[at + window <= ends[owner[: len(anchors)]]]
    anchor = anchors[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(fresh)
    run = np.repeat(starts, np.diff(np.append(starts, len(at))))
    starts = np.flatnonzero((np.arange(len(at)) - run) % LONGEST == 0)
    length = np.diff(np.append(starts, len(at)))
    text = owner[at[starts]] if len(at) else np.zeros(0, np.int64)
    span = length + window - gram
    offset = np.concatenate([[0], np.cumsum(span)])[:-1]
    where = np.arange(span.sum()) + np.repeat(at[starts] - offset, span)
    same = grams[where] == np.repeat(anchor[starts], span)
    places = np.add.reduceat(same.astype(np.int64), offset) if len(span) else span
    return text, at[starts] - (ends - counts)[text], length, anchor[starts].view(np.int64), places


def _slices(batch: pa.RecordBatch, size: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def _anchored(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, k2, pos, n, anchor, places): every segment of rows (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                text, first, n, anchor, places = segments(batch.column(2), window, gram)
                text = pa.array(text)
                columns = [batch.column(0).take(text), batch.column(1).take(text), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(places)]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "pos", "n", "anchor", "places"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, pos int, n int, anchor long, places long")


def _cut(joined: DataFrame, text_col: str, parts: str, window: int) -> DataFrame:
    """(k1, k2, pos, anchor, piece): texts of the segments that column parts lists."""
    at = {c: i for i, c in enumerate(joined.columns)}
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in _slices(big, 500)):
            out: list[tuple] = []
            k1s, k2s = batch.column(at["k1"]).to_pylist(), batch.column(at["k2"]).to_pylist()
            for k1, k2, text, found in zip(k1s, k2s, batch.column(at[text_col]), batch.column(at[parts]).to_pylist()):
                words = text.as_py().encode().split()
                out += [(k1, k2, s["pos"], s["anchor"], b" ".join(words[s["pos"] : s["pos"] + s["n"] + window - 1])) for s in found]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "pos", "anchor", "piece"])

    return joined.mapInArrow(run, "k1 long, k2 long, pos int, anchor long, piece binary")


def _windows(segs: DataFrame, window: int) -> DataFrame:
    """(s1, s2, m, off, part): every window of the distinct segments segs (s1, s2, m, piece)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in _slices(big, 500)):
            out: list[tuple] = []
            for s1, s2, m, piece in zip(*(c.to_pylist() for c in batch.columns)):
                words = piece.split()
                out += [(s1, s2, m, i, b" ".join(words[i : i + window])) for i in range(len(words) - window + 1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["s1", "s2", "m", "off", "part"])

    return segs.select("s1", "s2", "m", "piece").mapInArrow(run, "s1 long, s2 long, m long, off int, part binary")


def _name(column: str, first: str, second: str) -> list:
    return [F.xxhash64(column).alias(first), F.xxhash64(F.lit("second"), column).alias(second)]


def _by_content(hot: DataFrame, window: int) -> DataFrame:
    """(k1, k2, first, last) for the segments of hot anchors, dealt by content: no key has more than a row a task."""
    hot = hot.select("k1", "k2", "pos", "piece", *_name("piece", "s1", "s2"))
    segs = hot.groupBy("s1", "s2", "piece").agg(F.count("*").alias("m"))
    wins = _windows(segs, window).select("s1", "s2", "m", "off", "part", *_name("part", "w1", "w2"))
    again = wins.groupBy("w1", "w2", "part").agg(F.sum("m").alias("all")).where("all > 1").select("w1", "w2")
    single = wins.where("m = 1").select("s1", "s2", "off", "w1", "w2").join(again, ["w1", "w2"])
    single = single.groupBy("s1", "s2").agg(F.collect_set(F.struct(F.col("off").alias("a"), (F.col("off") + window - 1).alias("b"))).alias("spans"))
    length = F.size(F.split(F.col("piece").cast("string"), " "))
    whole = segs.where("m > 1").select("s1", "s2", F.array(F.struct(F.lit(0).alias("a"), (length - 1).alias("b"))).alias("spans"))
    placed = hot.select("k1", "k2", "pos", "s1", "s2").join(whole.union(single), ["s1", "s2"])
    return placed.select("k1", "k2", "pos", F.explode_outer("spans").alias("x")).select("k1", "k2", (F.col("pos") + F.col("x.a")).alias("first"), (F.col("pos") + F.col("x.b")).alias("last"))


def repeated_windows(pieces: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each of the distinct pieces, which of its windows stand more than once in all of them, counts included."""
    lists = [p.split() for p in pieces]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    # every piece is followed by symbol 0
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    symbols = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[starts + sizes] = False
    symbols[inside] = coded.indices.to_numpy(zero_copy_only=False) + 1
    windows = sizes - window + 1
    result = [np.ones(n, dtype=bool) for n in windows]  # a piece that was cut more than once is repeated as a whole
    alone = np.flatnonzero(counts == 1)
    if len(alone) and len(pieces):
        index = FMIndex(symbols, np.repeat(counts, sizes + 1), window)
        ends = np.concatenate([starts[i] + window - 1 + np.arange(windows[i]) for i in alone])
        full = index.matching(ends, window) >= window
        for i, found in zip(alone, np.split(full, np.cumsum(windows[alone])[:-1])):
            result[i] = found
    return result


def _searched(cut: DataFrame, window: int) -> DataFrame:
    """(k1, k2, first, last): intervals of words under repeated windows, from segments sorted by anchor in each task."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        coded = table.column("piece").combine_chunks().dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False)
        found = repeated_windows(coded.dictionary.to_pylist(), np.bincount(of), window)
        runs = []
        for flags in found:  # consecutive windows give one interval
            edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
            runs.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + window - 2).tolist())))
        out = [(k1, k2, pos + a, pos + b) for k1, k2, pos, i in zip(*(table.column(c).to_pylist() for c in ("k1", "k2", "pos")), of.tolist()) for a, b in runs[i]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[pa.RecordBatch] = []
        room, last = SHARD_WORDS, None
        for batch in (b for big in batches for b in _slices(big, 2000)):
            anchors = batch.column(3).to_numpy(zero_copy_only=False)
            sizes = np.cumsum(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False)) // 6  # about as many words
            begun = 0
            for at in np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])).tolist():
                full = room - (sizes[at - 1] if at else 0) <= 0
                if full and (at or anchors[0] != last) and (at > begun or shard):
                    shard.append(batch.slice(begun, at - begun))
                    yield flush(shard)
                    shard, begun, room = [], at, SHARD_WORDS + (int(sizes[at - 1]) if at else 0)
            shard.append(batch.slice(begun))
            room, last = room - int(sizes[-1]), anchors[-1]
        if shard:
            yield flush(shard)

    return cut.select("k1", "k2", "pos", "anchor", "piece").mapInArrow(run, "k1 long, k2 long, first int, last int")


def cut_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = HOT,
) -> DataFrame:
    """docs with n_words, n_removed, kept (the words that stay, joined by one space) and intervals (of words that go).

    Those four replace columns with such names, whatever their case. Words are unchanged runs without ASCII white
    space. Null texts have no word and kept is empty; texts of under `window` words lose nothing. Rows that repeat id
    and text count as two places each, and so lose all their windows. Ids may be null.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    new = ("n_words", "n_removed", "kept", "intervals")
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # internal names can't clash
    c_id, c_text = (next(f"c{i}" for i, c in enumerate(docs.columns) if c.lower() == x.lower()) for x in (id_col, text_col))
    keyed = base.select(*row_key(c_id, c_text), *base.columns)
    found = _anchored(keyed.select("k1", "k2", F.col(c_text).alias("text")), window, gram)
    counts = found.groupBy("anchor").agg(F.sum("places").alias("m")).where("m > 1")
    kept = found.drop("places").join(counts, "anchor")
    listed = kept.groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("m") <= hot, F.struct("pos", "n", "anchor"))).alias("cold"),
        F.collect_set(F.when(F.col("m") > hot, F.struct("pos", "n", "anchor"))).alias("hot"),
    )
    # the join is the same for all its uses, so that documents are shuffled once
    joined = keyed.join(listed, ["k1", "k2"], "left")
    cold = _cut(joined.where(F.size("cold") > 0), c_text, "cold", window)
    gone = _searched(cold.repartition("anchor").sortWithinPartitions("anchor"), window)
    gone = gone.union(_by_content(_cut(joined.where(F.size("hot") > 0), c_text, "hot", window), window))
    spans = gone.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    final = keyed.join(spans, ["k1", "k2"], "left")
    at = {c: i for i, c in enumerate(final.columns)}
    stay = [c for c in base.columns if docs.columns[int(c[1:])].lower() not in new]
    schema = final.select(*stay).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string").add("intervals", T.ArrayType(T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType())))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in _slices(big, 500)):
            rows = []
            for text, found in zip(batch.column(at[c_text]), batch.column(at["spans"]).to_pylist()):
                words = (text.as_py() or "").encode().split()
                merged: list[list[int]] = []
                for s in sorted((s["first"], s["last"]) for s in found or ()):
                    if merged and s[0] <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                gone, begin, left = 0, 0, []
                for a, b in merged:
                    left += words[begin:a]
                    begin, gone = b + 1, gone + b - a + 1
                rows.append((len(words), gone, b" ".join(left + words[begin:]).decode(), [{"first": a, "last": b} for a, b in merged]))
            n, g, k, spans_ = zip(*rows) if rows else ((), (), (), ())
            span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            columns = [batch.column(at[c]) for c in stay] + [pa.array(n, pa.int64()), pa.array(g, pa.int64()), pa.array(k, pa.string()), pa.array(spans_, span_type)]
            yield pa.RecordBatch.from_arrays(columns, [*stay, *new])

    return final.mapInArrow(finish, schema).toDF(*[docs.columns[int(c[1:])] for c in stay], *new)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(words[p:p + 34], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM w)),
cov AS (
  SELECT DISTINCT doc_id, p + k AS p
  FROM (SELECT doc_id, p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)), range(35) g(k)),
kept AS (
  SELECT a.doc_id, coalesce(string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE c.p IS NULL), '') AS kept, count(c.p)::BIGINT AS n_removed
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) a
  LEFT JOIN cov c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
}
