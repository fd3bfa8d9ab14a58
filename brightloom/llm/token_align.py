"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes. A token is known by where it ends, so a text is two rising arrays of ends. At index
shift j - i the arrays are compared in stretches of 1, 2, 4 ... tokens as long as they agree; a stretch that agrees is as
many groups of one token on each side. Where they differ the group is irregular: the side that ends earlier takes its
next token until both end together, which also gives the new shift. Every step of that walk is one overlap of an A with
a B token, so links come from the same pass.

Texts are aligned in one pass by Python workers, row by row. How often an id pair is linked is counted over the corpus
(combined before the shuffle), and what each text gains from those counts is looked up in the table of pairs: broadcast
while it has at most BROADCAST_PAIRS rows, joined by a shuffle beyond.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import named, read_table, written

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of the table of id pairs (24 bytes each) up to which it is broadcast.
BROADCAST_PAIRS = 2_000_000
#: A run of so many characters without, or of nothing but, white space is one piece to merge. Such texts go to the
#: library whose time does not grow with the square of a piece. Either gives the same tokens.
LONG_PIECE = re.compile(r"\S{2048}|\s{2048}")
#: The split pattern of byte-level BPE that the JSON file names by use_regex.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level BPE writes each byte: printable bytes stand for themselves, others follow at U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE in a tokenizers JSON file: ids of space + text."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(data.decode())
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_letters()
        of = {i: bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode() for entry, i in self.whole.get_vocab(False).items()}
        of |= {i: t.content.encode() for i, t in self.whole.get_added_tokens_decoder().items()}
        self.bytes = [of.get(i, b"") for i in range(max(of) + 1)]
        self.fast = self._by_rank(json.loads(data), of)

    @staticmethod
    def _by_rank(spec: dict, of: dict[int, bytes]):
        """The same vocabulary by ranks, which is some three times as fast, if ids follow the order of merges."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        n = len(model["vocab"]) - len(merges)
        special = {t["id"] for t in spec["added_tokens"]}
        ordered = all(model["vocab"].get(a + b) == i for i, (a, b) in enumerate(merges, 256))
        if not plain or not ordered or n - len(special & set(model["vocab"].values())) != 256:
            return None
        import tiktoken

        ranks = {of[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or (len(text) >= 2048 and LONG_PIECE.search(text)):
            return self.whole.encode(f" {text}", add_special_tokens=False).ids
        return self.fast.encode_ordinary(f" {text}")


class Pieces:
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def load_tokenizer(name: str, data: bytes) -> ByteLevel | Pieces:
    return ByteLevel(data) if name.endswith(".json") else Pieces(data)


def align_ends(a: list[int], b: list[int]) -> list[int]:
    """Links of two rising lists of ends with the same last end, as stretches i, j, n, one after the other: the tokens i,
    i + 1 ... of a with j, j + 1 ... of b, each pair a group of its own. A link after which its group goes on has n = -1."""
    i = j = 0
    n = len(a)
    links: list[int] = []
    while i < n:
        if a[i] == b[j]:
            # probe stretches at this shift, each twice as long, until one does not agree; then halve what is tried
            first, other, step = i, j, 1
            while a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
                if i >= n:
                    i, step = n, 0
                    break
            while step > 1:
                step >>= 1
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
            links += (first, other, i - first)
            if i >= n:
                break
        x, y = a[i], b[j]
        while x != y:
            links += (i, j, -1)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        links += (i, j, 1)
        i += 1
        j += 1
    return links


class Aligner:
    """Aligns texts by two tokenizers."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> None:
        self.sides = a, b
        self.lengths = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in self.sides]
        most = max(len(t.bytes) for t in self.sides)
        width = len(str(most))
        #: Every id in digits, to the right, with room for a separator; and which of these bytes count.
        self.digits = np.array([list(f"{i:0{width}},".encode()) for i in range(most)], dtype=np.uint8)
        self.shown = np.arange(width + 1) >= width - np.array([len(str(i)) for i in range(most)])[:, None]

    def tokens(self, text: str | None) -> list[np.ndarray] | None:
        """Ids of both sides; None where the text has no tokens or they don't give the text back."""
        if not text:
            return None
        found, raw = [t.encode(text) for t in self.sides], f" {text}".encode()
        whole = all(b"".join(map(t.bytes.__getitem__, ids)) == raw for t, ids in zip(self.sides, found))
        return [np.array(x, dtype=np.int64) for x in found] if whole else None

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Groups as a1,a2|b1;a3|b2: last_a and last_b are the places of each group's last tokens."""
        count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # a token stands behind those of its own side and, in whole groups, those of the other
        at_a = np.arange(len(a)) + np.repeat(last_b + 1 - count_b, count_a)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, count_b)
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        ids[at_a], ids[at_b] = a, b
        parts = []
        for at in range(0, len(ids), 1 << 16):  # a very long text needs no more memory than this
            some = ids[at : at + (1 << 16)]
            signs = self.digits[some]
            for places, sign in ((at_a[last_a], b"|"), (at_b[last_b], b";")):
                here = places[np.searchsorted(places, at) : np.searchsorted(places, at + len(some))]
                signs[here - at, -1] = sign[0]
            parts.append(signs[self.shown[some]].tobytes())
        return b"".join(parts)[:-1].decode()

    def groups(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups written as a1,a2|b1;a3|b2, and linked id pairs with their times."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b = found
        first_a, first_b, n = np.array(align_ends(*(np.cumsum(n[x]).tolist() for n, x in zip(self.lengths, found))), dtype=np.int64).reshape(-1, 3).T
        ends, n = n > 0, np.abs(n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        link_a, link_b, ends = np.repeat(first_a, n) + inside, np.repeat(first_b, n) + inside, np.repeat(ends, n)
        pairs, times = np.unique(a[link_a] << 32 | b[link_b], return_counts=True)
        shown = self.written(a, b, link_a[ends], link_b[ends])
        return len(a), len(b), int(ends.sum()), len(link_a), shown, pairs, times


_LOADED: dict[tuple, Aligner] = {}


def loaded(files: list[tuple[str, bytes]]) -> Aligner:
    """The aligner of two tokenizer files (name, content); a worker keeps the last one."""
    key = tuple((name, xxhash.xxh3_128_digest(data)) for name, data in files)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(*(load_tokenizer(*f) for f in files))
    return _LOADED[key]


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, pairs, times) for every row of docs.

    groups: decimal ids as `a1,a2|b1;a3|b2,b3`. pairs: distinct linked ids as a * 2^32 + b, rising; times: how often.
    row numbers the rows of one evaluation. Files are read by the driver and broadcast (a vocabulary is bounded).

    Null and empty texts, and texts whose tokens do not give back space + text in bytes, have zeros, an empty groups and
    empty arrays. Null ids are kept, repeated rows are each aligned. A text is aligned whole, whatever its length, in some
    150 bytes of memory a token. Other columns are not read, so they may have any name. Empty tables give no rows.
    """
    spark = docs.sparkSession
    files = []
    for path in (tokenizer_a, tokenizer_b):
        with open(path, "rb") as f:
            files.append((path, f.read()))
    shared = spark.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(shared.value)
        names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what is sent back is many times the text
                part = batch.slice(at, 256)
                *counts, groups, pairs, times = zip(*(aligner.groups(t.as_py()) for t in part.column(2)))
                out = [*part.columns[:2], *(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.large_string() if sum(map(len, groups)) >> 31 else pa.string())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names)

    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of aligned a pair is linked; best if no pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned (with row, pairs and times; written, so that row stays) with n_best and count_sum instead of those.

    n_best: links whose pair is the best of its A id; count_sum: the sum of n over links; zeros for rows without links.
    """
    small = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    each = aligned.select("row", F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    met = each.join(F.broadcast(counts) if small else counts, each["pairs"] == counts["pair"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    kept = aligned.drop("pairs", "times")
    return kept.join(sums, "row", "left").select(*[c for c in kept.columns if c != "row"], *zero)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = written(align_tokens(docs).withColumn("groups_sha256", digest).drop("groups"))
    scored = score_links(aligned, pair_counts(aligned))
    return scored.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_token_align": op13_token_align}
ORACLES: dict[str, str] = {}
