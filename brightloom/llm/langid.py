"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit of the code one binary classifier over hashed character n-grams tells the
languages with that bit set from the others; its weight of an n-gram is the log ratio of how often the two sides use
it. A margin is the mean log ratio of a text's n-grams, calibrated on the labelled rows: the two sides of a bit come out
at +1 and -1 on average. Margins are decoded by the codeword of least weighted logistic loss. Where the runner-up comes
close, measured by the lead that the labelled rows of the language have on average, the answer is flagged as ambiguous:
a text that is half in one language and half in another has next to no lead.

Training counts n-grams in Spark over all labelled rows; what reaches the driver is one row of BUCKETS counts for each
language. Prediction is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import named, read_table

BUCKETS = 1 << 14
#: n-grams of these lengths in bytes; a letter outside ASCII has two or more.
LENGTHS = (1, 2, 3, 4)
#: More languages than this are refused, which bounds the model (BUCKETS x bits) and the counts sent to the driver.
MAX_LANGUAGES = 256
#: An answer is ambiguous if its lead over the runner-up is under this share of the lead of a text that is wholly in it.
CERTAIN = 0.35
#: Lead (in nats) of a clear text between the two nearest codewords, and n-grams of doubt added to every text.
SHARPNESS, DOUBT = 6.0, 8
CHUNK = 1 << 20

_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """BUCKETS counts of the n-grams of the whole text, in lower case, with other signs of ASCII read as blanks."""
    raw = f" {text} ".lower().encode("utf-8", "replace").translate(_FOLD)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), CHUNK):  # a very long text needs no more memory than this
        piece = np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(CHUNK + max(LENGTHS) - 1, len(raw) - at)).astype(np.uint32)
        starts = min(CHUNK, len(piece))
        value = np.zeros(len(piece), dtype=np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            full = len(piece) - n + 1
            if full <= 0:
                break
            value = (value[:full] << np.uint32(8)) | piece[n - 1 :]
            if n in LENGTHS:
                mixed = (value[:starts] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
                total += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Exhaustive code up to 7 languages; beyond, random columns of a fixed seed, each splitting the languages."""
    if n <= 1:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 7:
        columns = [[1 if i == 0 or i in side else -1 for i in range(n)] for k in range(n - 1) for side in combinations(range(1, n), k)]
        return np.array(columns, dtype=np.int8).T
    random, bits = np.random.default_rng(7), math.ceil(10 * math.log2(n))
    best = None
    for _ in range(20):  # of 20 codes the one whose two nearest words are farthest apart
        code = np.where(random.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        gaps = (bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * bits
        if abs(code.sum(axis=0)).max() < n and (best is None or gaps.min() > best[0]):
            best = (gaps.min(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # of each bit, in the decoding
    middle: np.ndarray  # of each bit, the mean log ratio between its two sides
    half: np.ndarray  # of each bit, from there to either side
    lead: np.ndarray  # of each language, what its labelled rows have over the runner-up on average

    def losses(self, means: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword for mean log ratios of the bits."""
        return (np.logaddexp(0, -self.code * ((means - self.middle) / self.half)) * self.trust).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); und with score 0 where text is null or has no letter."""
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0, True
        counts = ngram_counts(text)
        n = counts.sum()
        doubt = n / (n + DOUBT)
        loss = self.losses(self.middle + doubt * ((counts @ self.weights) / n - self.middle))
        best = int(loss.argmin())  # of equal losses the first language by name
        score = float(1 / np.exp(loss[best] - loss).sum())
        lead = float(np.delete(loss, best).min() - loss[best]) if len(loss) > 1 else math.inf
        return self.languages[best], score, bool(lead < CERTAIN * self.lead[best])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows of labelled that have a text with a letter and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                if has_letter(t := text.as_py()):
                    sums.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))[:] += ngram_counts(t)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(total[used])], ["lang", "bucket", "n"])

    rows = labelled.select(named(text_col).alias("text"), named(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    found = sorted(table.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])  # one row of BUCKETS pairs at most each
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    used = np.zeros((len(found), BUCKETS))
    for i, r in enumerate(found):
        for bucket, n in r["counts"]:
            used[i, bucket] = n
    rates = (used + 0.5) / (used + 0.5).sum(axis=1, keepdims=True) if len(found) else used
    code = codewords(len(found))
    bits = code.shape[1]
    weights, trust = np.zeros((BUCKETS, bits), dtype=np.float32), np.ones(bits)
    for b in range(bits):
        yes, no = rates[code[:, b] > 0].mean(axis=0), rates[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log(yes / no)
        # a bit counts by how far its two sides are apart (symmetric divergence of their n-grams)
        trust[b] = ((yes - no) * weights[:, b]).sum()
    if not bits:
        return Model([r["lang"] for r in found], code, weights, trust, trust, trust, np.zeros(len(found)))
    means = rates @ weights  # of each language's labelled rows, for each bit
    sides = [np.array([means[code[:, b] == side, b].mean() for b in range(bits)]) for side in (1, -1)]
    n = len(found)
    nearest = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    model = Model([r["lang"] for r in found], code, weights, trust / trust.mean() * SHARPNESS / nearest, (sides[0] + sides[1]) / 2, (sides[0] - sides[1]) / 2, np.zeros(n))
    for i in range(n):
        loss = model.losses(means[i])
        model.lead[i] = max(0.0, np.delete(loss, i).min() - loss[i])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", certain_only: bool = False) -> DataFrame:
    """docs with lang_pred, score and ambiguous, which replace columns with such names, whatever their case.

    Null texts and texts without a letter are `und` with score 0, and ambiguous. certain_only: without the rows that
    are `und` or ambiguous. Of equal losses the first language by name is taken. Rows are judged one by one: repeated
    rows repeat, and texts are read whole, whatever their length. An empty table gives an empty result; a model of no
    language calls everything `und`.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    new = ["lang_pred", "score", "ambiguous"]
    inner = [f"c{i}" for i in range(len(kept))]  # names that can't clash
    base = docs.select(*[named(c).alias(i) for c, i in zip(kept, inner)])
    given = docs.select(*[named(c).alias(i) for c, i in zip(kept, inner)], named(text_col).alias("text"))
    schema = base.schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [model.predict(t.as_py()) for t in part.column(len(kept))]
                langs, scores, doubts = map(list, zip(*found)) if found else ([], [], [])
                columns = [*part.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())]
                out = pa.RecordBatch.from_arrays(columns, [*inner, *new])
                yield out.filter(pa.array([not d for d in doubts])) if certain_only else out

    return given.mapInArrow(run, schema).toDF(*kept, *new)


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from training: crc32(doc_id as text) mod 4 is 2. False for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(texts, fit_documents(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
