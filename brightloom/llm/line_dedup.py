"""Line dedup by overlapping windows of three lines, in DataFrame functions alone.

Consecutive lines are hashed as windows; a window that occurs more than once anywhere keeps its first occurrence, by
(id, position), and loses the lines of every later one. Covered positions of a document are merged before its lines
are put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import free_name, named, read_table, row_key

WIDTH = 3


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(k1, k2, id, pos, h1, h2): every window of width lines that is not blank; pos is that of its first line."""
    lined = docs.select(named(id_col).alias("id"), *row_key(id_col, text_col), F.split(named(text_col), "\n").alias("lines"))
    at = lambda i: [F.get("lines", i + k) for k in range(width)]
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*at(i)).alias("h1"),
            F.xxhash64(F.lit("second"), *at(i)).alias("h2"),
            F.concat(*at(i)).rlike(r"\S").alias("text"),
        ),
    )
    hashed = F.when(F.size("lines") >= width, hashed)
    # inline_outer: for inline, Spark would infer a filter on the array and compute it twice
    return lined.select("k1", "k2", "id", F.inline_outer(hashed)).where("text").drop("text")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, kept_col: str | None = None, counts: bool = False
) -> DataFrame:
    """docs with the later occurrences of repeated windows cut out of the text.

    The text goes to kept_col (text_col itself if None); counts adds n_lines and n_removed. Those replace columns with
    such names, whatever their case. Lines are split at "\\n" only. Windows are judged on the input, and so is "first":
    least id (null last), then position; rows that repeat id and text tie and keep the same lines. Windows of white
    space alone never count. Texts under `width` lines are unchanged; null texts stay null with 0 lines. A text whose
    lines all go is empty. Windows are equal when 128 bits of hash are.
    """
    seen = _windows(docs, id_col, text_col, width)
    place = F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2", "pos")
    first = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = seen.join(first, ["h1", "h2"]).where(place != F.col("first"))
    gone = later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    k1, k2, g1, g2, cov, all_lines = (free_name(docs, x) for x in ("_k1", "_k2", "_g1", "_g2", "_covered", "_lines"))
    covered = gone.select(
        F.col("k1").alias(g1),
        F.col("k2").alias(g2),
        F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + width - 1)))).alias(cov),
    )
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(id_col, text_col))))
    joined = keyed.join(covered, (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2)), "left").withColumn(all_lines, F.split(named(text_col), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), cov)
    text = F.when(F.col(cov).isNull(), named(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    new = {kept_col or text_col: text}
    if counts:
        new |= {"n_lines": F.when(named(text_col).isNull(), 0).otherwise(F.size(all_lines)), "n_removed": F.coalesce(F.size(cov), F.lit(0))}
    # a column that is replaced keeps its place
    by_name = {name.lower(): (name, c) for name, c in new.items()}
    old = [by_name[c.lower()][1].alias(c) if c.lower() in by_name else named(c) for c in docs.columns]
    added = [c.alias(name) for name, c in new.items() if name.lower() not in {x.lower() for x in docs.columns}]
    return joined.select(*old, *added)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(read_table(spark, sf_dir, "documents"), kept_col="kept", counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def line_dedup_ctes(docs: str) -> str:
    """CTEs after which the relation `line_kept` is docs with kept, n_lines and n_removed. Rows of docs have unique ids."""
    return rf"""
lined AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs} WHERE text IS NOT NULL),
win AS (
  SELECT doc_id, p AS pos, lines[p:p + 2] AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM lined)),
solid AS (SELECT * FROM win WHERE regexp_matches(array_to_string(w, ''), '[^ \t\n\r\f\v]')),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r FROM solid) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(3) g(k)),
cut AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE c.pos IS NULL), '') AS kept,
         count(*)::INT AS n_lines, count(c.pos)::INT AS n_removed
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM lined) l
  LEFT JOIN cov c ON c.doc_id = l.doc_id AND c.pos = l.p GROUP BY 1),
line_kept AS (SELECT d.*, k.kept, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed FROM {docs} d LEFT JOIN cut k USING (doc_id))"""


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": f"WITH {line_dedup_ctes('documents')}\nSELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM line_kept"}
