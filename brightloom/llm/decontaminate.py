"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

An item of n shingles that a document contains to at least the threshold t lacks at most n - ceil(t n) of them. Items
are partitioned by size so that all of a partition may lack the same number, p; their sketch is the p + 1 shingles of
least order (bottom-k), one of which at least is in any document that contains the item. The order is by the number of
items that have a shingle, then by hash: what many items share (a common prompt) is only in a sketch if the item has
too little else for a document with the shared part to miss the threshold. The sketches are searched in the shingle
hashes of whole documents, documents too short for an item are pruned by size, and every pair that is found is verified
by the exact share of the item's shingles that the document has.

Shingles have WIDTH words; an item of fewer words is one shingle of all its words, looked up among the document's
shingles of that width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import checkpointed, free_name, named, read_table, row_key

WIDTH, THRESHOLD = 5, 0.8
#: Sketches and pairs up to this many rows (32 MB) are broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000


def normalised_words(text: Column) -> Column:
    """Words of letters, marks and digits in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), " ")


def _shingled(df: DataFrame, keep: list[str], text_col: str, widths: Sequence[int], hashed: bool, whole: bool = False) -> DataFrame:
    """keep, `n_words` and `shingles`: the distinct shingles of each of widths; whole: of the greatest that the text has
    words for. Null where there are none.

    Callers explode with explode_outer: for explode, Spark would infer a filter on the array and push it below the
    projection, where it splits the text again for every shingle.
    """
    worded = df.select(*keep, normalised_words(F.col(text_col)).alias("words"))
    worded = worded.select(*keep, "words", F.coalesce(F.when(F.get("words", F.lit(0)) != "", F.size("words")), F.lit(0)).alias("n_words"))
    empty = F.array().cast("array<bigint>" if hashed else "array<string>")

    def of_width(width: int) -> Column:
        at = lambda i: [F.get("words", i + k) for k in range(width)]
        one = (lambda i: F.xxhash64(*at(i))) if hashed else (lambda i: F.concat_ws(" ", *at(i)))
        enough = F.col("n_words") >= width
        if whole and width < max(widths):
            enough = F.col("n_words") == width
        return F.when(enough, F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n_words") - width), one))).otherwise(empty)

    every = F.concat(*[of_width(w) for w in widths]) if len(widths) > 1 else of_width(widths[0]) if widths else empty
    return worded.select(*keep, "n_words", every.alias("shingles"))


def _least(n: Column, threshold: float) -> Column:
    """The number of shingles of n that reach the threshold. The product is rounded so that 0.8 * 5 is 4."""
    return F.ceil(F.round(n * threshold, 6)).cast("int")


def item_sketches(items: DataFrame, item_col: str, text_col: str, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(item, n, least, width, size_part, h): one row for each hash of an item's sketch."""
    texts = items.select(named(item_col).alias("item"), named(text_col).alias("text"))
    sized = _shingled(texts, ["item"], "text", range(1, width + 1), True, whole=True).select("item", F.least("n_words", F.lit(width)).alias("width"), F.size("shingles").alias("n"), "shingles")
    each = sized.select("item", "width", "n", F.explode_outer("shingles").alias("h")).where("h IS NOT NULL")
    common = each.groupBy("h").agg(F.count("*").alias("having"))
    rows = each.join(common, "h").groupBy("item", "width", "n").agg(F.array_sort(F.collect_list(F.struct("having", "h"))).alias("hs"))
    rows = rows.select("item", "n", _least(F.col("n"), threshold).alias("least"), "width", "hs").withColumn("size_part", F.col("n") - F.col("least"))
    return rows.select("item", "n", "least", "width", "size_part", F.explode(F.slice("hs", F.lit(1), F.col("size_part") + 1)).alias("x")).select("item", "n", "least", "width", "size_part", "x.h")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(k1, k2, id, item, n_shared, n_item, containment) for every document and item at or over the threshold.

    k1 and k2 stand for the row of docs (common.row_key); rows that repeat id and text are one. Texts are compared as
    words of letters and digits in lower case. Null texts and texts without such words have no shingle and match
    nothing; an item of fewer than `width` words is contained where they stand in a row. Items that repeat an id are
    each compared on their own, and the best counts. Null ids are kept as they are. Either table may be empty. Texts
    are read whole, whatever their length.
    """
    tests = items.select(*row_key(item_col, item_text_col), named(item_col).alias("item"), named(item_text_col).alias("text"))
    tests = tests.select(F.struct("k1", "k2", "item").alias("item"), "text")
    sketches = checkpointed(item_sketches(tests, "item", "text", width, threshold))
    widths = sorted(r["width"] for r in sketches.select("width").distinct().collect())  # `width` numbers at most
    rows = docs.select(*row_key(id_col, text_col), named(id_col).alias("id"), named(text_col).alias("text"))
    hashed = _shingled(rows, ["k1", "k2"], "text", widths, True)
    hashed = hashed.select("k1", "k2", "n_words", F.explode_outer("shingles").alias("h"))
    found = hashed.join(_bounded(sketches), "h").where(F.col("n_words") - F.col("width") + 1 >= F.col("least"))
    found = checkpointed(found.select("k1", "k2", "item", "n", "least").distinct())
    # the exact check: of whole texts of the documents found, the shingles that any item has, against those of the items found
    near = rows.join(_bounded(found.select("k1", "k2").distinct()), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    exact = _shingled(near, ["k1", "k2", "id"], "text", widths, False).select("k1", "k2", "id", F.explode_outer("shingles").alias("shingle"))
    own = _shingled(tests, ["item"], "text", range(1, width + 1), False, whole=True).select("item", F.explode_outer("shingles").alias("shingle"))
    own = checkpointed(own.where("shingle IS NOT NULL").distinct())
    exact = exact.join(_bounded(own.select("shingle").distinct()), "shingle")
    met = exact.join(found.join(_bounded(own), "item"), ["k1", "k2", "shingle"])
    shared = met.groupBy("k1", "k2", "id", "item", "n", "least").agg(F.count("*").alias("n_shared")).where("n_shared >= least")
    best = shared.groupBy("k1", "k2", "id", F.col("item.item").alias("item")).agg(
        F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", F.col("n").alias("n_item"))).alias("m")
    )
    return best.select("k1", "k2", "id", "item", "m.n_shared", "m.n_item", "m.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that contain an item; all columns stay. See contained_items for the cases and options."""
    hits = checkpointed(contained_items(docs, items, id_col, text_col, **how).select(F.col("k1").alias("c1"), F.col("k2").alias("c2")).distinct())
    k1, k2 = (free_name(docs, x) for x in ("_k1", "_k2"))
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(id_col, text_col))))
    return keyed.join(_bounded(hits), (keyed[k1] == hits["c1"]) & (keyed[k2] == hits["c2"]), "left_anti").drop(k1, k2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_item", "containment")


def contained_ctes(docs: str) -> str:
    """CTEs after which the relation `hits` has the pairs of contained_items. Rows of docs have unique ids."""
    words = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    return f"""
item_w AS (SELECT item_id, w, least(len(w), {WIDTH}) AS k FROM (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
item_s AS (SELECT DISTINCT item_id, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM item_w)),
item_n AS (SELECT item_id, count(*)::INT AS n_item FROM item_s GROUP BY 1),
doc_w AS (SELECT doc_id, w, k FROM (SELECT doc_id, {words} AS w FROM {docs} WHERE text IS NOT NULL), (SELECT DISTINCT k FROM item_w) WHERE len(w) >= k),
doc_s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc_w)),
hits AS (
  SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
  FROM doc_s JOIN item_s USING (s) JOIN item_n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= ceil(round(any_value(n_item) * {THRESHOLD}, 6)))"""


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": f"WITH {contained_ctes('documents')}\nSELECT * FROM hits"}
