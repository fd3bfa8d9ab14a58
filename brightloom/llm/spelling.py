"""Spelling variant grouping: PartEnum signatures of letter multisets, joined on equality and verified.

One inserted, deleted or replaced letter changes the multiset of a word's letters, taken as a binary vector with a place
for every (letter, occurrence), in at most two places. The places are dealt to PARTS parts by a hash. Two vectors within
a Hamming distance of two agree on all but two parts, so they share the signature of at least one choice of PARTS - 2
parts (partition and enumerate; Arasu, Ganti and Kaushik, "Efficient Exact Set-Similarity Joins", 2006). Words that share
a signature are verified by their edit distance:

* up to GROUP words of a signature are compared inside its list, and only near pairs become rows;
* words of a larger one are joined on what is left of them without one letter, too. At most (length + 1) x (letters)
  words leave the same rest, whatever the size of the vocabulary, and near words always share one: exact, no pairs.

Built-in functions alone. Words are counted before the shuffle, so the most frequent one is a row for each task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import named, read_table, written

#: Letters of a word; fixed by the query's contract.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = 6
#: Words of one signature that are compared in its list. It decides how near words meet, never whether.
GROUP = 64


def _without(word: Column, at: Column) -> Column:
    """word without its code point at place `at`, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = 199, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n) of the words of all texts that have least_length code points and least_n occurrences.

    Words are runs of LETTERS, with only A-Z lower-cased. A run loses the code point h % length if typo_every divides h,
    the crc32 of `<id>:<run>` (a planted slip, so that variants exist; 0 plants none). Null and empty texts have no words;
    a null id counts as empty text; a row that repeats counts again; texts are read whole, whatever their length.
    """
    found = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), named(text_col).alias("text"))
    found = found.select("id", F.explode_outer(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run")).where(F.char_length("run") >= least_length)
    # lower() changes more than A-Z, but what it leaves alone has no A-Z
    run = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    found = found.select("id", run.alias("run"))
    word = F.col("run")
    if typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        found = found.select("run", h.alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % typo_every == 0, _without(F.col("run"), at)).otherwise(F.col("run"))
    found = found.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def signatures(word: Column, parts: int = PARTS) -> Column:
    """Array of the signatures of word: one for each choice of parts - 2 parts."""
    letters = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))
    places = F.transform(letters, lambda c, i: F.xxhash64(c, i + 1 - F.array_position(letters, c)))
    of_part = lambda p: F.filter(places, lambda x: F.pmod(x, F.lit(parts)) == p)
    chosen = [of_part(p) for p in range(parts)]
    return F.array(*[F.xxhash64(F.lit(k), *[chosen[p] for p in c]) for k, c in enumerate(combinations(range(parts), parts - 2))])


def near_words(words: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """Distinct (word, n, near, near_n), in both directions, of words at an edit distance of exactly one.

    words: (word, n), words distinct and not null.
    """
    signed = words.select("word", "n", signatures(F.col("word"), parts).alias("s"))
    keyed = written(signed.select("word", "n", F.explode_outer("s").alias("s")))
    met = written(keyed.join(keyed.groupBy("s").agg(F.count("*").alias("size")).where("size > 1"), "s"))
    listed = met.where(F.col("size") <= group).groupBy("s").agg(F.collect_list(F.struct("word", "n")).alias("all"))
    listed = listed.select(F.explode("all").alias("x"), "all")
    one = lambda a, b: F.levenshtein(a, b, 1) == 1
    # explode_outer: for explode, Spark would infer a filter on the array and compute it twice
    pairs = listed.select("x", F.explode_outer(F.filter("all", lambda y: (y["word"] < F.col("x.word")) & one(y["word"], F.col("x.word")))).alias("y")).where("y IS NOT NULL")
    hot = met.where(F.col("size") > group)
    # a word and what is left of it without each of its letters
    every = F.transform(F.sequence(F.lit(0), F.char_length("word") - 1), lambda i: _without(F.col("word"), i))
    rests = hot.select("s", F.struct("word", "n").alias("x"), F.explode_outer(F.array_distinct(F.concat(F.array("word"), every))).alias("rest"))
    other = rests.select(F.col("s").alias("s2"), F.col("x").alias("y"), F.col("rest").alias("rest2"))
    same = (F.col("s") == F.col("s2")) & (F.col("rest") == F.col("rest2"))
    more = rests.join(other, same & (F.col("y.word") < F.col("x.word")) & one(F.col("x.word"), F.col("y.word"))).select("x", "y")
    both = pairs.union(more).distinct().select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", "p.x.n", F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form) of forms, none of which leads back: root is the last form that follows.

    Paths are halved in each round, so rounds grow with the logarithm of their length.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = written(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_groups(words: DataFrame, times: int = 5, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n), words distinct and not null.

    form is the near word of largest n (of equals, the least in code-point order) if that n is at least times the word's,
    else null; root is where forms lead, the word itself if nowhere. An empty table gives no rows. Columns of words other
    than these two are not read.
    """
    words = written(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near"))
    near = written(near_words(words, parts, group).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best")))
    able = -F.col("best.down") >= times * F.col("n")
    near = near.select(F.col("word").alias("w"), "n_near", F.when(able, F.col("best.near")).alias("form"), F.when(able, -F.col("best.down")).alias("form_n"))
    last = roots(near.where("form IS NOT NULL").select(F.col("w").alias("word"), "form")).select(F.col("word").alias("v"), "root")
    found = words.join(near, F.col("word") == F.col("w"), "left").join(last, F.col("word") == F.col("v"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(read_table(spark, sf_dir, "documents")))


QUERIES = {"op11_spelling": op11_spelling}
ORACLES: dict[str, str] = {}
