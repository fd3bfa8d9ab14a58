"""URL filter: rules by host and path, then a weighted vocabulary matched by Aho-Corasick.

Rules are looked up, not tried one by one: a host's suffixes, with the beginnings of the path as long as some rule of
that suffix, meet a table of rules of any size. Up to MAX_HELD_RULES rules every task holds them, and pages are judged
where they are read; more rules are met by a shuffle. The automaton finds all terms of the vocabulary in one pass over a url;
a term counts where it stands between boundaries (no letter or digit beside it), and once. A url is rejected if the
weights of its distinct terms reach 1: a strict term weighs 1, a soft one 1 / SOFT_LIMIT unless the vocabulary says
otherwise. Terms are in lower case; A-Z of the url are matched as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import free_name, named, read_table

STRICT = ("porn", "xxx", "xvideos", "hentai", "escort", "escorts", "camgirl", "camgirls", "nsfw", "milf", "adult-x", "pornhub", "sexcam", "onlycams")
SOFT = ("adult", "sex", "casino", "poker", "betting", "bet", "viagra", "cialis", "pills", "loan", "payday", "torrent", "crack", "warez", "keygen", "hack", "nude", "dating", "xx", "slots", "jackpot", "spam", "free-money", "malware", "phish")
SOFT_LIMIT = 2
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Terms of a vocabulary at most: every worker holds the automaton.
MAX_TERMS = 200_000
#: Rules up to this many (some 50 MB) are held by every worker; beyond, the lookup is a shuffle.
MAX_HELD_RULES = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of url. Host: after the first "://" up to / ? # or the end, A-Z in lower case; path: from there up
    to ? # or the end. Both empty where url is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def vocabulary_table(spark: SparkSession, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(term, weight): strict terms reject alone, soft_limit soft ones together."""
    return spark.createDataFrame([(t, 1.0) for t in strict] + [(t, 1.0 / soft_limit) for t in soft], "term string, weight double")


def _known(rules: DataFrame) -> DataFrame:
    """(s, start, said) of rules (host, path, verdict): hosts in lower case, and of rules that repeat the one that blocks."""
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("s"), F.coalesce("path", F.lit("")).alias("start"), "verdict").where("s <> ''")
    return known.groupBy("s", "start").agg(F.max("verdict").alias("said"))


def fitting_rules(parts: DataFrame, known: DataFrame) -> DataFrame:
    """(host, path, rule, said) of the longest of known rules (s, start, said) for each distinct host and path that one
    fits; rule is its host followed by its path.

    A rule fits its host and all hosts below it, if the path begins with the rule's. Of equally long rules that of the
    longer host wins.
    """
    lengths = known.groupBy("s").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = parts.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("s"))
    begun = keys.join(lengths, "s").select("host", "path", "s", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    met = begun.withColumn("start", F.substr("path", F.lit(1), F.col("n"))).join(known, ["s", "start"])
    best = F.max(F.struct((F.length("s") + F.col("n")).alias("length"), F.length("s").alias("host_length"), F.concat("s", "start").alias("rule"), "said"))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.said")


def held_rule(host: Column, path: Column, held: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, said) as fitting_rules finds it among held rules (s, start, said), inside the row; nulls if none fits."""

    @F.pandas_udf("rule string, said string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by_host: dict[str, dict[str, str]] = {}
        for s, start, said in held:
            by_host.setdefault(s, {})[start] = said
        lengths = {s: sorted({len(start) for start in paths}, reverse=True) for s, paths in by_host.items()}

        def longest(host: str, path: str) -> tuple[str | None, str | None]:
            best, found = (0, 0), (None, None)
            labels = host.split(".") if host else []
            for i in range(len(labels)):
                s = ".".join(labels[i:])
                for n in lengths.get(s, ()):
                    said = by_host[s].get(path[:n]) if n <= len(path) else None
                    if said is not None:
                        if (len(s) + n, len(s)) > best:
                            best, found = (len(s) + n, len(s)), (s + path[:n], said)
                        break  # shorter paths of the same host lose
            return found

        for hosts, paths in batches:
            yield pd.DataFrame([longest(h, p) for h, p in zip(hosts, paths)], columns=["rule", "said"], dtype=object)

    return find(host, path)


def term_hits(url: Column, terms: Sequence[tuple[str, float]]) -> Column:
    """struct(strict int, soft int, weight double) of the distinct terms between boundaries in url; zeros for null. A term
    is strict if its weight alone reaches 1."""

    @F.pandas_udf("strict int, soft int, weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for i, (term, _) in enumerate(terms):
            automaton.add_word(term, i)
        if terms:
            automaton.make_automaton()
        letters = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        table = str.maketrans(_UPPER, _LOWER)

        def count(url: str | None) -> tuple[int, int, float]:
            found = set()
            low = (url or "").translate(table)
            for end, i in automaton.iter(low) if terms else ():
                begin = end - len(terms[i][0])
                if (begin < 0 or low[begin] not in letters) and (end + 1 == len(low) or low[end + 1] not in letters):
                    found.add(i)
            hard = sum(terms[i][1] >= 1 for i in found)
            return hard, len(found) - hard, sum(terms[i][1] for i in found)

        for urls in batches:
            yield pd.DataFrame([count(u) for u in urls], columns=["strict", "soft", "weight"])

    return hits(url)


def judge_urls(pages: DataFrame, url_col: str = "url", rules: DataFrame | None = None, vocabulary: DataFrame | None = None, max_held: int = MAX_HELD_RULES) -> DataFrame:
    """pages with host, path, rule, n_strict, n_soft and verdict, which replace columns with such names.

    rules: (host, path, verdict), of any size: up to max_held of them are looked up inside the row, more by a shuffle of
    the distinct hosts and paths, with equal results; vocabulary: (term, weight), MAX_TERMS at most, or it is refused. The rule
    decides where one fits, else the vocabulary. A null or empty url, or one without "://", has empty host and path; no
    rule fits an empty host, and the vocabulary allows a null url. Null and empty terms and hosts of rules are ignored.
    Rows are judged one by one: repeats repeat, an empty table gives an empty result, and urls are read whole.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    vocabulary = vocabulary_table(spark) if vocabulary is None else vocabulary
    listed = vocabulary.where("term <> '' AND weight IS NOT NULL").groupBy("term").agg(F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()  # bounded
    if len(listed) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    terms = sorted((r["term"].translate(str.maketrans(_UPPER, _LOWER)), r["weight"]) for r in listed)
    new = ("host", "path", "rule", "n_strict", "n_soft", "verdict")
    old = [named(c) for c in pages.columns if c.lower() not in new]
    said_col, hits_col = free_name(pages, "_said"), free_name(pages, "_hits")
    host, path = url_parts(named(url_col))
    parts = pages.select(*old, host.alias("host"), path.alias("path"), term_hits(named(url_col), terms).alias(hits_col))
    known = _known(rules)
    held = [tuple(r) for r in known.limit(max_held + 1).collect()]  # bounded
    if len(held) <= max_held:
        fits = free_name(pages, "_fits")
        met = parts.withColumn(fits, held_rule(F.col("host"), F.col("path"), held))
        met = met.select(*[named(c) for c in parts.columns], F.col(fits)["rule"].alias("rule"), F.col(fits)["said"].alias(said_col))
    else:
        found = fitting_rules(parts, known).withColumnRenamed("said", said_col)
        empty = parts.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias(said_col))
        met = parts.where("host <> ''").join(found, ["host", "path"], "left").select(*[named(c) for c in parts.columns], "rule", named(said_col)).union(empty)
    hits = F.col(hits_col)
    bad = F.round(hits["weight"], 9) >= 1
    verdict = F.coalesce(said_col, F.when(bad, "block").otherwise("allow"))
    return met.select(*old, "host", "path", "rule", hits["strict"].alias("n_strict"), hits["soft"].alias("n_soft"), verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    low = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"
    hit = lambda t: f"regexp_matches({low}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    return f"""
WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         {" + ".join(map(hit, STRICT))} AS n_strict, {" + ".join(map(hit, SOFT))} AS n_soft
  FROM rest)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {said} END, CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {"op5_url_filter": _oracle()}
