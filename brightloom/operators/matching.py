"""Tracker rows of postings by stages: their own number, shared aliases, then company and role; concrete postings that
differ are never taken for each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, cooldown_url, text_key
from brightloom.operators.dedup import checkpointed, dealt

# Portals whose subdomains are one source, and what the path of any other posting holds.
PROVIDERS = ("wanted.co.kr", "rememberapp.co.kr", "saramin.co.kr", "jobkorea.co.kr", "linkedin.com", "greetinghr.com", "ninehire.com")
POSTING_PATH = r"(?i)job|career|recruit"


def _reference(alias: Column) -> Column:
    """"source url" of an alias that is the url of a concrete posting, else null."""
    url = cooldown_url(alias)
    host = F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    provider = F.lit(None).cast("string")
    for domain in PROVIDERS:
        provider = F.when((host == domain) | host.endswith(f".{domain}"), domain).otherwise(provider)
    other = F.when(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1).rlike(POSTING_PATH), host)
    return F.when(host != "", F.concat(F.coalesce(provider, other), F.lit(" "), url))


def posting_refs(aliases: Column) -> Column:
    """The concrete postings among aliases, as sorted texts of source and url."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), _reference))))


def _sources(refs: Column) -> Column:
    return F.array_distinct(F.transform(refs, lambda r: F.substring_index(r, " ", 1)))


def conflicting(a: Column, b: Column) -> Column:
    """Whether two lists of posting_refs name different postings of a source that both name."""
    return F.size(F.array_except(F.array_intersect(_sources(a), _sources(b)), _sources(F.array_intersect(a, b)))) > 0


def _one_row() -> list[Column]:
    """n and num over groups (n, tid, num) of rows that may share rows: n is 1 if all of them are one and the same row."""
    one = (F.max("n") == 1) & (F.min("tid") == F.max("tid"))
    return [F.when(one, 1).otherwise(F.greatest(F.max("n"), F.lit(2))).alias("n"), F.min("num").alias("num")]


def staged_match(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """(posting_id, num, how) of postings (posting_id, company, title, tracker_num, aliases) whose row of the
    tracker (num, company, role, aliases) is certain.

    The first stage with one row that fits decides: "number", the posting's own tracker_num; "alias", a shared alias;
    "exact", equal company and role keys. A row that names another posting of the same source never fits. Null numbers,
    aliases and blank keys match nothing; rows of the tracker are told apart by num, and a num that repeats is no certain
    row. Stages after the first work on distinct postings and distinct rows: those with equal keys and aliases count as one
    with a weight, and a posting meets the rows of one alias (or url) with equal urls as one group. In the last stage, rows
    that name no source of the posting's fit without a look at urls, and are only counted by their sets of sources; the
    others fit only if they share a url, which is a join on the url.
    """
    own = owner_of(postings, tracker)
    clean = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>")))))
    key = lambda company, role: F.concat_ws("\u0001", *[F.nullif(k, F.lit("")) for k in (company, role)])
    keyed = lambda df, role: df.withColumns({"_k": company_key(F.col("company")), "_r": text_key(F.col(role)), "al": clean("aliases")}).select(
        *own, *[c for c in ("posting_id", "tracker_num", "num") if c in df.columns], "al", posting_refs(F.col("al")).alias("refs"), F.when((F.col("_k") != "") & (F.col("_r") != ""), key(F.col("_k"), F.col("_r"))).alias("k")
    )
    p, t = checkpointed(keyed(postings, "title")), checkpointed(keyed(tracker, "role"))

    numbered = t.where("num IS NOT NULL").groupBy(*own, "num").agg(F.count("*").alias("n"), F.first("refs").alias("t_refs")).where("n = 1").drop("n")
    first = p.join(dealt(numbered.withColumnRenamed("num", "tracker_num")), [*own, "tracker_num"]).where(~conflicting(F.col("refs"), F.col("t_refs")))
    first = first.select(*own, "posting_id", F.col("tracker_num").alias("num"), F.lit("number").alias("how"))

    # what stages two and three look at: one row for each owner, key and list of aliases
    ids = F.struct(*own, "k", "al")
    ps = p.join(dealt(first.select(*own, "posting_id")), [*own, "posting_id"], "left_anti").withColumn("pid", F.sha2(F.to_json(ids), 256))
    asked = checkpointed(ps.groupBy("pid").agg(*[F.first(c).alias(c) for c in (*own, "k", "al", "refs")]))
    rows = t.groupBy(*own, "k", "al", "refs").agg(F.count("*").alias("n"), F.min("num").alias("num"))
    rows = checkpointed(rows.withColumn("tid", F.sha2(F.to_json(ids), 256)).withColumnsRenamed({"refs": "t_refs"}))

    # rows that share an alias and their own urls fit the same postings: they meet a posting as one group
    grouped = lambda df, by: df.groupBy(*own, *by, "t_refs").agg(F.sum("n").alias("n"), F.min("tid").alias("tid"), F.min("num").alias("num"))
    owned = grouped(rows.select(*own, F.explode_outer("al").alias("a"), "t_refs", "n", "tid", "num").where("a IS NOT NULL"), ["a"])
    shared = asked.select(*own, "pid", "refs", F.explode_outer("al").alias("a")).where("a IS NOT NULL").join(dealt(owned), [*own, "a"])
    met = shared.where(~conflicting(F.col("refs"), F.col("t_refs"))).groupBy("pid").agg(*_one_row())
    second = checkpointed(met.where("n = 1 AND num IS NOT NULL").select("pid", "num", F.lit("alias").alias("how")))

    left = asked.where("k IS NOT NULL").join(dealt(second.select("pid")), "pid", "left_anti").withColumn("src", _sources(F.col("refs")))
    named = rows.where("k IS NOT NULL")
    sets = named.groupBy(*own, "k", F.array_sort(_sources(F.col("t_refs"))).alias("t_src")).agg(F.sum("n").alias("n"), F.min("num").alias("num"))
    apart = left.select(*own, "k", "pid", "src").join(dealt(sets), [*own, "k"]).where(~F.arrays_overlap("src", "t_src")).select("pid", "n", "num")
    linked = grouped(named.select(*own, "k", F.explode_outer("t_refs").alias("u"), "t_refs", "n", "tid", "num").where("u IS NOT NULL"), ["k", "u"])
    by_url = left.select(*own, "k", "pid", "refs", F.explode_outer("refs").alias("u")).where("u IS NOT NULL").join(dealt(linked), [*own, "k", "u"])
    same = by_url.where(~conflicting(F.col("refs"), F.col("t_refs"))).groupBy("pid").agg(*_one_row()).select("pid", "n", "num")
    third = apart.union(same).groupBy("pid").agg(F.sum("n").alias("n"), F.min("num").alias("num")).where("n = 1 AND num IS NOT NULL").select("pid", "num", F.lit("exact").alias("how"))
    found = ps.select(*own, "posting_id", "pid").join(dealt(second.union(third)), "pid").select(*own, "posting_id", "num", "how")
    return first.union(found)
