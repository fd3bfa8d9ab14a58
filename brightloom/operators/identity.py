"""Who is who: company aliases, tracker matches, history gates, fuzzy roles, url sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, host_of, text_key, without_marks
from brightloom.operators.dedup import dealt

# Statuses by what they mean for a new posting of the same role.
HARD_STATUSES = ("applied", "responded", "interview", "offer", "rejected", "no-response")
# Words of titles by what they say of a role.
SENIORITIES = ("junior", "mid", "middle", "senior", "staff", "principal", "lead", "head", "chief", "associate", "intern", "entry")
# Levels below the bare title: one of them on one side alone is another role.
SUB_BASELINE = ("associate", "junior", "entry", "intern")
# Besides seniorities: words that say nothing of a role's subject.
STOPWORDS = (
    "level", "remote", "hybrid", "onsite", "contract", "contractor", "freelance", "fulltime", "parttime", "permanent", "temporary", "internship",
    "role", "position", "opportunity", "team", "based", "repost", "reposted", "relisted",
    "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "pune", "chennai", "london", "berlin", "paris", "madrid", "barcelona", "amsterdam", "dublin",
    "york", "francisco", "seattle", "boston", "austin", "chicago", "toronto", "tokyo", "singapore", "sydney", "melbourne", "lisbon", "warsaw",
    "europe", "emea", "apac", "latam", "americas", "india", "spain", "germany", "france", "italy", "canada", "brazil", "mexico", "japan",
    "with", "from", "into", "over", "this", "that",
)
# Short words that tell roles apart; "ai" and "ml" stand in too many titles for that.
SPECIALTIES = ("api", "sre", "sdk", "cli", "gpu", "cpu", "ios", "qa", "ux", "ui", "ar", "vr", "ocr", "crm", "erp")
# Words that many roles share: alone they make no match.
BASELINE = (
    "software", "engineer", "developer", "manager", "architect", "analyst", "designer", "consultant", "specialist", "platform", "systems", "services",
    "backend", "frontend", "full", "stack", "fullstack", "product",
)
# A level in front of a title at some companies, and the baseline word that it stands for.
LEVEL_PHRASE, LEVEL_WORD = "member of technical staff", "engineer"


def resolve_company(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Df with company_id and how it was found: exact, segment (of a name such as "A / B" or "A (B)"), ambiguous,
    unmapped. aliases: alias, company_id; an alias that two companies claim is no alias."""
    own = owner_of(df, aliases)
    known = aliases.select(*own, company_key(F.col("alias")).alias("k"), "company_id").where("k <> ''").groupBy(*own, "k").agg(F.min("company_id").alias("id"), F.max("company_id").alias("other")).where("id = other").select(*own, "k", "id")
    keyed = df.withColumn("_key", company_key(F.col("company")))
    exact = keyed.join(known.select(*own, F.col("k").alias("_key"), F.col("id").alias("_exact")), [*own, "_key"], "left")
    names = df.select(*own, "company").distinct()
    pieces = names.select(*own, "company", F.explode(F.split("company", r"[/()]")).alias("piece")).select(*own, "company", company_key(F.col("piece")).alias("k"))
    found = pieces.join(known, [*own, "k"]).groupBy(*own, "company").agg(F.collect_set("id").alias("ids"))
    met = exact.join(found, [*own, "company"], "left")
    one = F.size("ids") == 1
    return (
        met.withColumn("company_id", F.coalesce("_exact", F.when(one, F.col("ids")[0])))
        .withColumn("resolution", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("ids").isNull(), "unmapped").when(one, "segment").otherwise("ambiguous"))
        .select(*df.columns, "company_id", "resolution")
    )


def role_tokens(title: Column) -> Column:
    """Distinct words of a title that tell roles apart: over three letters and no stopword, or a known short specialty.

    Accents go. The level "member of technical staff" counts as the baseline word "engineer", so that it alone neither makes
    a match nor leaves a title without words. Signs of one to three letters or digits joined by a slash are one word ("ci/cd").
    """
    level = rf"(?<![a-z0-9_]){LEVEL_PHRASE.replace(' ', '\\s+')}(?![a-z0-9_])"
    low = F.regexp_replace(without_marks(F.lower(F.coalesce(title, F.lit("")))), level, f" {LEVEL_WORD} ")
    low = F.regexp_replace(low, r"(?<![a-z0-9_])([a-z0-9]{1,3})/([a-z0-9]{1,3})(?![a-z0-9_])", "$1$2")
    telling = lambda t: ((F.length(t) > 3) & ~t.isin(*STOPWORDS, *SENIORITIES)) | t.isin(*SPECIALTIES)
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), telling))


def role_of(title: Column) -> Column:
    """What roles_match compares: the title's text, its seniorities and its other tokens."""
    text = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    levels = F.array_distinct(F.filter(F.split(without_marks(text), "[^a-z0-9]+"), lambda t: t.isin(*SENIORITIES)))
    return F.struct(text.alias("text"), levels.alias("levels"), F.filter(role_tokens(title), lambda t: ~t.isin(*SENIORITIES)).alias("tokens"))


def roles_match(a: Column, b: Column) -> Column:
    """J10 on role_of: equal texts; else seniorities that agree, two shared tokens of which one is no baseline word,
    Jaccard of 0.6 or more, and no proper subset that lacks a word other than baseline words."""
    ta, tb = a["tokens"], b["tokens"]
    shared, union = F.array_intersect(ta, tb), F.array_union(ta, tb)
    telling = lambda words: F.exists(words, lambda t: ~t.isin(*BASELINE))
    both = (F.size(a["levels"]) > 0) & (F.size(b["levels"]) > 0)
    # with one side empty the union is the lone side
    below = F.exists(F.array_union(a["levels"], b["levels"]), lambda t: t.isin(*SUB_BASELINE))
    levels = F.when(both, F.arrays_overlap(a["levels"], b["levels"])).otherwise(~below)
    subset = (F.size(ta) != F.size(tb)) & (F.size(shared) == F.least(F.size(ta), F.size(tb)))
    marked = subset & telling(F.array_except(union, shared))
    alike = levels & (F.size(shared) >= 2) & telling(shared) & ~marked & (F.size(shared) / F.size(union) >= 0.6)
    return ((a["text"] != "") & (a["text"] == b["text"])) | alike


def alike_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(k, at, bt): distinct titles of one company that match; of (k, at) and (k, bt). They meet in a telling token, or
    in their whole text."""

    own = owner_of(left, right)

    def keyed(df: DataFrame, title: str, role: str) -> DataFrame:
        named = df.select(*own, "k", title).distinct().withColumn(role, role_of(F.col(title)))
        keys = F.array_append(F.filter(F.col(role)["tokens"], lambda t: ~t.isin(*BASELINE)), F.concat(F.lit("="), F.col(role)["text"]))
        return named.withColumn("key", F.explode_outer(keys))

    met = keyed(left, "at", "ra").join(dealt(keyed(right, "bt", "rb")), [*own, "k", "key"])
    return met.where(roles_match(F.col("ra"), F.col("rb"))).select(*own, "k", "at", "bt").distinct()


def fuzzy_role_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) of one company with alike roles; columns id, company, title. Blank companies never match.

    Titles are compared once for each pair of distinct titles of a company, then ids join on.
    """
    own = owner_of(a, b)
    left = a.select(*own, F.col("id").alias("a_id"), company_key(F.col("company")).alias("k"), F.col("title").alias("at")).where("k <> ''")
    right = b.select(*own, F.col("id").alias("b_id"), company_key(F.col("company")).alias("k"), F.col("title").alias("bt")).where("k <> ''")
    alike = alike_titles(left, right)
    return left.join(alike, [*own, "k", "at"]).join(right, [*own, "k", "bt"]).select(*own, "a_id", "b_id")


def fuzzy_role_classes(df: DataFrame) -> DataFrame:
    """J10 over a whole table (company, title): (k, at, bt), at before bt, the alike distinct titles of a company. Company key
    and title of a row name its class, so rows that repeat a title are not paired."""
    titles = df.select(*owner_of(df), company_key(F.col("company")).alias("k"), F.col("title").alias("at")).where("k <> ''")
    return alike_titles(titles, titles.withColumnRenamed("at", "bt")).where("at < bt")


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The newest `top` numbers of each key; Spark cuts the ranks before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc("num"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")


def tracker_matches(postings: DataFrame, tracker: DataFrame, top: int = 3) -> DataFrame:
    """For each posting (posting_id, company, title) its best rows of the tracker in the same company: those of
    the same role first, then the newest number; rank from 1 to top.

    The tracker is cut to the newest rows of each company and role, and of each company, before postings join on it:
    no more of them can be among the best. Where the tracker has owners and the postings have none, every owner of a
    matching row gets ranks of their own.
    """
    own = owner_of(tracker)
    both = owner_of(postings, tracker) if owner_of(postings) else []
    p = postings.select(*both, "posting_id", company_key(F.col("company")).alias("k"), text_key(F.col("title")).alias("pr")).where("k <> ''")
    t = tracker.select(*own, "num", "status", company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("tr")).where("k <> ''")
    columns = [*own, "posting_id", "num", "status"]
    same = p.join(_best(t, [*own, "k", "tr"], top).withColumnRenamed("tr", "pr"), [*both, "k", "pr"]).select(*columns, F.lit(True).alias("same_role"))
    other = p.join(_best(t, [*own, "k"], top), [*both, "k"]).where("pr <> tr").select(*columns, F.lit(False).alias("same_role"))
    w = W.partitionBy(*own, "posting_id").orderBy(F.desc("same_role"), F.desc("num"))
    return same.union(other).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def history_gate(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """(posting_id, gate): same_role_<status> for the newest row of the same role in a hard status, else
    same_company_prior_application for any hard status of the company, else eligible. Only an owner's own rows count.

    The tracker is summed by company, and by company and role, before the join, so that pairs are never made.
    """
    own = owner_of(postings, tracker)
    hard = tracker.where(F.col("status").isin(*HARD_STATUSES)).select(*own, "num", "status", company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("r")).where("k <> ''")
    by_role = hard.groupBy(*own, "k", "r").agg(F.max_by("status", "num").alias("role_status"))
    by_company = hard.select(*own, "k").distinct().withColumn("prior", F.lit(True))
    p = postings.select(*own, "posting_id", company_key(F.col("company")).alias("k"), text_key(F.col("title")).alias("r"))
    met = p.join(by_role, [*own, "k", "r"], "left").join(by_company, [*own, "k"], "left")
    gate = F.when(F.col("role_status").isNotNull(), F.concat(F.lit("same_role_"), "role_status")).when(F.col("prior"), "same_company_prior_application").otherwise("eligible")
    return met.select(*own, "posting_id", gate.alias("gate"))


def gate_stats(gated: DataFrame, examples: int = 5) -> DataFrame:
    """A10: rows by gate with the least ids as examples."""
    keys = [*owner_of(gated), "gate"]
    w = W.partitionBy(*keys).orderBy("posting_id")
    counts = gated.groupBy(*keys).agg(F.count("*").alias("n"))
    few = gated.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= examples).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("posting_id")).cast("array<string>"), ",").alias("examples"))
    return counts.join(few, keys)


def classify_source(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Df with source, that of the first rule (domain, source, pos) whose domain is the url's host or above it;
    without one the last two labels of the host."""
    hosts = df.select(host_of(F.col("url")).alias("h")).where("h IS NOT NULL").distinct()
    labels = F.split("h", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.select("h", F.explode(tails).alias("domain")).join(rules, "domain").groupBy("h").agg(F.min_by("source", "pos").alias("_source"))
    met = df.withColumn("_h", host_of(F.col("url"))).join(named, F.col("_h") == F.col("h"), "left")
    parts = F.split("_h", r"\.")
    base = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return met.withColumn("source", F.coalesce("_source", base)).drop("_h", "h", "_source")


def route_source(df: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Df with family of the first pattern (family, regular expression) that the url matches; group 1 is the slug."""
    family = slug = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        hit = F.col("url").rlike(pattern)
        family, slug = F.when(hit, name).otherwise(family), F.when(hit, F.regexp_extract("url", pattern, 1)).otherwise(slug)
    return df.withColumns({"family": family, "slug": slug})


def slug_candidates(company: Column) -> Column:
    """Names under which a company may have a board, in order: joined, dashed, underscored, first word."""
    words = F.filter(F.split(F.lower(company), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(words, "_"), F.coalesce(F.get(words, F.lit(0)), F.lit(""))))


def match_by_alias(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(item_id, decision_id, status): the newest decision that shares any alias with an item.

    Columns: item_id, aliases; decision_id, aliases, status, updated_at.
    """
    by = owner_of(items, decisions)
    own = items.select(*by, "item_id", F.explode(F.array_distinct("aliases")).alias("alias"))
    made = decisions.select(*by, "decision_id", "status", "updated_at", F.explode(F.array_distinct("aliases")).alias("alias"))
    newest = F.max_by(F.struct("decision_id", "status"), F.struct("updated_at", "decision_id"))
    # one decision for each alias is enough: the newest of all is the newest of its alias
    made = made.groupBy(*by, "alias").agg(F.max_by(F.struct("decision_id", "status", "updated_at"), F.struct("updated_at", "decision_id")).alias("d")).select(*by, "alias", "d.*")
    return own.join(made, [*by, "alias"]).groupBy(*by, "item_id").agg(newest.alias("d")).select(*by, "item_id", "d.decision_id", "d.status")


def unique_match(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """(posting_id, num) where exactly one row of the tracker has the posting's company and role keys."""
    own = owner_of(postings, tracker)
    t = tracker.select(*own, "num", company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("r")).where("k <> '' AND r <> ''")
    single = t.groupBy(*own, "k", "r").agg(F.min("num").alias("num"), F.count("*").alias("n")).where("n = 1").drop("n")
    p = postings.select(*own, "posting_id", company_key(F.col("company")).alias("k"), text_key(F.col("title")).alias("r"))
    return p.join(single, [*own, "k", "r"]).select(*own, "posting_id", "num")
