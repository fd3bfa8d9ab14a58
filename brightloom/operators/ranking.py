"""Freshness, cooldowns, liveness, evidence, scores and order of candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.text import cooldown_url


def annotate_liveness(df: DataFrame, state: DataFrame, now: Column, ttl_hours: int) -> DataFrame:
    """Df with live, the state (url, status, checked_at) of its url; expired counts only within ttl_hours before now."""
    latest = state.groupBy("url").agg(F.max_by("status", F.struct("checked_at", "status")).alias("_s"), F.max("checked_at").alias("_at")).withColumnRenamed("url", "_u")
    met = df.join(latest, df["url"] == latest["_u"], "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("_at")
    live = F.when(F.col("_s") != "expired", F.col("_s")).when(age.between(0, ttl_hours * 3600), "expired")
    return met.withColumn("live", F.coalesce(live, F.lit("unknown"))).drop("_u", "_s", "_at")


def annotate_cooldown(df: DataFrame, recommended: DataFrame, now: Column, days: int) -> DataFrame:
    """Df with cooling and until: was its canonical url recommended (url, at) within so many days before now?"""
    last = recommended.groupBy(cooldown_url(F.col("url")).alias("_u")).agg(F.max("at").alias("_at"))
    met = df.join(last, cooldown_url(df["url"]) == last["_u"], "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("_at")
    cooling = F.coalesce((age >= 0) & (age < days * 86400), F.lit(False))
    return met.withColumn("cooling", cooling).withColumn("until", F.when(cooling, F.date_add(F.to_date("_at"), days))).drop("_u", "_at")


def annotate_freshness(df: DataFrame, meta: DataFrame, today: Column) -> DataFrame:
    """Df (key, posted_at) with first_seen of meta (key, first_seen), the date to show and the origin."""
    first = meta.groupBy(F.col("key").alias("_k")).agg(F.min("first_seen").alias("first_seen"))
    met = df.join(first, df["key"] == first["_k"], "left").drop("_k")
    seen = F.coalesce("first_seen", today)
    return met.withColumn("shown_date", F.coalesce("posted_at", "first_seen")).withColumn("origin", F.when(seen == today, "pending_new").otherwise("pending_backlog"))


def recommendable(df: DataFrame) -> DataFrame:
    """df (live, verified, cooling) with eligible and method of its verification."""
    method = F.when((F.col("live") == "active") & F.col("verified"), "direct").when(F.col("live") == "active", "source").otherwise("none")
    return df.withColumn("method", method).withColumn("eligible", (F.col("live") != "expired") & (method != "none") & ~F.col("cooling"))


def fresh_only(df: DataFrame, now: Column, hours: int = 72, skew_seconds: int = 300) -> DataFrame:
    """rows checked from skew_seconds after now (clocks differ) to so many hours before."""
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    return df.where(age.between(-skew_seconds, hours * 3600))


def match_facts(df: DataFrame, facts: Mapping[str, Sequence[str]], fields: Sequence[str]) -> DataFrame:
    """Df with facts, the ids of the facts of which a term stands between boundaries in a field. The facts are a
    profile's and few; each is one regular expression in the projection, so nothing is joined."""
    def has(terms: Sequence[str]) -> Column:
        quoted = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in t.strip().lower()) for t in terms if t.strip())
        pattern = rf"(?<![a-z0-9])(?:{quoted})(?![a-z0-9])"
        found = F.lit(False)
        for f in fields:
            found = found | F.coalesce(F.lower(f).rlike(pattern), F.lit(False))
        return found

    return df.withColumn("facts", F.array_compact(F.array(*[F.when(has(t), F.lit(i)) for i, t in facts.items()])))


def profile_fit(df: DataFrame, preferred: str = "senior", secondary: str = "mid") -> DataFrame:
    """L2: df (facts, tier) with fit: 4 points for each of up to four facts, 3 or 1 for the tier, 24 off for entry level."""
    tier = F.when(F.col("tier") == preferred, 3).when(F.col("tier") == secondary, 1).when(F.col("tier").isin("entry", "intern"), -24).otherwise(0)
    return df.withColumn("fit", 4 * F.least(F.size("facts"), F.lit(4)) + tier)


def actionability(df: DataFrame) -> DataFrame:
    """L3: df (evidence, evaluation, agency, review, fit) with score and its level (800, 450)."""
    base = F.when(F.col("evidence") == "direct", 900).when(F.col("evidence") == "source", 750).when(F.col("evidence") == "stale", 600).otherwise(250)
    score = F.greatest(base, F.when(F.col("evaluation").isNotNull(), 600 + 50 * F.col("evaluation")).otherwise(0)) - F.when(F.col("agency"), 600).otherwise(0) - F.when(F.col("review"), 150).otherwise(0) + 25 * F.col("fit")
    return df.withColumn("action_score", score).withColumn("action_level", F.when(score >= 800, "high").when(score >= 450, "medium").otherwise("low"))


def priority_score(text: Column, terms: Sequence[str], verified: Column) -> Column:
    """L4: 30 less its place (1 at least) for each term in text, and 100 for a verified row."""
    low, score = F.lower(F.coalesce(text, F.lit(""))), F.when(verified, 100).otherwise(0)
    for i, t in enumerate(terms):
        score = score + F.when(low.contains(t.lower()), max(1, 30 - i)).otherwise(0)
    return score


#: L1, most telling first: fit, review, action score, evaluation, verified, active, posting date, texts, id.
RANK_ORDER = (
    F.desc_nulls_last, ("fit", "action_score", "evaluation", "verified", "active", "posted_at"), F.asc_nulls_last, ("company", "title", "posting_id"),
)


def rank_order() -> list[Column]:
    down, first, up, last = RANK_ORDER
    return [*[down(c) for c in first], *[up(c) for c in last]]


def rank_candidates(df: DataFrame, limit: int) -> DataFrame:
    """L1: the first `limit` candidates with their rank. A report is bounded; its order is a top-k, not a full sort."""
    top = df.orderBy(*rank_order()).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*rank_order())))


def round_robin(df: DataFrame, source: str, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows taking sources in turn, each in order; sources by their best row.

    A row's turn is at most `limit`, so that the window keeps no more of a source.
    """
    own = W.partitionBy(source).orderBy(*order)
    turned = df.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= limit)
    return turned.orderBy("turn", *order).limit(limit)


def verification_budget(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """The n unchecked rows to verify next: in order, sources in turn."""
    return round_robin(df.where("NOT checked"), source, order, n)


def top_per_site(df: DataFrame, site: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows of each site with the site's total. Totals are summed apart, so that a large site is never sorted whole."""
    total = df.groupBy(site).agg(F.count("*").alias("total"))
    w = W.partitionBy(site).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(total, site)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in order, with the total and whether more follow."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)
