"""Posting rules as boolean columns (True: passes) and the ordered funnel over them.

A rule without a value to judge lets the row pass. Rules are plain functions of columns and settings, so that one
projection holds the whole chain and every row keeps the reason of its first rejection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import any_of, company_key, has_keyword, host_of, keywords, location_hint, place_keyword, signals_remote, url_part

# What postings say about sponsorship.
VISA_POSITIVE = (
    "visa sponsorship", "sponsor a visa", "sponsor visas", "will sponsor", "sponsorship available", "sponsorship is available",
    "eligible for sponsorship", "provide sponsorship", "offer sponsorship", "immigration support", "h-1b", "h1b", "h-1b1", "h1b1", "o-1 visa",
)
VISA_NEGATIVE = (
    "no visa sponsorship", "no sponsorship", "without sponsorship", "unable to sponsor", "not able to sponsor", "cannot sponsor", "do not sponsor",
    "does not sponsor", "not offer sponsorship", "not provide sponsorship", "sponsorship is not available", "sponsorship not available",
    "not offer visa sponsorship",
)
# Words of titles by tier, most senior first.
TIERS = (
    ("senior", r"chief|vp|vice\s+president|director|principal|staff|lead|senior|sr|head\s+of|[a-z]{2,}[\s-](?:iii|iv|v)"),
    ("mid", r"mid-level|mid|[a-z]{2,}[\s-]ii|l4|l5"),
    ("entry", r"entry-level|entry|associate|junior|[a-z]{2,}[\s-]i|l1|l2"),
    ("intern", r"internship|intern|trainee|co-op"),
)
# Points off a posting's trust.
PENALTIES = {"invalid_url": 50, "missing_apply_url": 40, "suspicious_domain": 25, "company_domain_mismatch": 15}
#: Words that never mark a bucket of roles.
GENERIC_BUCKET = ("all", "roles", "role", "family", "bucket", "group", "team")
PERMANENT_SKIPS = ("skipped_invalid_url", "skipped_blocked_host")


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _contains(low: Column, words: Sequence[str]) -> Column:
    return any_of([low.contains(w) for w in words])


def title_passes(title: Column, positive: Sequence | None = (), negative: Sequence | None = ()) -> Column:
    """any positive keyword (or none configured), and no negative one."""
    low, good, bad = _low(title), keywords(positive), keywords(negative)
    wanted = any_of([has_keyword(low, k) for k in good]) if good else F.lit(True)
    return wanted & ~any_of([has_keyword(low, k) for k in bad])


def matched_keywords(title: Column, positive: Sequence | None) -> Column:
    """the positive keywords, as written, that the title has."""
    raw = [k for k in positive or () if isinstance(k, str) and k.strip()]
    if not raw:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(has_keyword(_low(title), k), F.lit(k)) for k in raw]))


def tier_of(title: Column) -> Column:
    """seniority of a title; the highest tier named wins, and no name is mid."""
    clean = _low(title)
    for pattern, word in ((r"(?<![a-z0-9_])a\.\s*i\.?(?![a-z0-9_])", "ai"), (r"(?<![a-z0-9_])i\.\s*t\.?(?![a-z0-9_])", "it"), (r"(?<![a-z0-9_])i/o(?![a-z0-9_])", "io")):
        clean = F.regexp_replace(clean, pattern, word)
    graduate = clean.rlike(r"(?<![a-z0-9_])graduate(?![a-z0-9_])") & clean.rlike(r"(?<![a-z0-9_])(?:program|scheme)(?![a-z0-9_])")
    result = F.when(graduate, "intern").otherwise("mid")
    for tier, pattern in reversed(TIERS):
        result = F.when(clean.rlike(rf"(?<![a-z0-9_])(?:{pattern})(?![a-z0-9_])"), tier).otherwise(result)
    return result


def location_passes(
    location: Column, url: Column, title: Column, allow: Sequence = (), block: Sequence = (), always_allow: Sequence = (), require_explicit: bool = False, check_title: bool = False
) -> Column:
    """title block, nothing to judge, always allow, block, allow, and last a title that says remote."""
    where, hint, low_title = F.trim(_low(location)), location_hint(url), _low(title)
    named = lambda given: any_of([((where != "") & place_keyword(where, k)) | ((hint != "") & place_keyword(hint, k)) for k in keywords(given)])
    steps = [((where == "") & (hint == ""), not require_explicit), (named(always_allow), True), (named(block), False)]
    if check_title:
        steps.insert(0, (any_of([place_keyword(low_title, k) for k in keywords(block)]), False))
    result = F.lit(True)
    if keywords(allow):
        steps.append((named(allow), True))
        result = signals_remote(title)
    for condition, passes in reversed(steps):
        result = F.when(condition, passes).otherwise(result)
    return result


def age_passes(posted_at: Column, days: object, today: Column) -> Column:
    """not older than so many days; other settings than a positive whole number switch the rule off."""
    if not isinstance(days, int) or isinstance(days, bool) or days <= 0:
        return F.lit(True)
    return posted_at.isNull() | (posted_at >= F.date_sub(today, days))


def window_passes(posted_at: Column, after: str | None = None, before: str | None = None) -> Column:
    """F8: posted from after to before, both included."""
    ok = F.lit(True)
    if after:
        ok = ok & (posted_at >= F.lit(after).cast("date"))
    if before:
        ok = ok & (posted_at <= F.lit(before).cast("date"))
    return posted_at.isNull() | ok


def salary_passes(low: Column, high: Column, currency: Column, least: float = 0, most: float = 0, wanted: str = "") -> Column:
    """the range overlaps; known and different currencies reject; invalid bounds switch the rule off."""
    if least < 0 or most < 0 or (most and least > most) or not (least or most):
        return F.lit(True)
    job_low, job_high = F.coalesce(low, high), F.coalesce(high, low)
    code, ours = F.upper(F.trim(F.coalesce(currency, F.lit("")))), wanted.strip().upper()
    chain = F.when(job_low.isNull(), True)
    if ours:
        chain = chain.when((code != "") & (code != ours), False)
    if least:
        chain = chain.when(job_high < least, False)
    if most:
        chain = chain.when(job_low > most, False)
    return chain.otherwise(True)


def content_passes(description: Column, positive: Sequence = (), negative: Sequence = (), by_title_keyword: Mapping[str, Mapping] | None = None, matched: Column | None = None) -> Column:
    """keywords of the description; rules of matched title keywords replace the general pair, and any may pass."""
    low = _low(description)

    def one(good: Sequence, bad: Sequence) -> Column:
        good, bad = keywords(good), keywords(bad)
        return ~_contains(low, bad) & (_contains(low, good) if good else F.lit(True))

    verdict = one(positive, negative)
    if by_title_keyword and matched is not None:
        has = lambda k: F.exists(matched, lambda m: F.lower(F.trim(m)) == k.strip().lower())
        rules = [(has(k), one(r.get("positive", ()), r.get("negative", ()))) for k, r in by_title_keyword.items() if k.strip()]
        verdict = F.when(any_of([h for h, _ in rules]), any_of([h & ok for h, ok in rules])).otherwise(verdict)
    return _blank(description) | verdict


def country_passes(description: Column, exclusionary: Sequence = (), inclusive: Sequence = (), country: str | None = None, as_written: bool = False) -> Column:
    """an excluding phrase rejects unless an including one, or the candidate's country, is there too. Blanks round a
    phrase don't count, unless phrases are taken as written: then "mit " is no part of "mitten"."""
    home, low = (country or "").strip().lower(), _low(description)
    phrases = (lambda given: [k.lower() for k in given or () if isinstance(k, str) and k.strip()]) if as_written else keywords
    if home == "united states" or not phrases(exclusionary):
        return F.lit(True)
    rescued = _contains(low, phrases(inclusive)) | (low.contains(home) if home else F.lit(False))
    return _blank(description) | ~_contains(low, phrases(exclusionary)) | rescued


def visa_passes(description: Column, positive: Sequence = VISA_POSITIVE, negative: Sequence = VISA_NEGATIVE, require_mention: bool = False) -> Column:
    """phrases against sponsorship reject; require_mention keeps only phrases for it."""
    low = _low(description)
    wanted = _contains(low, keywords(positive)) if require_mention and keywords(positive) else F.lit(True)
    return F.when(_blank(description), not require_mention).when(_contains(low, keywords(negative)), False).otherwise(wanted)


def blacklisted(df: DataFrame, blacklist: DataFrame, include: bool = False) -> DataFrame:
    """rows of blacklisted companies go, or (include) stay with the reason as note. blacklist: company, reason."""
    listed = blacklist.select(company_key(F.col("company")).alias("_key"), "reason").where("_key <> ''").groupBy("_key").agg(F.min("reason").alias("_reason"))
    met = df.withColumn("_own", company_key(F.col("company"))).join(listed, F.col("_own") == F.col("_key"), "left")
    if include:
        return met.withColumn("note", F.when(F.col("_key").isNotNull(), F.concat(F.lit("blacklisted: "), F.coalesce("_reason", F.lit(""))))).drop("_own", "_key", "_reason")
    return met.where("_key IS NULL").drop("_own", "_key", "_reason")


def cooldown_reason(company: Column, title: Column, windows: Sequence[Mapping], today: str) -> Column:
    """cooldown:<company>:<until> of the first window that the posting falls in; null if none.

    windows: company, last_apply_date, same_role_days, applied_to, cross_role_bucket. Companies are equal by key.
    """
    low, reason = _low(title), F.lit(None).cast("string")
    for w in reversed(list(windows)):
        if not w.get("last_apply_date"):
            continue
        until = F.date_format(F.date_add(F.lit(w["last_apply_date"]).cast("date"), int(w.get("same_role_days") or 0)), "yyyy-MM-dd")
        bucket = [k for k in (w.get("cross_role_bucket") or "").lower().split("_") if k and k not in GENERIC_BUCKET]
        near = [low.contains(r.lower()) for r in w.get("applied_to") or ()]
        near += [low.rlike(r"(?<![a-z0-9_])em(?![a-z0-9_])") | low.contains("engineering manager") if k == "em" else low.contains(k) for k in bucket]
        same = company_key(company) == company_key(F.lit(w["company"]))
        reason = F.when(same & (F.lit(today) < until) & any_of(near), F.concat(F.lit(f"cooldown:{w['company']}:"), until)).otherwise(reason)
    return reason


def history_active(status: Column, first_seen: Column, recheck_days: int | None, today: str) -> Column:
    """F16: does a row of the history still mark its posting as seen?"""
    state = F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("added"))
    age = F.datediff(F.lit(today).cast("date"), first_seen)
    fresh = F.lit(True) if recheck_days is None else F.coalesce(age < recheck_days, F.lit(True))
    return F.when(state.isin(*PERMANENT_SKIPS), True).when(state.startswith("cooldown:"), F.lit(today) < F.substring_index(state, ":", -1)).otherwise(fresh)


def scope_passes(title: Column, description: Column, company: Column, url: Column, hard: Sequence = (), soft: Sequence = (), scope: Sequence = ()) -> Column:
    """hard terms reject; soft ones only if no scope term is there; title, company and url must not be blank."""
    low = F.concat_ws(" ", _low(title), _low(description))
    compact = F.regexp_replace(low, "[^a-z0-9]+", "")

    def named(term: str) -> Column:
        bare = "".join(c for c in term.lower() if c.isascii() and c.isalnum())
        return low.contains(term.lower()) | (compact.contains(bare) if len(bare) >= 4 else F.lit(False))

    in_scope = any_of([named(t) for t in keywords(scope)])
    filled = ~_blank(title) & ~_blank(company) & ~_blank(url)
    return filled & ~any_of([named(t) for t in keywords(hard)]) & (in_scope | ~any_of([named(t) for t in keywords(soft)]))


def url_valid(url: Column) -> Column:
    """http or https, a host, and no user in it."""
    return F.coalesce(F.lower(url_part(url, "PROTOCOL")).isin("http", "https") & (F.coalesce(url_part(url, "HOST"), F.lit("")) != "") & url_part(url, "USERINFO").isNull(), F.lit(False))


def trust(url: Column, company: Column, suspicious: Sequence[str] = (), ats: Sequence[str] = ()) -> Column:
    """struct(score, flags, level) of a posting's url and company."""
    host = host_of(url)
    under = lambda names: any_of([(host == n) | host.endswith(f".{n}") for n in keywords(names)])
    plain = F.trim(F.regexp_replace(_low(company), "[^a-z0-9 ]", ""))
    parts = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= 3)
    related = (plain == "") | host.contains(F.regexp_replace(plain, r"\s+", "")) | F.exists(parts, lambda w: host.contains(w))
    missing, valid = _blank(url), F.coalesce(F.lower(url_part(url, "PROTOCOL")).isin("http", "https"), F.lit(False))
    flags = F.array_compact(
        F.array(
            F.when(missing, "missing_apply_url"),
            F.when(~missing & ~valid, "invalid_url"),
            F.when(~missing & valid & under(suspicious), "suspicious_domain"),
            F.when(~missing & valid & ~_blank(company) & ~under(ats) & ~F.coalesce(related, F.lit(True)), "company_domain_mismatch"),
        )
    )
    score = F.lit(100)
    for flag, points in PENALTIES.items():
        score = score - F.when(F.array_contains(flags, flag), points).otherwise(0)
    return F.struct(score.alias("score"), flags.alias("flags"), F.when(score >= 90, "high").when(score >= 60, "medium").otherwise("low").alias("level"))


def scan_funnel(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with reject_reason, the name of the first rule in order that a row fails; null if it passes all."""
    return df.withColumn("reject_reason", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules], F.lit(None).cast("string")))


def funnel_stats(df: DataFrame, by: str, reasons: Sequence[str]) -> DataFrame:
    """A1: rows, survivors and rejections by rule for each source, and for all (source null, is_total true)."""
    counts = [F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}") for r in reasons]
    summed = df.rollup(by).agg(F.count("*").alias("found"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), *counts, F.grouping(by).alias("g"))
    return summed.withColumn("is_total", F.col("g") == 1).drop("g")
