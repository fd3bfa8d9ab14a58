"""Health, liveness, run statistics and set operations over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of

from brightloom.functions.text import job_id_in, without_marks


def failure_streaks(health: DataFrame, healthy: tuple[str, ...] = ("reachable", "empty"), threshold: int = 3) -> DataFrame:
    """For each company the failures since its last healthy row (ts, then event_id), and whether they reach threshold.

    Counting what comes after the last healthy row needs two aggregates and no sort of a company's log.
    """
    at = F.struct("ts", "event_id")
    last = health.groupBy("company").agg(F.max(F.when(F.col("status").isin(*healthy), at)).alias("ok"))
    met = health.join(last, "company")
    bad = ~F.col("status").isin(*healthy) & (F.col("ok").isNull() | (at > F.col("ok")))
    return met.groupBy("company").agg(F.count_if(bad).alias("streak")).withColumn("alert", F.col("streak") >= threshold)


def error_class(status: Column, error: Column) -> Column:
    """Class of a failed fetch."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status.isin(404, 410), "slug_gone").when(status.isin(401, 403), "auth").when(status >= 500, "server").when(low.rlike("timeout|timed out|econn|enotfound|dns|network"), "network").otherwise("unknown")
    )


# What pages say of a posting, for text without accents and curly quotes.
GONE = (
    r"job (is )?no longer available",
    r"job.*no longer open",
    r"\b(?:job|jobs|position|role|posting|opening|vacancy|requisition|req|listing)\b[\s\S]{0,60}?(?<!\b(?:application|form)\s)has been filled\b(?!\s+out)",
    r"this job has expired",
    r"job posting has expired",
    r"no longer accepting applications",
    r"this (position|role|job) (is )?no longer",
    r"this job (listing )?is closed",
    r"job (listing )?not found",
    r"the page you are looking for doesn.t exist",
    r"applications?\s+(?:(?:have|are|is)\s+)?closed",
    r"closed on \d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"closed on (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}",
    r"diese stelle (ist )?(nicht mehr|bereits) besetzt",
    r"offre (expiree|n'est plus disponible)",
    r"(cette )?offre n'est plus (disponible|en ligne|active)",
    r"(offre|poste|annonce) (deja )?pourvu(e)?",
    r"offre (cloturee|desactivee|terminee)",
    r"ce poste n'est plus (disponible|a pourvoir|ouvert)",
    r"recrutement (termine|cloture)",
    r"candidatures (closes|cloturees)",
)
LISTING = (r"\d+\s+jobs?\s+found", r"search for jobs page is loaded")
CHALLENGE = (
    r"just a moment", r"performing security verification", r"checking your browser before", r"verify you are (a |not a )?human", r"enable javascript and cookies to continue",
    r"attention required.*cloudflare", r"\bray id\b", r"\bcf-ray\b", r"please complete the security check",
)
APPLY = (
    r"\bapply\b", r"지원하기", r"입사지원", r"즉시\s*지원", r"홈페이지\s*지원", r"\bsolicitar\b", r"\bbewerben\b", r"\bpostuler\b", r"submit application", r"easy apply", r"start application",
    r"ich bewerbe mich", r"\baplikuj\b", r"panelu aplikowania", r"wyslij (cv|aplikacj)",
)
LEAST_CONTENT = 300
#: Codes of liveness by what they mean.
LIVENESS_RESULTS = {
    "http_gone": "expired", "bot_challenge": "uncertain", "access_blocked": "uncertain", "server_error": "uncertain", "expired_url": "expired", "expired_body": "expired",
    "redirected_off_posting": "uncertain", "apply_control_visible": "active", "listing_page": "expired", "insufficient_content": "expired", "no_apply_control": "uncertain",
}


def _says(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def liveness(status: Column, url: Column, final_url: Column, body: Column, controls: Column) -> Column:
    """Code of what a fetched page says of its posting; the first rule that fits counts.

    controls: texts of the page's buttons and links. A page that lost the job id of the url it was asked for is another
    page, and its apply buttons prove nothing.
    """
    text = F.regexp_replace(without_marks(F.coalesce(body, F.lit(""))), r"\s+", " ")
    final, job = F.coalesce(final_url, F.lit("")), F.lower(job_id_in(F.lower(url)))
    lost = job.isNotNull() & (final != "") & ~F.lower(final).contains(job)
    applies = F.exists(F.coalesce(controls, F.array().cast("array<string>")), lambda c: F.coalesce(_says(without_marks(c), APPLY), F.lit(False)))
    return (
        F.when(status.isin(404, 410), "http_gone")
        .when(_says(text, CHALLENGE), "bot_challenge")
        .when(status.isin(403, 503), "access_blocked")
        .when(status >= 500, "server_error")
        .when(final.rlike("(?i)[?&]error=true"), "expired_url")
        .when(_says(text, GONE), "expired_body")
        .when(F.coalesce(lost, F.lit(False)), "redirected_off_posting")
        .when(applies, "apply_control_visible")
        .when(_says(text, LISTING), "listing_page")
        .when(F.length(F.trim(text)) < LEAST_CONTENT, "insufficient_content")
        .otherwise("no_apply_control")
    )


def liveness_result(code: Column) -> Column:
    """active, expired or uncertain for a code of liveness."""
    found = F.lit("uncertain")
    for name, result in LIVENESS_RESULTS.items():
        found = F.when(code == name, result).otherwise(found)
    return found


def route_liveness(df: DataFrame) -> DataFrame:
    """Q13: df (outcome, a code of liveness or of the url guard) with route: verified, expired, dropped (no apply control),
    invalid (the guard's codes), or uncertain, which is not kept."""
    code = F.col("outcome")
    route = F.when(code == "no_apply_control", "dropped").when(code.isin("invalid_url", "blocked_url"), "invalid")
    result = liveness_result(code)
    return df.withColumn("route", route.when(result == "active", "verified").otherwise(result))


def history_of_routes(df: DataFrame) -> DataFrame:
    """Q13: (url, status): what history is told of routed postings (url, previous_url, outcome, route), so that they are not
    looked at again: the expired, the old url of those that moved, those without an apply control, and urls that the guard
    refused. Verified and uncertain ones are not told, but for the url that they moved from. A null url tells nothing."""
    status = F.when(F.col("route") == "expired", "skipped_expired").when(F.col("route") == "dropped", "skipped_no_apply_control")
    status = status.when(F.col("route") == "invalid", F.when(F.col("outcome") == "blocked_url", "skipped_blocked_host").otherwise("skipped_invalid_url"))
    moved = F.when(~F.col("previous_url").eqNullSafe(F.col("url")), F.col("previous_url"))
    own = F.struct(F.col("url").alias("url"), status.alias("status"))
    old = F.struct(moved.alias("url"), F.lit("skipped_expired").alias("status"))
    told = df.select(*owner_of(df), F.explode_outer(F.array(own, old)).alias("told")).where("told.url IS NOT NULL AND told.status IS NOT NULL")
    return told.select(*owner_of(df), "told.*").distinct()


def liveness_stats(df: DataFrame, source: str) -> DataFrame:
    """Outcomes by source, one column each."""
    count = lambda r: F.count_if(F.col("route") == r).alias(r)
    return df.groupBy(source).agg(F.count("*").alias("checked"), *[count(r) for r in ("verified", "expired", "dropped", "invalid", "uncertain")])


def board_membership(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """(posting_id, state) by whether a posting's job id (any case) is on its organisation's board (org, job_id,
    usable); a board that is missing or not usable tells nothing."""
    usable = boards.groupBy("org").agg(F.bool_and("usable").alias("_ok"))
    listed = boards.where("usable").select(F.col("org"), F.lower("job_id").alias("_j")).distinct().withColumn("_on", F.lit(True))
    met = postings.withColumn("_j", F.lower("job_id")).join(usable, "org", "left").join(listed, ["org", "_j"], "left")
    return met.select("posting_id", F.when(~F.coalesce("_ok", F.lit(False)), "unknown").when(F.col("_on"), "active").otherwise("expired").alias("state"))


def timing_report(df: DataFrame) -> DataFrame:
    """Batches, retries and seconds by scope and operation, by scope, and for all."""
    sets = df.groupingSets([["scope", "op"], ["scope"], []], "scope", "op")
    return sets.agg(F.count("*").alias("batches"), F.sum(F.when(F.col("attempt") > 1, 1).otherwise(0)).alias("retries"), F.round(F.sum("seconds"), 4).alias("total_seconds"), F.max("seconds").alias("longest"))


def last_runs(df: DataFrame) -> DataFrame:
    """Ids of the last run of all, the last full and the last resumed one, by completed_at then run_id."""
    last = lambda cond: F.max_by(F.when(cond, F.col("run_id")), F.when(cond, F.struct("completed_at", "run_id")))
    return df.agg(last(F.lit(True)).alias("last"), last(F.col("mode") == "full").alias("last_full"), last(F.col("resumed")).alias("last_resumed"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    b, a = before.select(F.col(key).alias("key"), F.col(value).alias("b"), F.lit(True).alias("in_b")), after.select(F.col(key).alias("key"), F.col(value).alias("a"), F.lit(True).alias("in_a"))
    met = b.join(a, "key", "full")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return met.select("key", change.alias("change")).where("change IS NOT NULL")


def merge_batches(old: DataFrame, new: DataFrame, key: str, at: str, cap: int) -> DataFrame:
    """Union of two batches in which new replaces old, newest first, capped (a bounded inbox)."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_batch")]
    merged = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_batch", at)).alias("r")).select(key, "r.*")
    return merged.orderBy(F.desc(at), key).limit(cap)


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key is not done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def restore_missing(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Saved items (item_id, aliases) none of whose aliases a current one has."""
    now = current.select(F.explode("aliases").alias("alias")).distinct()
    found = saved.select("item_id", F.explode("aliases").alias("alias")).join(now, "alias", "left_semi").select("item_id").distinct()
    return saved.join(found, "item_id", "left_anti")


def union_origins(origins: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of candidates by key; the first origin in the list wins."""
    out = None
    for i, (name, df) in enumerate(origins):
        part = df.withColumns({"origin": F.lit(name), "_p": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_p")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("r")).select(key, "r.*")


def orphans(reports: DataFrame, tracker: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports without a row that names them, rows whose report is missing); columns report, num."""
    named = tracker.select("num", F.explode("reports").alias("report"))
    return reports.join(named, "report", "left_anti"), named.join(reports, "report", "left_anti")


def company_summary(df: DataFrame, company: str, max_chars: int) -> DataFrame:
    """The distinct companies in order as far as they fit, and how many more there are.

    No more than max_chars + 1 names can fit, so only those are put in one place.
    """
    names = df.select(company).where(F.trim(company) != "").distinct()
    few = names.orderBy(company).limit(max_chars + 1)
    w = W.orderBy(company).rowsBetween(W.unboundedPreceding, 0)
    fits = few.withColumn("used", F.sum(F.length(company) + 2).over(w) - 2).where(F.col("used") <= max_chars)
    shown = fits.agg(F.count("*").alias("shown"), F.array_join(F.array_sort(F.collect_list(company)), ", ").alias("names"))
    return names.agg(F.count("*").alias("n")).crossJoin(shown).select("names", (F.col("n") - F.col("shown")).alias("more"))
