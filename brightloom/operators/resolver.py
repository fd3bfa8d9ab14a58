"""Postings against an application history in full: companies by name or in the posting's text, roles by key or likeness,
and whether the history keeps a posting back.

No posting is paired with a company's whole history. Roles are compared once for each pair of distinct titles of a
company that share a telling word; of the rest a posting only meets the newest few rows of its company, which are enough
for its best matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, dedup_url, host_of, nfkc, role_key, text_key
from brightloom.operators.dedup import checkpointed, dealt
from brightloom.operators.identity import alike_titles

# Statuses that keep a posting of the same role back, and those that keep back others of the company.
ROLE_BLOCKS = ("applied", "responded", "interview", "offer", "rejected", "discarded", "skip", "hired")
COMPANY_BLOCKS = ("applied", "responded", "interview", "offer", "rejected")
# Urls of notes that name one posting.
POSTING_URL = r"(?i)/wd/\d+|/job(?:-posting|/posting)/\d+|rec_idx=\d+|gi_read/\d+|/jobs/view/\d+"
#: Letters of the pieces by which names are looked up in texts.
PIECE = 4


def pieces(text: Column, longest: int = PIECE) -> Column:
    """Distinct runs of 1 to longest letters of text."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(text) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)])))


def keys_in_texts(texts: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """(id, k): keys (k) that texts (id, text) contain, both without blanks and signs; within by.

    Each key is looked up by the piece of it that the fewest texts have, and then sought in those texts: an exact
    containment join whose candidates are few, and no key meets all texts. Blank keys are in no text.
    """
    spread = checkpointed(texts.select(*by, "id", "text", F.explode_outer(pieces(F.col("text"))).alias("piece")).where("piece IS NOT NULL"))
    common = spread.groupBy(*by, "piece").agg(F.count("*").alias("n"))
    own = lambda k: F.filter(pieces(k), lambda p: F.length(p) == F.least(F.length(k), F.lit(PIECE)))
    led = keys.where("k <> ''").select(*by, "k").distinct().select(*by, "k", F.explode_outer(own(F.col("k"))).alias("piece"))
    # a piece that no text has rules its key out
    led = led.join(dealt(common), [*by, "piece"], "left").groupBy(*by, "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    led = led.where("least.n > 0").select(*by, "k", F.col("least.piece").alias("piece"))
    return spread.join(dealt(led), [*by, "piece"]).where(F.contains("text", "k")).select(*by, "id", "k")


def _exact(role: Column) -> Column:
    return F.lower(F.regexp_replace(nfkc(F.coalesce(role, F.lit(""))), r"\s+", ""))


def _target(url: Column) -> Column:
    return F.coalesce(dedup_url(url), url)


def _top(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark cuts the ranks before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order, F.desc("num"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


class Resolved:
    """What both results share: links of postings to companies, and which rows of the tracker have their role."""

    def __init__(self, postings: DataFrame, tracker: DataFrame) -> None:
        self.own = own = owner_of(postings, tracker)
        maybe = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        self.postings = postings.select(
            *own, "posting_id", company_key(F.col("company")).alias("k"), F.coalesce("title", F.lit("")).alias("at"), role_key(F.col("title")).alias("pr"), _exact(F.col("title")).alias("exact"),
            _target(maybe(postings, "url")).alias("target"), text_key(maybe(postings, "identity_text")).alias("text"), maybe(postings, "resolution").alias("resolution"), maybe(postings, "pipeline_bucket").alias("bucket"),
        )
        noted = F.regexp_extract_all(F.coalesce(maybe(tracker, "notes"), F.lit("")), F.lit(r"(https?://[^\s<>\])]+)"), 1)
        urls = F.transform(F.filter(F.concat(F.array(F.coalesce(maybe(tracker, "url"), F.lit(""))), noted), lambda u: u.rlike(POSTING_URL)), _target)
        rows = tracker.select(*own, "num", F.lower("status").alias("status"), company_key(F.col("company")).alias("k"), F.coalesce("role", F.lit("")).alias("bt"), role_key(F.col("role")).alias("tr"), _exact(F.col("role")).alias("exact"), urls.alias("urls"))
        self.tracker = checkpointed(rows.where("k <> ''"))
        base = self.postings.select(*own, "posting_id", "k", "at", "pr", "exact", "target")
        blank = self.postings.where("k = '' AND text <> ''").select(*own, F.col("posting_id").alias("id"), "text")
        found = keys_in_texts(blank, self.tracker, own).withColumnRenamed("id", "posting_id")
        told = base.where("k = ''").drop("k").join(dealt(found), [*own, "posting_id"]).select(*base.columns)
        self.links = checkpointed(base.where("k <> ''").union(told))

    def roles(self) -> DataFrame:
        """(k, at, bt): titles of postings and roles of the tracker of one company that are the same."""
        own = self.own
        left = self.links.select(*own, "k", "at", "pr").distinct()
        right = self.tracker.where("status <> 'skip'").select(*own, "k", "bt", "tr").distinct()
        equal = left.where("pr <> ''").join(dealt(right.withColumnRenamed("tr", "pr")), [*own, "k", "pr"]).select(*own, "k", "at", "bt")
        return equal.union(alike_titles(left.select(*own, "k", "at"), right.select(*own, "k", "bt"))).distinct()

    def skipped(self) -> DataFrame:
        """(posting_id, num, status): rows that were skipped and are of a posting: by its url, or by the very same role unless
        the row names another url of the same site."""
        own = self.own
        skip = self.tracker.where("status = 'skip'").select(*own, "k", "num", "status", "exact", "urls")
        by_url = self.links.join(dealt(skip.select(*own, "k", "num", "status", F.explode("urls").alias("target"))), [*own, "k", "target"])
        other = F.exists("urls", lambda u: F.coalesce((host_of(u) == host_of(F.col("target"))) & (u != F.col("target")), F.lit(False)))
        by_role = self.links.where("exact <> ''").join(dealt(skip), [*own, "k", "exact"]).where(~other)
        columns = [*own, "posting_id", "num", "status"]
        return by_url.select(*columns).union(by_role.select(*columns)).distinct()


def resolved_matches(postings: DataFrame, tracker: DataFrame, top: int = 3) -> DataFrame:
    """J5/W4 in full: (posting_id, num, status, role_match, rank): the best rows of the tracker for each posting, those of its
    role first, then the newest.

    postings: posting_id, company, title, and if there are any url, identity_text (searched for names of companies where
    the company is blank), resolution, pipeline_bucket. tracker: num, company, role, status, and if there are any url, notes.
    A role matches by its key or by likeness (J10); a skipped row only matches its own posting. Blank companies of the
    tracker match nothing, null titles no role. A posting that repeats counts once.
    """
    r = Resolved(postings, tracker)
    own = r.own
    columns = [*own, "posting_id", "num", "status"]
    rows = r.tracker.where("status <> 'skip'")
    newest = _top(rows.select(*own, "k", "bt", "num", "status"), [*own, "k", "bt"], top)
    same = _top(r.roles().join(dealt(newest), [*own, "k", "bt"]).select(*own, "k", "at", "num", "status").distinct(), [*own, "k", "at"], top)
    same = r.links.join(dealt(same), [*own, "k", "at"]).select(*columns, F.lit(True).alias("role_match"))
    skipped = _top(r.skipped(), [*own, "posting_id"], top).withColumn("role_match", F.lit(True))
    # with fewer than `top` rows of its role, the rest of a posting's best are among so many of its company
    rest = _top(r.tracker.select(*own, "k", "num", "status"), [*own, "k"], 2 * top - 1)
    other = r.links.select(*own, "posting_id", "k").distinct().join(dealt(rest), [*own, "k"]).select(*columns, F.lit(False).alias("role_match"))
    found = same.union(skipped).union(other).groupBy(*columns).agg(F.max("role_match").alias("role_match"))
    w = W.partitionBy(*own, "posting_id").orderBy(F.desc("role_match"), F.desc("num"), "status")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def resolved_gate(postings: DataFrame, tracker: DataFrame) -> DataFrame:
    """J6 in full: (posting_id, gate, reason, num): does the history keep a posting back?

    In this order: an ambiguous company (resolution), the bucket conditional_reapply, the newest row of the same role in a
    blocking status (same_role_<status>), the newest row of the company in one (same_company_prior_application); else
    eligible, no_blocking_history. num is the row that decides. Inputs as in resolved_matches.
    """
    r = Resolved(postings, tracker)
    own = r.own
    rows = r.tracker
    last = F.max(F.struct("num", "status"))
    hard = rows.where(F.col("status").isin(*ROLE_BLOCKS) & (F.col("status") != "skip")).groupBy(*own, "k", "bt").agg(last.alias("row"))
    titled = r.roles().join(dealt(hard), [*own, "k", "bt"]).groupBy(*own, "k", "at").agg(F.max("row").alias("row"))
    by_role = r.links.join(dealt(titled), [*own, "k", "at"]).select(*own, "posting_id", "row").union(r.skipped().select(*own, "posting_id", F.struct("num", "status")))
    by_role = by_role.groupBy(*own, "posting_id").agg(F.max("row").alias("role_row"))
    prior = rows.where(F.col("status").isin(*COMPANY_BLOCKS)).groupBy(*own, "k").agg(last.alias("row"))
    by_company = r.links.join(dealt(prior), [*own, "k"]).groupBy(*own, "posting_id").agg(F.max("row").alias("company_row"))
    met = r.postings.select(*own, "posting_id", "resolution", "bucket").distinct().join(dealt(by_role), [*own, "posting_id"], "left").join(dealt(by_company), [*own, "posting_id"], "left")
    role, company = F.col("role_row"), F.col("company_row")
    reason = (
        F.when(F.col("resolution") == "ambiguous", "ambiguous_company_identity")
        .when(F.col("bucket") == "conditional_reapply", "pipeline_conditional_reapply")
        .when(role.isNotNull(), F.concat(F.lit("same_role_"), role["status"]))
        .when(company.isNotNull(), "same_company_prior_application")
        .otherwise("no_blocking_history")
    )
    decides = F.when(reason.startswith("same_role_"), role["num"]).when(reason == "same_company_prior_application", company["num"])
    return met.select(*own, "posting_id", F.when(reason == "no_blocking_history", "eligible").otherwise("excluded").alias("gate"), reason.alias("reason"), decides.alias("num"))
