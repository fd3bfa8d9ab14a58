"""Application tracker: queries, repairs, duplicates, numbers and audits over a table of applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, text_key
from brightloom.operators.numbering import numbered

# Statuses from the least to the most advanced, and their other spellings.
STATUS_RANK = ("skip", "discarded", "evaluated", "no-response", "rejected", "applied", "responded", "interview", "offer")
#: From here on an application is in flight: its row is only merged with one of the same report or number.
ADVANCED = ("applied", "responded", "interview", "offer")
STATUS_ALIASES = {
    "aplicado": "applied", "enviada": "applied", "sent": "applied", "evaluada": "evaluated", "entrevista": "interview", "oferta": "offer", "rechazado": "rejected",
    "rechazada": "rejected", "descartado": "discarded", "descartada": "discarded", "closed": "discarded", "respondido": "responded", "no aplicar": "skip", "dup": "discarded",
}


def status_name(raw: Column) -> Column:
    """Status in lower case without bold marks and a trailing date, aliases resolved; unknown gives null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"\*+", ""), r"\s*\(?\d{4}-\d{2}-\d{2}\)?\s*$", ""))
    alias = F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv])
    return F.when(bare.isin(*STATUS_RANK), bare).otherwise(F.try_element_at(alias, bare))


def score_value(raw: Column) -> Column:
    """The number of a cell such as "4.2/5" or "**3**"; null if there is none."""
    return F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\W*(\d+(?:\.\d+)?)\s*(?:/\s*5)?\W*$", 1).try_cast("double")


def report_numbers(cell: Column) -> Column:
    """Report numbers of the links of a cell, without leading zeros."""
    return F.transform(F.regexp_extract_all(cell, F.lit(r"\[0*(\d+)\]"), 1), lambda n: n.cast("long"))


def merge_note(notes: Column, clause: Column) -> Column:
    """Clause appended to notes unless it is one of its clauses already; "-" and "—" count as empty."""
    old = F.when(F.trim(F.coalesce(notes, F.lit(""))).isin("", "-", "—"), "").otherwise(F.trim(notes))
    new = F.trim(F.coalesce(clause, F.lit("")))
    return F.when(new == "", old).when(old == "", new).when(F.array_contains(F.split(old, "; "), new), old).otherwise(F.concat_ws("; ", old, new))


def transition_allowed(current: Column, proposed: Column) -> Column:
    """Rejected and discarded are final; otherwise only to a status at least as advanced."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_RANK) for x in (s, i)])
    final = current.isin("rejected", "discarded")
    forward = F.try_element_at(rank, proposed) >= F.try_element_at(rank, current)
    return F.coalesce(F.when(final, proposed == current).when(proposed == "rejected", True).otherwise(forward), F.lit(False))


def query_tracker(df: DataFrame, status: str | None = None, company: str | None = None, role: str | None = None, since: str | None = None, num: int | None = None, limit: int | None = None) -> DataFrame:
    """rows by status, parts of company and role, first date and id; newest id first."""
    if status:
        df = df.where(F.lower("status") == status.strip().lower())
    if company:
        df = df.where(F.lower("company").contains(company.lower()))
    if role:
        df = df.where(F.lower("role").contains(role.lower()))
    if since:
        df = df.where(F.col("date") >= F.lit(since).cast("date"))
    if num is not None:
        df = df.where(F.col("num") == num)
    return df.orderBy(F.desc("num")).limit(limit) if limit else df


def delete_rows(df: DataFrame, num: int) -> DataFrame:
    """the tracker without the rows of a number."""
    return df.where(~F.col("num").eqNullSafe(F.lit(num)))


def no_response_candidates(tracker: DataFrame, protected: DataFrame, today: str, days: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, counts): applied at least so many days ago and not protected (column num), oldest first, at
    most cap; counts has candidates, deferred beyond the cap and rows set aside for their missing date."""
    applied = tracker.where("status = 'applied'")
    old = applied.where(F.datediff(F.lit(today).cast("date"), "date") >= days)
    keys = [*owner_of(tracker, protected), "num"]
    old = old.join(protected.select(*keys).distinct(), keys, "left_anti")
    counts = old.agg(F.count("*").alias("candidates"), F.greatest(F.count("*") - cap, F.lit(0)).alias("deferred")).crossJoin(
        applied.agg(F.count_if(F.col("date").isNull()).alias("undated"))
    )
    return old.orderBy("date", "num").limit(cap), counts


def status_counts(df: DataFrame) -> DataFrame:
    """A3: rows and distinct companies by status."""
    return df.groupBy(*owner_of(df), "status").agg(F.count("*").alias("n"), F.countDistinct("company").alias("companies"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """A5: company and role keys with more than one row; ids in order."""
    own = owner_of(df)
    keyed = df.select(*own, company_key(F.col("company")).alias("company_key"), text_key(F.col("role")).alias("role_key"), "num").where("company_key <> '' AND role_key <> ''")
    grouped = keyed.groupBy(*own, "company_key", "role_key").agg(F.count("*").alias("n"), F.min("num").alias("first_num"), F.max("num").alias("last_num"))
    return grouped.where("n > 1")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Numbers used by more than one row."""
    return df.groupBy(*owner_of(df), "num").agg(F.count("*").alias("n")).where("n > 1")


def cross_channel(df: DataFrame) -> DataFrame:
    """Company and role keys applied to over more than one channel; no channel is "direct"."""
    own = owner_of(df)
    keyed = df.select(*own, company_key(F.col("company")).alias("company_key"), text_key(F.col("role")).alias("role_key"), F.coalesce(F.nullif(text_key(F.col("via")), F.lit("")), F.lit("direct")).alias("via"))
    return keyed.groupBy(*own, "company_key", "role_key").agg(F.countDistinct("via").alias("channels")).where("channels > 1")


def merge_clusters(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cluster: that of the best score (of equals, the least number), with the most advanced status.

    Where df has them, report (of the best row) and notes (the distinct ones in order of number) come along.
    """
    keys = [*(k for k in owner_of(df) if k not in keys), *keys]
    rank = F.array_position(F.array(*map(F.lit, STATUS_RANK)), F.col("status"))
    carried = [c for c in ("report",) if c in df.columns]
    best = F.max_by(F.struct("num", "date", "score", *carried), F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("num")))
    noted = F.array_sort(F.collect_list(F.when(F.trim("notes") != "", F.struct("num", "notes")))) if "notes" in df.columns else None
    extra = [] if noted is None else [F.array_join(F.array_distinct(F.transform(noted, lambda x: F.trim(x["notes"]))), "; ").alias("notes")]
    grouped = df.groupBy(*keys).agg(best.alias("keep"), F.max(F.struct(rank, "status")).alias("top"), F.count("*").alias("n"), *extra)
    more = [F.col(f"keep.{c}") for c in carried] + (["notes"] if extra else [])
    return grouped.select(*keys, F.col("keep.num").alias("num"), F.col("keep.score").alias("score"), F.col("top.status").alias("status"), "n", *more)


def status_events(log: DataFrame) -> DataFrame:
    """A row of (key, at, tie, status) where the status of a key first appears or changes, with the one before."""
    own = owner_of(log)
    w = W.partitionBy(*own, "key").orderBy("at", "tie")
    seen = log.withColumn("old", F.lag("status").over(w)).withColumn("first", F.row_number().over(w) == 1)
    return seen.where("first OR NOT old <=> status").select(*own, "key", "at", "tie", "old", F.col("status").alias("new"))


def reassign_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Missing and repeated numbers of an owner are given new ones after their greatest, in row order (which must be
    total); the first use keeps its own."""
    own = owner_of(df)
    first = df.where("num IS NOT NULL").groupBy(*own, "num").agg(F.min(F.struct(*order)).alias("_first"))
    marked = df.join(first, [*own, "num"], "left").withColumn("_bad", ~F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))).drop("_first")
    top = df.groupBy(*own).agg(F.coalesce(F.max("num"), F.lit(0)).alias("_top"))
    fresh = numbered(marked.where("_bad").drop("_bad"), own, order, "_n")
    fresh = fresh.join(top, own) if own else fresh.crossJoin(F.broadcast(top))  # without owners top is one row
    return marked.where("NOT _bad").select(*df.columns).unionByName(fresh.withColumn("num", F.col("_top") + F.col("_n")).select(*df.columns))


def audit(df: DataFrame) -> DataFrame:
    """Q1: integrity findings as (check, severity, key), of each owner."""
    own = owner_of(df)
    finding = lambda rows, check, severity, key: rows.select(*own, F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"))
    parts = [
        finding(df.where(status_name(F.col("status")).isNull()), "status", "error", F.col("num")),
        finding(df.where("score IS NULL OR score < 0 OR score > 5"), "score", "error", F.col("num")),
        finding(df.where("date IS NULL"), "date", "warning", F.col("num")),
        finding(duplicate_ids(df), "number", "error", F.col("num")),
        finding(duplicate_groups(df), "duplicate", "warning", F.concat_ws("::", "company_key", "role_key")),
        finding(cross_channel(df), "channel", "warning", F.concat_ws("::", "company_key", "role_key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
