"""Integrity of a tracker as it was landed, with the reports and additions beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import text_key
from brightloom.operators.tracker import score_value, status_name

# Words that stand for a company that is kept secret, what a report's file is called, cells without a score.
CONFIDENTIAL = r"(?i)^(confidential|vertraulich|confidentiel|confidencial|riservato|gizli|機密|سري)$"
REPORT_NAME = r"^(\d+)-(.+)-\d{4}-\d{2}-\d{2}\.md$"
NO_SCORE = ("n/a", "dup", "-", "—")
#: Hours after which a number that is held for a report counts as forgotten.
HELD_HOURS = 4


def report_role(body: Column) -> Column:
    """The role of a report: that of its machine summary, else what follows the last dash of its title; null without."""
    fence = F.regexp_extract(body, r"(?i)##\s*Machine Summary\s*\n+```(?:yaml|yml|json)?\s*\n([\s\S]*?)\n```", 1)
    said = F.trim(F.regexp_extract(fence, r"""(?m)^role:\s*["']?(.+?)["']?\s*$""", 1))
    title = F.regexp_extract(body, r"(?m)^# (.*)$", 1)
    last = F.trim(F.regexp_extract(title, r"^.*[—–]([^—–]*)$", 1))
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(last, F.lit("")))


def integrity_audit(tracker: DataFrame, reports: DataFrame, additions: DataFrame, now: Column) -> DataFrame:
    """Q1: findings (check, severity, key, message) of each owner.

    tracker: rows as read, all texts but num: num, company, role, status, score, report (Markdown links), via, and n_cells
    of need_cells where the width of a row is known. reports: landed files (name, body, modified); a report's link is held
    against the name at its end. additions: files (name) that wait to be merged. Groups are reported by their size and
    their first and last number or name, so nothing is gathered; nulls count as empty cells, and empty tables give no
    findings of their own.
    """
    own = owner_of(tracker, reports, additions)
    cell = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    t = tracker.select(*own, "num", *[cell(c).alias(c) for c in ("company", "role", "status", "score", "report", "via")], *[c for c in ("n_cells", "need_cells") if c in tracker.columns])
    found = lambda rows, check, severity, key, *message: rows.select(*own, F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), F.concat(*[F.coalesce(m.cast("string"), F.lit("")) for m in message]).alias("message"))
    num, say = F.col("num"), F.lit

    status, score = F.col("status"), F.col("score")
    scored = score_value(score).isNotNull() | F.lower(score).isin(*NO_SCORE)
    confidential, blind = F.col("company").rlike(CONFIDENTIAL), (F.col("company") == "?") & F.col("via").isin("", "—")
    checks = [
        ("status", "error", status_name(status).isNull(), [say("unknown status: "), status]), ("status_bold", "error", status.contains("**"), [say("status in bold: "), status]),
        ("status_date", "error", status.rlike(r"\d{4}-\d{2}-\d{2}"), [say("status with a date: "), status]), ("score", "error", ~scored, [say("no score: "), score]),
        ("score_bold", "warning", score.contains("**"), [say("score in bold: "), score]), ("via", "error", blind, [say("unknown company without a channel")]),
        ("confidential", "warning", confidential, [say("placeholder as company: "), F.col("company")]),
    ]
    if {"n_cells", "need_cells"} <= set(tracker.columns):
        checks.append(("width", "error", F.col("n_cells") < F.col("need_cells"), [say("cells: "), F.col("n_cells"), say(" of "), F.col("need_cells")]))
    # the checks of single rows are one pass over the tracker
    each = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.concat(*[F.coalesce(m.cast("string"), F.lit("")) for m in m_]).alias("message"))) for c, s, bad, m_ in checks])
    rows = t.select(*own, num.cast("string").alias("key"), F.explode_outer(F.array_compact(each)).alias("f")).where("f IS NOT NULL").select(*own, "f.check", "f.severity", "key", "f.message")

    keyed = t.withColumn("k", F.concat_ws("::", text_key(F.col("company")), text_key(F.col("role"))))
    size = [F.count("*").alias("n"), F.min("num").alias("a"), F.max("num").alias("b")]
    span = [F.col("n"), say(" rows, #"), F.col("a"), say(" to #"), F.col("b")]
    twice = keyed.where("k <> '::'").groupBy(*own, "k").agg(*size).where("n > 1")
    channel = F.coalesce(F.nullif(text_key(F.col("via")), F.lit("")), F.lit("direct"))
    known = t.where("company NOT IN ('', '?')").withColumn("k", F.concat_ws("::", F.lower("company"), F.lower("role"))).withColumn("channel", channel)
    ways = known.groupBy(*own, "k").agg(F.countDistinct("channel").alias("w"), *size).where("w > 1")
    numbers = t.where("num IS NOT NULL").groupBy(*own, "num").agg(F.count("*").alias("n")).where("n > 1")

    files = reports.select(*own, "name", "body", "modified", F.regexp_extract("name", REPORT_NAME, 1).try_cast("long").alias("number"), F.regexp_extract("name", REPORT_NAME, 2).alias("slug"))
    links = t.select(*own, "num", F.explode_outer(F.regexp_extract_all("report", F.lit(r"\]\(([^)]+)\)"), 1)).alias("link")).where("link IS NOT NULL").withColumn("name", F.substring_index("link", "/", -1))
    lost = links.join(files.select(*own, "name").distinct(), [*own, "name"], "left_anti")
    named = F.transform(F.regexp_extract_all("report", F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("long"))
    aimed = F.transform(F.regexp_extract_all("report", F.lit(r"\]\((?:[^)]*/)?(\d+)-[^)/]*\)"), 1), lambda x: x.try_cast("long"))
    linked = F.size(F.regexp_extract_all("report", F.lit(r"\[\d+\]|\]\([^)]+\)"), 0)) > 0
    used = t.select(*own, F.explode_outer(F.when(linked, F.concat(named, aimed)).otherwise(F.array(num.cast("long")))).alias("number")).where("number IS NOT NULL").distinct()
    orphans = files.where("number IS NOT NULL").join(used, [*own, "number"], "left_anti")
    roles = files.where("number IS NOT NULL").select(*own, "name", F.concat_ws("::", text_key(F.col("slug")), text_key(report_role(F.col("body")))).alias("k"), report_role(F.col("body")).alias("r")).where("r IS NOT NULL")
    again = roles.groupBy(*own, "k").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).where("n > 1")
    held = files.where(F.col("name").endswith("-RESERVED.md") & (F.col("modified").cast("timestamp") < now.cast("timestamp") - F.expr(f"INTERVAL {HELD_HOURS} HOURS")))
    waiting = additions.groupBy(*own).agg(F.count("*").alias("n")).where("n > 0")
    parts = [
        rows,
        found(twice, "duplicate", "warning", F.col("k"), *span),
        found(ways, "channel", "warning", F.col("k"), F.col("w"), say(" channels, "), *span),
        found(numbers, "number", "error", num, F.col("n"), say(" rows")),
        found(lost, "report_missing", "error", num, say("no such report: "), F.col("link")),
        found(orphans, "report_orphan", "warning", F.col("name"), say("no row names #"), F.col("number")),
        found(again, "report_twice", "warning", F.col("k"), F.col("n"), say(" reports, "), F.col("a"), say(" to "), F.col("b")),
        found(held, "report_held", "warning", F.col("name"), say("held since "), F.date_format(F.col("modified").cast("timestamp"), "yyyy-MM-dd HH:mm")),
        found(waiting, "additions", "warning", say("additions"), F.col("n"), say(" not merged")),
    ]
    return reduce(DataFrame.unionByName, parts)
