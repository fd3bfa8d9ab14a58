"""Jobs that put operators together: merging additions, clustering duplicates, snapshots, queues and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.functions.scope import owner_of
from brightloom.functions.text import company_key, host_of, role_key, text_key
from brightloom.operators.dedup import accept_in_order, checkpointed
from brightloom.operators.identity import alike_titles, classify_source, role_of, roles_match
from brightloom.operators.numbering import numbered
from brightloom.operators.tracker import ADVANCED, merge_clusters, transition_allowed


def guard_failed(additions: DataFrame, failed: DataFrame) -> DataFrame:
    """Additions whose report is not marked as failed (column report)."""
    keys = [*owner_of(additions, failed), "report"]
    return additions.join(failed.select(*keys).distinct(), keys, "left_anti")


def allocate_numbers(additions: DataFrame, used: DataFrame) -> DataFrame:
    """Additions (pos, num) with given, their own number where it is free with their owner and they are the first to
    ask for it, else the next above all numbers, in order of pos (unique). Numbers taken are compared by join, not collected."""
    own = owner_of(additions, used)
    taken = used.select(*own, "num").where("num IS NOT NULL").distinct().withColumn("_used", F.lit(True))
    first = additions.where("num IS NOT NULL").groupBy(*own, "num").agg(F.min("pos").alias("pos")).withColumn("_first", F.lit(True))
    met = additions.select(*own, "pos", "num").join(taken, [*own, "num"], "left").join(first, [*own, "num", "pos"], "left")
    marked = met.select(*own, "pos", "num", F.coalesce(F.col("_first") & F.col("_used").isNull(), F.lit(False)).alias("_own"))
    top = used.select(*own, "num").union(additions.select(*own, "num")).groupBy(*own).agg(F.coalesce(F.max("num"), F.lit(0)).alias("_top"))
    fresh = numbered(marked.where("NOT _own").drop("_own"), own, ["pos"], "_n")
    fresh = fresh.join(top, own) if own else fresh.crossJoin(F.broadcast(top))  # without owners top is one row
    return marked.where("_own").select(*own, "pos", "num", F.col("num").alias("given")).union(fresh.select(*own, "pos", "num", F.col("_top") + F.col("_n")))


def merge_additions(tracker: DataFrame, additions: DataFrame) -> DataFrame:
    """(pos, action, num): the row that an addition (pos, num, company, role, report) updates, found by report and
    company, else number and company, else company and alike role (newest row); an addition that finds none is inserted.

    Roles are compared once for each pair of distinct titles of a company that share a telling word.
    """
    own = owner_of(tracker, additions)
    t = tracker.select(*own, F.col("num").alias("t_num"), company_key(F.col("company")).alias("k"), "role", "report").where("k <> ''")
    a = additions.select(*own, "pos", F.col("num").alias("a_num"), company_key(F.col("company")).alias("k"), F.col("role").alias("at"), "report")
    by_report = t.groupBy(*own, "k", "report").agg(F.max("t_num").alias("n1"))
    by_number = t.select(*own, "k", F.col("t_num").alias("a_num"), F.col("t_num").alias("n2")).distinct()
    newest = t.groupBy(*own, "k", F.col("role").alias("bt")).agg(F.max("t_num").alias("n"))
    alike = alike_titles(a.select(*own, "k", "at"), newest.select(*own, "k", "bt")).join(newest, [*own, "k", "bt"]).groupBy(*own, "k", "at").agg(F.max("n").alias("n3"))
    met = a.join(by_report, [*own, "k", "report"], "left").join(by_number, [*own, "k", "a_num"], "left").join(alike, [*own, "k", "at"], "left")
    num = F.coalesce("n1", "n2", "n3")
    return met.select(*own, "pos", F.when(num.isNull(), "insert").otherwise("update").alias("action"), num.alias("num"))


#: A company that is not known; what is known is the channel.
BLIND = "?"


def _opening_keys(df: DataFrame) -> DataFrame:
    """df with group (company, or the channel of a row without one), opening (its title, where the application is not in
    flight) and named (number and title); parts of keys that are null match nothing."""
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("role", F.lit("")), r"\s+", " ")))
    blind = F.trim("company") == BLIND
    via = text_key(F.col("via")) if "via" in df.columns else F.lit("")
    return df.withColumns(
        {
            "blind": F.coalesce(blind, F.lit(False)),
            "group": F.when(blind, F.concat(F.lit("via:"), via)).otherwise(F.concat(F.lit("company:"), company_key(F.col("company")))),
            "opening": F.when(~F.coalesce(F.col("status").isin(*ADVANCED), F.lit(False)), title),
            "named": F.concat(F.col("num").cast("string"), F.lit("::"), title),
        }
    )


#: Rows of one piece of a channel that one task folds at most.
FOLD_ROWS = 50_000


def cluster_duplicates(df: DataFrame, days: int = 90, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(pos, leader): greedy clusters of a company in order of pos (unique): a row joins the first leader with its
    report, with its number and title, or with its title where neither application is in flight (applied or later).

    Titles are compared exactly but for case and blanks. Rows are led as accept_in_order accepts them: whoever shares no
    key with an earlier leader leads. Rows without a company ("?") belong to their channel, and only join a leader whose
    date is within so many days, which no key expresses: pieces of a channel of up to fold_rows rows are folded in order,
    larger ones are decided in rounds.

    df: pos, num, company, role, status, report, date, and via if there are channels.
    """
    own = owner_of(df)
    keyed = _opening_keys(df)
    sighted = keyed.where("NOT blind")
    part = lambda c: F.when(F.col(c).isNotNull(), F.struct("group", F.col(c).alias("c")))
    keys = {"k_report": part("report"), "k_named": part("named"), "k_opening": part("opening")}
    rows = checkpointed(sighted.select(*own, "pos", *[k.alias(n) for n, k in keys.items()]))
    led = accept_in_order(rows, list(keys), "pos")
    leaders = checkpointed(led.where("accepted").drop("accepted"))
    rest = checkpointed(led.where("NOT accepted").drop("accepted"))
    # rows without a key stay out of its join, where they would meet in one task
    some = lambda df, n: df.where(F.col(n).isNotNull())
    least = lambda n: some(leaders, n).groupBy(*own, n).agg(F.min("pos").alias("leader"))
    shared = [some(rest, n).select(*own, n, "pos").join(least(n), [*own, n]).select(*own, "pos", "leader") for n in keys]
    # the least pos of a leader that shares any key; a later one can't have come first
    found = reduce(DataFrame.union, shared).groupBy(*own, "pos").agg(F.min("leader").alias("leader"))
    return leaders.select(*own, "pos", F.col("pos").alias("leader")).union(found).union(_blind_leaders(keyed.where("blind"), own, days, fold_rows))


def _marks(rows: DataFrame) -> DataFrame:
    """(pos, day, mark): one row for each key of a row that is not null, with the day counted from 1970."""
    pairs = F.array(*[F.struct("who", F.lit(i).alias("kind"), F.col(c).alias("key")) for i, c in enumerate(("report", "named", "opening"))])
    return rows.select("pos", F.datediff("date", F.lit("1970-01-01")).alias("day"), F.explode_outer(F.filter(pairs, lambda x: x["key"].isNotNull())).alias("mark"))


def _least_near(points: DataFrame, sources: DataFrame, days: int) -> DataFrame:
    """(mark, day, least): the least pos of sources with a point's mark within so many days; null if there is none. A mark
    is cut to one row a day before its window, so the calendar bounds what a task holds of it."""
    both = points.select("mark", "day", F.when(F.lit(False), F.col("pos")).alias("pos")).union(sources.select("mark", "day", "pos"))
    near = W.partitionBy("mark").orderBy("day").rangeBetween(-days, days)
    return both.groupBy("mark", "day").agg(F.min("pos").alias("p")).select("mark", "day", F.min("p").over(near).alias("least"))


def _leaders_in_rounds(rows: DataFrame, days: int) -> DataFrame:
    """(pos, leader) as the fold gives them. A round accepts the rows that come first among those undecided near them, and
    then rejects what shares a mark with one of these; rounds are bounded by the longest chain in which each row waits
    for the one before."""
    points = undecided = checkpointed(_marks(rows))
    leaders = points.limit(0)
    while True:
        met = undecided.join(_least_near(undecided, undecided, days), ["mark", "day"])
        first = met.groupBy("pos").agg(F.bool_or(F.col("least") < F.col("pos")).alias("waits")).where("NOT waits").select("pos")
        now = checkpointed(undecided.join(first, "pos", "left_semi"))
        if now.isEmpty():
            break
        leaders = checkpointed(leaders.union(now))
        reached = _least_near(undecided, now, days).where("least IS NOT NULL")
        decided = undecided.join(reached, ["mark", "day"], "left_semi").select("pos").distinct()
        undecided = checkpointed(undecided.join(decided, "pos", "left_anti"))
    return points.join(_least_near(points, leaders, days), ["mark", "day"]).groupBy("pos").agg(F.min("least").alias("leader"))


def _leaders_by_fold(rows: DataFrame, days: int) -> DataFrame:
    """(pos, leader): rows in order of pos, with the leaders of one piece of a channel in memory."""
    by = ["who", "piece"]
    sent = rows.select(F.to_json("who").alias("who"), "piece", "pos", "date", "report", "named", "opening").repartition(*by).sortWithinPartitions(*by, "pos")
    kind = sent.schema["pos"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        leaders: dict[tuple, list] = {}
        for batch in batches:
            out = []
            for who, piece, pos, date, *keys in zip(*(c.to_pylist() for c in batch.columns)):
                if (who, piece) != key:
                    key, leaders = (who, piece), {}
                marks = [(i, m) for i, m in enumerate(keys) if m is not None]
                near = [p for m in marks for p, d in leaders.get(m, ()) if abs((date - d).days) <= days]
                if not near:
                    for m in marks:
                        leaders.setdefault(m, []).append((pos, date))
                out.append(min(near, default=pos))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(out, batch.column("pos").type)], ["pos", "leader"])

    return sent.mapInArrow(fold, f"pos {kind}, leader {kind}")


def _blind_leaders(blind: DataFrame, own: list[str], days: int, fold_rows: int) -> DataFrame:
    """(own, pos, leader) of rows without a company.

    Rows with equal keys and date have one leader, that of the first of them, so one row of each such group is judged. A
    channel is cut where no row has a date for more than so many days: rows across a gap never meet. A piece of up to
    fold_rows is folded by one task; what is still larger is decided in rounds of aggregates. Rows without date or keys
    meet nobody.
    """
    keys = ["who", "date", "report", "named", "opening"]
    sent = checkpointed(blind.withColumn("who", F.struct(*own, "group")).select("pos", F.struct(*keys).alias("alike")))
    a = F.col("alike")
    meets = a["date"].isNotNull() & F.coalesce(a["report"], a["named"], a["opening"]).isNotNull()
    firsts = sent.where(meets).groupBy("alike").agg(F.min("pos").alias("pos")).select("pos", "alike.*")
    opens = F.coalesce(F.datediff("date", F.lag("date").over(W.partitionBy("who").orderBy("date"))) > days, F.lit(True))
    dates = firsts.select("who", "date").distinct().withColumn("opens", opens.cast("int"))
    pieces = dates.select("who", "date", F.sum("opens").over(W.partitionBy("who").orderBy("date")).alias("piece"))
    cut = firsts.join(pieces, ["who", "date"])
    cut = checkpointed(cut.join(cut.groupBy("who", "piece").agg(F.count("*").alias("n")), ["who", "piece"]))
    large = cut.where(F.col("n") > fold_rows)
    found = _leaders_by_fold(cut.where(F.col("n") <= fold_rows), days)
    if not large.isEmpty():
        found = found.union(_leaders_in_rounds(large, days))
    led = cut.join(found, "pos").select(F.struct(*keys).alias("alike"), "leader")
    mine = [a["who"][c].alias(c) for c in own]
    return sent.where(~meets).select(*mine, "pos", F.col("pos").alias("leader")).union(sent.where(meets).join(led, "alike").select(*mine, "pos", "leader"))


def dedup_tracker(df: DataFrame, days: int = 90) -> DataFrame:
    """Q2: W12 and A14: one row for each cluster: the one of best score, with the most advanced status and all notes."""
    keys = [*owner_of(df), "pos"]
    return merge_clusters(df.join(cluster_duplicates(df, days), keys), ["leader"]).drop("leader")


def resolve_mail_events(events: DataFrame, reviewed: DataFrame, links: DataFrame, tracker: DataFrame) -> DataFrame:
    """(event_id, num, how): an event's row by review (event_id, num), else by an earlier event of its thread
    (thread_id, num), else by the one row of its company and role; several rows make it ambiguous, none unmatched."""
    own = owner_of(events, reviewed, links, tracker)
    rev = reviewed.groupBy(*own, "event_id").agg(F.max("num").alias("n1"))
    lin = links.groupBy(*own, "thread_id").agg(F.max("num").alias("n2"), F.countDistinct("num").alias("c2"))
    exact = tracker.groupBy(*own, company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("r")).agg(F.max("num").alias("n3"), F.count("*").alias("c3"))
    e = events.select(*own, "event_id", "thread_id", company_key(F.col("company")).alias("k"), text_key(F.col("role")).alias("r"))
    met = e.join(rev, [*own, "event_id"], "left").join(lin, [*own, "thread_id"], "left").join(exact, [*own, "k", "r"], "left")
    thread, one = F.col("c2") == 1, F.col("c3") == 1
    how = F.when(F.col("n1").isNotNull(), "reviewed").when(thread, "thread").when(one, "exact").when((F.col("c2") > 1) | (F.col("c3") > 1), "ambiguous").otherwise("unmatched")
    return met.select(*own, "event_id", F.coalesce("n1", F.when(thread, F.col("n2")), F.when(one, F.col("n3"))).alias("num"), how.alias("how"))


def sync_pdf_flags(tracker: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tracker (num, reports) with pdf: does the manifest (report) have any of the row's report numbers?"""
    own = owner_of(tracker, manifest)
    named = tracker.select(*own, "num", F.explode("reports").alias("report")).join(manifest.select(*own, "report").distinct(), [*own, "report"], "left_semi").select(*own, "num").distinct().withColumn("_p", F.lit(True))
    return tracker.join(named, [*own, "num"], "left").withColumn("pdf", F.coalesce("_p", F.lit(False))).drop("_p")


def enrich_offices(postings: DataFrame, offices: DataFrame, vague: Sequence[str] = ("remote", "hybrid", "on-site", "")) -> DataFrame:
    """Postings (posting_id, location) whose location only names a way of working take the offices of the nested
    tree offices(name, departments array<struct<jobs array<long>>>) that list them."""
    jobs = offices.select("name", F.explode("departments").alias("d")).select("name", F.explode("d.jobs").alias("posting_id"))
    named = jobs.groupBy("posting_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("_o"))
    plain = F.lower(F.trim(F.coalesce("location", F.lit("")))).isin(*vague)
    return postings.join(named, "posting_id", "left").withColumn("location", F.when(plain, F.coalesce("_o", "location")).otherwise(F.col("location"))).drop("_o")


def reconcile_pending(pending: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: (pending with state and reason, rows by reason): items whose gate (posting_id, gate) is not eligible are processed."""
    keys = [*owner_of(pending, gate), "posting_id"]
    met = pending.join(gate.select(*keys, "gate"), keys, "left")
    blocked = F.coalesce(F.col("gate") != "eligible", F.lit(False))
    out = met.withColumn("state", F.when(blocked, "processed").otherwise("pending")).withColumn("reason", F.when(blocked, F.col("gate"))).drop("gate")
    return out, out.where("reason IS NOT NULL").groupBy(*keys[:-1], "reason").agg(F.count("*").alias("n"))


def snapshot(jobs: DataFrame, decisions: DataFrame, applied: DataFrame) -> DataFrame:
    """Q7: (item_id, category) of jobs (item_id, fresh): applications, then decided pending or excluded, then
    recommended if fresh, else available."""
    keys = [*owner_of(jobs, decisions, applied), "item_id"]
    dec = decisions.groupBy(*keys).agg(F.max_by("status", F.struct("updated_at", "status")).alias("_s"))
    app = applied.select(*keys).distinct().withColumn("_a", F.lit(True))
    met = jobs.join(dec, keys, "left").join(app, keys, "left")
    category = F.when(F.col("_a"), "application").when(F.col("_s").isin("pending", "excluded"), F.col("_s")).when(F.col("fresh"), "recommended").otherwise("available")
    return met.select(*keys, category.alias("category"))


def dashboard_stats(snap: DataFrame) -> DataFrame:
    """One row of counts by category (of each owner)."""
    return snap.groupBy(*owner_of(snap)).agg(F.count("*").alias("total"), *[F.count_if(F.col("category") == c).alias(c) for c in ("application", "pending", "excluded", "recommended", "available")])


def run_summary(funnel: DataFrame) -> DataFrame:
    """A2: one row for a run of scan_funnel: sources, rows, accepted, rejected, and the most frequent reason."""
    top = funnel.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n")).agg(F.min_by("reject_reason", F.struct(-F.col("n"), "reject_reason")).alias("top_reason"))
    sums = funnel.agg(F.countDistinct("company").alias("sources"), F.count("*").alias("found"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"))
    return sums.withColumn("rejected", F.col("found") - F.col("accepted")).crossJoin(top)


def merge_audits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Audits (scope, calls, started, ended, status) of two runs in one: sums, bounds and the worst status."""
    worst = F.array(*map(F.lit, ("ok", "partial", "failed")))
    both = a.unionByName(b).withColumn("_r", F.array_position(worst, F.col("status")))
    summed = both.groupBy("scope").agg(F.sum("calls").alias("calls"), F.min("started").alias("started"), F.max("ended").alias("ended"), F.max("_r").alias("_r"))
    return summed.withColumn("status", F.get(worst, (F.col("_r") - 1).cast("int"))).drop("_r")


def application_index(tracker: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: (index, new events): the whole index, and a change for each row whose status differs from the last event
    (num, at, new) known of it."""
    keys = [*owner_of(tracker, events), "num"]
    last = events.groupBy(*keys).agg(F.max_by("new", "at").alias("old"))
    met = tracker.select(*keys, "status", "company", "role", "score").join(last, keys, "left")
    return met.drop("old"), met.where("NOT status <=> old").select(*keys, "old", F.col("status").alias("new"))


def export_candidates(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """K6: one JSON document for each row, of the allowed columns alone; a column that is missing is an error."""
    return df.select(F.to_json(F.struct(*allowed)).alias("value"))


def append_dated(df: DataFrame, path: str, at: str) -> None:
    """K5: append run or health rows, partitioned by the day of column at."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def find(tracker: DataFrame, text: str) -> DataFrame:
    """rows by number or report number (leading zeros don't count), or whose company or role contains text or is alike."""
    bare = text.strip().lstrip("0")
    hit = F.lower("company").contains(text.lower()) | F.lower("role").contains(text.lower()) | roles_match(role_of(F.lit(text)), role_of(F.col("role")))
    if bare.isdigit():
        hit = (F.col("num") == int(bare)) | F.exists("reports", lambda n: n == int(bare))
    return tracker.where(hit)


def alias_set(item: Column, url: Column, cluster: Column) -> Column:
    """Distinct aliases of an item; the cluster's counts only where there is neither id nor url."""
    own = F.array_distinct(F.array_compact(F.array(item, url)))
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(cluster)))


def portal_url(url: Column, portals: Sequence[tuple[str, str, str]]) -> Column:
    """The canonical form of the first portal (host, pattern of the id, prefix) that a url belongs to, else the url."""
    out = url
    for host, pattern, prefix in reversed(portals):
        out = F.when(url.contains(host) & url.rlike(pattern), F.concat(F.lit(prefix), F.regexp_extract(url, pattern, 1))).otherwise(out)
    return out


def structured_liveness(status: Column, closed: Column, deadline: Column, today: Column) -> Column:
    """State of a portal's own fields: a closed mark or a deadline before today ends a posting."""
    return F.when(closed | (deadline < today), "expired").when(F.lower(status).isin("open", "active", "published"), "active").otherwise("unknown")


def probe_outcome(url: Column, status: Column, patterns: Sequence[tuple[str, str]]) -> tuple[Column, Column, Column]:
    """(ats, job id, outcome) of a probed url by the first pattern that reads an id; unsafe ids give nothing."""
    ats = job = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        got = F.regexp_extract(url, pattern, 1)
        ok = (got != "") & got.rlike(r"^[A-Za-z0-9_-]+$")
        ats, job = F.when(ok, name).otherwise(ats), F.when(ok, got).otherwise(job)
    outcome = F.when(ats.isNull(), None).when(status.isin(404, 410), "expired").when(status == 200, "active").otherwise("unknown")
    return ats, job, outcome


def portal_health(probes: DataFrame) -> DataFrame:
    """Q9: (company, state, suggestion) of probes (company, priority, ok, n_jobs, slug): live if a probe finds jobs, empty if
    one only answers, else missing; skipped if no portal could be probed at all (slug is null in all its rows). The
    suggestion is the best slug that has jobs."""
    tried = F.col("slug").isNotNull()
    has = tried & F.col("ok") & (F.col("n_jobs") > 0)
    out = probes.groupBy("company").agg(
        F.bool_or(tried).alias("tried"), F.bool_or(has).alias("live"), F.bool_or(tried & F.col("ok")).alias("any"), F.min_by(F.when(has, F.col("slug")), F.when(has, F.struct("priority", "slug"))).alias("suggestion")
    )
    state = F.when(~F.col("tried"), "skipped").when(F.col("live"), "live").when(F.col("any"), "empty").otherwise("missing")
    return out.select("company", state.alias("state"), "suggestion")


def bootstrap(state: DataFrame, artifact: DataFrame, since: Column) -> DataFrame:
    """Q11: the newer of state and artifact (url, status, at) for each url, the artifact's if they are of one time; artifact
    rows before since don't count."""
    both = state.withColumn("_p", F.lit(0)).unionByName(artifact.where(F.col("at") >= since).withColumn("_p", F.lit(1)))
    return both.groupBy("url").agg(F.max_by(F.struct("status", "at"), F.struct("at", "_p", "status")).alias("r")).select("url", "r.*")


def newest_run(runs: DataFrame, version: str) -> DataFrame:
    """Q11: the run (name, body, ...) of the greatest name whose body is a JSON object of that schema_version; no row if
    there is none. Names are compared before any body moves."""
    valid = runs.where((F.get_json_object("body", "$.schema_version") == version) & F.trim("body").startswith("{"))
    return valid.join(F.broadcast(valid.agg(F.max("name").alias("name"))), "name")  # one row


def bootstrap_from_runs(state: DataFrame, runs: DataFrame, version: str, now: Column, hours: int = 72) -> DataFrame:
    """Q11: (url, status, at): what state (url, status, at) and the newest valid run know of urls and is recent: at most so
    many hours before now, and not after it. The run's evidence ($.liveness.results, url to status) is as old as the run
    ($.started_at); where both know a url, the newer counts, and the run's if they are of one time."""
    body = F.col("body")
    started = F.get_json_object(body, "$.started_at").try_cast("timestamp")
    seen = F.from_json(F.get_json_object(body, "$.liveness.results"), "map<string, string>")
    # beside the explode, the time would be read from the whole body again for each url
    opened = newest_run(runs, version).select(started.alias("at"), seen.alias("seen"))
    artifact = opened.select("at", F.explode_outer("seen").alias("url", "status")).where("url IS NOT NULL").select("url", "status", "at")
    age = now.cast("timestamp").cast("double") - F.col("at").cast("double")
    recent = lambda df: df.select("url", "status", F.col("at").cast("timestamp").alias("at")).where((age >= 0) & (age <= hours * 3600))
    return bootstrap(recent(state), recent(artifact), F.lit("0001-01-01").cast("timestamp"))


def search_ingest(df: DataFrame, title_ok: Column, place_ok: Column, seen_urls: DataFrame, seen_roles: DataFrame | None = None) -> DataFrame:
    """Q10: df (company, title, location, url, pos) with outcome: invalid, title, location, dup_url, dup_role, or accepted.

    Rows count in order of pos (unique): one is a dup_url if its url was seen or accepted earlier here, else a dup_role if
    its company and role were (seen_roles: company, title). What is not accepted marks nothing. Urls are compared as they
    are, companies and roles by their keys; a blank key is the role of no other row.
    """
    roles = lambda t: t.withColumns({"_c": company_key(F.col("company")), "_r": role_key(F.col("title"))})
    seen = seen_urls.select(F.col("url").alias("_u")).where("_u IS NOT NULL").distinct()
    early = F.when(F.col("url").isNull() | F.col("title").isNull(), "invalid").when(~F.coalesce(title_ok, F.lit(True)), "title").when(~F.coalesce(place_ok, F.lit(True)), "location")
    judged = roles(df.withColumn("_e", early)).join(seen, F.col("url") == F.col("_u"), "left").withColumn("_seen_url", F.col("_u").isNotNull()).drop("_u")
    judged = judged.withColumn("_role", F.when((F.col("_c") != "") & (F.col("_r") != ""), F.struct("_c", "_r"))).drop("_c", "_r")
    if seen_roles is None:
        judged = judged.withColumn("_seen_role", F.lit(False))
    else:
        known = roles(seen_roles).where("_c <> '' AND _r <> ''").select(F.struct("_c", "_r").alias("_k")).distinct()
        judged = judged.join(known, F.col("_role") == F.col("_k"), "left").withColumn("_seen_role", F.col("_k").isNotNull()).drop("_k")
    judged = checkpointed(judged)
    open_rows = judged.where("_e IS NULL AND NOT _seen_url AND NOT _seen_role").select("pos", "url", "_role")
    taken = checkpointed(accept_in_order(open_rows, ["url", "_role"], "pos").where("accepted").select(F.col("pos").alias("_at"), F.col("url").alias("_au")))
    out = judged.join(taken, F.col("url") == F.col("_au"), "left")  # one accepted row has a url at most
    outcome = F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_at") == F.col("pos"), "accepted").when(F.col("_seen_url") | F.coalesce(F.col("_at") < F.col("pos"), F.lit(False)), "dup_url").otherwise("dup_role")
    return out.withColumn("outcome", outcome).select(*df.columns, "outcome")


def search_stats(judged: DataFrame) -> DataFrame:
    """Q10: one row of counts of search_ingest's outcomes: received, and each of them."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return judged.agg(F.count("*").alias("received"), *[count(o) for o in ("accepted", "invalid", "title", "location", "dup_url", "dup_role")])


def apply_transitions(rows: DataFrame) -> DataFrame:
    """rows (status, proposed) with the status after the guard of X29."""
    return rows.withColumn("status", F.when(transition_allowed(F.col("status"), F.col("proposed")), F.col("proposed")).otherwise(F.col("status")))


def newest_first(df: DataFrame, dates: Sequence[str], key: str, limit: int) -> DataFrame:
    """The newest `limit` rows by the first of several dates that is there."""
    return df.orderBy(F.desc_nulls_last(F.coalesce(*dates)), key).limit(limit)


def defer_cooling(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows, those that are not cooling first."""
    return df.orderBy("cooling", *order).limit(limit)


def rank_search(df: DataFrame, limit: int) -> DataFrame:
    """Search records by freshness, priority, company, title and id; at least 1 and at most 100."""
    return df.orderBy(F.desc_nulls_last("posted_at"), F.desc("priority"), "company", "title", "id").limit(min(100, max(1, limit)))


def source_inventory(items: DataFrame, rules: DataFrame) -> DataFrame:
    """A4: (source, hosts, pending, processed) of a pipeline (url, state), by J20; hosts in order. Busiest first: by
    pending, then both, then name."""
    own = owner_of(items)
    placed = classify_source(items, rules).withColumn("_host", host_of(F.col("url")))
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    found = placed.groupBy(*own, "source").agg(F.array_sort(F.collect_set("_host")).alias("hosts"), count("pending"), count("processed"))
    return found.orderBy(*own, F.desc("pending"), F.desc(F.col("pending") + F.col("processed")), "source")
