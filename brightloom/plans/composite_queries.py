"""Registered queries of composite jobs, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions.text import has_keyword
from brightloom.operators import composite as C
from brightloom.operators import filters as R
from brightloom.operators import tracker as T
from brightloom.operators.identity import history_gate, role_tokens
from brightloom.operators.portals import portal_liveness
from brightloom.plans import identity_queries as I
from brightloom.plans import posting_queries as P
from brightloom.plans.views import postings, table, tracker, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_KR = "regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS k, regexp_replace(lower(role), '[^a-z0-9]+', '', 'g') AS r"


@query("j4_guard_failed", "SELECT o_orderkey AS report FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j4(spark, d):
    failed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("report"))
    return C.guard_failed(table(spark, d, "orders").select(F.col("o_orderkey").alias("report")), failed)


@query("w10_allocate_numbers", """WITH a AS (SELECT event_id AS pos, CASE WHEN event_id % 3 > 0 THEN event_id // 2 END AS num FROM events), u AS (SELECT o_custkey AS num FROM orders),
m AS (SELECT *, num IS NOT NULL AND num NOT IN (SELECT num FROM u) AND row_number() OVER (PARTITION BY num ORDER BY pos) = 1 AS own FROM a)
SELECT pos, CASE WHEN own THEN num ELSE (SELECT max(num) FROM (SELECT num FROM a UNION ALL SELECT num FROM u)) + row_number() OVER (PARTITION BY own ORDER BY pos) END AS given FROM m""")
def w10(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 > 0, F.expr("event_id div 2")).alias("num"))
    return C.allocate_numbers(a, table(spark, d, "orders").select(F.col("o_custkey").alias("num"))).select("pos", "given")


@query("j24_merge_additions", f"""{with_views('tracker')}, t AS (SELECT num, {_KR}, 'r' || num AS report FROM tracker),
a AS (SELECT event_id AS pos, event_id % 5000 AS num, 'customer' || printf('%09d', user_id) AS k, 'r' || (event_id % 700) AS report FROM events)
SELECT pos, CASE WHEN n IS NULL THEN 'insert' ELSE 'update' END AS action, n AS num FROM (SELECT pos, coalesce((SELECT max(t.num) FROM t WHERE t.k = a.k AND t.report = a.report), (SELECT max(t.num) FROM t WHERE t.k = a.k AND t.num = a.num), (SELECT max(t.num) FROM t WHERE t.k = a.k AND t.r = 'urgent')) AS n FROM a)""")
def j24(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.col("event_id").alias("pos"), (F.col("event_id") % 5000).alias("num"), F.format_string("Customer#%09d, Inc.", "user_id").alias("company"), F.lit("URGENT").alias("role"), F.concat(F.lit("r"), F.col("event_id") % 700).alias("report"))
    return C.merge_additions(tracker(spark, d).withColumn("report", F.concat(F.lit("r"), "num")), a)


#: A tracker of two owners in which some titles, numbers and reports repeat; pos is its order.
_ROWS = f"""{with_views('tracker')}, base AS (
  SELECT num AS pos, CASE WHEN num % 2 = 0 THEN 'a' ELSE 'b' END AS owner_id, num // 3 AS num, company, role, status, score, CASE WHEN num % 6 < 2 THEN 'r' || (num % 40) END AS report, 'n' || (num % 3) AS notes FROM tracker),
d AS (SELECT *, owner_id || regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS g, lower(role) AS t, coalesce(status IN {T.ADVANCED!r}, false) AS flying FROM base),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS i FROM d),
f(g, i, leads, pos, leader) AS (
  SELECT g, 1, [{{'pos': pos, 'num': num, 't': t, 'flying': flying, 'report': report}}], pos, pos FROM o WHERE i = 1
  UNION ALL
  SELECT g, i, CASE WHEN hit IS NULL THEN leads || [{{'pos': pos, 'num': num, 't': t, 'flying': flying, 'report': report}}] ELSE leads END, pos, coalesce(hit, pos)
  FROM (SELECT o.*, f.leads, list_filter(f.leads, lambda l: coalesce(l.report = o.report, false) OR (l.num = o.num AND l.t = o.t) OR (l.t = o.t AND NOT l.flying AND NOT o.flying))[1].pos AS hit
        FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1))""".replace("WITH", "WITH RECURSIVE", 1)


def _two_owners(spark, d):
    t = tracker(spark, d)
    return t.select(
        F.col("num").alias("pos"), F.when(F.col("num") % 2 == 0, "a").otherwise("b").alias("owner_id"), F.expr("num div 3").alias("num"), "company", "role", "status", "score", "date",
        F.when(F.col("num") % 6 < 2, F.concat(F.lit("r"), F.col("num") % 40)).alias("report"), F.concat(F.lit("n"), F.col("num") % 3).alias("notes"),
    )


@query("w12_cluster_duplicates", f"{_ROWS} SELECT owner_id, pos, leader FROM f JOIN d USING (pos)")
def w12(spark, d):
    return C.cluster_duplicates(_two_owners(spark, d)).select("owner_id", "pos", "leader")


@query(
    "w12_unnamed_companies",
    f"""{with_views('tracker')},
d AS (SELECT num AS pos, 'via' || (num // 4 % 400) AS g, lower(role) AS t, date, coalesce(status IN {T.ADVANCED!r}, false) AS flying, CASE WHEN num % 6 < 2 THEN 'r' || (num % 40) END AS report FROM tracker),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS i FROM d),
f(g, i, leads, pos, leader) AS (
  SELECT g, 1, [{{'pos': pos, 't': t, 'flying': flying, 'report': report, 'date': date}}], pos, pos FROM o WHERE i = 1
  UNION ALL
  SELECT g, i, CASE WHEN hit IS NULL THEN leads || [{{'pos': pos, 't': t, 'flying': flying, 'report': report, 'date': date}}] ELSE leads END, pos, coalesce(hit, pos)
  FROM (SELECT o.*, f.leads, list_filter(f.leads, lambda l: abs(date_diff('day', l.date, o.date)) <= 90 AND (coalesce(l.report = o.report, false) OR (l.t = o.t AND NOT l.flying AND NOT o.flying)))[1].pos AS hit
        FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1))
SELECT pos, leader FROM f""".replace("WITH", "WITH RECURSIVE", 1),
)
def w12_unnamed(spark, d):
    """Applications whose company is not known, by the channel they came through."""
    t = tracker(spark, d)
    rows = t.select(F.col("num").alias("pos"), "num", F.lit(C.BLIND).alias("company"), "role", "status", "date", F.concat(F.lit("via"), F.expr("num div 4 % 400")).alias("via"), F.when(F.col("num") % 6 < 2, F.concat(F.lit("r"), F.col("num") % 40)).alias("report"))
    return C.cluster_duplicates(rows).select("pos", "leader")


@query(
    "q2_dedup_tracker",
    f"""{_ROWS}, c AS (SELECT d.*, leader FROM f JOIN d USING (pos))
SELECT owner_id, arg_max(num, (score, -num)) AS num, max(score) AS score, count(*) AS n,
       {list(T.STATUS_RANK)!r}[max(list_position({list(T.STATUS_RANK)!r}, status))] AS status, array_length(list_distinct(list(notes))) AS n_notes FROM c GROUP BY owner_id, leader""",
)
def q2(spark, d):
    found = C.dedup_tracker(_two_owners(spark, d))
    return found.select("owner_id", "num", "score", "n", "status", F.size(F.split("notes", "; ")).cast("long").alias("n_notes"))


@query("j14_resolve_mail_events", f"""{with_views('tracker')}, ex AS (SELECT k, r, max(num) AS n, count(*) AS c FROM (SELECT num, {_KR} FROM tracker) GROUP BY 1, 2), li AS (SELECT user_id AS thread_id, max(event_id) AS n, count(DISTINCT event_id) AS c FROM events WHERE event_id % 400 = 0 GROUP BY 1),
ev AS (SELECT event_id, user_id AS thread_id, 'customer' || printf('%09d', event_id % 1500) AS k, 'low' AS r FROM events)
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_id WHEN li.c = 1 THEN li.n WHEN ex.c = 1 THEN ex.n END AS num, CASE WHEN event_id % 10 = 0 THEN 'reviewed' WHEN li.c = 1 THEN 'thread' WHEN ex.c = 1 THEN 'exact' WHEN li.c > 1 OR ex.c > 1 THEN 'ambiguous' ELSE 'unmatched' END AS how
FROM ev LEFT JOIN li USING (thread_id) LEFT JOIN ex USING (k, r)""")
def j14(spark, d):
    e = table(spark, d, "events")
    ev = e.select("event_id", F.col("user_id").alias("thread_id"), F.format_string("Customer#%09d", F.col("event_id") % 1500).alias("company"), F.lit("Low").alias("role"))
    links = e.where("event_id % 400 = 0").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("num"))
    return C.resolve_mail_events(ev, e.where("event_id % 10 = 0").select("event_id", F.col("event_id").alias("num")), links, tracker(spark, d))


@query("j19_pdf_flags", "SELECT o_orderkey AS num, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') OR o_orderkey + 1 IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AS pdf FROM orders")
def j19(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("num"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("reports"))
    return C.sync_pdf_flags(t, table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("report"))).select("num", "pdf")


@query("j21_enrich_offices", """WITH o AS (SELECT s_nationkey, s_suppkey FROM supplier), n AS (SELECT c_custkey AS id, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM customer JOIN supplier ON s_suppkey % 100 = c_custkey % 100 JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey AS posting_id, CASE WHEN c_custkey % 2 = 0 THEN coalesce(names, 'Remote') ELSE c_mktsegment END AS location FROM customer LEFT JOIN n ON id = c_custkey""")
def j21(spark, d):
    c = table(spark, d, "customer")
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    # an office of a name lists a group's jobs once, in departments of a thousand: suppliers of one nation list the same
    jobs = c.groupBy((F.col("c_custkey") % 100).alias("g"), F.expr("c_custkey div 100000").alias("part")).agg(F.collect_list("c_custkey").alias("jobs"))
    named = s.select(F.col("n_name").alias("name"), (F.col("s_suppkey") % 100).alias("g")).distinct()
    offices = named.join(jobs, "g").select("name", F.array(F.struct("jobs")).alias("departments"))
    p = c.select(F.col("c_custkey").alias("posting_id"), F.when(F.col("c_custkey") % 2 == 0, "Remote").otherwise(F.col("c_mktsegment")).alias("location"))
    return C.enrich_offices(p, offices)


@query("q5_reconcile_pending", f"{with_views('tracker')}, {I._GATE} SELECT gate AS reason, count(*) AS n FROM g WHERE gate <> 'eligible' GROUP BY 1")
def q5(spark, d):
    c = I._candidates(spark, d)
    return C.reconcile_pending(c, history_gate(c, tracker(spark, d)))[1]


_SNAP = """snap AS (SELECT c_custkey AS item_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0) THEN 'application'
  WHEN s IN ('pending', 'excluded') THEN s WHEN c_acctbal > 3000 THEN 'recommended' ELSE 'available' END AS category
  FROM customer LEFT JOIN (SELECT user_id, arg_max(CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'excluded' ELSE 'new' END, (ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'excluded' ELSE 'new' END)) AS s FROM events GROUP BY 1) ON user_id = c_custkey)"""


def _snapshot(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_acctbal") > 3000).alias("fresh"))
    dec = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "excluded").otherwise("new").alias("status"), F.col("ts").alias("updated_at"))
    return C.snapshot(jobs, dec, table(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderkey % 4 = 0").select(F.col("o_custkey").alias("item_id")))


@query("q7_snapshot", f"WITH {_SNAP} SELECT * FROM snap")
def q7(spark, d):
    return _snapshot(spark, d)


@query("a19_dashboard_stats", f"WITH {_SNAP} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE category = '{c}') AS {c}''' for c in ('application', 'pending', 'excluded', 'recommended', 'available'))} FROM snap")
def a19(spark, d):
    return C.dashboard_stats(_snapshot(spark, d))


@query("a2_run_summary", f"""{with_views('postings')}, f AS (SELECT company, {P._REASON} AS r FROM postings) SELECT count(DISTINCT company) AS sources, count(*) AS found, count(*) FILTER (WHERE r IS NULL) AS accepted, count(r) AS rejected,
(SELECT r FROM f WHERE r IS NOT NULL GROUP BY r ORDER BY count(*) DESC, r LIMIT 1) AS top_reason FROM f""")
def a2(spark, d):
    return C.run_summary(R.scan_funnel(postings(spark, d), P._rules()))


@query("a23_merge_audits", "SELECT event_type AS scope, sum(user_id) AS calls, min(ts) AS started, max(ts) AS ended, ['ok', 'partial', 'failed'][max(event_id % 3) + 1] AS status FROM events GROUP BY 1")
def a23(spark, d):
    a = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("calls"), F.col("ts").alias("started"), F.col("ts").alias("ended"), F.element_at(F.array(*map(F.lit, ("ok", "partial", "failed"))), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), "event_id")
    return C.merge_audits(a.where("event_id % 2 = 0").drop("event_id"), a.where("event_id % 2 = 1").drop("event_id"))


@query("k7_application_index", f"{with_views('tracker')}, l AS (SELECT l_orderkey AS num, arg_max(CASE l_returnflag WHEN 'A' THEN 'applied' WHEN 'R' THEN 'rejected' ELSE 'offer' END, pos) AS old FROM (SELECT *, l_orderkey || '-' || l_linenumber || l_partkey || l_suppkey || l_quantity || l_returnflag || l_linestatus AS pos FROM lineitem) GROUP BY 1) SELECT num, old, status AS new FROM tracker LEFT JOIN l USING (num) WHERE old IS NULL OR old <> status")
def k7(spark, d):
    new = F.when(F.col("l_returnflag") == "A", "applied").when(F.col("l_returnflag") == "R", "rejected").otherwise("offer")
    at = F.concat("l_orderkey", F.lit("-"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    ev = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("num"), at.alias("at"), new.alias("new"))
    return C.application_index(tracker(spark, d), ev)[1]


@query("k6_export", """SELECT '{"num":' || o_orderkey || ',"state":"' || o_orderstatus || '"}' AS value FROM orders""")
def k6(spark, d):
    return C.export_candidates(table(spark, d, "orders").select(F.col("o_orderkey").alias("num"), F.col("o_orderstatus").alias("state"), "o_custkey"), ["num", "state"])


@query("f24_find", f"{with_views('tracker')} SELECT num FROM tracker WHERE num = 12 OR num + 1 = 12")
def f24(spark, d):
    return C.find(tracker(spark, d).withColumn("reports", F.array(F.col("num") + 1)), "0012").select("num")


@query("x22_alias_set", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'i' || o_orderkey || ',u' || o_custkey WHEN 1 THEN 'u' || o_custkey ELSE 'pc' || o_custkey END AS aliases FROM orders")
def x22(spark, d):
    k = F.col("o_orderkey")
    a = C.alias_set(F.when(k % 3 == 0, F.concat(F.lit("i"), k)), F.when(k % 3 < 2, F.concat(F.lit("u"), "o_custkey")), F.concat(F.lit("pc"), "o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(a, ",").alias("aliases"))


@query("x6_portal_url", r"SELECT page_id, CASE WHEN contains(url, 'example.com') AND regexp_matches(url, '/([0-9]+)') THEN 'https://portal.example.com/view/' || regexp_extract(url, '/([0-9]+)', 1) ELSE url END AS key FROM pages")
def x6(spark, d):
    return table(spark, d, "pages").select("page_id", C.portal_url(F.col("url"), [("example.com", r"/([0-9]+)", "https://portal.example.com/view/")]).alias("key"))


_X9_SQL = """lower(p_name || ' ' || p_type || ' uxui ' || CASE p_partkey % 3 WHEN 0 THEN 'engineer connector' WHEN 1 THEN 'frontend mobile a1b2 qa' ELSE '' END)"""


@query("x9_role_tokens", f"SELECT p_partkey, array_to_string(list_sort(list_distinct([x for x in regexp_split_to_array({_X9_SQL}, '[^a-z0-9]+') if length(x) > 3 OR x = 'qa'])), ',') AS tokens FROM part")
def x9(spark, d):
    more = F.when(F.col("p_partkey") % 3 == 0, "Member of  Technical Staff, Connector").when(F.col("p_partkey") % 3 == 1, "Frontend/Mobile A1/B2, QA ab/c/d").otherwise("")
    title = F.concat_ws(" ", "p_name", "p_type", F.lit("Sénior ux/ui"), more)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(role_tokens(title)), ",").alias("tokens"))


@query("x24_structured_liveness", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'unknown' END AS state FROM orders")
def x24(spark, d):
    s = C.structured_liveness(F.when(F.col("o_orderstatus") == "O", "Open").otherwise(F.col("o_orderstatus")), F.col("o_orderkey") % 7 == 0, F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", s.alias("state"))


@query(
    "x24_portal_rules",
    """WITH e AS (SELECT event_id, event_id // 8 AS i, ['saramin', 'wanted', 'remember', 'jobkorea', 'ashby', 'greenhouse', 'lever', 'workday'][event_id % 8 + 1] AS portal FROM events),
s AS (SELECT *, CASE WHEN i % 11 = 0 THEN 404 WHEN i % 11 = 1 THEN 503 ELSE 200 END AS status FROM e),
v AS (SELECT event_id, portal, CASE WHEN status = 404 THEN portal || '_api_gone' WHEN status = 503 THEN NULL
  WHEN portal = 'saramin' THEN [NULL, 'saramin_posting_closed', 'saramin_apply_open', 'saramin_posting_closed'][i % 4 + 1]
  WHEN portal = 'wanted' THEN [NULL, 'wanted_structured_hidden', 'wanted_structured_active', 'wanted_structured_closed'][i % 4 + 1]
  WHEN portal = 'remember' THEN [NULL, 'remember_structured_closed', 'remember_structured_active', NULL][i % 4 + 1]
  WHEN portal = 'jobkorea' THEN ['jobkorea_explicitly_closed', 'jobkorea_ongoing', 'jobkorea_deadline_passed', 'jobkorea_future_deadline'][i % 4 + 1]
  WHEN portal = 'ashby' THEN ['ashby_api_ok', 'ashby_api_unlisted', 'ashby_api_unlisted', NULL][i % 4 + 1]
  ELSE portal || '_api_ok' END AS code FROM s)
SELECT event_id, code, CASE WHEN code IS NULL THEN 'unknown' WHEN ends_with(code, '_gone') OR ends_with(code, '_closed') OR ends_with(code, '_hidden') OR ends_with(code, '_passed') OR ends_with(code, '_unlisted') THEN 'expired' ELSE 'active' END AS result FROM v""",
)
def x24_portals(spark, d):
    """Answers of eight portals, each in four forms."""
    forms = {
        "saramin": ("'<button onclick=\"quickApplyForm(', event_id, '7)\">입사지원</button>'", "'<a onclick=\"quickApplyForm(&#39;', event_id, '&#39;)\" disabled>입사지원</a>'", "'<p>x</p><button onclick=\"quickApplyForm(', event_id, ')\"><b>입사지원</b></button>'", "'<p>본 채용정보는 마감되었습니다</p>'"),
        "wanted": ("""'{"id": ', event_id, ', "status": "active"}'""", """'{"job": {"id": ', event_id, ', "position": "x", "hidden": true, "status": "active"}}'""", """'{"id": ', event_id, ', "position": "x", "status": "Open"}'""", """'{"job": {"id": ', event_id, ', "position": "x", "status": "close"}}'"""),
        "remember": ("'<p>no data</p>'",) + tuple(f"""'<script id="__NEXT_DATA__">{{"props": [{{"id": "x"}}, {{"deep": {{"id": ', event_id, ', "title": "{t}", "status": "{v}"}}}}]}}</script>'""" for t, v in (("t", "Ended"), ("t", "recruiting"), (" ", "open"))),
        "jobkorea": ("'<b>마감되었습니다.</b> 마감일 : 상시채용'", "'마감일: 상시채용 마감일: 2020.1.1'", "'마감일 : 2024.3.14 남은기간'", "'마감일 : 2024.3.15 남은기간 1일'"),
        "ashby": ("""'{"jobs": [{"id": "1x"}, {"id": "', event_id, '"}]}'""", """'{"jobs": [{"id": "', event_id, '", "isListed": false}]}'""", """'{"jobs": []}'""", """'{"jobs": {}}'"""),
        "greenhouse": ("'{}'",) * 4, "lever": ("'{}'",) * 4, "workday": ("'{}'",) * 4,
    }
    case = " ".join(f"WHEN event_id % 8 = {p} AND i % 4 = {n} THEN concat({body})" for p, bodies in enumerate(forms.values()) for n, body in enumerate(bodies))
    e = table(spark, d, "events").select("event_id", F.expr("event_id div 8").alias("i"))
    answers = e.select(
        "event_id", F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 8 + 1).cast("int")).alias("portal"), F.col("event_id").cast("string").alias("posting_id"),
        F.when(F.col("i") % 11 == 0, 404).when(F.col("i") % 11 == 1, 503).otherwise(200).alias("status"), F.expr(f"CASE {case} END").alias("body"),
    )
    return portal_liveness(answers, F.lit("2024-03-15").cast("date")).select("event_id", "code", "result")


@query("x32_probe_outcome", r"SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 'org' WHEN contains(url, 'example.net') THEN 'net' END AS ats, CASE WHEN NOT contains(url, 'example.com') THEN regexp_extract(url, '/([0-9]+)', 1) END AS job_id, CASE WHEN contains(url, 'example.com') THEN NULL ELSE ['expired', 'active', 'unknown'][page_id % 3 + 1] END AS outcome FROM pages")
def x32(spark, d):
    code = F.element_at(F.array(F.lit(404), F.lit(200), F.lit(500)), (F.col("page_id") % 3 + 1).cast("int"))
    ats, job, outcome = C.probe_outcome(F.col("url"), code, [("org", r"example\.org/[a-z]+/([0-9]+)"), ("net", r"example\.net/[a-z]+/([0-9]+)")])
    return table(spark, d, "pages").select("page_id", ats.alias("ats"), job.alias("job_id"), outcome.alias("outcome"))


@query("q9_portal_health", """SELECT user_id AS company, CASE WHEN user_id % 11 = 0 THEN 'skipped' WHEN bool_or(event_id % 2 = 0 AND event_id % 5 = 0) THEN 'live' WHEN bool_or(event_id % 2 = 0) THEN 'empty' ELSE 'missing' END AS state,
  arg_min('s' || event_id, (event_id % 7, 's' || event_id)) FILTER (WHERE event_id % 2 = 0 AND event_id % 5 = 0 AND user_id % 11 > 0) AS suggestion FROM events GROUP BY 1""")
def q9(spark, d):
    e = F.col("event_id")
    slug = F.when(F.col("user_id") % 11 > 0, F.concat(F.lit("s"), e))  # no portal is known of the others
    return C.portal_health(table(spark, d, "events").select(F.col("user_id").alias("company"), (e % 7).alias("priority"), (e % 2 == 0).alias("ok"), F.when(e % 5 == 0, 3).otherwise(0).alias("n_jobs"), slug.alias("slug")))


@query("q11_bootstrap", "SELECT user_id::VARCHAR AS url, arg_max(event_type, (ts, event_id % 2 = 1, event_type)) AS status, max(ts) AS at FROM events WHERE event_id % 2 = 0 OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def q11(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id")
    return C.bootstrap(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"), F.lit("2024-01-15").cast("timestamp"))


@query(
    "q11_newest_run",
    """WITH e AS (SELECT user_id::VARCHAR AS url, event_type AS status, ts AS t0, event_id FROM events), n AS (SELECT max(ts) AS now FROM events),
r AS (SELECT ts::DATE AS day, user_id::VARCHAR AS url, event_type AS status, event_id FROM events WHERE event_id % 3 = 0),
d AS (SELECT max(day) AS day FROM r WHERE dayofmonth(day) % 3 = 0),
a AS (SELECT url, arg_max(status, event_id) AS status, (d.day + INTERVAL 20 HOUR)::TIMESTAMP AS t0, 1 AS p FROM r JOIN d USING (day) GROUP BY url, d.day),
b AS (SELECT url, status, t0, p FROM a UNION ALL SELECT url, status, t0, 0 FROM e WHERE event_id % 3 > 0)
SELECT url, arg_max(status, (t0, p, status)) AS status, max(t0) AS at FROM b, n WHERE t0 <= now AND t0 >= now - INTERVAL 240 HOUR GROUP BY url""",
)
def q11_newest(spark, d):
    """A run of each day lands as a document; of days that three does not divide it is of another version or broken."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id")
    seen = e.where("event_id % 3 = 0").groupBy(F.to_date("at").alias("day"), "url").agg(F.max_by("status", "event_id").alias("status"))
    body = F.to_json(F.struct(F.when(F.dayofmonth("day") % 3 < 2, "run.v1").otherwise("run.v0").alias("schema_version"), F.date_format("day", "yyyy-MM-dd'T'20:00:00").alias("started_at"), F.struct(F.map_from_entries("m").alias("results")).alias("liveness")))
    runs = seen.groupBy("day").agg(F.collect_list(F.struct("url", "status")).alias("m")).select(F.date_format("day", "'apply-'yyyy-MM-dd'.json'").alias("name"), F.when(F.dayofmonth("day") % 3 == 1, F.concat(F.lit("["), body)).otherwise(body).alias("body"))
    last = F.lit(str(e.agg(F.max("at")).first()[0])).cast("timestamp")
    return C.bootstrap_from_runs(e.where("event_id % 3 > 0").drop("event_id"), runs, "run.v1", last, 240).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Search results of part by company, with urls and roles that repeat, judged one by one: r is a row, s what was accepted.
_SEARCH = """WITH RECURSIVE r AS (SELECT p_partkey AS pos, row_number() OVER (ORDER BY p_partkey) AS i, CASE WHEN p_partkey % 13 > 0 THEN p_name END AS title, p_type AS location, 'u' || (p_partkey % 900) AS url, 'c' || (p_partkey % 50) AS company FROM part),
e AS (SELECT pos, url, company || ':' || regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS role, row_number() OVER (ORDER BY pos) AS i,
        CASE WHEN title IS NULL THEN 'invalid' WHEN NOT contains(title, 'ring') AND NOT contains(title, 'widget') THEN 'title' WHEN location = 'ECONOMY' THEN 'location' END AS x,
        url IN (SELECT 'u' || s_suppkey FROM supplier) AS su, company || ':' || regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') IN (SELECT 'c7:' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') FROM part WHERE p_partkey % 20 = 0) AS sr FROM r),
c AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM e WHERE x IS NULL),
f(n, pos, outcome, urls, roles) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT n, pos, o, CASE WHEN o = 'accepted' THEN urls || [url] ELSE urls END, CASE WHEN o = 'accepted' THEN roles || [role] ELSE roles END
  FROM (SELECT c.n, c.pos, c.url, c.role, f.urls, f.roles, CASE WHEN c.su OR list_contains(f.urls, c.url) THEN 'dup_url' WHEN c.sr OR list_contains(f.roles, c.role) THEN 'dup_role' ELSE 'accepted' END AS o FROM f JOIN c ON c.n = f.n + 1)),
judged AS (SELECT pos, outcome FROM f WHERE n > 0 UNION ALL SELECT pos, x FROM e WHERE x IS NOT NULL)"""


def _search(spark, d):
    p = table(spark, d, "part")
    r = p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 13 > 0, F.col("p_name")).alias("title"), F.col("p_type").alias("location"), F.concat(F.lit("c"), F.col("p_partkey") % 50).alias("company"), F.concat(F.lit("u"), F.col("p_partkey") % 900).alias("url"))
    low = F.lower("title")
    seen_roles = p.where("p_partkey % 20 = 0").select(F.lit("c7").alias("company"), F.col("p_name").alias("title"))
    return C.search_ingest(r, has_keyword(low, "ring ") | low.contains("ring") | has_keyword(low, "widget"), F.col("location") != "ECONOMY", table(spark, d, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url")), seen_roles)


@query("q10_search_ingest", f"{_SEARCH} SELECT pos, outcome FROM judged")
def q10(spark, d):
    return _search(spark, d).select("pos", "outcome")


@query("q10_search_stats", f"{_SEARCH} SELECT count(*) AS received, {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ('accepted', 'invalid', 'title', 'location', 'dup_url', 'dup_role'))} FROM judged")
def q10_stats(spark, d):
    return C.search_stats(_search(spark, d))


@query("l5_rank_search", "SELECT p_partkey AS id FROM part ORDER BY CASE WHEN p_partkey % 4 > 0 THEN p_size END DESC NULLS LAST, p_retailprice DESC, p_brand, p_name, p_partkey LIMIT 80")
def l5(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("posted_at"), F.col("p_retailprice").alias("priority"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"))
    return C.rank_search(p, 80).select("id")


@query("l8_newest_first", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '1996-01-01' END DESC, o_orderkey LIMIT 120")
def l8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp")).alias("a"), F.lit("1996-01-01").cast("timestamp").alias("b"))
    return C.newest_first(o, ["a", "b"], "o_orderkey", 120).select("o_orderkey")


@query("l9_defer_cooling", "SELECT o_orderkey FROM orders ORDER BY o_orderkey % 3 = 0, o_totalprice DESC, o_orderkey LIMIT 100")
def l9(spark, d):
    o = table(spark, d, "orders").withColumn("cooling", F.col("o_orderkey") % 3 == 0)
    return C.defer_cooling(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey")


@query("a4_source_inventory", """WITH i AS (SELECT page_id % 3 AS o, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, page_id % 2 = 0 AS p FROM pages),
s AS (SELECT *, CASE WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'org' ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS source FROM i)
SELECT 'o' || o AS owner_id, source, string_agg(DISTINCT h, ',' ORDER BY h) AS hosts, count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE NOT p) AS processed FROM s GROUP BY ALL""")
def a4(spark, d):
    items = table(spark, d, "pages").select(F.concat(F.lit("o"), F.col("page_id") % 3).alias("owner_id"), "url", F.when(F.col("page_id") % 2 == 0, "pending").otherwise("processed").alias("state"))
    rules = spark.createDataFrame([("example.org", "org", 1)], "domain string, source string, pos int")
    return C.source_inventory(items, rules).withColumn("hosts", F.array_join("hosts", ","))


@query("w4_top_matches", f"""{with_views('tracker')}, t AS (SELECT 'o' || num % 2 AS owner_id, num, status, {_KR} FROM tracker), p AS (SELECT c_custkey AS posting_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k FROM customer)
SELECT owner_id, posting_id, num, row_number() OVER (PARTITION BY owner_id, posting_id ORDER BY t.r = 'high' DESC, num DESC)::INT AS rank FROM p JOIN t USING (k) QUALIFY rank <= 2""")
def w4(spark, d):
    """The best two rows of each owner for shared postings."""
    from brightloom.operators.identity import tracker_matches

    p = table(spark, d, "customer").select(F.col("c_custkey").alias("posting_id"), F.col("c_name").alias("company"), F.lit("High").alias("title"))
    t = tracker(spark, d).withColumn("owner_id", F.concat(F.lit("o"), F.col("num") % 2))
    return tracker_matches(p, t, 2).select("owner_id", "posting_id", "num", "rank")
