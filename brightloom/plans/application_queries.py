"""Registered queries of the tracker, ranking, messages, health and sets, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.operators import ingest as TI
from brightloom.operators import mail as M
from brightloom.operators import quality as Q
from brightloom.operators import ranking as K
from brightloom.operators import threads as TH
from brightloom.operators import tracker as T
from brightloom.plans.views import changes, health, messages, table, tracker, with_views

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
_RANK = f"list_position({list(T.STATUS_RANK)!r}, "


@query("f23_delete_rows", f"{with_views('tracker')} SELECT num, status FROM tracker WHERE num <> 7")
def f23(spark, d):
    return T.delete_rows(tracker(spark, d), 7).select("num", "status")


@query(
    "f25_no_response",
    f"{with_views('tracker')} SELECT num, date FROM tracker WHERE status = 'applied' AND DATE '1998-01-01' - date >= 30 AND num NOT IN (SELECT num FROM tracker WHERE num % 5 = 0) ORDER BY date, num LIMIT 40",
)
def f25(spark, d):
    t = tracker(spark, d)
    return T.no_response_candidates(t, t.where("num % 5 = 0"), "1998-01-01", 30, 40)[0].select("num", "date")


@query("f25_counts", f"{with_views('tracker')}, o AS (SELECT * FROM tracker WHERE status = 'applied' AND DATE '1998-01-01' - date >= 30 AND num % 5 <> 0) SELECT count(*) AS candidates, greatest(count(*) - 40, 0) AS deferred, 0 AS undated FROM o")
def f25b(spark, d):
    t = tracker(spark, d)
    return T.no_response_candidates(t, t.where("num % 5 = 0"), "1998-01-01", 30, 40)[1]


@query("a3_status_counts", f"{with_views('tracker')} SELECT status, count(*) AS n, count(DISTINCT company) AS companies FROM tracker GROUP BY 1")
def a3(spark, d):
    return T.status_counts(tracker(spark, d))


@query("a5_duplicate_groups", f"{with_views('tracker')} SELECT k AS company_key, r AS role_key, count(*) AS n, min(num) AS first_num, max(num) AS last_num FROM (SELECT num, {_KR} FROM tracker) GROUP BY 1, 2 HAVING count(*) > 1")
def a5(spark, d):
    return T.duplicate_groups(tracker(spark, d))


@query("a6_duplicate_ids", "SELECT l_orderkey AS num, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def a6(spark, d):
    return T.duplicate_ids(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("num")))


@query("a7_cross_channel", f"{with_views('tracker')} SELECT k AS company_key, r AS role_key, count(DISTINCT coalesce(via, 'direct')) AS channels FROM (SELECT via, {_KR} FROM tracker) GROUP BY 1, 2 HAVING count(DISTINCT coalesce(via, 'direct')) > 1")
def a7(spark, d):
    return T.cross_channel(tracker(spark, d))


@query("a14_merge_clusters", f"{with_views('tracker')} SELECT company, role, arg_max(num, (score, -num)) AS num, max(score) AS score, {list(T.STATUS_RANK)!r}[max({_RANK}status))] AS status, count(*) AS n FROM tracker GROUP BY 1, 2")
def a14(spark, d):
    return T.merge_clusters(tracker(spark, d), ["company", "role"])


@query("a17_status_dates", f"{with_views('changes')} SELECT key, kind, max(event_at) AS at FROM changes GROUP BY 1, 2")
def a17(spark, d):
    return changes(spark, d).groupBy("key", "kind").agg(F.max("event_at").alias("at"))


@query("w6_status_changes", f"{with_views('changes')}, l AS (SELECT key, event_at AS at, event_id AS tie, kind AS new, lag(kind) OVER (PARTITION BY key ORDER BY event_at, event_id) AS old FROM changes) SELECT * FROM l WHERE old IS NULL OR old <> new")
def w6(spark, d):
    return T.status_events(changes(spark, d).select("key", F.col("event_at").alias("at"), F.col("event_id").alias("tie"), F.col("kind").alias("status")))


@query(
    "w9_reassign_ids",
    """WITH t AS (SELECT event_id AS pos, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id - event_id % 2 END AS num FROM events),
m AS (SELECT *, num IS NULL OR row_number() OVER (PARTITION BY num ORDER BY pos) > 1 AS bad FROM t)
SELECT pos, CASE WHEN bad THEN (SELECT max(num) FROM t) + row_number() OVER (PARTITION BY bad ORDER BY pos) ELSE num END AS num FROM m""",
)
def w9(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 50 > 0, F.col("event_id") - F.col("event_id") % 2).alias("num"))
    return T.reassign_ids(t, ["pos"]).select("pos", "num")


@query(
    "q1_audit",
    f"""{with_views('tracker')}, t AS (SELECT num, company, role, via, score, CASE WHEN num % 97 = 0 THEN 'zzz' ELSE status END AS status, CASE WHEN num % 89 <> 0 THEN date END AS date FROM tracker), g AS (SELECT *, {_KR} FROM t)
SELECT 'status' AS check, 'error' AS severity, num::VARCHAR AS key FROM t WHERE status = 'zzz' UNION ALL SELECT 'date', 'warning', num::VARCHAR FROM t WHERE date IS NULL
UNION ALL SELECT 'duplicate', 'warning', k || '::' || r FROM g GROUP BY k, r HAVING count(*) > 1
UNION ALL SELECT 'channel', 'warning', k || '::' || r FROM g GROUP BY k, r HAVING count(DISTINCT coalesce(via, 'direct')) > 1""",
)
def q1(spark, d):
    t = tracker(spark, d).withColumn("status", F.when(F.col("num") % 97 == 0, "zzz").otherwise(F.col("status"))).withColumn("date", F.when(F.col("num") % 89 != 0, F.col("date")))
    return T.audit(t)


@query(
    "q1_integrity",
    f"""{with_views('tracker')}, t AS (SELECT num // 2 AS num, company, role, via, CASE num % 97 WHEN 0 THEN 'zzz' WHEN 1 THEN '**Applied**' WHEN 2 THEN 'Applied 2024-01-02' ELSE status END AS status, CASE num % 89 WHEN 0 THEN '' WHEN 1 THEN '**4.1/5**' WHEN 2 THEN 'DUP' ELSE score || '/5' END AS score,
  num AS id, num % 3 = 0 AS lost, num % 4 = 0 AS bare FROM tracker),
u AS (SELECT * REPLACE (CASE id % 101 WHEN 0 THEN '?' WHEN 1 THEN 'Confidential' ELSE company END AS company) FROM t), g AS (SELECT *, {_KR} FROM u),
f AS (SELECT DISTINCT id AS number, id || '-acme-2024-01-01.md' AS name, 'acme::role' || (id % 1000) AS rk FROM t WHERE NOT lost),
x AS (SELECT 'status' AS check, 'error' AS severity, num::VARCHAR AS key, 'unknown status: zzz' AS message FROM u WHERE status = 'zzz'
UNION ALL SELECT 'status_bold', 'error', num::VARCHAR, 'status in bold: **Applied**' FROM u WHERE contains(status, '**')
UNION ALL SELECT 'status_date', 'error', num::VARCHAR, 'status with a date: Applied 2024-01-02' FROM u WHERE contains(status, '2024')
UNION ALL SELECT 'score', 'error', num::VARCHAR, 'no score: ' FROM u WHERE score = ''
UNION ALL SELECT 'score_bold', 'warning', num::VARCHAR, 'score in bold: **4.1/5**' FROM u WHERE contains(score, '**')
UNION ALL SELECT 'via', 'error', num::VARCHAR, 'unknown company without a channel' FROM u WHERE company = '?' AND via IS NULL
UNION ALL SELECT 'confidential', 'warning', num::VARCHAR, 'placeholder as company: Confidential' FROM u WHERE company = 'Confidential'
UNION ALL SELECT 'width', 'error', num::VARCHAR, 'cells: 6 of 9' FROM u WHERE id % 103 = 0
UNION ALL SELECT 'duplicate', 'warning', k || '::' || r, count(*) || ' rows, #' || min(num) || ' to #' || max(num) FROM g GROUP BY k, r HAVING count(*) > 1
UNION ALL SELECT 'channel', 'warning', lower(company) || '::' || lower(role), count(DISTINCT coalesce(via, 'direct')) || ' channels, ' || count(*) || ' rows, #' || min(num) || ' to #' || max(num) FROM u WHERE company <> '?' GROUP BY lower(company), lower(role) HAVING count(DISTINCT coalesce(via, 'direct')) > 1
UNION ALL SELECT 'number', 'error', num::VARCHAR, count(*) || ' rows' FROM u GROUP BY num HAVING count(*) > 1
UNION ALL SELECT 'report_missing', 'error', num::VARCHAR, 'no such report: reports/' || id || '-acme-2024-01-01.md' FROM u WHERE lost AND NOT bare
UNION ALL SELECT 'report_orphan', 'warning', name, 'no row names #' || number FROM f WHERE number NOT IN (SELECT id FROM u WHERE NOT bare UNION SELECT num FROM u WHERE bare)
UNION ALL SELECT 'report_twice', 'warning', rk, count(*) || ' reports, ' || min(name) || ' to ' || max(name) FROM f GROUP BY rk HAVING count(*) > 1
UNION ALL SELECT 'report_held', 'warning', c_custkey || '-RESERVED.md', 'held since 2024-03-14 0' || (c_custkey % 10) || ':30' FROM customer WHERE c_custkey % 10 < 8
UNION ALL SELECT 'additions', 'warning', 'additions', count(*) || ' not merged' FROM supplier)
SELECT * FROM x""",
)
def q1_integrity(spark, d):
    """The audit of a landed tracker with its reports: some rows are odd, a third of the reports are lost, numbers repeat."""
    from brightloom.operators.audit import integrity_audit

    n = F.col("num")
    status = F.when(n % 97 == 0, "zzz").when(n % 97 == 1, "**Applied**").when(n % 97 == 2, "Applied 2024-01-02").otherwise(F.col("status"))
    score = F.when(n % 89 == 0, "").when(n % 89 == 1, "**4.1/5**").when(n % 89 == 2, "DUP").otherwise(F.concat(F.col("score").cast("string"), F.lit("/5")))
    file = F.concat(n.cast("string"), F.lit("-acme-2024-01-01.md"))
    t = tracker(spark, d).select(
        F.expr("num div 2").alias("num"), F.when(n % 101 == 0, "?").when(n % 101 == 1, "Confidential").otherwise(F.col("company")).alias("company"), "role", status.alias("status"), score.alias("score"),
        F.when(n % 4 != 0, F.concat(F.lit("[report](reports/"), file, F.lit(")"))).alias("report"), "via", F.when(n % 103 == 0, 6).otherwise(9).alias("n_cells"), F.lit(9).alias("need_cells"),
    )
    kept = tracker(spark, d).where("num % 3 > 0").select(file.alias("name"), F.concat(F.lit("# Acme — Role "), n % 1000).alias("body"), F.lit("2024-03-14 00:00:00").cast("timestamp").alias("modified"))
    c = F.col("c_custkey")
    held = table(spark, d, "customer").select(F.concat(c, F.lit("-RESERVED.md")).alias("name"), F.lit(None).cast("string").alias("body"), F.concat(F.lit("2024-03-14 0"), c % 10, F.lit(":30:00")).cast("timestamp").alias("modified"))
    waiting = table(spark, d, "supplier").select(F.concat(F.col("s_suppkey"), F.lit(".tsv")).alias("name"))
    return integrity_audit(t, kept.union(held), waiting, F.lit("2024-03-14 12:00:00").cast("timestamp"))


_RAW = "CASE o_orderkey % 5 WHEN 0 THEN '**Applied** 2024-01-02' WHEN 1 THEN 'Entrevista' WHEN 2 THEN ' offer ' WHEN 3 THEN 'dup' ELSE 'whatever' END"


@query("x16_status_name", "SELECT o_orderkey, ['applied', 'interview', 'offer', 'discarded', NULL][(o_orderkey % 5 + 1)::INT] AS status FROM orders")
def x16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.status_name(F.expr(_RAW)).alias("status"))


@query("x17_score_value", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 50) / 10.0::DOUBLE WHEN 1 THEN (o_orderkey % 6)::DOUBLE END AS score FROM orders")
def x17(spark, d):
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.format_string("%.1f", F.col("o_orderkey") % 50 / 10), F.lit("/5"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("**"), F.col("o_orderkey") % 6, F.lit("**"))).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", T.score_value(cell).alias("score"))


@query("x18_report_numbers", "SELECT o_orderkey, o_orderkey || ',' || (o_orderkey + 1) AS reports FROM orders")
def x18(spark, d):
    cell = F.concat(F.lit("[00"), "o_orderkey", F.lit("](reports/a.md) and ["), F.col("o_orderkey") + 1, F.lit("](b.md) [x](c)"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.report_numbers(cell).cast("array<string>"), ",").alias("reports"))


@query("x19_merge_note", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old; new' ELSE 'old; new clause; new' END AS notes FROM orders")
def x19(spark, d):
    notes = F.when(F.col("o_orderkey") % 3 == 0, "—").when(F.col("o_orderkey") % 3 == 1, "old; new").otherwise("old; new clause")
    return table(spark, d, "orders").select("o_orderkey", T.merge_note(notes, F.lit("new ")).alias("notes"))


@query(
    "x29_transition",
    f"""{with_views('tracker')}, s AS (SELECT num, status, lead(status) OVER (ORDER BY num) AS next FROM tracker)
SELECT num, coalesce(CASE WHEN status IN ('rejected', 'discarded') THEN next = status WHEN next = 'rejected' THEN true ELSE {_RANK}next) >= {_RANK}status) END, false) AS allowed FROM s""",
)
def x29(spark, d):
    t = tracker(spark, d).select("num", "status")
    nxt = t.select((F.col("num") - 1).alias("num"), F.col("status").alias("next"))
    return t.join(nxt, "num", "left").select("num", T.transition_allowed(F.col("status"), F.col("next")).alias("allowed"))


# ranking

_CAND = """cand AS (SELECT o_orderkey AS posting_id, o_custkey % 20 AS source, (o_orderkey * 7 % 13)::INT AS fit, (o_orderkey % 4 * 200)::INT AS action_score, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 5)::INT END AS evaluation,
  o_orderkey % 2 = 0 AS verified, o_orderkey % 7 > 2 AS active, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate::DATE END AS posted_at, c_name AS company, o_orderpriority AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
_ORDER = "fit DESC NULLS LAST, action_score DESC NULLS LAST, evaluation DESC NULLS LAST, verified DESC NULLS LAST, active DESC NULLS LAST, posted_at DESC NULLS LAST, company NULLS LAST, title NULLS LAST, posting_id"


def _candidates(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("posting_id"), (F.col("o_custkey") % 20).alias("source"), (k * 7 % 13).cast("int").alias("fit"), (k % 4 * 200).cast("int").alias("action_score"), F.when(k % 3 > 0, (k % 5).cast("int")).alias("evaluation"),
        (k % 2 == 0).alias("verified"), (k % 7 > 2).alias("active"), F.when(k % 11 > 0, F.to_date("o_orderdate")).alias("posted_at"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("title"),
    )


@query("l1_rank_candidates", f"WITH {_CAND} SELECT posting_id, row_number() OVER (ORDER BY {_ORDER})::INT AS rank FROM cand QUALIFY rank <= 200")
def l1(spark, d):
    return K.rank_candidates(_candidates(spark, d), 200).select("posting_id", "rank")


@query("w5_round_robin", f"WITH {_CAND}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS turn FROM cand) SELECT posting_id, source, turn::INT AS turn FROM t ORDER BY turn, {_ORDER} LIMIT 100")
def w5(spark, d):
    return K.round_robin(_candidates(spark, d), "source", K.rank_order(), 100).select("posting_id", "source", "turn")


@query("l6_verification_budget", f"WITH {_CAND}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS turn FROM cand WHERE NOT verified) SELECT posting_id FROM t ORDER BY turn, {_ORDER} LIMIT 12")
def l6(spark, d):
    return K.verification_budget(_candidates(spark, d).withColumn("checked", F.col("verified")), "source", K.rank_order(), 12).select("posting_id")


@query("w3_top_per_site", f"WITH {_CAND} SELECT posting_id, source, row_number() OVER (PARTITION BY source ORDER BY {_ORDER})::INT AS rank, count(*) OVER (PARTITION BY source) AS total FROM cand QUALIFY rank <= 5")
def w3(spark, d):
    return K.top_per_site(_candidates(spark, d), "source", K.rank_order()).select("posting_id", "source", "rank", "total")


@query("l7_page", f"WITH {_CAND} SELECT posting_id, (SELECT count(*) FROM cand) AS total, (SELECT count(*) FROM cand) > 150 AS has_more FROM cand ORDER BY {_ORDER} LIMIT 50 OFFSET 100")
def l7(spark, d):
    return K.page(_candidates(spark, d), K.rank_order(), 100, 50).select("posting_id", "total", "has_more")


_FACTS = {"f-ring": ["ring"], "f-widget": ["Widget", "gear"], "f-small": ["small ring", "eco"]}


@query("j17_match_facts", """SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])ring([^a-z0-9]|$)') THEN 'f-ring' END,
  CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(widget|gear)([^a-z0-9]|$)') THEN 'f-widget' END, CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(small ring|eco)([^a-z0-9]|$)') THEN 'f-small' END) AS facts FROM part""")
def j17(spark, d):
    return K.match_facts(table(spark, d, "part"), _FACTS, ["p_name"]).select("p_partkey", F.array_join("facts", ",").alias("facts"))


@query("l2_profile_fit", """SELECT p_partkey, 4 * ((regexp_matches(lower(p_name), '(^|[^a-z0-9])ring([^a-z0-9]|$)'))::INT + (regexp_matches(lower(p_name), '(^|[^a-z0-9])(widget|gear)([^a-z0-9]|$)'))::INT
  + (regexp_matches(lower(p_name), '(^|[^a-z0-9])(small ring|eco)([^a-z0-9]|$)'))::INT) + [3, 1, -24, -24][p_size % 4 + 1] AS fit FROM part""")
def l2(spark, d):
    p = table(spark, d, "part").withColumn("tier", F.element_at(F.array(*map(F.lit, ("senior", "mid", "entry", "intern"))), F.col("p_size") % 4 + 1))
    return K.profile_fit(K.match_facts(p, _FACTS, ["p_name"])).select("p_partkey", "fit")


@query("l3_actionability", f"""WITH {_CAND}, s AS (SELECT posting_id, greatest([900, 750, 600, 250][(posting_id % 4 + 1)::INT], CASE WHEN evaluation IS NOT NULL THEN 600 + 50 * evaluation ELSE 0 END)
  - CASE WHEN posting_id % 9 = 0 THEN 600 ELSE 0 END - CASE WHEN posting_id % 10 = 0 THEN 150 ELSE 0 END + 25 * fit AS action_score FROM cand)
SELECT posting_id, action_score, CASE WHEN action_score >= 800 THEN 'high' WHEN action_score >= 450 THEN 'medium' ELSE 'low' END AS action_level FROM s""")
def l3(spark, d):
    k = F.col("posting_id")
    c = _candidates(spark, d).drop("action_score").withColumn("evidence", F.element_at(F.array(*map(F.lit, ("direct", "source", "stale", "none"))), (k % 4 + 1).cast("int"))).withColumn("agency", k % 9 == 0).withColumn("review", k % 10 == 0)
    return K.actionability(c).select("posting_id", "action_score", "action_level")


@query("l4_priority_score", "SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 30 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 29 ELSE 0 END)::INT AS score FROM part")
def l4(spark, d):
    return table(spark, d, "part").select("p_partkey", K.priority_score(F.col("p_name"), ["Ring", "red"], F.col("p_size") % 2 == 0).alias("score"))


@query("j8_liveness_cache", """WITH s AS (SELECT user_id::VARCHAR AS url, arg_max(CASE event_type WHEN 'error' THEN 'expired' WHEN 'view' THEN 'active' ELSE 'uncertain' END, (ts, CASE event_type WHEN 'error' THEN 'expired' WHEN 'view' THEN 'active' ELSE 'uncertain' END)) AS st, max(ts) AS at FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN st <> 'expired' THEN st WHEN st = 'expired' AND epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch("at")) BETWEEN 0 AND 36 * 3600 THEN 'expired' ELSE 'unknown' END AS live FROM customer LEFT JOIN s ON url = c_custkey::VARCHAR""")
def j8(spark, d):
    st = F.when(F.col("event_type") == "error", "expired").when(F.col("event_type") == "view", "active").otherwise("uncertain")
    state = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), st.alias("status"), F.col("ts").alias("checked_at"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("url"))
    return K.annotate_liveness(c, state, F.lit("2024-01-30 12:00:00").cast("timestamp"), 36).select("c_custkey", "live")


@query("j9_cooldown", """WITH r AS (SELECT user_id AS id, max(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey, coalesce(epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch("at")) >= 0 AND epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch("at")) < 3 * 86400, false) AS cooling,
  CASE WHEN epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch("at")) >= 0 AND epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch("at")) < 3 * 86400 THEN "at"::DATE + 3 END AS until FROM customer LEFT JOIN r ON id = c_custkey""")
def j9(spark, d):
    r = table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("https://A.example.com/J/"), "user_id", F.lit("/?utm_x=1")).alias("url"), F.col("ts").alias("at"))
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("https://a.example.com:443/j/"), "c_custkey").alias("url"))
    return K.annotate_cooldown(c, r, F.lit("2024-01-30 00:00:00").cast("timestamp"), 3).select("c_custkey", "cooling", "until")


@query("j11_freshness", """WITH m AS (SELECT l_orderkey AS key, min(l_shipdate)::DATE AS first_seen FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, first_seen, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END, first_seen) AS shown_date, CASE WHEN coalesce(first_seen, DATE '1998-06-01') = DATE '1998-06-01' THEN 'pending_new' ELSE 'pending_backlog' END AS origin
FROM orders LEFT JOIN m ON key = o_orderkey""")
def j11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate")).alias("posted_at"))
    meta = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("first_seen"))
    return K.annotate_freshness(o, meta, F.lit("1998-06-01").cast("date")).select("key", "first_seen", "shown_date", "origin")


@query("f19_recommendable", """SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'direct' WHEN event_type = 'view' THEN 'source' ELSE 'none' END AS method, event_type = 'view' AND event_id % 3 > 0 AS eligible FROM events""")
def f19(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "error", "expired").otherwise("unknown").alias("live"), (F.col("event_id") % 2 == 0).alias("verified"), (F.col("event_id") % 3 == 0).alias("cooling"))
    return K.recommendable(e).select("event_id", "method", "eligible")


@query("f20_fresh_only", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) BETWEEN -300 AND 72 * 3600")
def f20(spark, d):
    return K.fresh_only(table(spark, d, "events").withColumn("checked_at", F.col("ts")), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("w13_is_new", "SELECT event_id, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) BETWEEN 0 AND 86400 AS is_new FROM events")
def w13(spark, d):
    age = F.lit("2024-01-20 00:00:00").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return table(spark, d, "events").select("event_id", age.between(0, 86400).alias("is_new"))


# messages

#: What the last line of a message says, and its kind; the first word of each line is the body's own.
_SAID = (
    ("your application was unsuccessful", "rejected"), ("we decided not to proceed with your application for this position", "rejected"), ("이번 전형 결과 탈락 안내드립니다", "rejected"),
    ("we decided not to proceed", None), ("탈락률은 30%입니다", None), ("최종 합격을 축하드립니다", "offer"), ("Your Offer Letter is attached", "offer"), ("interview invitation", "interview"),
    ("서류 전형 합격", "interview"), ("Your application is under review", "responded"), ("서류 검토 중입니다", "responded"), ("Thank you for applying", "applied"), ("지원서가 정상적으로 접수되었습니다", "applied"),
    ("해당 포지션에 지원하고자 합니다. 이력서를 첨부드립니다", "applied"), ("good day", None), ("", None),
)
_KIND = "CASE (thread_id * 7 + \"at\") % 16 " + " ".join(f"WHEN {i} THEN {repr(k) if k else 'NULL'}" for i, (_, k) in enumerate(_SAID)) + " END"


def _told(spark, d):
    said = F.element_at(F.array(*[F.lit(t) for t, _ in _SAID]), ((F.col("thread_id") * 7 + F.col("at")) % 16 + 1).cast("int"))
    return messages(spark, d).withColumn("body", F.concat(F.lit("Dear all,\n"), said))


@query("x27_message_kind", f"{with_views('messages')} SELECT thread_id, \"at\", {_KIND} AS kind FROM messages")
def x27(spark, d):
    return _told(spark, d).select("thread_id", "at", M.message_kind(F.col("body")).alias("kind"))


_NAMES = (
    ("'[Acme Careers] 안내'", "'[' || c || '] ' || r || ' 지원이 정상적으로 완료되었습니다'", True, True), ("'Fwd: [지원 안내] ' || c || ' | ' || r || ' (신입)'", "''", True, True),
    ("'지원하신 ' || c || ' ' || r || '의 서류 결과'", "''", True, True), ("'[원티드] 안녕하세요! ' || c || '의 ' || r || '에 지원이 완료되었습니다'", "''", True, True),
    ("'[' || c || ' 채용] 안내'", "c || '의 ' || r || ' 인터뷰 일정'", True, True), ("'리멤버'", "'기업명 ' || c || ' 지원한 공고 ' || r || ' - 서류'", True, True),
    ("'Re: Thank you for applying to ' || c || ' - x'", "'good day'", True, False), ("'hello'", "'your application for the ' || r || ' position'", False, True),
    ("'[리멤버] 알림'", "'채용 포지션: ' || c || ' - ' || r", True, True), ("'hello'", "'nothing'", False, False),
)
_ROWS = f"(SELECT c_custkey, replace(c_name, '#', '') AS c, lower(c_mktsegment) AS r, c_custkey % {len(_NAMES)} AS i FROM customer)"


@query("x28_subject_names", f"SELECT c_custkey, CASE WHEN i IN ({', '.join(str(i) for i, n in enumerate(_NAMES) if n[2])}) THEN c END AS company, CASE WHEN i IN ({', '.join(str(i) for i, n in enumerate(_NAMES) if n[3])}) THEN r END AS role FROM {_ROWS}")
def x28(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "replace(c_name, '#', '') AS c", "lower(c_mktsegment) AS r", f"c_custkey % {len(_NAMES)} AS i")
    pick = lambda k: F.expr("CASE i " + " ".join(f"WHEN {i} THEN {n[k]}" for i, n in enumerate(_NAMES)) + " END")
    company, role = M.subject_names(pick(0), pick(1))
    return rows.select("c_custkey", company.alias("company"), role.alias("role"))


@query("s17_explode_mail", f"{with_views('messages')} SELECT thread_id, \"at\", sha256(trim(CASE WHEN \"at\" % 2 = 0 THEN body ELSE 'Seen & done' END)) AS body_sha256 FROM messages WHERE thread_id % 5 > 0")
def s17_parts(spark, d):
    part = lambda mime, text: F.struct(F.lit(mime).alias("mime"), text.alias("text"))
    html = part("text/html", F.lit("<p>Seen &amp; <b>done</b></p>"))
    parts = F.when(F.col("at") % 2 == 0, F.array(html, part("text/plain", F.col("body")))).otherwise(F.array(part("text/plain", F.lit("  ")), html))
    m = messages(spark, d).select("thread_id", "at", F.when(F.col("thread_id") % 5 == 0, F.array(F.lit("INBOX"), F.lit("SPAM"))).alias("labels"), parts.alias("parts"))
    return M.explode_mail(m).select("thread_id", "at", F.sha2("body", 256).alias("body_sha256"))


@query("s17_clean_body", f"{with_views('messages')} SELECT thread_id, \"at\", sha256(trim(body)) AS body_sha256 FROM messages")
def s17(spark, d):
    m = messages(spark, d).withColumn("body", F.concat("body", F.lit("\nOn Monday someone wrote:\n> quoted\n> text")))
    return m.select("thread_id", "at", F.sha2(M.clean_body(F.col("body")), 256).alias("body_sha256"))


_NEXT = "f.kind IS NULL OR (m.kind <> f.kind AND CASE WHEN f.kind IN ('rejected', 'discarded') THEN false WHEN m.kind = 'rejected' THEN true ELSE list_position(o, m.kind) >= list_position(o, f.kind) END)"


@query(
    "w7_thread_events",
    f"""{with_views('messages').replace('WITH', 'WITH RECURSIVE')}, m AS (
  SELECT thread_id, "at", kind, row_number() OVER (PARTITION BY thread_id ORDER BY "at", kind) AS i, {list(T.STATUS_RANK)!r} AS o FROM (SELECT thread_id, "at", {_KIND} AS kind FROM messages) WHERE kind IS NOT NULL),
f AS (
  SELECT thread_id, i, "at", kind, true AS new FROM m WHERE i = 1
  UNION ALL SELECT m.thread_id, m.i, m."at", CASE WHEN {_NEXT} THEN m.kind ELSE f.kind END, coalesce({_NEXT}, false) FROM f JOIN m ON m.thread_id = f.thread_id AND m.i = f.i + 1)
SELECT thread_id, "at", kind, row_number() OVER (PARTITION BY thread_id ORDER BY i DESC) = 1 AS apply FROM f WHERE new""",
)
def w7(spark, d):
    """W7 and W11."""
    return M.thread_events(_told(spark, d), M.message_kind(F.col("body")))


@query("j15_paired_receipts", f"{with_views('changes')} SELECT a.event_id AS a_id, b.event_id AS b_id FROM changes a JOIN changes b ON a.key = b.key AND a.kind = b.kind AND epoch_us(b.event_at) - epoch_us(a.event_at) BETWEEN 0 AND 3600000000 AND (b.event_at > a.event_at OR b.event_id > a.event_id)")
def j15(spark, d):
    return M.paired_receipts(changes(spark, d).withColumnRenamed("kind", "role"), 3600)


_RECEIPTS = """e AS (SELECT event_id, ts, ts::DATE AS day, user_id % 40 AS k, event_id % 3 AS form FROM events),
n AS (SELECT *, CASE form WHEN 0 THEN 'acme' || k WHEN 1 THEN '에이콤' || k || '(acme' || k || ')' ELSE '에이콤' || k END AS c,
  CASE form WHEN 0 THEN ['acme' || k] WHEN 1 THEN ['에이콤' || k || '(acme' || k || ')', 'acme' || k, '에이콤' || k] ELSE ['에이콤' || k] END AS names FROM e),
r AS (SELECT day, k, k * 1000 + day_of_month AS num, 'acme' || k AS c FROM (SELECT DISTINCT day, k, extract(day FROM day) AS day_of_month FROM e) WHERE k % 4 > 0)"""


@query(
    "j15_receipt_aliases",
    f"""WITH {_RECEIPTS} SELECT DISTINCT a.event_id, r.num FROM n a JOIN r ON a.day = r.day AND list_contains(a.names, r.c)
JOIN n p ON p.c = r.c AND p.event_id <> a.event_id AND len(list_intersect(p.names, a.names)) > 0 AND abs(epoch_us(p.ts) - epoch_us(a.ts)) <= 7200000000""",
)
def j15_aliases(spark, d):
    e = table(spark, d, "events").withColumn("k", F.col("user_id") % 40)
    name = F.expr("CASE event_id % 3 WHEN 0 THEN concat('Acme', k) WHEN 1 THEN concat('에이콤', k, ' ( ACME', k, ' )') ELSE concat('에이콤', k) END")
    rows = e.where("k % 4 > 0").select((F.col("k") * 1000 + F.dayofmonth("ts")).alias("num"), F.concat(F.lit("Acme"), "k").alias("company"), F.lit("Dev").alias("role"), F.to_date("ts").alias("date")).distinct()
    return M.receipt_aliases(e.select("event_id", name.alias("company"), F.lit("DEV ").alias("role"), F.col("ts").alias("event_at")), rows, 7200)


@query("j16_same_run_block", "SELECT c_custkey, c_custkey % 100 IN (SELECT s_suppkey % 100 FROM supplier WHERE s_suppkey % 3 = 0) AS blocked FROM customer")
def j16(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("co "), F.col("c_custkey") % 100).alias("company"))
    m = table(spark, d, "supplier").select(F.concat(F.lit("CO-"), F.col("s_suppkey") % 100, F.lit(", Inc")).alias("company"), F.when(F.col("s_suppkey") % 3 == 0, "add").otherwise("review").alias("action"))
    return M.same_run_block(c, m).select("c_custkey", "blocked")


@query("q3_reconcile", f"""{with_views('tracker')}, m AS (SELECT event_id, regexp_replace('customer' || printf('%09d', user_id), '[^a-z0-9]', '', 'g') AS k, ['urgent', 'high', 'low'][(event_id % 3 + 1)::INT] AS r, ['applied', 'rejected', 'offer', 'interview'][(event_id % 4 + 1)::INT] AS kind FROM events),
f AS (SELECT k, r, arg_min(kind, event_id) AS kind FROM m GROUP BY 1, 2), t AS (SELECT k, r, count(*) AS n, arg_max(num, num) AS num, arg_max(status, num) AS status FROM (SELECT num, status, {_KR} FROM tracker) GROUP BY 1, 2)
SELECT k || '::' || r AS key, kind, CASE WHEN n = 1 THEN num END AS num, CASE WHEN n IS NULL THEN 'add' WHEN n > 1 THEN 'review' WHEN status <> kind AND CASE WHEN status IN ('rejected', 'discarded') THEN kind = status WHEN kind = 'rejected' THEN true ELSE {_RANK}kind) >= {_RANK}status) END THEN 'update' ELSE 'no_change' END AS action
FROM f LEFT JOIN t USING (k, r)""")
def q3(spark, d):
    e = F.col("event_id")
    m = table(spark, d, "events").select(e.alias("message_id"), F.format_string("Customer#%09d", "user_id").alias("company"), F.element_at(F.array(*map(F.lit, ("Urgent", "high", "LOW"))), (e % 3 + 1).cast("int")).alias("role"), F.element_at(F.array(*map(F.lit, ("applied", "rejected", "offer", "interview"))), (e % 4 + 1).cast("int")).alias("kind"))
    return M.reconcile(m, tracker(spark, d))


@query("a18_reconcile_stats", ORACLES["q3_reconcile"].replace("SELECT k || '::'", ", z AS (SELECT k || '::'", 1) + ") SELECT action, count(*) AS n FROM z GROUP BY 1")
def a18(spark, d):
    return q3(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("q6_ingest_events", f"""{with_views('changes')}, ev AS (SELECT event_id, key, ['applied', 'rejected', 'offer', 'interview', 'responded'][(event_id % 5 + 1)::INT] AS kind, event_at FROM changes WHERE event_id % 7 <> 0),
st AS (SELECT key, ['applied', 'discarded', 'interview', 'rejected'][(key % 4 + 1)::INT] AS status, TIMESTAMP '2024-01-10' AS decided_at FROM (SELECT DISTINCT key FROM changes WHERE key % 5 > 0)),
j AS (SELECT event_id, key, kind, event_at, CASE WHEN status IS NULL THEN 'history_only' WHEN event_at < decided_at THEN 'older_than_current_decision' WHEN status IN ('discarded', 'skip') THEN 'prior_exclusion_preserved'
  WHEN NOT CASE WHEN status IN ('rejected', 'discarded') THEN kind = status WHEN kind = 'rejected' THEN true ELSE {_RANK}kind) >= {_RANK}status) END THEN 'later_stage_preserved' ELSE 'apply' END AS o FROM ev LEFT JOIN st USING (key))
SELECT event_id, key, kind, event_at, CASE WHEN o = 'apply' AND row_number() OVER (PARTITION BY key, o ORDER BY event_at DESC, event_id DESC) > 1 THEN 'superseded_in_batch' ELSE o END AS outcome FROM j""")
def q6(spark, d):
    c, e = changes(spark, d), F.col("event_id")
    events = c.select("event_id", "key", F.element_at(F.array(*map(F.lit, ("applied", "rejected", "offer", "interview", "responded"))), (e % 5 + 1).cast("int")).alias("kind"), "event_at")
    state = c.where("key % 5 > 0").select("key").distinct().withColumn("status", F.element_at(F.array(*map(F.lit, ("applied", "discarded", "interview", "rejected"))), (F.col("key") % 4 + 1).cast("int"))).withColumn("decided_at", F.lit("2024-01-10").cast("timestamp"))
    return M.ingest_events(events, c.where("event_id % 7 = 0"), state)


@query("q4_review_queue", """WITH q AS (SELECT user_id AS k, min(ts)::DATE AS f, max(ts)::DATE AS l FROM events WHERE event_id % 2 = 0 GROUP BY 1), m AS (SELECT user_id AS k, min(ts)::DATE AS a, max(ts)::DATE AS z FROM events WHERE event_id % 11 = 1 AND user_id % 3 = 0 GROUP BY 1),
j AS (SELECT k, CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'archived' END AS s, f, l, a, z, greatest(l, z) AS last FROM q FULL JOIN m USING (k)),
o AS (SELECT k AS message_key, CASE WHEN l IS NOT NULL AND s IN ('resolved', 'ignored') THEN s WHEN z IS NOT NULL AND DATE '2024-02-20' - last < 25 THEN 'open' WHEN DATE '2024-02-20' - last >= 25 THEN 'archived' ELSE CASE WHEN l IS NULL THEN 'open' ELSE s END END AS state, least(f, a) AS first_seen, last AS last_seen FROM j)
SELECT * FROM o WHERE NOT (state = 'archived' AND DATE '2024-02-20' - last_seen >= 28)""")
def q4(spark, d):
    e, day = table(spark, d, "events"), F.to_date("ts")
    state = F.when(F.col("message_key") % 3 == 0, "open").when(F.col("message_key") % 3 == 1, "resolved").otherwise("archived")
    queue = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("message_key")).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen")).withColumn("state", state)
    new = e.where("event_id % 11 = 1 AND user_id % 3 = 0").select(F.col("user_id").alias("message_key"), day.alias("at"))
    return M.update_queue(queue, new, F.lit("2024-02-20").cast("date"), 25, 28)


@query("q8_timeline", "SELECT user_id AS id, ts AS at, event_type AS what FROM events UNION ALL SELECT o_custkey, o_orderdate, 'order' FROM orders")
def q8(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("what"))
    return M.timeline(e, table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("what")))


# health, liveness, runs, sets


@query("w1_failure_streaks", f"""{with_views('health')}, i AS (SELECT *, sum((status <> 'network')::INT) OVER (PARTITION BY company ORDER BY ts DESC, event_id DESC) AS later FROM health)
SELECT company, count(*) FILTER (WHERE later = 0) AS streak, count(*) FILTER (WHERE later = 0) >= 3 AS alert FROM i GROUP BY 1""")
def w1(spark, d):
    return Q.failure_streaks(health(spark, d))


@query("x26_error_class", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'slug_gone' WHEN 1 THEN 'auth' WHEN 2 THEN 'server' WHEN 3 THEN 'network' ELSE 'unknown' END AS class FROM events")
def x26(spark, d):
    code, err = F.expr("CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 200 END"), F.expr("CASE event_id % 6 WHEN 3 THEN 'Request timed out' ELSE '' END")
    return table(spark, d, "events").select("event_id", Q.error_class(code, err).alias("class"))


#: (status, what is added to the page, its final url, control, code) of pages by number.
_PAGES = (
    (410, "", "", "", "http_gone"), (502, "", "", "Apply", "server_error"), (403, "", "", "Apply", "access_blocked"), (200, "", "https://elsewhere.example.com/", "Apply", "redirected_off_posting"),
    (503, " Just a moment...", "", "Apply", "bot_challenge"), (200, " This position at Acme has been filled.", "", "Apply", "expired_body"), (200, " Cette offre n’est plus disponible.", "", "Apply", "expired_body"),
    (200, " once the application form has been filled out", "", "Aplikuj teraz", "apply_control_visible"), (200, " 12 jobs found", "", "", "listing_page"), (200, "", "?error=true", "Apply", "expired_url"),
    (200, "-", "", "Contact", "insufficient_content"), (200, " once the application form has been filled, we call", "", "", "no_apply_control"), (200, "", "", "Jetzt bewerben", "apply_control_visible"),
)


def _fetched(spark, d):
    i = f"page_id % {len(_PAGES)}"
    pick = lambda k: F.expr(f"CASE {i} " + " ".join(f"WHEN {n} THEN {p[k] if k == 0 else chr(39) + p[k] + chr(39)}" for n, p in enumerate(_PAGES)) + " END")
    url = F.concat("url", F.lit("/job/1234567"))
    final = F.when(pick(2).startswith("http"), pick(2)).otherwise(F.concat(url, pick(2)))
    body = F.when(pick(1) == "-", "Home Imprint").otherwise(F.concat(F.rpad("html", 400, "."), pick(1)))
    code = Q.liveness(pick(0), url, final, body, F.array(pick(3)))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "example\\.([a-z]+)", 1).alias("source"), code.alias("outcome"))


_OUT = f"CASE page_id % {len(_PAGES)} " + " ".join(f"WHEN {n} THEN '{p[4]}'" for n, p in enumerate(_PAGES)) + " END"
_ROUTE = f"CASE WHEN o = 'apply_control_visible' THEN 'verified' WHEN o IN ({', '.join(repr(c) for c, r in Q.LIVENESS_RESULTS.items() if r == 'expired')}) THEN 'expired' WHEN o = 'no_apply_control' THEN 'dropped' WHEN o = 'blocked_url' THEN 'invalid' ELSE 'uncertain' END"


@query("x23_liveness", f"SELECT page_id, {_OUT} AS outcome FROM pages")
def x23(spark, d):
    return _fetched(spark, d).select("page_id", "outcome")


@query("q13_route_liveness", f"SELECT page_id, {_ROUTE} AS route FROM (SELECT page_id, CASE WHEN page_id % 17 = 3 THEN 'blocked_url' ELSE {_OUT} END AS o FROM pages)")
def q13(spark, d):
    guarded = _fetched(spark, d).withColumn("outcome", F.when(F.col("page_id") % 17 == 3, "blocked_url").otherwise(F.col("outcome")))
    return Q.route_liveness(guarded).select("page_id", "route")


@query(
    "q13_history",
    f"""WITH r AS (SELECT page_id, o, {_ROUTE} AS route FROM (SELECT page_id, CASE WHEN page_id % 17 = 3 THEN 'blocked_url' WHEN page_id % 17 = 4 THEN 'invalid_url' ELSE {_OUT} END AS o FROM pages))
SELECT 'u' || page_id AS url, CASE WHEN page_id % 17 = 3 THEN 'skipped_blocked_host' WHEN page_id % 17 = 4 THEN 'skipped_invalid_url' WHEN route = 'expired' THEN 'skipped_expired' ELSE 'skipped_no_apply_control' END AS status FROM r WHERE page_id % 17 IN (3, 4) OR route IN ('expired', 'dropped')
UNION ALL SELECT 'old' || page_id, 'skipped_expired' FROM pages WHERE page_id % 5 = 0""",
)
def q13_history(spark, d):
    i = F.col("page_id")
    seen = _fetched(spark, d).withColumn("outcome", F.when(i % 17 == 3, "blocked_url").when(i % 17 == 4, "invalid_url").otherwise(F.col("outcome")))
    moved = Q.route_liveness(seen).withColumns({"url": F.concat(F.lit("u"), i), "previous_url": F.when(i % 5 == 0, F.concat(F.lit("old"), i)).when(i % 5 == 1, F.concat(F.lit("u"), i))})
    return Q.history_of_routes(moved)


@query("a11_liveness_stats", f"SELECT source, count(*) AS checked, {', '.join(f'''count(*) FILTER (WHERE r = '{x}') AS {x}''' for x in ('verified', 'expired', 'dropped', 'invalid', 'uncertain'))} FROM (SELECT source, {_ROUTE} AS r FROM (SELECT regexp_extract(url, 'example\\.([a-z]+)', 1) AS source, {_OUT} AS o FROM pages)) GROUP BY 1")
def a11(spark, d):
    return Q.liveness_stats(Q.route_liveness(_fetched(spark, d)), "source")


@query("j25_board_membership", "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS posting_id, CASE WHEN l_suppkey % 10 = 0 THEN 'unknown' WHEN (l_suppkey % 10, l_partkey % 50) IN (SELECT (s_suppkey % 10, p_size) FROM supplier, part WHERE p_partkey % 10 = s_suppkey % 10) THEN 'active' ELSE 'expired' END AS state FROM lineitem")
def j25(spark, d):
    from pyspark.sql import Window as W

    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    p = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(W.partitionBy(*k).orderBy("l_quantity")))
    p = p.select(F.concat_ws("-", *k, "rn").alias("posting_id"), (F.col("l_suppkey") % 10).alias("org"), F.concat(F.lit("J"), F.col("l_partkey") % 50).alias("job_id"))
    b = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("org"), F.concat(F.lit("j"), "p_size").alias("job_id"), (F.col("p_partkey") % 10 > 0).alias("usable"))
    return Q.board_membership(p, b)


@query("a15_timing_report", "SELECT user_id % 3 AS scope, event_type AS op, count(*) AS batches, count(*) FILTER (WHERE event_id % 4 > 1) AS retries, round(sum(value), 4) AS total_seconds, max(value) AS longest FROM events GROUP BY GROUPING SETS ((user_id % 3, event_type), (user_id % 3), ())")
def a15(spark, d):
    return Q.timing_report(table(spark, d, "events").select((F.col("user_id") % 3).alias("scope"), F.col("event_type").alias("op"), (F.col("event_id") % 4).alias("attempt"), F.col("value").alias("seconds")))


@query("a16_last_runs", "SELECT arg_max(event_id, (ts, event_id)) AS last, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'view') AS last_full, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_id % 9 = 0) AS last_resumed FROM events")
def a16(spark, d):
    return Q.last_runs(table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("completed_at"), F.when(F.col("event_type") == "view", "full").otherwise("part").alias("mode"), (F.col("event_id") % 9 == 0).alias("resumed")))


@query("u7_changed", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) OR (o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0) OR (o_orderkey % 15 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus = 'P')")
def u7(spark, d):
    o = table(spark, d, "orders")
    return Q.changed(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "Q").otherwise(F.col("o_orderstatus"))), "o_orderkey", "o_orderstatus")


@query("u2_merge_batches", "SELECT event_id, ts, event_id % 5 < 2 AS newer FROM events ORDER BY ts DESC, event_id LIMIT 500")
def u2(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return Q.merge_batches(e.withColumn("newer", F.lit(False)), e.where("event_id % 5 < 2").withColumn("newer", F.lit(True)), "event_id", "ts", 500)


@query("u5_reserve", "SELECT c_custkey AS candidate FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def u5(spark, d):
    """The pool without what is verified."""
    pool = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate"))
    return Q.remaining(pool, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("candidate")), "candidate")


@query("u4_remaining", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def u4(spark, d):
    return Q.remaining(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey")


@query("u1_union_origins", "SELECT k, CASE WHEN k IN (SELECT o_custkey FROM orders) THEN 'orders' WHEN k IN (SELECT user_id FROM events) THEN 'events' ELSE 'customer' END AS origin FROM (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events UNION SELECT c_custkey FROM customer)")
def u1(spark, d):
    part = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return Q.union_origins([("orders", part("orders", "o_custkey")), ("events", part("events", "user_id")), ("customer", part("customer", "c_custkey"))], "k").select("k", "origin")


@query("u3_known_threads", "SELECT user_id AS thread_id FROM events UNION SELECT conv_id FROM conversations")
def u3(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("thread_id")).union(table(spark, d, "conversations").select("conv_id")).distinct()


@query("u6_restore_missing", "SELECT c_custkey AS item_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 3 = c_custkey OR s_suppkey * 3 = c_custkey + 1)")
def u6(spark, d):
    saved = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.array("c_custkey", F.col("c_custkey") + 1).alias("aliases"))
    return Q.restore_missing(saved, table(spark, d, "supplier").select(F.array(F.col("s_suppkey") * 3).alias("aliases"))).select("item_id")


@query("j18_orphan_reports", "SELECT o_orderkey AS report FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j18(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("num"), F.array("l_orderkey").alias("reports"))
    return Q.orphans(table(spark, d, "orders").select(F.col("o_orderkey").alias("report")), rows)[0]


@query("a20_company_summary", "WITH n AS (SELECT s_name, sum(length(s_name) + 2) OVER (ORDER BY s_name) - 2 AS used FROM (SELECT DISTINCT s_name FROM supplier)) SELECT string_agg(s_name, ', ' ORDER BY s_name) FILTER (WHERE used <= 200) AS names, count(*) FILTER (WHERE used > 200) AS more FROM n")
def a20(spark, d):
    return Q.company_summary(table(spark, d, "supplier"), "s_name", 200)


@query("a13_archive_sources", "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def a13(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.col("source") == "unknown", "source")


@query("a21_latest_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def a21(spark, d):
    from brightloom.operators.dedup import latest_state

    return latest_state(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])


# threads and ingest in full

#: What a message says, its kind as an own and as a received one, and what it proves: proposal, rejects, recruits, tells,
#: proves (own), proves (received).
_SAYINGS = (
    ("포지션 제안 드립니다", None, None, 1, 0, 1, 0, 1, 1), ("지원하겠습니다. 이력서를 첨부드립니다", "applied", None, 0, 0, 1, 0, 1, 0), ("정중히 거절하겠습니다", "declined", None, 0, 0, 0, 0, 0, 0),
    ("지원을 철회합니다", "withdrawn", None, 0, 0, 0, 0, 0, 0), ("검토해 보겠습니다", "pending", None, 0, 0, 0, 0, 0, 0), ("지원이 정상적으로 접수되었습니다", None, "applied", 0, 0, 1, 1, 0, 0),
    ("면접 일정 안내드립니다", None, "interview", 0, 0, 1, 1, 0, 0), ("최종 합격을 축하드립니다", None, "offer", 0, 0, 0, 1, 0, 0), ("이번 전형에서 탈락하셨습니다", None, "rejected", 0, 1, 0, 1, 0, 0),
    ("입사일은 3월 1일입니다", None, "hired", 0, 0, 1, 0, 0, 0), ("감사합니다", None, None, 0, 0, 0, 0, 0, 0), ("연봉이 맞으면 지원하겠습니다", None, None, 0, 0, 0, 0, 1, 0),
    ("포지션 제안: 불합격자에게는 연락하지 않습니다\n채용 절차: 서류 → 면접 → 최종 합격", None, None, 1, 0, 1, 1, 1, 1),
)


def conversing(spark, d, m=None):
    """Messages of conversations whose bodies are sayings; with message_id and at as the place in the thread."""
    m = messages(spark, d) if m is None else m
    said = F.element_at(F.array(*[F.lit(t[0]) for t in _SAYINGS]), ((F.col("thread_id") * 7 + F.col("at")) % len(_SAYINGS) + 1).cast("int"))
    at = F.col("at").cast("long")
    return m.select("thread_id", at.alias("at"), at.alias("message_id"), "sent", F.concat(F.lit("Hello,\n"), said).alias("body"), (F.col("at") % 5 == 4).alias("removed"))


_SAID_ROWS = ", ".join(f"({i}, {', '.join(repr(x) if x else 'NULL::VARCHAR' for x in t[1:3])}, {', '.join(map(str, t[3:]))})" for i, t in enumerate(_SAYINGS))
_PROPOSED = "NOT m.sent AND f.current IS NULL AND m.proposal = 1"
_SAID_KIND = f"""CASE WHEN {_PROPOSED} AND NOT (m.recruits = 1 AND m.rejects = 1) THEN 'proposal_unanswered' WHEN m.rule IS NOT NULL THEN m.rule WHEN {_PROPOSED} THEN 'proposal_unanswered'
    WHEN m.sent AND f.current = 'proposal_unanswered' THEN 'pending' WHEN NOT m.sent AND f.current IN ('applied', 'responded') THEN 'responded' END"""
_THREAD_CTES = f"""{with_views('messages').replace('WITH', 'WITH RECURSIVE')},
s(i, own, received, proposal, rejects, recruits, tells, proves_own, proves_received) AS (VALUES {_SAID_ROWS}),
a AS (SELECT thread_id, "at", sent, CASE WHEN sent THEN own ELSE received END AS rule, proposal, rejects, recruits AS r, tells, CASE WHEN sent THEN proves_own ELSE proves_received END AS proves
  FROM messages JOIN s ON s.i = (thread_id * 7 + "at") % {len(_SAYINGS)}),
m AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY "at") AS i FROM (SELECT *, max(r) OVER t AS recruits, max(tells) OVER t AS any_tells, max(proves) OVER t AS any_proves FROM a WINDOW t AS (PARTITION BY thread_id))
  WHERE any_proves = 1 OR (recruits = 1 AND any_tells = 1)),
f AS (
  SELECT DISTINCT thread_id, 0::BIGINT AS i, NULL::BIGINT AS "at", NULL::VARCHAR AS current, false AS application, false AS new FROM m
  UNION ALL SELECT thread_id, i, "at", CASE WHEN new THEN kind ELSE current END, application OR coalesce(new AND kind IN ('applied', 'responded', 'interview', 'offer', 'hired', 'rejected'), false), new
  FROM (SELECT thread_id, i, "at", current, application, CASE WHEN application AND k = 'declined' THEN 'withdrawn' ELSE k END AS kind, k IS NOT NULL AND NOT (application AND k = 'pending') AS new
    FROM (SELECT m.thread_id, m.i, m."at", f.current, f.application, {_SAID_KIND} AS k FROM f JOIN m ON m.thread_id = f.thread_id AND m.i = f.i + 1)))"""


@query("w7_thread_states", f"""{_THREAD_CTES} SELECT thread_id, "at" AS message_id, current AS kind, false AS needs_review, row_number() OVER (PARTITION BY thread_id ORDER BY i DESC) = 1 AS apply FROM f WHERE new""")
def w7_states(spark, d):
    """W7 and W11 with all kinds of the classifier."""
    return TH.thread_states(conversing(spark, d)).select("thread_id", "message_id", "kind", "needs_review", "apply")


_KINDS_OF_EVENTS = ("proposal_unanswered", "pending", "declined", "withdrawn", "applied", "responded", "interview", "offer", "rejected", "hired")
_STATUSES_OF_KEYS = (None, "evaluated", "applied", "skip", "interview", "discarded", "rejected")
_APPLIED = f"(f.status IN {TI.APPLICATION!r} OR (f.status = 'discarded' AND (coalesce(f.decision = 'applied', false) OR f.noted)))"
_PHASES = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TI.PHASE.items()) + " ELSE 0 END"
_CANONICAL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TI.CANONICAL.items()) + " END"


@query(
    "q6_ingest_in_order",
    f"""{with_views('changes').replace('WITH', 'WITH RECURSIVE')},
ev AS (SELECT event_id, key, {list(_KINDS_OF_EVENTS)!r}[(event_id % 10 + 1)::INT] AS kind, event_at, event_id % 13 > 0 AS apply, event_id % 11 = 0 AS review FROM changes WHERE event_id % 7 <> 0 OR event_id % 14 = 0),
st AS (SELECT key, {str(list(_STATUSES_OF_KEYS)).replace('None', 'NULL')}[(key % 7 + 1)::INT] AS status, key % 2 = 0 AS dated, ['applied', 'pending', 'excluded', NULL][(key % 4 + 1)::INT] AS decision,
  [TIMESTAMP '2024-01-05', NULL, TIMESTAMP '2024-01-10'][(key % 3 + 1)::INT] AS decided_at, key % 8 = 2 AS withdrawn, key % 6 = 0 AS noted FROM (SELECT DISTINCT key FROM changes WHERE key % 5 > 0)),
m AS (SELECT *, {_CANONICAL} AS canonical, row_number() OVER (PARTITION BY key ORDER BY event_at, event_id) AS i FROM ev WHERE apply),
f AS (
  SELECT k.key, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::TIMESTAMP AS event_at, NULL::VARCHAR AS outcome, false AS review, st.status, st.status AS first_status, coalesce(dated, false) AS dated,
    decision, decided_at, coalesce(withdrawn, false) AS withdrawn, coalesce(noted, false) AS noted FROM (SELECT DISTINCT key FROM m) k LEFT JOIN st USING (key)
  UNION ALL SELECT key, i, event_id, kind, event_at, o, rv, CASE WHEN o = 'applied' AND NOT rv AND canonical IS NOT NULL THEN canonical ELSE status END, first_status, dated,
    CASE WHEN o <> 'applied' THEN decision WHEN rv OR kind IN ('pending', 'proposal_unanswered') THEN 'pending' WHEN kind IN ('declined', 'withdrawn') THEN 'excluded' ELSE 'applied' END,
    CASE WHEN o = 'applied' THEN event_at ELSE decided_at END, CASE WHEN o = 'applied' THEN kind = 'withdrawn' AND NOT rv ELSE withdrawn END, noted
  FROM (SELECT *, CASE WHEN o = 'application_preserved' THEN kind = 'declined' ELSE given END AS rv FROM (
    SELECT f.key, m.i, m.event_id, m.kind, m.event_at, m.review AS given, m.canonical, f.status, f.first_status, f.dated, f.decision, f.decided_at, f.withdrawn, f.noted,
      CASE WHEN f.decided_at IS NOT NULL AND m.event_at < f.decided_at THEN 'older_than_current_decision'
        WHEN f.dated AND f.status = f.first_status AND m.event_at::DATE < DATE '2024-01-08' THEN 'older_than_canonical_transition'
        WHEN f.status = 'skip' AND m.kind = 'proposal_unanswered' THEN 'prior_exclusion_preserved'
        WHEN m.review AND {_APPLIED} THEN 'review_preserves_application'
        WHEN {_APPLIED} AND m.kind IN ('pending', 'proposal_unanswered', 'declined') THEN 'application_preserved'
        WHEN f.status IS NOT NULL AND m.canonical IS NOT NULL AND m.kind <> 'withdrawn' AND {_PHASES.format('f.status')} > {_PHASES.format('m.canonical')} THEN 'later_application_stage_preserved'
        WHEN f.withdrawn AND m.kind IN ('pending', 'proposal_unanswered', 'declined') THEN 'withdrawal_preserved' ELSE 'applied' END AS o
    FROM f JOIN m ON m.key = f.key AND m.i = f.i + 1)))
SELECT event_id, key, kind, outcome, review AS needs_review, status, decision FROM f WHERE i > 0
UNION ALL SELECT event_id, key, kind, 'history_only', review, NULL, NULL FROM ev WHERE NOT apply""",
)
def q6_in_order(spark, d):
    """All outcomes, each event against what the ones before it left."""
    c, e, k = changes(spark, d), F.col("event_id"), F.col("key")
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    events = c.select("event_id", "key", of(_KINDS_OF_EVENTS, e % 10).alias("kind"), "event_at", (e % 13 > 0).alias("apply"), (e % 11 == 0).alias("needs_review"))
    ledger = c.where("event_id % 7 = 0").select("event_id", F.when(e % 14 == 0, "error").otherwise("applied").alias("outcome"))
    state = c.where("key % 5 > 0").select("key").distinct().withColumn("status", of(_STATUSES_OF_KEYS, k % 7))
    state = state.withColumns(
        {
            "dates": F.when((k % 2 == 0) & F.col("status").isNotNull(), F.create_map("status", F.lit("2024-01-08").cast("date"))),
            "decision": of(("applied", "pending", "excluded", None), k % 4),
            "decided_at": of(("2024-01-05", None, "2024-01-10"), k % 3).cast("timestamp"),
            "withdrawn": k % 8 == 2,
            "noted": k % 6 == 0,
        }
    )
    return TI.ingest_in_order(events, ledger, state).drop("event_at")
