"""Registered queries of dedup, identity and similarity, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.operators.matching import staged_match
from brightloom.operators import dedup as D
from brightloom.operators import filters as R
from brightloom.operators import identity as I
from brightloom.operators import resolver as V
from brightloom.operators import similarity as S
from brightloom.plans.views import history, table, titles, tracker, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_KEY = "regexp_replace(regexp_replace(lower(url), '\\?utm_source=x$', ''), '/+$', '')"
_PAST, _NEW = "first_seen < DATE '2000-01-01'", "first_seen >= DATE '2000-01-01'"


@query("j1_anti_seen_urls", f"{with_views('history')} SELECT pos, url FROM history WHERE {_NEW} AND {_KEY} NOT IN (SELECT {_KEY} FROM history WHERE {_PAST})")
def j1(spark, d):
    h = history(spark, d)
    return D.anti_seen_urls(h.where(_NEW), h.where(_PAST)).select("pos", "url")


@query(
    "j2_anti_seen_roles",
    f"{with_views('history')}, k AS (SELECT *, regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS c, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS r FROM history) "
    f"SELECT pos FROM k a WHERE {_NEW} AND NOT EXISTS (SELECT 1 FROM k b WHERE b.first_seen < DATE '1993-01-01' AND b.status = 'added' AND a.c = b.c AND a.r = b.r)",
)
def j2(spark, d):
    h = history(spark, d)
    return D.anti_seen_roles(h.where(_NEW), h.where("first_seen < DATE '1993-01-01' AND status = 'added'")).select("pos")


@query("w2_first_wins", f"{with_views('history')} SELECT url_key, min(pos) AS pos FROM (SELECT {_KEY} AS url_key, pos FROM history) GROUP BY 1")
def w2(spark, d):
    h = history(spark, d).select(D.dedup_url(F.col("url")).alias("url_key"), "pos").distinct()
    return D.first_per_key(h.withColumn("p", F.col("pos")), ["url_key"], F.col("p")).select("url_key", "pos")


@query("w2_accept_two_keys")
def w2b(spark, d):
    h = history(spark, d).select("pos", "url", F.concat_ws("::", "company", "title").alias("role"))
    return D.verdicts_in_order(h, ["url", "role"], "pos")


_ACTIVE = "(status = 'skipped_invalid_url' OR (starts_with(status, 'cooldown:') AND '2000-06-01' < regexp_extract(status, '[^:]*$')) OR (status <> 'skipped_invalid_url' AND NOT starts_with(status, 'cooldown:') AND DATE '2000-06-01' - first_seen < 400))"


@query(
    "k1_append_history",
    f"{with_views('history')}, k AS (SELECT *, {_KEY} AS u FROM history) SELECT min(pos) AS pos, status FROM k WHERE {_NEW} "
    f"AND NOT EXISTS (SELECT 1 FROM k o WHERE o.{_PAST} AND {_ACTIVE.replace('status', 'o.status').replace('first_seen', 'o.first_seen')} AND o.u = k.u AND o.status = k.status) GROUP BY u, status",
)
def k1(spark, d):
    h = history(spark, d)
    active = R.history_active(F.col("status"), F.col("first_seen"), 400, "2000-06-01")
    return D.append_history(h.where(_NEW).withColumn("p", F.col("pos")), h.where(_PAST), active).select(F.col("p").alias("pos"), "status")


_INDEX = f"""SELECT 'li_' || substr(sha256({_KEY}), 1, 20) AS listing_instance_id, 'pc_' || substr(sha256(regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') || '::' || regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')), 1, 20) AS posting_cluster_id, status, pos FROM history"""


@query(
    "k3_rebuild_index",
    f"{with_views('history')}, i AS ({_INDEX}) SELECT listing_instance_id, min(pos) AS pos, arg_min(posting_cluster_id, pos) AS posting_cluster_id, arg_min(status, pos) AS status FROM i GROUP BY 1",
)
def k3(spark, d):
    return D.posting_index(history(spark, d), ["status", "pos"]).select("listing_instance_id", "pos", "posting_cluster_id", "status")


@query(
    "k2_append_index",
    f"{with_views('history')}, i AS ({_INDEX.replace('FROM history', 'FROM history WHERE ' + _NEW)}), o AS ({_INDEX.replace('FROM history', 'FROM history WHERE ' + _PAST)}) "
    "SELECT listing_instance_id, min(pos) AS pos FROM i WHERE listing_instance_id NOT IN (SELECT listing_instance_id FROM o) GROUP BY 1",
)
def k2(spark, d):
    h = history(spark, d)
    return D.append_posting_index(h.where(_NEW), D.posting_index(h.where(_PAST), []), ["pos"]).select("listing_instance_id", "pos")


@query("a9_history_metadata", f"{with_views('history')} SELECT {_KEY} AS url_key, min(first_seen) AS first_seen, max(first_seen) AS last_seen, count(*) AS n FROM history GROUP BY 1")
def a9(spark, d):
    return D.history_metadata(history(spark, d))


@query("k9_upsert_state", "WITH s AS (SELECT user_id::VARCHAR AS url, max(ts) AS at, count(*) AS n FROM events GROUP BY 1) SELECT * FROM s")
def k9(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("at"), "event_id")
    state = e.where("event_id % 3 = 0").groupBy("url").agg(F.max("at").alias("at"), F.count("*").alias("n"))
    return D.upsert_state(state, e.where("event_id % 3 <> 0"))


@query("k10_sanitize_tsv", r"SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '^[=+\-@]') THEN '''' || t ELSE t END) AS cell FROM (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 4 = 0 THEN '=' ELSE '' END || text, '[\t\r\n]+', ' ', 'g')) AS t FROM documents)")
def k10(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise(""), "text").alias("t"))
    return D.sanitize_tsv(t, ["t"]).select("doc_id", F.sha2("t", 256).alias("cell"))


@query("s18_dedup_feed", "SELECT event_type, coalesce(CASE WHEN event_id % 2 = 0 THEN (user_id % 40)::VARCHAR END, 'u' || (user_id % 50)) AS id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def s18(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 40).alias("row_id"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("url"))
    e = e.withColumn("id", F.coalesce(F.col("row_id").cast("string"), "url")).withColumn("o", F.col("event_id"))
    return D.dedup_feed(e, "event_type", "row_id", "url", "o").select("event_type", "id", "event_id")


@query("s19_open_only", "SELECT event_id FROM events WHERE event_type = 'view'")
def s19(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", " Active ").when(F.col("event_type") == "click", "closed").alias("status"))
    return D.open_only(e, "status").select("event_id")


@query("s20_collect_offices", "SELECT l_orderkey AS posting, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS location FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def s20(spark, d):
    l, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    rows = l.join(s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return D.collect_offices(rows.select(F.col("l_orderkey").alias("posting"), F.col("n_name").alias("office")), "posting", "office")


_ALIAS = "'c' || (c_custkey % 50)"


@query(
    "j3_resolve_company",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'segment' WHEN 2 THEN CASE WHEN (p_partkey % 50) = ((p_partkey + 1) % 50) THEN 'segment' ELSE 'ambiguous' END ELSE 'unmapped' END AS resolution,
  CASE WHEN p_size % 4 IN (0, 1) THEN p_partkey % 50 END AS company_id FROM part""",
)
def j3(spark, d):
    aliases = table(spark, d, "customer").select(F.expr(f"concat({_ALIAS.replace(' || ', ', ')}, ' Inc.')").alias("alias"), (F.col("c_custkey") % 50).alias("company_id"))
    name = F.expr("""CASE p_size % 4 WHEN 0 THEN concat('C', p_partkey % 50, ', LLC') WHEN 1 THEN concat('zzz (c', p_partkey % 50, ')')
      WHEN 2 THEN concat('c', p_partkey % 50, ' / c', (p_partkey + 1) % 50) ELSE concat('unknown', p_partkey) END""")
    return I.resolve_company(table(spark, d, "part").select("p_partkey", name.alias("company")), aliases).select("p_partkey", "resolution", "company_id")


_TRK = "SELECT num, status, regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS k, regexp_replace(lower(role), '[^a-z0-9]+', '', 'g') AS r FROM tracker"
_CAND = "SELECT c_custkey AS posting_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k, ['urgent', 'high', 'low', 'none'][(c_custkey % 4 + 1)::INT] AS r FROM customer"


def _candidates(spark, d):
    roles = F.element_at(F.array(*map(F.lit, ("URGENT", "High", "low", "none"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("posting_id"), F.concat("c_name", F.lit(", Ltd.")).alias("company"), roles.alias("title"))


@query(
    "j5_tracker_matches",
    f"{with_views('tracker')}, t AS ({_TRK}), p AS ({_CAND}) SELECT posting_id, num, status, p.r = t.r AS same_role, row_number() OVER (PARTITION BY posting_id ORDER BY p.r = t.r DESC, num DESC)::INT AS rank FROM p JOIN t USING (k) QUALIFY rank <= 3",
)
def j5(spark, d):
    return I.tracker_matches(_candidates(spark, d), tracker(spark, d))


_GATE = f"""t AS ({_TRK}), p AS ({_CAND}), h AS (SELECT * FROM t WHERE status IN {I.HARD_STATUSES!r}), br AS (SELECT k, r, arg_max(status, num) AS s FROM h GROUP BY 1, 2),
g AS (SELECT posting_id, CASE WHEN s IS NOT NULL THEN 'same_role_' || s WHEN p.k IN (SELECT k FROM h) THEN 'same_company_prior_application' ELSE 'eligible' END AS gate FROM p LEFT JOIN br ON p.k = br.k AND p.r = br.r)"""


@query("j6_history_gate", f"{with_views('tracker')}, {_GATE} SELECT * FROM g")
def j6(spark, d):
    return I.history_gate(_candidates(spark, d), tracker(spark, d))


_RESOLVED = f"""t AS (SELECT num, status, lower(role) = 'low' AS low, num % 1000 AS u, regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS k FROM tracker),
p AS (SELECT c_custkey AS posting_id, c_custkey % 4 = 2 AS low, c_custkey % 1000 AS u, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k FROM customer),
j AS (SELECT posting_id, num, status, CASE WHEN status = 'skip' THEN t.u = p.u ELSE t.low = p.low END AS role_match FROM p JOIN t USING (k))"""


def _told_candidates(spark, d):
    """Customers as postings; one in five names its company in the text alone. Titles of any two roles but "low" are alike."""
    name = F.col("c_name")
    roles = F.element_at(F.array(*map(F.lit, ("Urgent", "High", "Low", "None"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    blank = F.col("c_custkey") % 5 == 0
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("posting_id"), F.when(blank, " ").otherwise(F.concat(name, F.lit(", Ltd."))).alias("company"), F.concat(F.lit("Data Platform Engineer, "), roles).alias("title"),
        F.when(blank, F.concat(F.lit("We at "), name, F.lit(" look for you"))).otherwise("Customer#000000001").alias("identity_text"), F.concat(F.lit("https://x.example.com/wd/"), F.col("c_custkey") % 1000, F.lit("?ref=a")).alias("url"),
        F.when(F.col("c_custkey") % 19 == 0, "ambiguous").otherwise("exact").alias("resolution"), F.when(F.col("c_custkey") % 17 == 0, "conditional_reapply").alias("pipeline_bucket"),
    )


def _told_tracker(spark, d):
    return tracker(spark, d).select("num", "company", F.concat("role", F.lit(" Data Platform Engineer")).alias("role"), "status", F.concat(F.lit("see https://x.example.com/wd/"), F.col("num") % 1000, F.lit(" and https://x.example.com/about")).alias("notes"))


@query("j5_resolved_matches", f"{with_views('tracker')}, {_RESOLVED} SELECT posting_id, num, status, role_match, row_number() OVER (PARTITION BY posting_id ORDER BY role_match DESC, num DESC)::INT AS rank FROM j QUALIFY rank <= 3")
def j5_resolved(spark, d):
    """Unnamed companies, alike roles and skipped rows."""
    return V.resolved_matches(_told_candidates(spark, d), _told_tracker(spark, d))


@query(
    "j6_resolved_gate",
    f"""{with_views('tracker')}, {_RESOLVED}, g AS (SELECT posting_id, max_by({{'n': num, 's': status}}, num) FILTER (WHERE role_match AND status IN {V.ROLE_BLOCKS!r}) AS r, max(num) FILTER (WHERE status IN {V.COMPANY_BLOCKS!r}) AS c FROM j GROUP BY 1),
w AS (SELECT posting_id, r, c, CASE WHEN posting_id % 19 = 0 THEN 'ambiguous_company_identity' WHEN posting_id % 17 = 0 THEN 'pipeline_conditional_reapply' WHEN r IS NOT NULL THEN 'same_role_' || r.s WHEN c IS NOT NULL THEN 'same_company_prior_application'
  ELSE 'no_blocking_history' END AS reason FROM p LEFT JOIN g USING (posting_id))
SELECT posting_id, CASE WHEN reason = 'no_blocking_history' THEN 'eligible' ELSE 'excluded' END AS gate, reason, CASE WHEN starts_with(reason, 'same_role_') THEN r.n WHEN reason = 'same_company_prior_application' THEN c END AS num FROM w""",
)
def j6_resolved(spark, d):
    return V.resolved_gate(_told_candidates(spark, d), _told_tracker(spark, d))


@query("f18_gate", f"{with_views('tracker')}, {_GATE} SELECT posting_id FROM g WHERE gate = 'eligible'")
def f18(spark, d):
    return I.history_gate(_candidates(spark, d), tracker(spark, d)).where("gate = 'eligible'").select("posting_id")


@query("a10_gate_stats", f"{with_views('tracker')}, {_GATE} SELECT gate, count(*) AS n, array_to_string(list_sort(list(posting_id))[:5], ',') AS examples FROM g GROUP BY 1")
def a10(spark, d):
    return I.gate_stats(I.history_gate(_candidates(spark, d), tracker(spark, d)))


@query("j13_unique_match", f"{with_views('tracker')}, t AS ({_TRK}), p AS ({_CAND}), u AS (SELECT k, r, min(num) AS num FROM t GROUP BY 1, 2 HAVING count(*) = 1) SELECT posting_id, num FROM p JOIN u USING (k, r)")
def j13(spark, d):
    return I.unique_match(_candidates(spark, d), tracker(spark, d))


_URLS = ("'https://www.wanted.co.kr/wd/' || {x}", "'https://board.example.com/careers/' || {x}", "'li_' || {x}")


@query(
    "j13_staged_match",
    f"""{with_views('tracker')},
t AS (SELECT num, k, r, [['li_' || num // 3, {_URLS[0].format(x='num % 500')}], [{_URLS[1].format(x='num % 300')}], []][num % 3 + 1] AS al FROM ({_TRK})),
p AS (SELECT posting_id, k, r, CASE WHEN posting_id % 7 = 0 THEN posting_id // 7 END AS tn, [[{_URLS[0].format(x='posting_id % 500')}], [{_URLS[1].format(x='posting_id % 300')}], ['li_' || posting_id], []][posting_id % 4 + 1] AS al FROM ({_CAND})),
pairs AS (SELECT posting_id, num, p.tn = num AS s1, len(list_intersect(p.al, t.al)) > 0 AS s2, p.k = t.k AND p.r = t.r AS s3,
    len(list_filter(p.al, lambda u: contains(u, 'wanted'))) > 0 AND len(list_filter(t.al, lambda u: contains(u, 'wanted'))) > 0 AND len(list_intersect(list_filter(p.al, lambda u: contains(u, 'wanted')), t.al)) = 0
    OR len(list_filter(p.al, lambda u: contains(u, 'careers'))) > 0 AND len(list_filter(t.al, lambda u: contains(u, 'careers'))) > 0 AND len(list_intersect(list_filter(p.al, lambda u: contains(u, 'careers')), t.al)) = 0 AS bad
  FROM p JOIN t ON p.tn = t.num OR (p.k = t.k AND p.r = t.r) OR len(list_intersect(p.al, t.al)) > 0),
g AS (SELECT posting_id, count(*) FILTER (WHERE s1) AS n1, min(num) FILTER (WHERE s1) AS m1, count(*) FILTER (WHERE s2) AS n2, min(num) FILTER (WHERE s2) AS m2, count(*) FILTER (WHERE s3) AS n3, min(num) FILTER (WHERE s3) AS m3 FROM pairs WHERE NOT bad GROUP BY 1)
SELECT posting_id, CASE WHEN n1 = 1 THEN m1 WHEN n2 = 1 THEN m2 ELSE m3 END AS num, CASE WHEN n1 = 1 THEN 'number' WHEN n2 = 1 THEN 'alias' ELSE 'exact' END AS how FROM g WHERE n1 = 1 OR n2 = 1 OR n3 = 1""",
)
def j13_staged(spark, d):
    """Postings by their own number, then an alias, then company and role; a row of another concrete posting never fits."""
    none = F.array().cast("array<string>")
    link = lambda i, x: F.concat(F.lit(("https://www.wanted.co.kr/wd/", "https://board.example.com/careers/", "li_")[i]), x.cast("string"))
    pick = lambda key, *lists: F.element_at(F.array(*lists), (key % len(lists) + 1).cast("int"))
    n, c = F.col("num"), F.col("posting_id")
    t = tracker(spark, d).withColumn("aliases", pick(n, F.array(link(2, F.expr("num div 3")), link(0, n % 500)), F.array(link(1, n % 300)), none))
    p = _candidates(spark, d).withColumns({"tracker_num": F.when(c % 7 == 0, F.expr("posting_id div 7")), "aliases": pick(c, F.array(link(0, c % 500)), F.array(link(1, c % 300)), F.array(link(2, c)), none)})
    return staged_match(p, t).select("posting_id", "num", "how")


_lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TITLES = f"""t AS (
  SELECT p_partkey AS id, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS k, p_name || ' ' || p_type AS title, regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+') AS w FROM part),
r AS (
  SELECT *, lower(trim(title)) AS txt, list_distinct(list_filter(w, lambda x: list_contains({_lists(I.SENIORITIES)}, x))) AS lv,
         list_distinct(list_filter(w, lambda x: (length(x) > 3 AND NOT list_contains({_lists(I.STOPWORDS + I.SENIORITIES)}, x)) OR list_contains({_lists(I.SPECIALTIES)}, x))) AS tok FROM t)"""
_SHARED, _UNION = "list_intersect(a.tok, b.tok)", "list_distinct(a.tok || b.tok)"
_telling = lambda l: f"len(list_filter({l}, lambda x: NOT list_contains({_lists(I.BASELINE)}, x))) > 0"
_ALIKE = f"""((a.txt <> '' AND a.txt = b.txt) OR (
  CASE WHEN len(a.lv) > 0 AND len(b.lv) > 0 THEN len(list_intersect(a.lv, b.lv)) > 0 ELSE len(list_intersect(a.lv || b.lv, {_lists(I.SUB_BASELINE)})) = 0 END
  AND len({_SHARED}) >= 2 AND {_telling(_SHARED)} AND len({_SHARED}) * 1.0 / len({_UNION}) >= 0.6
  AND NOT (len(a.tok) <> len(b.tok) AND len({_SHARED}) = least(len(a.tok), len(b.tok)) AND {_telling(f"list_filter({_UNION}, lambda y: NOT list_contains({_SHARED}, y))")})))"""


@query("j10_fuzzy_roles", f"WITH {_TITLES} SELECT a.id AS a_id, b.id AS b_id FROM r a JOIN r b ON a.k = b.k AND a.id < b.id AND {_ALIKE}")
def j10(spark, d):
    """All pairs of parts of a brand with alike titles."""
    t = titles(spark, d).withColumnRenamed("posting_id", "id")
    return I.fuzzy_role_pairs(t, t).where("a_id < b_id")


@query("j10_fuzzy_role_classes", f"WITH {_TITLES}, c AS (SELECT DISTINCT k, title, txt, lv, tok FROM r) SELECT a.k, a.title AS at, b.title AS bt FROM c a JOIN c b ON a.k = b.k AND a.title < b.title AND {_ALIKE}")
def j10_classes(spark, d):
    """All titles of each company, once each."""
    return I.fuzzy_role_classes(titles(spark, d))


@query("j12_decisions_by_alias", """WITH own AS (SELECT c_custkey AS item_id, unnest([c_custkey % 97, 100 + c_nationkey]) AS alias FROM customer),
made AS (SELECT event_id, event_type, ts, unnest([user_id % 90, 100 + user_id % 20]) AS alias FROM events)
SELECT item_id, arg_max(event_id, (ts, event_id)) AS decision_id, arg_max(event_type, (ts, event_id)) AS status FROM own JOIN made USING (alias) GROUP BY 1""")
def j12(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.array(F.col("c_custkey") % 97, (100 + F.col("c_nationkey")).cast("long")).alias("aliases"))
    made = table(spark, d, "events").select(F.col("event_id").alias("decision_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.array(F.col("user_id") % 90, 100 + F.col("user_id") % 20).alias("aliases"))
    return I.match_by_alias(items, made)


@query("j20_classify_source", """WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN ends_with(h, '.example.org') THEN 'org' WHEN starts_with(h, 'm.') AND ends_with(h, '.example.net') AND false THEN '' WHEN ends_with(h, '.example.com') THEN 'com' ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS source FROM h""")
def j20(spark, d):
    pages = table(spark, d, "pages")
    rules = spark.createDataFrame([("example.org", "org", 1), ("org", "late", 2), ("example.com", "com", 3)], "domain string, source string, pos int")
    return I.classify_source(pages.select("page_id", "url"), rules).select("page_id", "source")


@query("j23_route_source", r"SELECT page_id, CASE WHEN regexp_matches(url, '://m\.([a-z]+)\.') THEN 'mobile' WHEN regexp_matches(url, 'example\.org/([a-z]+)') THEN 'org' END AS family, CASE WHEN regexp_matches(url, '://m\.([a-z]+)\.') THEN regexp_extract(url, '://m\.([a-z]+)\.', 1) WHEN regexp_matches(url, 'example\.org/([a-z]+)') THEN regexp_extract(url, 'example\.org/([a-z]+)', 1) END AS slug FROM pages")
def j23(spark, d):
    return I.route_source(table(spark, d, "pages"), [("mobile", r"://m\.([a-z]+)\."), ("org", r"example\.org/([a-z]+)")]).select("page_id", "family", "slug")


@query("x30_slug_candidates", "SELECT s_suppkey, array_to_string(list_distinct_ordered, '|') AS slugs FROM (SELECT s_suppkey, [replace(n, ' ', ''), replace(n, ' ', '-'), replace(n, ' ', '_'), string_split(n, ' ')[1]] AS list_distinct_ordered FROM (SELECT s_suppkey, 'acme ' || lower(replace(s_name, '#', ' ')) AS n FROM supplier))")
def x30(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(I.slug_candidates(F.concat(F.lit("Acme, "), "s_name")), "|").alias("slugs"))


_FP = r"""w AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>|&[a-z#0-9]+;', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents),
sp AS (SELECT doc_id, string_split(t, ' ') AS w FROM w WHERE length(t) >= 200),
sh AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] AS s FROM sp WHERE len(w) >= 3),
hs AS (SELECT doc_id, ('0x' || substr(sha1(unnest(s)), 1, 16))::UBIGINT AS h FROM sh),
fp AS (SELECT doc_id, {bits} AS fp FROM hs GROUP BY 1)""".replace("{bits}", " | ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64)))


@query("a22_simhash", f"WITH {_FP} SELECT doc_id, printf('%016x', fp) AS fingerprint FROM fp")
def a22(spark, d):
    return S.simhash(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"))


@query(
    "j7_cross_listings",
    f"""WITH {_FP}, p AS (SELECT doc_id AS id, source AS k, fp, DATE '2024-01-01' + (doc_id % 120)::INT AS seen_at FROM documents JOIN fp USING (doc_id))
SELECT a.id, b.id AS other_id, bit_count(xor(a.fp, b.fp))::INT AS distance FROM p a JOIN p b ON a.k <> b.k AND a.seen_at - b.seen_at BETWEEN 0 AND 90 AND bit_count(xor(a.fp, b.fp)) <= 5""",
)
def j7(spark, d):
    docs = table(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("company"), F.col("doc_id").cast("string").alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")).alias("seen_at"))
    fps = S.simhash(docs, "doc_id", "text")
    rows = D.checkpointed(own.join(fps, F.col("id") == F.col("doc_id")).drop("doc_id"))
    return S.cross_listings(rows, rows)


@query("j7_near_fingerprints", f"WITH {_FP}, d AS (SELECT DISTINCT fp FROM fp) SELECT printf('%016x', a.fp) AS fingerprint, printf('%016x', b.fp) AS near, bit_count(xor(a.fp, b.fp))::INT AS distance FROM d a JOIN d b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 5")
def j7_fingerprints(spark, d):
    """One row for each pair of near texts, whatever their copies; a22_simhash has what belongs to each."""
    fps = D.checkpointed(S.simhash(table(spark, d, "documents"), "doc_id", "text").select(F.col("fingerprint").alias("fp")).distinct())
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return S.near_fingerprints(fps, fps).where(text("fa") < text("fb")).select(text("fa").alias("fingerprint"), text("fb").alias("near"), "distance")
