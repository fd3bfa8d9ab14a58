"""Registered queries of feeds and streams over the driver's tables, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brightloom.operators.dedup import checkpointed
from brightloom.operators.threads import stream_thread_states
from brightloom.plans.application_queries import _THREAD_CTES, conversing
from brightloom.plans.views import as_messages, changes, table, with_views
from brightloom.sources import feeds as S
from brightloom.streaming import events as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "s12_json_feed",
    """SELECT 'board' AS source, event_id::VARCHAR AS id, event_type AS title, 'https://b.example.com/' || event_id AS url, 'c' || user_id AS location, ts::DATE AS posted_on FROM events WHERE event_id % 3 = 0 AND event_id % 5 > 0
UNION ALL SELECT 'list', event_id::VARCHAR, event_type, 'https://l.example.com/' || event_id, NULL, ts::DATE FROM events WHERE event_id % 3 = 1""",
)
def s12(spark, d):
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    board = F.to_json(F.struct(F.array(F.struct(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("title"), F.concat(F.lit("https://b.example.com/"), "event_id").alias("absolute_url"),
        F.struct(F.concat(F.lit("c"), "user_id").alias("name")).alias("location"), day.alias("updated_at"),
    )).alias("jobs")))
    flat = F.to_json(F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.concat(F.lit("https://l.example.com/"), "event_id").alias("hostedUrl"), day.alias("createdAt"))))
    raw = e.select(F.element_at(F.array(*map(F.lit, ("board", "list", "unknown"))), (F.col("event_id") % 3 + 1).cast("int")).alias("source"), F.when(F.col("event_id") % 3 == 0, board).otherwise(flat).alias("payload"))
    return S.normalize_json_feed(raw).select("source", "id", "title", "url", "location", F.to_date("posted_at").alias("posted_on"))


@query("s13_xml_feed", "SELECT s_name AS company, 'Role & ' || s_suppkey AS title, 'https://x.example.com/' || s_suppkey AS url, 'has inside and ' || s_suppkey AS description FROM supplier")
def s13(spark, d):
    s = table(spark, d, "supplier")
    item = F.concat(
        F.lit("<item><title><![CDATA["), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(": Role & "), "s_suppkey", F.lit("]]></title>"))).otherwise(F.concat(F.lit("Role & "), "s_suppkey", F.lit("]]></title><company>"), "s_name", F.lit("</company>"))),
        F.lit("<description><![CDATA[<b>has</b> </item> inside]]> and "), "s_suppkey", F.lit("</description><link>https://x.example.com/"), "s_suppkey", F.lit("</link></item><item><title>no link</title></item>"),
    )
    raw = s.select(F.lit("x").alias("source"), F.concat(F.lit("<rss><channel><description>the feed</description>"), item, F.lit("</channel></rss>")).alias("payload"))
    return S.normalize_xml_feed(raw).select("company", "title", "url", "description")


@query(
    "s14_html_pages",
    r"""WITH c AS (SELECT url AS page, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS card FROM pages)
SELECT page, trim(regexp_extract(card, '<a[^>]*>(.*?)</a>', 1)) AS title, regexp_extract(page, '^https?://[^/?#]*') || regexp_extract(card, 'href="([^"]*)"', 1) AS url FROM c""",
)
def s14(spark, d):
    return S.normalize_html_pages(table(spark, d, "pages").select("url", "html")).select("page", "title", "url")


@query("s15_thread_posts", "SELECT c_custkey, c_name AS company, c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Berlin' END AS location, CASE WHEN c_custkey % 3 = 0 THEN 'https://t.example.com/' ELSE 'https://j.example.com/' || c_custkey END AS url FROM customer WHERE c_custkey % 5 > 0")
def s15(spark, d):
    text = F.expr("""CASE WHEN c_custkey % 5 = 0 THEN 'just a remark' ELSE concat(c_name, ' | <b>', c_mktsegment, '</b>', CASE WHEN c_custkey % 2 = 0 THEN ' | Berlin' ELSE '' END, '<p>More',
      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(' at <a href="https://j.example.com/', c_custkey, '">here</a>') END) END""")
    rows = table(spark, d, "customer").select("c_custkey", text.alias("text"), F.lit("https://t.example.com/").alias("thread"))
    return S.normalize_thread_posts(rows, thread_url="thread").select("c_custkey", "company", "title", "location", "url")


@query("s16_search_results", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand END AS company, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type END AS location FROM part")
def s16(spark, d):
    line = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, ' is hiring ', p_name, ' in ', p_type) WHEN 1 THEN concat(p_brand, ' ', p_name, ' (', p_type, ') 채용 중') ELSE concat(p_brand, ' looks for ', p_name) END")
    return S.normalize_search_results(table(spark, d, "part").withColumn("line", line)).select("p_partkey", "company", "title", "location")


@query("x21_embedded_json", "SELECT event_id, event_type AS kind, event_id % 4 > 0 AS found FROM events WHERE event_id % 4 > 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 4 = 0")
def x21(spark, d):
    html = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit('<html><script id="data" type="application/json">{"props": {"kind": "'), "event_type", F.lit('"}}</script></html>'))).otherwise("<html></html>")
    kind = S.embedded_json(html, "data", "$.props.kind")
    return table(spark, d, "events").select("event_id", kind.alias("kind")).withColumn("found", F.col("kind").isNotNull())


@query("t1_changes", "SELECT event_id, event_type = 'purchase' OR (event_type <> 'error' AND event_id % 4 = 1) AS relevant FROM events")
def t1(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "error", "other").otherwise("labels_added")
    label = F.element_at(F.array(*map(F.lit, ("INBOX", "SPAM", "STARRED", "UNREAD"))), (F.col("event_id") % 4 + 1).cast("int"))
    return E.stream_changes(table(spark, d, "events").select("event_id", "event_type", kind.alias("kind"), F.array(label).alias("labels"))).select("event_id", "relevant")


@query("t4_late_guard", f"{with_views('changes')}, s AS (SELECT key, max(event_at) AS d FROM changes WHERE kind = 'purchase' GROUP BY 1) SELECT event_id, coalesce(event_at >= d, true) AS applied FROM changes LEFT JOIN s USING (key)")
def t4(spark, d):
    c = changes(spark, d)
    return E.apply_late_guard(c, c.where("kind = 'purchase'").select("key", F.col("event_at").alias("decided_at"))).select("event_id", "applied")


@query("t6_soft_delete", "SELECT event_id AS message_id, event_id IN (SELECT event_id FROM events WHERE event_type = 'error') AS unavailable FROM events")
def t6(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("message_id"), "event_type")
    return E.soft_delete(e, e.where("event_type = 'error'")).select("message_id", "unavailable")


@query("t7_backfill_windows", """WITH b AS (SELECT min(ts)::DATE - 7 AS a, max(ts)::DATE AS z FROM events), m AS (SELECT unnest(generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH))::DATE AS m, a, z FROM b)
SELECT count(*) AS n, greatest(m, a) AS window_start, least(last_day(m), z) AS window_end FROM m JOIN events ON ts::DATE BETWEEN greatest(m, a) AND least(last_day(m), z) GROUP BY ALL""")
def t7(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"))
    first, last = e.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    w = E.backfill_windows(spark, first, last)
    return e.join(F.broadcast(w), F.col("day").between(F.col("window_start"), F.col("window_end"))).groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query("t10_prune_by_bound", "SELECT event_id FROM events WHERE ts >= DATE '2024-01-20' - 3")
def t10(spark, d):
    return E.prune_by_bound(table(spark, d, "events"), "ts", "2024-01-20", 3).select("event_id")


@query("t11_out_of_window", f"{with_views('changes')} SELECT key, max(event_at) < TIMESTAMP '2024-01-29' AS needs_review FROM changes GROUP BY 1")
def t11(spark, d):
    return E.flag_out_of_window(changes(spark, d), "2024-01-29")


def _drained(spark, d, build, key: str, name: str = "events"):
    """The last row of each key that a stream over a table gives, by its batch, when it has read everything."""
    # the file source wants a pattern or a folder; batches are folders beside the checkpoints, which all executors share
    schema = table(spark, d, name).schema
    src = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    checkpointed(spark.range(1))  # sets the folder where the session has none
    home = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    E.run_incremental(build(src), f"{home}/cursor", E.parquet_sink(f"{home}/out")).awaitTermination()
    out = spark.read.parquet(f"{home}/out")
    rest = [c for c in out.columns if c not in (key, "batch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


@query("t8_stream_failure_streaks", f"""{with_views('health')}, i AS (SELECT *, sum((status <> 'network')::INT) OVER (PARTITION BY company ORDER BY ts DESC, event_id DESC) AS later FROM health)
SELECT company, count(*) FILTER (WHERE later = 0) AS streak, count(*) FILTER (WHERE later = 0) >= 3 AS alert FROM i GROUP BY 1""")
def t8(spark, d):
    def build(src):
        status = F.when(F.col("event_type") == "error", "network").when(F.col("event_type") == "signup", "empty").otherwise("reachable")
        return E.stream_failure_streaks(src.select(F.col("user_id").alias("company"), F.col("event_id").alias("at"), status.alias("status")), 3)

    return _drained(spark, d, build, "company")


@query("t5_stream_threads", """WITH RECURSIVE m AS (SELECT user_id AS thread_id, event_id AS at, event_type = 'error' AS removed, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type <> 'signup'),
f AS (SELECT thread_id, i, CASE WHEN NOT removed THEN r END AS s FROM m WHERE i = 1 UNION ALL SELECT m.thread_id, m.i, CASE WHEN m.removed OR f.s = 2 OR m.r IS NULL THEN f.s WHEN f.s IS NULL OR m.r >= f.s THEN m.r ELSE f.s END FROM f JOIN m ON m.thread_id = f.thread_id AND m.i = f.i + 1)
SELECT thread_id, ['view', 'click', 'purchase'][arg_max(s, i) + 1] AS status, (SELECT count(*) FROM m WHERE m.thread_id = f.thread_id AND NOT removed) AS n_messages, (SELECT count(*) FROM m WHERE m.thread_id = f.thread_id AND removed) AS unavailable FROM f GROUP BY 1""")
def t5(spark, d):
    def build(src):
        rows = src.where("event_type <> 'signup'").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("removed"))
        return E.stream_threads(rows, ("view", "click", "purchase"), ("purchase",))

    return _drained(spark, d, build, "thread_id")


@query(
    "t5_stream_thread_states",
    f"""{_THREAD_CTES} SELECT t.thread_id, e.kind, e.message_id, coalesce(e.n, 0) AS n_events, t.n_messages, t.unavailable FROM (SELECT thread_id, count(*) AS n_messages, count(*) FILTER ("at" % 5 = 4) AS unavailable FROM messages GROUP BY 1) t
LEFT JOIN (SELECT thread_id, arg_max(current, i) AS kind, max("at") AS message_id, count(*) AS n FROM f WHERE new GROUP BY 1) e USING (thread_id)""",
)
def t5_states(spark, d):
    """The same events as in batch, of threads that a stream gathers."""
    build = lambda src: stream_thread_states(conversing(spark, d, as_messages(src)))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drained(spark, d, build, "thread_id", "conversations")
    finally:
        spark.conf.set(store, before)


@query("t3_stream_dedup", "SELECT user_id AS key, 1 AS n FROM events GROUP BY 1")
def t3(spark, d):
    def build(src):
        return E.stream_dedup(src.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at")), "key", "at", "60 days").select("key", F.lit(1).alias("n"))

    return _drained(spark, d, build, "key")
