"""Views that shape the driver's tables as postings, trackers, histories and messages, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators.dedup import dealt

TODAY = "2024-03-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture: documents with the url of a page, and the first 60 signs of the text as title. The page number is the
    document's modulo the (one-row) page count."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select("page_id", "url")
    placed = docs.crossJoin(F.broadcast(pages.agg(F.count("*").alias("n_pages")))).withColumn("page_id", F.expr("doc_id % n_pages"))
    kind = F.col("doc_id") % 3
    return placed.join(pages, "page_id", "left").select(
        F.col("doc_id").alias("posting_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        "url",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")).alias("posted_at"),
        F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") * 20.0).alias("salary_min"),
        F.when(F.col("doc_id") % 7 > 0, F.col("n_chars") * 30.0).alias("salary_max"),
        F.when(kind == 0, "EUR").when(kind == 1, "usd").alias("currency"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("posting_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.col("p_brand").alias("company"),
        "p_size",
        F.col("p_retailprice").alias("salary"),
    )


STATUSES = ("evaluated", "applied", "responded", "interview", "offer", "rejected", "discarded", "skip", "no-response")


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, people, places = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.ascii("o_orderstatus") + F.substring("o_orderpriority", 1, 1).cast("int")) % 9 + 1)
    joined = orders.join(dealt(people), orders["o_custkey"] == people["c_custkey"], "left").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("num"),
        F.to_date("o_orderdate").alias("date"),
        F.col("c_name").alias("company"),
        F.substring("o_orderpriority", 3, 20).alias("role"),
        status.alias("status"),
        F.round(1 + F.col("o_totalprice") % 4, 1).alias("score"),
        F.col("n_name").alias("location"),
        F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("agency-"), (F.col("o_orderkey") % 3).cast("string"))).alias("via"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log in which urls come back. pos is the place in the log."""
    items, supp, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    joined = items.join(supp, items["l_suppkey"] == supp["s_suppkey"], "left").join(part, items["l_partkey"] == part["p_partkey"], "left")
    status = (
        F.when(F.col("l_returnflag") == "R", "skipped_expired")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.concat(F.lit("cooldown:"), "s_name", F.lit(":"), F.date_format(F.date_add("l_shipdate", 180), "yyyy-MM-dd")))
        .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "skipped_invalid_url")
        .otherwise("added")
    )
    return joined.select(
        F.concat(F.lit("https://jobs.example.com/Job/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("/?utm_source=x")).alias("url"),
        F.to_date("l_shipdate").alias("first_seen"),
        F.col("s_name").alias("company"),
        F.col("p_name").alias("title"),
        status.alias("status"),
        F.concat_ws("-", F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("portal"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_shipdate").cast("date")).alias("pos"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "network").when(F.col("event_type") == "signup", "empty").otherwise("reachable")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("company"), "ts", "event_id", status.alias("status"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("ts").alias("event_at"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value"
    )


def as_messages(conversations: DataFrame) -> DataFrame:
    return conversations.where("role <> 'system'").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("at"), (F.col("role") == "user").alias("sent"), F.col("text").alias("body"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "conversations"))


#: The same views as DuckDB CTEs.
SQL = {
    "postings": """postings AS (
  SELECT doc_id AS posting_id, substr(text, 1, 60) AS title, source AS company, lang AS location, text AS description, p.url,
         DATE '2024-01-01' + (doc_id % 120)::INT AS posted_at,
         CASE WHEN doc_id % 5 > 0 THEN n_chars * 20.0::DOUBLE END AS salary_min, CASE WHEN doc_id % 7 > 0 THEN n_chars * 30.0::DOUBLE END AS salary_max,
         CASE doc_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'usd' END AS currency
  FROM documents d LEFT JOIN pages p ON p.page_id = doc_id % (SELECT count(*) FROM pages))""",
    "titles": """titles AS (
  SELECT p_partkey AS posting_id, p_name || ' ' || p_type AS title, p_brand AS company, p_size, p_retailprice AS salary FROM part)""",
    "tracker": f"""tracker AS (
  SELECT o_orderkey AS num, o_orderdate::DATE AS date, c_name AS company, substr(o_orderpriority, 3, 20) AS role,
         {list(STATUSES)!r}[(ascii(o_orderstatus) + substr(o_orderpriority, 1, 1)::INT) % 9 + 1] AS status,
         round(1 + o_totalprice % 4, 1) AS score, n_name AS location,
         CASE WHEN o_orderkey % 4 > 0 THEN 'agency-' || (o_orderkey % 3) END AS via
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)""",
    "history": """history AS (
  SELECT 'https://jobs.example.com/Job/' || l_orderkey || '-' || l_linenumber || '/?utm_source=x' AS url, l_shipdate::DATE AS first_seen,
         s_name AS company, p_name AS title,
         CASE WHEN l_returnflag = 'R' THEN 'skipped_expired'
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'cooldown:' || s_name || ':' || strftime(l_shipdate::DATE + 180, '%Y-%m-%d')
              WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'skipped_invalid_url' ELSE 'added' END AS status,
         'p-' || (l_suppkey % 5) AS portal,
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice::DECIMAL(18, 2), l_shipdate::DATE) AS pos
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey)""",
    "health": """health AS (
  SELECT user_id AS company, ts, event_id, CASE event_type WHEN 'error' THEN 'network' WHEN 'signup' THEN 'empty' ELSE 'reachable' END AS status FROM events)""",
    "changes": """changes AS (
  SELECT event_id, user_id AS key, event_type AS kind, ts AS event_at, (props->>'$.k')::INT AS k, value FROM events)""",
    "messages": """messages AS (
  SELECT conv_id AS thread_id, turn AS at, role = 'user' AS sent, text AS body FROM conversations WHERE role <> 'system')""",
}


def with_views(*names: str) -> str:
    """WITH clause of the named views; more CTEs may follow after a comma."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
