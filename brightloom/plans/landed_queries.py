"""Registered queries of readers: each lands files made from the driver's tables and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.operators.composite import append_dated
from brightloom.operators.dedup import checkpointed
from brightloom.plans.views import table, tracker, with_views
from brightloom.sources import feeds, readers
from brightloom.sources.landed import register_landed
from brightloom.streaming import events as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Lines of one landed file.
LINES = 200
#: Lists of one landed checklist: to make and open a file costs more than the lines of a list.
LISTS = 20


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _folder(spark) -> str:
    checkpointed(spark.range(1))  # sets the folder where the session has none
    return f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"


def _land(files: DataFrame, suffix: str = "*") -> str:
    """Writes every row of files (owner_id, body) as a file in a folder of its owner; the pattern of all folders.

    With a column file, names of files are in its order: partitions of a range, and a counter inside each.
    """
    path = _folder(files.sparkSession)
    if "file" in files.columns:
        files = files.repartitionByRange(8, "owner_id", "file").sortWithinPartitions("owner_id", "file")
    files.select("owner_id", "body").write.option("maxRecordsPerFile", 1).partitionBy("owner_id").text(path)
    return f"{path}/{suffix}"


def _files(rows: DataFrame, key: str, line: Column, head: str = "", lists: int = 1) -> DataFrame:
    """(owner_id, body): files of up to LINES lines in order of key, for four owners. With more lists, a file holds so many
    of them one after the other, each with its head."""
    placed = rows.select(F.concat(F.lit("o"), F.col(key) % 4).alias("owner_id"), F.col(key).alias("key"), F.floor(F.col(key) / (4 * LINES)).alias("file"), line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n")
    made = placed.groupBy("owner_id", "file").agg(lines.alias("body")).select("owner_id", "file", F.concat(F.lit(head), "body").alias("body"))
    if lists == 1:
        return made
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "body"))), lambda x: x["body"]), "\n")
    return made.groupBy("owner_id", F.floor(F.col("file") / lists).alias("of")).agg(joined.alias("body")).select("owner_id", F.col("of").alias("file"), "body")


def _owned(df: DataFrame) -> DataFrame:
    """Folders are named owner_id=..."""
    return df.withColumn("owner_id", F.regexp_replace("owner_id", "^owner_id=", ""))


@query(
    "s1_scan_history",
    """SELECT 'o' || event_id % 4 AS owner_id, 'https://h.example.com/' || event_id AS url, CASE WHEN event_id % 7 > 0 THEN ts::DATE END AS first_seen, CASE WHEN event_id % 3 = 0 THEN 'added' ELSE event_type END AS status,
  CASE WHEN event_id % 2 = 0 THEN (event_id % 100)::INT END AS trust_score, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_flags FROM events WHERE event_id % 11 > 0""",
)
def s1(spark, d):
    line = F.expr(r"""concat_ws('\t', CASE WHEN event_id % 11 > 0 THEN concat('https://h.example.com/', event_id) ELSE ' ' END, CASE WHEN event_id % 7 > 0 THEN date_format(ts, 'yyyy-MM-dd') ELSE 'soon' END, 'portal', 'title', 'company',
      CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, 'here', CASE WHEN event_id % 2 = 0 THEN concat('00ff\t2024-02-01\t', event_id % 100, '\tnew,odd\tcompany') END)""")
    files = _files(table(spark, d, "events"), "event_id", line, "url\tfirst_seen\tportal\ttitle\tcompany\tstatus\tlocation\n")
    return _owned(readers.read_scan_history(spark, _land(files))).select("owner_id", "url", "first_seen", "status", "trust_score", F.size("trust_flags").alias("n_flags"))


@query("s2_history_metadata", "SELECT 'o' || event_id % 4 AS owner_id, 'https://h.example.com/' || event_id AS url, strftime(ts, '%Y-%m-%d') AS first_seen, CASE WHEN event_id % 3 > 0 THEN event_type END AS posted_at FROM events WHERE event_id % 5 > 0")
def s2(spark, d):
    line = F.expr(r"concat_ws('\t', 'x', CASE WHEN event_id % 3 > 0 THEN event_type ELSE ' ' END, CASE WHEN event_id % 5 > 0 THEN concat('https://h.example.com/', event_id) ELSE '' END, date_format(ts, 'yyyy-MM-dd'))")
    files = _files(table(spark, d, "events"), "event_id", line, "Other\tPosted\tLink\tDate\n")
    return _owned(readers.read_history_metadata(spark, _land(files)))


@query(
    "s3_tracker",
    f"""{with_views('tracker')} SELECT 'o' || num % 4 AS owner_id, num, date, company, role, status, CASE WHEN num % 2 = 0 THEN 'Berlin' END AS location FROM tracker WHERE num % 9 > 0""",
)
def s3(spark, d):
    """Owners of even numbers have a Spanish header with a location; the others have no header."""
    t = tracker(spark, d)
    day = F.date_format("date", "yyyy-MM-dd")
    number = F.when(F.col("num") % 9 > 0, F.col("num").cast("string")).otherwise("-")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    named = row(number, day, "company", "role", F.lit("Berlin"), F.lit("4/5"), "status", F.lit("x"), F.lit("[1](r)"), F.lit("n"))
    plain = row(number, day, "company", "role", F.lit("4/5"), "status", F.lit("x"), F.lit("[1](r)"), F.lit("n"))
    head = "# Tracker\n\n| # | Fecha | Empresa | Rol | Ubicación | Puntuación | Estado | PDF | Informe | Notas |\n|---|---|---|---|---|---|---|---|---|---|\n"
    files = _files(t.where("num % 2 = 0"), "num", named, head).union(_files(t.where("num % 2 = 1"), "num", plain))
    return _owned(readers.read_tracker(spark, _land(files))).select("owner_id", "num", "date", "company", "role", "status", "location")


_MENDED = """SELECT num, CASE WHEN num % 4 = 3 THEN 'evaluated' ELSE status END AS status, CASE WHEN num % 4 = 2 THEN NULL ELSE score END AS score,
  CASE WHEN num % 4 = 3 THEN 'n; status was ' || 'odd' WHEN num % 4 = 1 THEN '—' ELSE 'n' END AS notes FROM tracker"""


def _broken(spark, d):
    """Rows with score and status swapped (1), no score (2), an unknown status (3)."""
    kind = F.col("num") % 4
    cell = F.concat(F.format_number("score", 1), F.lit("/5"))
    status, score = F.when(kind == 1, cell).when(kind == 3, "odd").otherwise(F.col("status")), F.when(kind == 1, F.col("status")).when(kind == 2, "-").otherwise(cell)
    return readers.repair_tracker(tracker(spark, d).select("num", status.alias("status"), score.alias("score"), F.when(kind == 1, "â€”").otherwise("n").alias("notes")))


@query("s4_repair_tracker", f"{with_views('tracker')} {_MENDED}")
def s4(spark, d):
    return _broken(spark, d)[0]


@query(
    "s4_landed_repair",
    f"""{with_views('tracker')} SELECT 'o' || num % 4 AS owner_id, count(*) AS n, count(DISTINCT num) AS numbers, max(num) FILTER (WHERE num % 9 > 0) + count(*) FILTER (WHERE num % 9 = 0) AS greatest, count(*) FILTER (WHERE num % 9 = 0) AS bad_id, count(*) FILTER (WHERE num % 5 = 0) AS stray_pipes,
  count(*) FILTER (WHERE num % 7 = 0) AS score_in_status, count(*) FILTER (WHERE num % 7 = 1) AS unknown_status, count(*) FILTER (WHERE num % 11 = 0) AS bad_date, count(*) FILTER (WHERE num % 13 = 0) AS mojibake FROM tracker GROUP BY 1""",
)
def s4_landed(spark, d):
    """Files of four owners with every kind of damage; all numbers are distinct afterwards."""
    n = F.col("num")
    part = lambda bad, odd, good: F.when(bad, odd).otherwise(good)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", part(n % 9 == 0, F.lit("-"), n.cast("string")), part(n % 11 == 0, F.lit("soon"), F.lit("2024-01-02")), "company", "role", part(n % 13 == 0, F.lit("�"), F.lit("4/5")), F.when(n % 7 == 0, "3/5").when(n % 7 == 1, "zzz").otherwise("applied"), F.lit("x"), F.lit("r"), part(n % 5 == 0, F.lit("a|b"), F.lit("a"))), F.lit(" |"))
    rows, counts = readers.read_tracker_repaired(spark, _land(_files(tracker(spark, d), "num", line)))
    kept = rows.groupBy("owner_id").agg(F.count("*").alias("n"), F.countDistinct("num").alias("numbers"), F.max("num").alias("greatest"))
    return _owned(kept.join(counts, "owner_id")).select("owner_id", "n", "numbers", "greatest", "bad_id", "stray_pipes", "score_in_status", "unknown_status", "bad_date", "mojibake")


@query("a12_repair_counts", f"{with_views('tracker')} SELECT count(*) FILTER (WHERE num % 4 = 1) AS swapped, count(*) FILTER (WHERE num % 4 = 3) AS unknown_status, count(*) FILTER (WHERE num % 4 = 1) AS placeholders, count(*) FILTER (WHERE num % 4 = 2) AS no_score FROM tracker")
def a12(spark, d):
    return _broken(spark, d)[1]


def _checklist(spark, d):
    """Files of two kinds of lists: pending items under buckets, every fifth with three cells alone, and processed ones."""
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), "event_type")
    pending = F.expr("""concat(CASE WHEN key % 3 = 0 THEN concat('### B', key, '\n') ELSE '' END, '- [ ] https://p.example.com/', key, ' | c', key, ' | t',
      CASE WHEN key % 5 > 0 THEN concat(' | ', event_type, ' | posted: 2024-01-02') ELSE '' END)""")
    done = F.expr("""concat('- [x] #', key, ' https://p.example.com/', key, ' | c', key, ' | t | ', event_type, CASE key % 3 WHEN 0 THEN ' | 4/5 | clean net-new, active' WHEN 1 THEN ' | 4.5/5 | clean net-new, active, now closed' ELSE ' | active' END)""")
    files = _files(e.where("key % 8 < 4"), "key", pending, "# List\n## Pending\n", LISTS).union(_files(e.where("key % 8 >= 4"), "key", done, "## Pending\n### Old\n## Processed\n", LISTS))
    return _owned(readers.read_pipeline(spark, _land(files)))


@query(
    "s5_pipeline",
    """WITH e AS (SELECT event_id AS key, event_type AS t, event_id // 800 AS f FROM events),
p AS (SELECT *, max(CASE WHEN key % 3 = 0 THEN key END) OVER (PARTITION BY key % 4, f ORDER BY key) AS b FROM e WHERE key % 8 < 4)
SELECT 'o' || key % 4 AS owner_id, 'pending' AS state, 'Pending' AS section, 'B' || b AS bucket, 'c' || key AS company, t AS location, '2024-01-02' AS posted FROM p WHERE key % 5 > 0
UNION ALL SELECT 'o' || key % 4, 'processed', 'Processed', NULL, 'c' || key, t, NULL FROM e WHERE key % 8 >= 4""",
)
def s5(spark, d):
    """Headings are carried over the lines of their file."""
    return _checklist(spark, d).select("owner_id", "state", "section", "bucket", "company", "location", "posted")


@query("s6_active_processed", "SELECT 'c' || event_id AS company FROM events WHERE event_id % 8 >= 4 AND event_id % 3 = 0")
def s6(spark, d):
    return readers.active_processed(_checklist(spark, d)).select("company")


def _additions(spark, d):
    body = F.expr(r"""concat_ws('\t', s_suppkey, '2024-01-01', s_name, 'Dev', CASE s_suppkey % 3 WHEN 0 THEN '4.5/5' WHEN 1 THEN 'offer' ELSE 'foo' END, CASE s_suppkey % 3 WHEN 0 THEN 'Aplicado' WHEN 1 THEN '3' ELSE 'bar' END, 'x', '[7](r)', CASE WHEN s_suppkey % 2 = 0 THEN 'via=agency' END, 'Rome')""")
    return readers.read_additions(spark, _land(table(spark, d, "supplier").select(F.concat(F.lit("o"), F.col("s_suppkey") % 4).alias("owner_id"), body.alias("body")).repartition(64)))  # a file is made for each row


@query(
    "s7_additions",
    """SELECT 'o' || s_suppkey % 4 AS owner_id, s_suppkey AS num, s_name AS company, CASE s_suppkey % 3 WHEN 0 THEN 4.5::DOUBLE ELSE 3.0 END AS score, CASE s_suppkey % 3 WHEN 0 THEN 'applied' ELSE 'offer' END AS status,
  CASE WHEN s_suppkey % 2 = 0 THEN 'agency' END AS via, 'Rome' AS location FROM supplier WHERE s_suppkey % 3 < 2""",
)
def s7(spark, d):
    return _owned(_additions(spark, d)[0]).select("owner_id", "num", "company", "score", "status", "via", "location")


@query("s7_additions_rejected", "SELECT 'o' || s_suppkey % 4 AS owner_id, 'score or status undecidable' AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 2 GROUP BY 1")
def s7b(spark, d):
    return _owned(_additions(spark, d)[1]).groupBy("owner_id", "reason").agg(F.count("*").alias("n"))


@query("s8_state_documents", "SELECT 'o' || o_orderkey % 4 AS owner_id, 'https://s.example.com/' || o_orderkey AS key, o_orderstatus AS status, o_custkey::INT AS n FROM orders WHERE o_orderkey % 6 > 0")
def s8(spark, d):
    entry = F.expr("""concat('"https://s.example.com/', o_orderkey, '": ', CASE WHEN o_orderkey % 6 > 0 THEN concat('{"status": "', o_orderstatus, '", "n": ', o_custkey, '}') ELSE 'null' END)""")
    files = _files(table(spark, d, "orders"), "o_orderkey", entry).select("owner_id", F.concat(F.lit('{"items": {'), F.regexp_replace("body", "\n", ", "), F.lit("}}")).alias("body"))
    return _owned(readers.read_state(spark, _land(files), "status: string, n: int"))


@query("s9_blacklist", "SELECT 'o' || c_custkey % 4 AS owner_id, 'customer' || c_nationkey AS key, 'because of ' || min(c_custkey) AS reason FROM customer GROUP BY c_custkey % 4, c_nationkey")
def s9(spark, d):
    """The first row of a company counts, over all files of an owner."""
    row = F.concat(F.lit("| Customer "), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, ", Inc.").otherwise(""), F.lit(" | 2024 | all | because of "), "c_custkey", F.lit(" |"))
    files = _files(table(spark, d, "customer"), "c_custkey", row, "| Company | Since | Scope | Reason |\n|---|---|---|---|\n")
    return _owned(readers.read_blacklist(spark, _land(files))).select("owner_id", "key", "reason")


@query("s10_manifest", "SELECT 'o' || p_partkey % 4 AS owner_id, (p_partkey // 8)::VARCHAR AS report, max_by(p_name, p_partkey) AS pdf FROM part GROUP BY p_partkey % 4, p_partkey // 8")
def s10(spark, d):
    """The last row of a report counts, with or without leading zeros."""
    line = F.concat(F.when(F.col("p_partkey") % 3 == 0, "00").otherwise(""), F.expr("p_partkey div 8"), F.lit("\t"), "p_name", F.lit("\tx.html\tA4\t2024"))
    files = _files(table(spark, d, "part"), "p_partkey", line, "# report\tpdf\n")
    return _owned(readers.read_manifest(spark, _land(files))).select("owner_id", "report", "pdf")


@query("s11_run_history", "SELECT 'o' || event_id % 4 AS owner_id, 'r' || event_id AS run_id FROM events WHERE event_id % 5 = 0 AND value >= 20")
def s11(spark, d):
    line = F.expr("""CASE event_id % 5 WHEN 1 THEN '{"run_id": "r' ELSE concat('{"run_id": "r', event_id, '", "status": "', CASE event_id % 5 WHEN 2 THEN 'failed' ELSE 'complete' END, '", "duration_seconds": ', CASE event_id % 5 WHEN 0 THEN value - 20 ELSE -1 END, '}') END""")
    return _owned(readers.read_run_history(spark, _land(_files(table(spark, d, "events"), "event_id", line)))).select("owner_id", "run_id")


@query("k5_append_dated", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def k5(spark, d):
    """Two runs append, and a read of one day only opens that day's folder."""
    e, path = table(spark, d, "events").select("event_id", "ts", "event_type"), _folder(spark)
    for part in (0, 1):
        append_dated(e.where(F.col("event_id") % 2 == part), path, "ts")
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"))


@query("v1_own_source", "SELECT event_id::VARCHAR AS id, event_type AS title, 'https://v.example.com/' || event_id AS url FROM events")
def v1(spark, d):
    """A source of the user's own, by paths of its rows and fields."""
    item = F.struct(F.col("event_id").alias("no"), F.struct(F.col("event_type").alias("name")).alias("job"), F.concat(F.lit("https://v.example.com/"), "event_id").alias("href"))
    raw = table(spark, d, "events").select(F.lit("mine").alias("source"), F.to_json(F.struct(F.struct(F.array(item).alias("list")).alias("data"))).alias("payload"))
    own = {"mine": ("$.data.list", {"id": "$.no", "title": "$.job.name", "url": "$.href"})}
    return feeds.normalize_json_feed(raw, own).select("id", "title", "url")


@query("v1_data_source", "SELECT event_id::VARCHAR AS id, event_type AS title, 'https://v.example.com/' || event_id AS url, 'board' AS source FROM events")
def v1_data_source(spark, d):
    """Payloads land in two steps under names that rise; the stream reads the first, stops, and resumes after its cursor."""
    register_landed(spark)
    home = _folder(spark)
    item = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.concat(F.lit("https://v.example.com/"), "event_id").alias("absolute_url"))
    raw = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.array(item).alias("jobs"))).alias("payload"))
    for part in (0, 1):
        raw.where(F.col("event_id") % 2 == part).select("payload").write.text(f"{home}/in/board/{part}")
        landed = spark.readStream.format("landed_payloads").option("lines", True).load(f"{home}/in")
        E.run_incremental(feeds.normalize_json_feed(landed), f"{home}/cursor", E.parquet_sink(f"{home}/out"), "append").awaitTermination()
    return spark.read.parquet(f"{home}/out").select("id", "title", "url", "source")


@query("t2_resume_and_rescan", "SELECT event_id, event_type AS kind FROM events")
def t2(spark, d):
    """Half of the events arrive, then the rest; then the cursor is lost, and the rescan adds nothing twice."""
    e, home = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind")), _folder(spark)
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{home}/in")
        E.run_incremental(stream, f"{home}/cursor", E.keyed_sink(f"{home}/out", ["event_id"])).awaitTermination()
    stream = spark.readStream.schema(e.schema).parquet(f"{home}/in")
    E.rescan(stream, f"{home}/cursor", E.keyed_sink(f"{home}/out", ["event_id"])).awaitTermination()
    return spark.read.parquet(f"{home}/out").select("event_id", "kind")


@query("t2_daily_sink", "SELECT event_id, event_type AS kind, ts::DATE AS day FROM events")
def t2_daily(spark, d):
    """As t2_resume_and_rescan, into a table with a folder for each day, of which a batch reads those of its days."""
    e, home = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.to_date("ts").alias("day")), _folder(spark)
    sink = E.keyed_sink(f"{home}/out", ["event_id"], "day")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{home}/in")
        E.run_incremental(spark.readStream.schema(e.schema).parquet(f"{home}/in"), f"{home}/cursor", sink).awaitTermination()
    E.rescan(spark.readStream.schema(e.schema).parquet(f"{home}/in"), f"{home}/cursor", sink).awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{home}/out")


_BOARDS = ("amazon", "ashby", "himalayas", "lever", "recruitee", "smartrecruiters", "workable")


@query(
    "s12_public_boards",
    f"""WITH e AS (SELECT event_id AS i, event_type AS t, ts::DATE AS d, {list(_BOARDS)!r}[event_id % {len(_BOARDS)} + 1] AS source FROM events)
SELECT source, t AS title, CASE source WHEN 'amazon' THEN 'https://www.amazon.jobs/en/jobs/' || i WHEN 'smartrecruiters' THEN 'https://jobs.smartrecruiters.com/acme/' || i ELSE 'https://b.example.com/' || i END AS url,
  CASE source WHEN 'himalayas' THEN 'Spain, Italy' WHEN 'amazon' THEN 'Berlin' WHEN 'workable' THEN 'Rome, Italy' WHEN 'recruitee' THEN 'Rome, Italy' ELSE 'Rome' END AS location,
  CASE WHEN source <> 'smartrecruiters' THEN d END AS posted_on FROM e""",
)
def s12_boards(spark, d):
    """One payload for each event, in the form of one of seven public feeds."""
    day, seconds = "date_format(ts, 'yyyy-MM-dd')", "unix_timestamp(to_timestamp(to_date(ts)))"
    bodies = {
        "amazon": f"""concat('{{"jobs": [{{"title": "', event_type, '", "job_path": "/en/jobs/', event_id, '", "location": "Berlin", "posted_date": "', date_format(ts, 'MMMM d, yyyy'), '"}}, {{"title": "no path"}}]}}')""",
        "ashby": f"""concat('{{"jobs": [{{"title": "', event_type, '", "jobUrl": "https://b.example.com/', event_id, '", "location": "Rome", "publishedAt": "', {day}, 'T10:00:00.000+00:00"}}]}}')""",
        "himalayas": f"""concat('{{"jobs": [{{"title": "', event_type, '", "guid": "https://b.example.com/', event_id, '", "locationRestrictions": ["Spain", "Italy"], "pubDate": ', {seconds}, '}}]}}')""",
        "lever": f"""concat('[{{"text": "', event_type, '", "hostedUrl": "https://b.example.com/', event_id, '", "categories": {{"location": "Rome"}}, "createdAt": ', {seconds}, '000}}]')""",
        "recruitee": f"""concat('{{"offers": [{{"title": "', event_type, '", "careers_url": "https://b.example.com/', event_id, '", "city": "Rome", "country": "Italy", "published_at": "', {day}, ' 09:00:00 UTC"}}]}}')""",
        "smartrecruiters": """concat('{"content": [{"name": "', event_type, '", "id": "', event_id, '", "company": {"identifier": "acme"}, "location": {"fullLocation": "Rome"}}, {"name": "x", "id": "1"}]}')""",
        "workable": f"""concat('{{"jobs": [{{"title": "', event_type, '", "shortlink": "https://b.example.com/', event_id, '", "city": "Rome", "country": "Italy", "published_on": "', {day}, '"}}]}}')""",
    }
    case = " ".join(f"WHEN {i} THEN {bodies[n]}" for i, n in enumerate(_BOARDS))
    raw = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, _BOARDS)), (F.col("event_id") % len(_BOARDS) + 1).cast("int")).alias("source"), F.expr(f"CASE event_id % {len(_BOARDS)} {case} END").alias("payload"))
    return feeds.normalize_json_feed(raw).select("source", "title", "url", "location", F.to_date("posted_at").alias("posted_on"))
