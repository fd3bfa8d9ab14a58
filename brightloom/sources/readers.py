"""Readers of logs, checklists, trackers and state documents. All take folders of many files as well as one.

Every reader of text carries `owner_id`, the name of the file's folder, so that many people's files form one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = "url string, first_seen string, portal string, title string, company string, status string, location string, fingerprint string, posted_at string, trust_score string, trust_flags string, normalized_company string"
# Names of tracker columns, in English and Spanish.
TRACKER_NAMES = {
    "num": ("#", "num", "no", "id", "número"), "date": ("date", "fecha"), "company": ("company", "empresa"), "via": ("via", "canal"), "role": ("role", "rol", "puesto"),
    "location": ("location", "ubicación"), "score": ("score", "puntuación"), "status": ("status", "estado"), "pdf": ("pdf",), "report": ("report", "informe"), "notes": ("notes", "notas"),
}
FIXED_LAYOUT = ("num", "date", "company", "role", "score", "status", "pdf", "report", "notes")
INACTIVE = ("closed", "expired", "rejected", "no longer")


def _owner() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def _blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def read_scan_history(spark: SparkSession, path: str) -> DataFrame:
    """History of 7 or 12 columns, with or without a header; rows without a url go, an empty status is added."""
    raw = spark.read.csv(path, sep="\t", schema=HISTORY, mode="PERMISSIVE", quote="").withColumn("owner_id", _owner())
    rows = raw.where(~_blank("url") & (F.lower(F.trim("url")) != "url"))
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date")
    return rows.withColumns(
        {
            "status": F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("added")),
            "first_seen": day("first_seen"),
            "posted_at": day("posted_at"),
            "trust_score": F.col("trust_score").try_cast("int"),
            "trust_flags": F.filter(F.split(F.coalesce("trust_flags", F.lit("")), ","), lambda f: f != ""),
        }
    )


def read_history_metadata(spark: SparkSession, path: str, names: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Url, first_seen and posted_at of logs with a header, each under any of several names."""
    names = names or {"url": ("url", "link"), "first_seen": ("first_seen", "date"), "posted_at": ("posted_at", "posted")}
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    have = {c.lower(): c for c in raw.columns}
    pick = lambda of: F.coalesce(*[F.nullif(F.trim(have[n]), F.lit("")) for n in of if n in have], F.lit(None).cast("string"))
    return raw.select(_owner().alias("owner_id"), *[pick(of).alias(c) for c, of in names.items()]).where("url IS NOT NULL")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(owner_id, file, pos, line) of every line; a file is one row until it is split, so files must fit a task."""
    whole = spark.read.text(path, wholetext=True).select(_owner().alias("owner_id"), F.input_file_name().alias("file"), "value")
    return whole.select("owner_id", "file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def _tracker_rows(spark: SparkSession, path: str) -> DataFrame:
    """(owner_id, file, pos, cells, map) of the rows of Markdown tables; map has the place of each column, by the names of
    the file's first header, else by the fixed nine columns. Separators and headers go."""
    rows = _lines(spark, path).where(F.trim("line").startswith("|")).withColumn("cells", _cells(F.col("line"))).where(~F.col("line").rlike(r"^[\s|:\-]+$"))
    low = rows.withColumn("names", F.transform("cells", F.lower))
    at = {c: F.coalesce(*[F.nullif(F.array_position("names", n), F.lit(0)) for n in of], F.lit(0)) for c, of in TRACKER_NAMES.items()}
    is_header = (at["num"] > 0) & (at["company"] > 0) & (at["role"] > 0) & (at["score"] > 0) & (at["status"] > 0)
    places = F.struct(*[p.cast("int").alias(c) for c, p in at.items()])
    headers = low.withColumn("is_header", is_header)
    found = headers.where("is_header").groupBy("file").agg(F.min_by(places, "pos").alias("map"))
    fixed = F.struct(*[F.lit(FIXED_LAYOUT.index(c) + 1 if c in FIXED_LAYOUT else 0).alias(c) for c in TRACKER_NAMES])
    return headers.where("NOT is_header").join(found, "file", "left").withColumn("map", F.coalesce("map", fixed))


def _cell(c: str) -> Column:
    return F.nullif(F.when(F.col(f"map.{c}") > 0, F.get("cells", F.col(f"map.{c}") - 1)), F.lit("")).alias(c)


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """S3: rows of Markdown tables by the names of their header, else by the fixed nine columns.

    Separators, headers, rows without a number and rows too narrow to have a status go. Each file has its own header.
    """
    wide = F.size("cells") >= F.greatest("map.num", "map.company", "map.role", "map.score", "map.status")
    named = _tracker_rows(spark, path).where(wide).select("owner_id", "file", "pos", *[_cell(c) for c in TRACKER_NAMES])
    return named.withColumn("num", F.col("num").try_cast("long")).where("num IS NOT NULL").withColumn("date", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date"))


def read_tracker_repaired(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S4 and A12 of landed files: (rows, counts). Rows are never dropped, whatever they lack.

    Cells beyond the last column, where that is the notes, came of stray pipes and are joined to the notes again. Broken
    dashes become dashes; a score in the status cell moves to the score unless there is one, and the status is evaluated;
    an unknown status becomes evaluated, with what stood there as a note; missing, zero and repeated numbers of an owner
    follow the greatest in the order of files and rows. Dates stay as they are. counts: one row an owner with the rows that
    each repair touched, and those whose date is none.
    """
    from brightloom.operators.dedup import checkpointed
    from brightloom.operators.tracker import reassign_ids, score_value, status_name

    rows = _tracker_rows(spark, path)
    width = F.greatest(*[F.col(f"map.{c}") for c in TRACKER_NAMES])
    stray = (F.size("cells") > width) & (F.col("map.notes") == width)
    joined = F.concat(F.slice("cells", F.lit(1), width - 1), F.array(F.array_join(F.slice("cells", width, F.size("cells")), " | ")))
    read = rows.withColumn("stray_pipes", stray).withColumn("cells", F.when(stray, joined).otherwise(F.col("cells"))).select("owner_id", "file", "pos", "stray_pipes", *[_cell(c) for c in TRACKER_NAMES])
    broken = ("score", "pdf", "report")
    odd = lambda c: F.coalesce(F.col(c).rlike("^(鈥.{0,2}|â€.{0,2}|�+)$"), F.lit(False))
    read = read.withColumn("mojibake", odd("score") | odd("pdf") | odd("report")).withColumns({c: F.when(odd(c), "—").otherwise(F.col(c)) for c in broken})
    misplaced = score_value(F.col("status")).isNotNull()
    read = read.withColumn("score_in_status", misplaced).withColumns(
        {"score": F.when(misplaced & score_value(F.col("score")).isNull(), F.col("status")).otherwise(F.col("score")), "status": F.when(misplaced, "evaluated").otherwise(F.col("status"))}
    )
    note = F.concat(F.lit('[sync: original status "'), F.coalesce("status", F.lit("")), F.lit('"]'))
    read = read.withColumn("unknown_status", status_name(F.col("status")).isNull()).withColumns(
        {"notes": F.when(F.col("unknown_status"), F.concat_ws(" ", "notes", note)).otherwise(F.col("notes")), "status": F.coalesce(status_name(F.col("status")), F.lit("evaluated"))}
    )
    number = F.regexp_extract(F.coalesce("num", F.lit("")), r"^\s*(\d{1,18})", 1).try_cast("long")
    read = read.withColumns({"num": F.when(number > 0, number), "bad_date": ~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))})
    read = checkpointed(read.fillna("—", ["score", "report"]).fillna("❌", ["pdf"]))
    kept = read.where("num IS NOT NULL").groupBy("owner_id").agg(F.countDistinct("num").alias("kept"))
    flags = ("mojibake", "score_in_status", "unknown_status", "bad_date", "stray_pipes")
    counted = read.groupBy("owner_id").agg(*[F.count_if(f).alias(f) for f in flags], F.count("*").alias("n")).join(kept, "owner_id", "left")
    counts = counted.select("owner_id", *flags, (F.col("n") - F.coalesce("kept", F.lit(0))).alias("bad_id"))
    return reassign_ids(read, ["file", "pos"]).drop(*flags), counts


def repair_tracker(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): a status in the score cell swaps back, unknown statuses become evaluated with a note,
    placeholders become a dash; one row of counts of each repair."""
    from brightloom.operators.tracker import merge_note, score_value, status_name

    swapped = score_value(F.col("status")).isNotNull() & status_name(F.col("score")).isNotNull()
    fixed = df.withColumns({"_swap": swapped, "status": F.when(swapped, F.col("score")).otherwise(F.col("status")), "score": F.when(swapped, F.col("status")).otherwise(F.col("score"))})
    unknown = status_name(F.col("status")).isNull()
    odd = F.col("notes").rlike("^â€”$|^�+$")
    out = fixed.withColumns({"_unknown": unknown, "_odd": F.coalesce(odd, F.lit(False))}).withColumns(
        {
            "notes": F.when(F.col("_unknown"), merge_note(F.col("notes"), F.concat(F.lit("status was "), F.coalesce("status", F.lit("empty"))))).when(F.col("_odd"), "—").otherwise(F.col("notes")),
            "status": F.coalesce(status_name(F.col("status")), F.lit("evaluated")),
            "score": score_value(F.col("score")),
        }
    )
    counts = out.agg(F.count_if("_swap").alias("swapped"), F.count_if("_unknown").alias("unknown_status"), F.count_if("_odd").alias("placeholders"), F.count_if(F.col("score").isNull()).alias("no_score"))
    return out.drop("_swap", "_unknown", "_odd"), counts


def read_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """Items of checklists with the section and bucket they stand under; pending ones need four cells.

    Headings are carried forward over the lines of one file.
    """
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = _lines(spark, path)
    head = lambda p: F.last(F.nullif(F.regexp_extract("line", p, 1), F.lit("")), ignorenulls=True).over(w)
    bucket_at = F.max(F.when(F.col("line").rlike("^### "), F.col("pos"))).over(w)
    section_at = F.max(F.when(F.col("line").rlike("^## "), F.col("pos"))).over(w)
    placed = lines.withColumns({"section": head(r"^## (.+?)\s*$"), "bucket": F.when(bucket_at > section_at, head(r"^### (.+?)\s*$"))})
    items = placed.withColumn("mark", F.regexp_extract("line", r"^\s*- \[([ xX])\]", 1)).where("mark <> ''")
    cells = items.withColumn("cells", _cells(F.regexp_replace("line", r"^\s*- \[[ xX]\]\s*", ""))).withColumn("state", F.when(F.col("mark") == " ", "pending").otherwise("processed"))
    label = lambda n: F.nullif(F.regexp_extract("line", rf"{n}:\s*([^|]+?)\s*(?:\||$)", 1), F.lit(""))
    kept = cells.where("state = 'processed' OR size(cells) >= 4")
    return kept.select("owner_id", "file", "pos", "state", "section", "bucket", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("url", "company", "title", "location"))], label("posted").alias("posted"), label("trust").alias("trust"), "line")


def active_processed(df: DataFrame) -> DataFrame:
    """Processed items that show every sign of being open (number, score, "clean net-new", "active") and no other."""
    low = F.lower("line")
    good = F.col("line").rlike(r"#\d+") & F.col("line").rlike(r"\d(?:\.\d)?/5") & low.contains("clean net-new") & low.rlike(r"(?<![a-z])active(?![a-z])") & ~_blank("location")
    bad = F.lit(False)
    for term in INACTIVE:
        bad = bad | low.contains(term)
    return df.where((F.col("state") == "processed") & good & ~bad)


def read_additions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of one-row files; which of cells 5 and 6 is the score is told by their content."""
    from brightloom.operators.tracker import score_value, status_name

    whole = spark.read.text(path, wholetext=True).select(_owner().alias("owner_id"), F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\t| ?\| ?").alias("c"))
    cell = lambda i: F.trim(F.coalesce(F.get("c", F.lit(i)), F.lit("")))
    is_score = lambda i: score_value(cell(i)).isNotNull()
    is_status = lambda i: status_name(cell(i)).isNotNull()
    order = F.when(is_score(4) & is_status(5), 4).when(is_status(4) & is_score(5), 5)
    extras = F.slice("c", 9, 100)
    via = F.filter(extras, lambda x: F.trim(x).startswith("via="))
    rest = F.filter(extras, lambda x: ~F.trim(x).startswith("via=") & (F.trim(x) != ""))
    judged = whole.withColumns({"_score": order, "_via": via, "_rest": rest}).withColumn("reason", F.when(F.size("c") < 8, "too narrow").when(F.col("_score").isNull(), "score or status undecidable").when(F.size("_rest") > 1, "more than one location"))
    rows = judged.where("reason IS NULL").select(
        "owner_id", "file", cell(0).try_cast("long").alias("num"), cell(1).alias("date"), cell(2).alias("company"), cell(3).alias("role"),
        F.when(F.col("_score") == 4, score_value(cell(4))).otherwise(score_value(cell(5))).alias("score"), F.when(F.col("_score") == 4, status_name(cell(5))).otherwise(status_name(cell(4))).alias("status"),
        cell(6).alias("pdf"), cell(7).alias("report"), F.substring(F.get("_via", F.lit(0)), 5, 200).alias("via"), F.get("_rest", F.lit(0)).alias("location"),
    )
    return rows, judged.where("reason IS NOT NULL").select("owner_id", "file", "reason")


def read_state(spark: SparkSession, path: str, schema: str, root: str = "items") -> DataFrame:
    """Entries of JSON documents {root: {key: entry}} as rows (key, fields of schema); entries that are not objects go."""
    docs = spark.read.text(path, wholetext=True).select(_owner().alias("owner_id"), F.from_json("value", f"{root} map<string,struct<{schema}>>").alias("d"))
    return docs.select("owner_id", F.explode(f"d.{root}").alias("key", "e")).where("e IS NOT NULL").select("owner_id", "key", "e.*")


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Company, since, scope and reason of a Markdown table; the first row of a company counts."""
    from brightloom.functions.text import company_key

    rows = _lines(spark, path).where(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^[\s|:\-]+$")).withColumn("c", _cells(F.col("line")))
    named = rows.select("owner_id", "file", "pos", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("company", "since", "scope", "reason"))]).withColumn("key", company_key(F.col("company")))
    kept = named.where("key NOT IN ('', 'company', 'empresa')")
    return kept.groupBy("owner_id", "key").agg(F.min_by(F.struct("company", "since", "scope", "reason"), F.struct("file", "pos")).alias("r")).select("owner_id", "key", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each report number (without leading zeros) of tab-separated manifests with # comments."""
    rows = _lines(spark, path).where(~_blank("line") & ~F.trim("line").startswith("#")).withColumn("c", F.split("line", "\t"))
    named = rows.select("owner_id", "file", "pos", F.regexp_replace(F.get("c", F.lit(0)), r"^0+(?=\d)", "").alias("report"), *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("pdf", "html", "format", "date"), 1)])
    return named.groupBy("owner_id", "report").agg(F.max_by(F.struct("pdf", "html", "format", "date"), F.struct("file", "pos")).alias("r")).select("owner_id", "report", "r.*")


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """Complete runs with a duration of zero or more; lines that are no JSON go."""
    raw = spark.read.schema("run_id string, attempt_id string, status string, duration_seconds double, resumed boolean, run_mode string").json(path, mode="DROPMALFORMED").withColumn("owner_id", _owner())
    return raw.where("status = 'complete' AND duration_seconds >= 0 AND NOT isnan(duration_seconds)")
