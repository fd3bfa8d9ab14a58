"""Landed feeds (JSON, XML, HTML pages, threads, search results) as one table of postings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import html_to_text, parse_date, url_part

#: How a field is read from a row: a JSON path, several of which the first with a value counts, or a text with paths in
#: braces, which is empty if one of them is.
Read = str | Sequence[str]
#: Registered sources: name -> (JSON path of the rows, field -> how it is read).
SOURCES: dict[str, tuple[str, Mapping[str, Read]]] = {}
FIELDS = ("id", "title", "url", "company", "location", "posted_at", "description")


def register_source(name: str, rows: str, fields: Mapping[str, Read]) -> None:
    """V1: a JSON source by the path of its rows and of each field in a row."""
    unknown = set(fields) - set(FIELDS)
    if unknown or not {"title", "url"} <= set(fields):
        raise ValueError(f"title and url are needed; unknown fields: {sorted(unknown)}")
    SOURCES[name] = (rows, dict(fields))


register_source("board", "$.jobs", {"id": "$.id", "title": "$.title", "url": "$.absolute_url", "location": "$.location.name", "posted_at": "$.updated_at", "description": "$.content"})
register_source("list", "$", {"id": "$.id", "title": "$.text", "url": "$.hostedUrl", "company": "$.company", "location": "$.categories.location", "posted_at": "$.createdAt"})
# Where public job feeds have their fields.
register_source("amazon", "$.jobs", {"title": "$.title", "url": "https://www.amazon.jobs{$.job_path}", "location": ("$.normalized_location", "$.location"), "posted_at": "$.posted_date"})
register_source("arbeitnow", "$.data", {"id": "$.slug", "title": "$.title", "url": "$.url", "company": "$.company_name", "location": "$.location", "posted_at": "$.created_at"})
register_source("ashby", "$.jobs", {"id": "$.id", "title": "$.title", "url": "$.jobUrl", "location": "$.location", "posted_at": "$.publishedAt"})
register_source("breezy", "$", {"id": "$.id", "title": "$.name", "url": "$.url", "company": "$.company.name", "location": "$.location.name", "posted_at": "$.published_date"})
register_source("greenhouse", "$.jobs", {"id": "$.id", "title": "$.title", "url": "$.absolute_url", "location": "$.location.name", "posted_at": "$.first_published", "description": "$.content"})
register_source("himalayas", "$.jobs", {"title": "$.title", "url": ("$.applicationLink", "$.guid"), "company": "$.companyName", "location": "$.locationRestrictions", "posted_at": "$.pubDate"})
register_source("jobicy", "$.jobs", {"id": "$.id", "title": "$.jobTitle", "url": "$.url", "company": "$.companyName", "location": "$.jobGeo", "posted_at": "$.pubDate"})
register_source("lever", "$", {"id": "$.id", "title": "$.text", "url": "$.hostedUrl", "location": "$.categories.location", "posted_at": "$.createdAt", "description": "$.descriptionPlain"})
register_source("pinpoint", "$.data", {"id": "$.id", "title": "$.title", "url": "$.url", "location": ("$.location.name", "{$.location.city}, {$.location.province}", "$.location.city")})
register_source("recruitee", "$.offers", {"id": "$.id", "title": "$.title", "url": ("$.careers_url", "$.url"), "company": "$.company_name", "location": ("$.location", "{$.city}, {$.country}", "$.city"), "posted_at": "$.published_at"})
register_source("remoteok", "$", {"id": "$.id", "title": "$.position", "url": "$.url", "company": "$.company", "location": "$.location"})
register_source("remotive", "$.jobs", {"id": "$.id", "title": "$.title", "url": "$.url", "company": "$.company_name", "location": "$.candidate_required_location"})
register_source("smartrecruiters", "$.content", {"id": "$.id", "title": "$.name", "url": "https://jobs.smartrecruiters.com/{$.company.identifier}/{$.id}", "company": "$.company.name", "location": ("$.location.fullLocation", "{$.location.city}, {$.location.country}")})
register_source("themuse", "$.results", {"id": "$.id", "title": "$.name", "url": "$.refs.landing_page", "company": "$.company.name", "location": "$.locations[0].name"})
register_source("workable", "$.jobs", {"id": "$.shortcode", "title": "$.title", "url": ("$.shortlink", "$.url"), "location": ("{$.city}, {$.country}", "$.country"), "posted_at": "$.published_on", "description": "$.description"})
register_source("workingnomads", "$", {"title": "$.title", "url": "$.url", "company": "$.company_name", "location": "$.location"})


def _posting(df: DataFrame) -> DataFrame:
    return df.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("url", F.lit(""))) != ""))


def _read(how: Read) -> Column:
    """A field of the column item; lists of texts are joined by comma, and blank is null."""
    if not isinstance(how, str):
        return F.coalesce(*map(_read, how))
    if "{$" in how:
        pieces = re.split(r"\{(\$[^}]*)\}", how)
        return F.concat(*[_read(x) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
    value = F.get_json_object("item", how)
    joined = F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(value)
    return F.nullif(F.trim(joined), F.lit(""))


def _moment(raw: Column) -> Column:
    """A date, or seconds or milliseconds since 1970."""
    number = F.when(raw.rlike("^[0-9]{13}$"), raw.try_cast("double") / 1000).when(raw.rlike("^[0-9]{9,10}$"), raw.try_cast("double"))
    return F.coalesce(F.timestamp_seconds(number), parse_date(raw), raw.try_cast("timestamp"))


def normalize_json_feed(raw: DataFrame, sources: Mapping[str, tuple[str, Mapping[str, Read]]] | None = None) -> DataFrame:
    """Postings of landed payloads (source, payload); payloads of unknown sources and rows without title or url go."""
    known = SOURCES if sources is None else sources
    path = F.lit(None).cast("string")
    for name, (rows, _) in known.items():
        path = F.when(F.col("source") == name, F.get_json_object("payload", rows)).otherwise(path)
    items = raw.where(F.col("source").isin(*known)).select("source", F.explode_outer(F.from_json(path, "array<string>")).alias("item")).where("item IS NOT NULL")

    def field(f: str) -> Column:
        value = F.lit(None).cast("string")
        for name, (_, fields) in known.items():
            if f in fields:
                value = F.when(F.col("source") == name, _read(fields[f])).otherwise(value)
        return value.alias(f)

    return _posting(items.select("source", *[field(f) for f in FIELDS])).withColumn("posted_at", _moment(F.col("posted_at")))


def _tag(xml: Column, name: str) -> Column:
    raw = F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    bare = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.nullif(F.trim(bare), F.lit(""))


def normalize_xml_feed(raw: DataFrame, row_tag: str = "item", tags: Mapping[str, str] | None = None) -> DataFrame:
    """Postings of landed feeds (source, payload), with their descriptions as text.

    A description may hold anything, a closing row tag too. So text under CDATA and descriptions is set aside before
    rows are split, and put back into its own row: rows and the pieces set aside come in the same order. A title such as
    "Company: Role" is split where the feed has no company of its own. tags: names of a feed's tags by field.
    """
    named = {"title": "title", "url": "link", "company": "company", "location": "region", "posted_text": "pubDate", "description": "description"} | dict(tags or {})
    hidden = rf"(?s)<{named['description']}(?:\s[^>]*)?>.*?</{named['description']}>"
    texts = F.regexp_extract_all("payload", F.lit(hidden), 0)
    safe = F.regexp_replace("payload", hidden, "\u0001")
    split = raw.select("source", texts.alias("texts"), F.regexp_extract_all(safe, F.lit(rf"(?s)(.*?<{row_tag}(?:\s[^>]*)?>.*?</{row_tag}>)"), 1).alias("rows"))
    # marks of a chunk up to and with its row; those before the row belong to the feed itself
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\u0001"), F.lit("")))
    start = F.aggregate(F.slice("rows", F.lit(1), F.col("i")), F.lit(0), lambda n, x: n + marks(x))
    row = F.regexp_extract("chunk", rf"(?s)<{row_tag}(?:\s[^>]*)?>(.*)</{row_tag}>$", 1)
    each = split.select("source", "texts", "rows", F.posexplode_outer("rows").alias("i", "chunk")).where("chunk IS NOT NULL")
    own = F.when(marks(row) > 0, F.get("texts", (start + marks(F.col("chunk")) - marks(row)).cast("int"))).otherwise("")
    items = each.select("source", row.alias("item"), own.alias("said"))
    x = F.col("item")
    title, company = _tag(x, named["title"]), F.coalesce(_tag(x, named["company"]), F.nullif(F.regexp_extract(_tag(x, named["title"]), r"^([^:]+):\s*\S", 1), F.lit("")))
    role = F.when(_tag(x, named["company"]).isNull(), F.regexp_replace(title, r"^[^:]+:\s*(?=\S)", "")).otherwise(title)
    fields = {"title": role, "url": _tag(x, named["url"]), "company": company, "location": _tag(x, named["location"]), "posted_text": _tag(x, named["posted_text"]), "description": html_to_text(_tag(F.col("said"), named["description"]))}
    return _posting(items.select("source", *[c.alias(f) for f, c in fields.items()]))


def normalize_html_pages(pages: DataFrame, page_url: str = "url", html: str = "html", cards: Sequence[str] = (r"(?s)<li[^>]*>(.*?)</li>", r"(?s)<article[^>]*>(.*?)</article>")) -> DataFrame:
    """(page url, title, url) of the first link of every card of a listing page; of several markups the first that
    gives any card counts. Relative links are resolved, links to other hosts and links without text go."""
    found = F.array().cast("array<string>")
    for pattern in reversed(cards):
        hit = F.regexp_extract_all(html, F.lit(pattern), 1)
        found = F.when(F.size(hit) > 0, hit).otherwise(found)
    card = pages.select(F.col(page_url).alias("page"), F.explode_outer(found).alias("card")).where("card IS NOT NULL")
    href, root = F.regexp_extract("card", r"""<a[^>]*\shref="([^"]*)\"""", 1), F.concat(url_part(F.col("page"), "PROTOCOL"), F.lit("://"), url_part(F.col("page"), "AUTHORITY"))
    url = F.when(href.startswith("/"), F.concat(root, href)).otherwise(href)
    title = html_to_text(F.regexp_extract("card", r"(?s)<a[^>]*>(.*?)</a>", 1))
    rows = card.select("page", title.alias("title"), url.alias("url"), F.lower(url_part(F.col("page"), "HOST")).alias("_h"))
    return _posting(rows).where(F.lower(url_part(F.col("url"), "HOST")) == F.col("_h")).drop("_h")


def normalize_thread_posts(df: DataFrame, text: str = "text", thread_url: str = "url") -> DataFrame:
    """Postings of comments whose first line is "Company | Role | Location ..."; the first link, else the thread's."""
    bare = F.regexp_replace(F.regexp_replace(F.col(text), r'<a[^>]*href="([^"]*)"[^>]*>[^<]*</a>', " $1 "), r"<p>|<br ?/?>", "\n")
    first = F.split(F.regexp_replace(F.get(F.split(bare, "\n"), F.lit(0)), "<[^>]*>", ""), r"\s*\|\s*")
    link = F.nullif(F.regexp_extract(bare, r"(https?://[^\s<>\"|]+)", 1), F.lit(""))
    rows = df.withColumns({"_f": first, "_l": link}).where(F.size("_f") >= 2)
    part = lambda i: F.nullif(F.trim(F.get("_f", F.lit(i))), F.lit(""))
    return _posting(rows.withColumns({"company": part(0), "title": part(1), "location": part(2), "url": F.coalesce("_l", F.col(thread_url))}).drop("_f", "_l"))


def normalize_search_results(df: DataFrame, line: str = "line") -> DataFrame:
    """Company, title and location of "X is hiring Y in Z" and "X Y (Z) 채용 중"; other lines are invalid (null)."""
    en, ko = r"^(.+?) (?:is )?hiring (.+?) in (.+?)\s*$", r"^(\S+)\s+(.+?)\s*\((.+?)\)\s*채용 중\s*$"
    get = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, en, i), F.lit("")), F.nullif(F.regexp_extract(line, ko, i), F.lit("")))
    return df.withColumns({"company": get(1), "title": get(2), "location": get(3)})


def embedded_json(html: Column, element_id: str, path: str) -> Column:
    """A value of the JSON of a page's script element; null where there is none."""
    raw = F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1), F.lit(""))
    return F.try_variant_get(F.try_parse_json(raw), path, "string")
