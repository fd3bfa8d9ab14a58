"""Column expressions for keys, urls, dates, pay and text, all in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that never tell two postings apart.
STRIP_PARAMS = (
    "language", "lang", "locale", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "src", "source", "gh_src", "lever-origin", "lever-source", "rltr",
)
# Hours and periods of pay in a year.
PAY_PERIODS = {"HOUR": 2080.0, "DAY": 260.0, "WEEK": 52.0, "2 WEEK": 26.0, "0.5 MONTH": 24.0, "MONTH": 12.0, "YEAR": 1.0}
CURRENCIES = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₩": "KRW"}


# Trailing tags of a title that name a place or a way of working, not another role.
PLACE_TAGS = (
    "amer", "americas", "amsterdam", "apac", "austin", "barcelona", "bay area", "belgium", "berlin", "boston", "brussels", "budapest", "canada", "chicago",
    "copenhagen", "dublin", "emea", "eu", "europe", "finland", "france", "frankfurt", "germany", "hamburg", "helsinki", "india", "ireland", "italy", "la",
    "latin america", "lisbon", "london", "los angeles", "madrid", "melbourne", "milan", "montreal", "munich", "netherlands", "new york", "north america", "nyc",
    "on site", "onsite", "oslo", "paris", "poland", "porto", "prague", "remote", "rome", "san francisco", "seattle", "sf", "singapore", "spain", "stockholm",
    "sydney", "tokyo", "toronto", "uk", "united kingdom", "united states", "us", "usa", "vancouver", "vienna", "warsaw", "zurich",
)
WORK_TAGS = ("distributed", "hybrid", "on site", "onsite", "remote", "wfh", "work from home")
# Legal forms at the end of an English name, and at either end of a Korean one.
LEGAL_FORMS = ("co ltd", "corporation", "corp", "incorporated", "inc", "limited", "ltd", "llc", "plc")
KOREAN_FORMS = ("(주)", "주식회사", "유한회사")


def nfkc(text: Column) -> Column:
    """V4: Unicode compatibility normal form, by the ICU library that Spark ships for its collations. It stays in the JVM,
    and only texts outside ASCII are normalised. Spark takes a reflected call as not deterministic: keys made of it can be
    projected, grouped and windowed, but must be a column before they stand in a join condition."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: Spark does not share what a call that it takes as not deterministic gives."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Latin letters with marks and the letter alone, by Unicode's own decomposition.
_MARKED = {chr(c): base[0] for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFD", chr(c)))[0].isascii() and len(base) > 1}


def without_marks(text: Column) -> Column:
    """Latin letters lose their accents, composed or not; curly quotes become straight ones."""
    plain = F.translate(text, "".join(_MARKED) + "‘’ʼ′´`“”″", "".join(_MARKED.values()) + "'" * 6 + '"' * 3)
    return F.regexp_replace(plain, "[\u0300-\u036f]", "")


def text_key(text: Column, sep: str = "") -> Column:
    """NFKC in lower case; every run of other signs than letters, marks and digits becomes sep, none at the ends."""
    joined = F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{M}\p{N}]+", sep or "")
    return F.trim(joined) if sep in ("", " ") else F.regexp_replace(joined, f"^{sep}|{sep}$", "")


def _plain_key(text: Column) -> Column:
    """text_key of what is in NFKC and lower case already."""
    return F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", "")


def company_key(name: Column) -> Column:
    """text_key without legal forms at the end, however many; a Korean form may also come first.

    A form counts as a word of its own: what comes before it is a sign or the beginning of the name, and dots, commas and
    blanks inside it don't matter ("Co., Ltd." is "co ltd").
    """
    korean = "|".join(r"\s*".join("\\" + c if c in "()" else c for c in f) if "(" in f else f for f in KOREAN_FORMS)
    forms = "|".join(r"\.?\s*,?\s*".join(f.split(" ")) + r"\.?" for f in LEGAL_FORMS)

    def without_korean(low: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(low, rf"^(?:{korean})\s*", ""), rf"\s*(?:{korean})$", "")
        return F.when(any_of([low.contains(f.strip("()")) for f in KOREAN_FORMS]), bare).otherwise(low)

    def without_forms(bare: Column) -> Column:
        # most names have no form, and no need of the pattern
        ends = let(F.rtrim(bare, F.lit(" .\t")), lambda end: any_of([end.endswith(f.split(" ")[-1]) for f in LEGAL_FORMS]))
        return _plain_key(F.when(ends, F.regexp_replace(bare, rf"(?:(?:^|[\s,._-]+)(?:{forms})\s*)+$", "")).otherwise(bare))

    return let(F.trim(F.lower(nfkc(F.coalesce(name, F.lit(""))))), lambda low: let(without_korean(low), without_forms))


def _is_place_tag(tag: Column) -> Column:
    """A tag that names a place, several places, or a way of working with a place; tag is in lower case."""
    flat = lambda t: F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    parts = F.filter(F.transform(F.split(tag, r"[,/|;]+|\s+(?:and|or)\s+"), flat), lambda t: t != "")
    led = [flat(tag).startswith(f"{w} ") & F.substr(flat(tag), F.lit(len(w) + 2)).isin(*PLACE_TAGS) for w in WORK_TAGS]
    return flat(tag).isin(*PLACE_TAGS) | ((F.size(parts) > 1) & F.forall(parts, lambda t: t.isin(*PLACE_TAGS))) | any_of(led)


def role_key(title: Column) -> Column:
    """text_key without trailing bracket tags that name a place or a way of working, such as "(Remote)" or "[Berlin]".

    Other tags stay, so that "Engineer (Backend)" and "Engineer (Frontend)" are two roles.
    """

    def untagged(low: Column) -> Column:
        # the tags at the end, last first; those before the first that is no place stay
        tail = F.regexp_extract(low, r"((?:\s*[(\[][^()\[\]]+[)\]])+)$", 1)
        tags = F.regexp_extract_all(tail, F.lit(r"[(\[]([^()\[\]]+)[)\]]"), 1)
        kept = F.aggregate(F.reverse(tags), F.array().cast("array<string>"), lambda acc, t: F.when((F.size(acc) > 0) | ~_is_place_tag(t), F.array_append(acc, t)).otherwise(acc))
        head = F.substr(low, F.lit(1), F.length(low) - F.length(tail))
        return F.concat(head, F.lit(" "), F.array_join(F.reverse(kept), " "))

    return let(F.trim(F.lower(nfkc(F.coalesce(title, F.lit(""))))), lambda low: _plain_key(F.when(low.rlike(r"[)\]]$"), untagged(low)).otherwise(low)))


def has_keyword(low: Column, keyword: str) -> Column:
    """Keyword of a title rule in lower-case text: two or three letters match as a word, others anywhere."""
    word = keyword.strip().lower()
    if 2 <= len(word) <= 3 and word.isascii() and word.isalpha():
        return low.rlike(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")
    return low.contains(word)


def keywords(given: Sequence | None) -> list[str]:
    """The usable keywords of a rule: strings that are not blank."""
    return [k.strip().lower() for k in given or () if isinstance(k, str) and k.strip()]


def any_of(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def place_keyword(low: Column, keyword: str) -> Column:
    """Keyword of a location rule: no letter or digit right before or after it, where it begins or ends with one."""
    word = keyword.strip().lower()
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)
    before = "(?<![a-z0-9])" if word[0].isascii() and word[0].isalnum() else ""
    after = "(?![a-z0-9])" if word[-1].isascii() and word[-1].isalnum() else ""
    return low.rlike(before + quoted + after)


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host_of(url: Column) -> Column:
    return F.lower(url_part(url, "HOST"))


def dedup_url(url: Column, strip: Sequence[str] = STRIP_PARAMS, sort: bool = False, strip_utm: bool = False) -> Column:
    """Url for comparisons: tracking parameters, fragment and trailing slashes go; scheme, host and path in lower case.

    Values of the other parameters keep their case. What has no scheme and host stays as it is. Parts are cut by plain
    string functions; patterns only see what comes before the path, and queries that there are.
    """
    bare = F.substring_index(url, "#", 1)
    front = F.substring_index(bare, "?", 1)
    low = F.rtrim(F.lower(front), F.lit("/"))
    pathless = F.locate("/", F.substring_index(low, "://", -1)) == 0
    query = F.substr(bare, F.length(front) + 2)
    names = "|".join(n.replace(".", "\\.") for n in strip) + ("|utm_[^=&]*" if strip_utm else "")
    left = F.regexp_replace(query, rf"(?i)(?<![^&])(?:{names})(?:=[^&]*)?(?:&|$)", "")
    left = F.trim(F.regexp_replace(left, "&&+", "&"), F.lit("&"))
    left = F.array_join(F.array_sort(F.split(left, "&")), "&") if sort else left
    asked = F.when(query == "", "").otherwise(F.when(left == "", "").otherwise(F.concat(F.lit("?"), left)))
    built = F.concat(low, F.when(pathless, "/").otherwise(""), asked)
    return F.when(front.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]"), built).otherwise(url)


def cooldown_url(url: Column) -> Column:
    """dedup_url that also drops every utm_ parameter and default ports, and sorts the rest."""
    return F.regexp_replace(dedup_url(url, sort=True, strip_utm=True), r"^(http://[^/:]+):80(?=/)|^(https://[^/:]+):443(?=/)", "$1$2")


def job_id_in(url: Column) -> Column:
    """The last UUID or run of five or more digits in a url; null without one."""
    found = F.regexp_extract_all(url, F.lit(r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]{5,})"), 1)
    return F.try_element_at(found, F.lit(-1))


def location_hint(url: Column) -> Column:
    """The path segment after the last /job/, decoded, with -, _ and + as spaces; empty without one."""
    parts = F.filter(F.split(F.coalesce(url_part(url, "PATH"), F.lit("")), "/"), lambda p: p != "")
    place = F.size(parts) - F.array_position(F.reverse(parts), "job") + 1
    after = F.when((F.array_position(parts, "job") > 0) & (place < F.size(parts)), F.get(parts, place.cast("int")))
    decoded = F.coalesce(F.try_url_decode(F.replace(after, F.lit("+"), F.lit(" "))), after)
    return F.coalesce(F.lower(F.trim(F.regexp_replace(F.regexp_replace(decoded, "[-_+]+", " "), r"\s+", " "))), F.lit(""))


# Blanks besides those of \s; a title that says remote, and one that denies it.
OTHER_BLANKS = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
REMOTE_SAID = rf"(?<![a-z])remote(?=$|[\s{OTHER_BLANKS}]*[^a-z\s{OTHER_BLANKS}]|[\s{OTHER_BLANKS}]+in(?![a-z0-9_]))"
REMOTE_DENIED = r"(?<![a-z0-9_])(?:non|not|no)[^a-z]*remote"


def signals_remote(title: Column) -> Column:
    """"remote" not inside a word, at the end, before a sign or before "in", and denied nowhere in the title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return low.contains("remote") & low.rlike(REMOTE_SAID) & ~low.rlike(REMOTE_DENIED)


def stable_id(prefix: str, value: Column, digits: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, digits))


def relative_date(text: Column, today: Column) -> Column:
    """Date of "3 days ago", "posted yesterday", "2주 전" and the like; null where the text says "30+" or nothing known."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"(\d+)", 1).cast("int")
    unit = F.regexp_extract(low, r"\d+\s*(hour|day|week|month|시간|일|주|개월)", 1)
    days = F.when(unit.isin("hour", "시간"), 0).when(unit.isin("day", "일"), number).when(unit.isin("week", "주"), number * 7).when(unit.isin("month", "개월"), number * 30)
    return (
        F.when(low.contains("+"), None)
        .when(low.rlike("today|just posted|오늘"), today)
        .when(low.rlike("yesterday|어제"), F.date_sub(today, 1))
        .when(low.rlike("ago|전"), F.date_sub(today, days))
    )


def parse_date(raw: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX")) -> Column:
    """First format that reads raw; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats])


def annual_pay(amount: Column, interval: Column) -> Column:
    """Amount in a year; an unknown interval counts as a year."""
    factor = F.lit(1.0)
    for name, times in PAY_PERIODS.items():
        factor = F.when(F.upper(F.trim(interval)) == name, times).otherwise(factor)
    return amount * factor


def currency_code(text: Column) -> Column:
    """ISO code of a symbol; other texts in upper case; blank is null."""
    code = F.upper(F.trim(text))
    for sign, iso in CURRENCIES.items():
        code = F.when(F.trim(text) == sign, iso).otherwise(code)
    return F.nullif(code, F.lit(""))


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, common entities are read, urls go, white space is one blank."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"https?://\S+", " "), r"\s+", " "))


def redact(text: Column, mail: str = "[email]", phone: str | None = "[phone]", whole_words: bool = False) -> Column:
    """Addresses and Korean mobile numbers become [email] and [phone]; a run of digits that goes on is no number.

    Without phone numbers stay. whole_words: nor is one a number that a letter or _ touches.
    """
    bare = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", mail)
    if phone is None:
        return bare
    beside = "[0-9A-Za-z_]" if whole_words else "[0-9]"
    return F.regexp_replace(bare, rf"(?<!{beside})01[016789][- .]?[0-9]{{3,4}}[- .]?[0-9]{{4}}(?!{beside})", phone)


def evidence(text: Column, pattern: str, whole_words: bool = False) -> Column:
    """What a text says round the first match of pattern (in any case, "." for line ends too), redacted: from the line
    or sentence in which it begins to the end of the line in which it ends, or 120 signs further in the last line; 800
    signs at most. Without a match the first 500 signs, as they are; null for null. whole_words: as in redact."""
    found = rf"(?is)^(.*?)({pattern})"
    before, met = F.regexp_extract(text, found, 1), F.regexp_extract(text, found, 2)
    back = F.reverse(before)
    line, sentence = F.instr(back, "\n"), F.instr(back, " .")
    start = F.greatest(F.when(line > 0, F.length(before) - line + 1).otherwise(0), F.when(sentence > 0, F.length(before) - sentence).otherwise(0)) + 1
    end = F.length(before) + F.length(met)
    rest = F.substr(text, end + 1)
    stop = end + F.when(F.instr(rest, "\n") > 0, F.instr(rest, "\n") - 1).otherwise(F.least(F.length(rest), F.lit(120)))
    window = F.regexp_replace(F.substr(text, start, stop - start + 1), r"(?U)^\s+|\s+$", "")
    return F.when(F.rlike(text, F.lit(f"(?is){pattern}")), redact(F.substr(window, F.lit(1), F.lit(800)), whole_words=whole_words)).otherwise(F.substr(text, F.lit(1), F.lit(500)))
