"""Liveness of postings from what their portals answer, by rules that are data.

A portal is registered with the form of its answers and its rules in order; a portal more needs no change of code. Rules
are compiled into one projection, so judging shuffles nothing and patterns are literals of the plan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (what is read, test, value). Read are: "body"; "~pattern", the first group of a pattern in the body; a JSON path of the
#: document, or several with "|" between, of which the first with a value counts. Tests are those of _holds.
Condition = tuple[str, str, str]
#: (result, code, conditions that must all hold)
Rule = tuple[str, str | None, Sequence[Condition]]
#: name -> (document, rules). Documents: "body"; "next", the JSON in a page's __NEXT_DATA__ script; "object", the object in
#: that JSON which has the posting's id, the nearest to the root.
PORTALS: dict[str, tuple[str, Sequence[Rule]]] = {}
DOCUMENTS = ("body", "next", "object")
RESULTS = ("active", "expired", "unknown")
TESTS = ("in", "not_in", "like", "unlike", "is_id", "before_today", "from_today", "lists_id")


def register_portal(name: str, document: str, rules: Sequence[Rule]) -> None:
    """A portal by the form of its answers and its rules, of which the first that holds decides."""
    tests = {t for _, _, conditions in rules for _, t, _ in conditions}
    if document not in DOCUMENTS or not {r for r, _, _ in rules} <= set(RESULTS) or not tests <= set(TESTS):
        raise ValueError(f"documents are {DOCUMENTS}, results {RESULTS}, tests {TESTS}")
    PORTALS[name] = (document, tuple(rules))


# What portals say of a posting.
OPEN_STATES = "active|open|published|recruiting"
CLOSED_STATES = "close|closed|expired|ended"
_APPLY = r"""quickApplyForm\s*\(\s*(?:["']|&#0*39;|&apos;|&quot;)?\s*"""
_CLOSED_CONTROL = r"""(?:title=["']\s*(?:접수마감|지원마감)\s*["']|>\s*(?:접수마감|지원마감)\s*<|[\s<]disabled[\s=>]|\baria-disabled=["']true["'])"""
_OPEN_CONTROL = r"""(?:title=["'][^"']*입사지원할\s*수\s*있는\s*창[^"']*["']|>.{0,200}?(?:입사지원|홈페이지\s*지원).{0,50}?<)"""
_CLOSED_NOTICE = r"본\s*채용정보는\s*마감되었습니다|마감된\s*채용정보(?:입니다)?|지원\s*기간이\s*종료|채용이\s*마감"
_DEADLINE = r"~마감일\s*[:：]\s*(상시채용|\d{4}[.]\d{1,2}[.]\d{1,2})"
#: Up to 800 signs of a button or link, and a button or link that applies for the posting itself.
_INSIDE = r"(?:(?!</(?:button|a)>).){0,800}?"
_OWN_CONTROL = rf"(?is)<(?:button|a)\b(?={_INSIDE}{_APPLY}{{id}}(?!\d)){_INSIDE}"

register_portal(
    "saramin",
    "body",
    [
        ("unknown", None, [("body", "like", rf"(?i){_APPLY}\d"), ("body", "unlike", rf"(?i){_APPLY}{{id}}(?!\d)")]),
        ("expired", "saramin_posting_closed", [("body", "like", _OWN_CONTROL + _CLOSED_CONTROL)]),
        ("expired", "saramin_posting_closed", [("body", "like", _CLOSED_NOTICE)]),
        ("active", "saramin_apply_open", [("body", "like", _OWN_CONTROL + _OPEN_CONTROL)]),
    ],
)
register_portal(
    "wanted",
    "body",
    [
        ("unknown", None, [("$.job.position|$.position", "unlike", r"\S")]),
        ("expired", "wanted_structured_hidden", [("$.job.id|$.id", "is_id", ""), ("$.job.hidden|$.hidden", "in", "true")]),
        ("expired", "wanted_structured_closed", [("$.job.id|$.id", "is_id", ""), ("$.job.status|$.status", "in", "close|closed|expired")]),
        ("active", "wanted_structured_active", [("$.job.id|$.id", "is_id", ""), ("$.job.status|$.status", "in", "active|open|recruiting")]),
    ],
)
register_portal(
    "remember",
    "object",
    [
        ("unknown", None, [("$.title", "unlike", r"\S")]),
        ("active", "remember_structured_active", [("$.status", "in", OPEN_STATES)]),
        ("expired", "remember_structured_closed", [("$.status", "in", CLOSED_STATES)]),
    ],
)
register_portal(
    "jobkorea",
    "body",
    [
        ("expired", "jobkorea_explicitly_closed", [("body", "like", "마감되었습니다")]),
        ("active", "jobkorea_ongoing", [(_DEADLINE, "in", "상시채용")]),
        ("expired", "jobkorea_deadline_passed", [(_DEADLINE, "before_today", "")]),
        ("active", "jobkorea_future_deadline", [(_DEADLINE, "from_today", ""), ("body", "like", "남은기간")]),
    ],
)
register_portal("ashby", "body", [("active", "ashby_api_ok", [("$.jobs", "lists_id", "")]), ("expired", "ashby_api_unlisted", [("$.jobs", "like", r"^\s*\[")])])
register_portal("greenhouse", "body", [("active", "greenhouse_api_ok", [])])
register_portal("lever", "body", [("active", "lever_api_ok", [])])
register_portal("workday", "body", [("active", "workday_api_ok", [])])


def _nearest(root: object, wanted: str) -> str | None:
    """The object of that id nearest to the root, the first in its order, as JSON."""
    level = [root]
    while level:
        for value in level:
            if isinstance(value, dict) and str(value.get("id")) == wanted:
                return json.dumps(value, ensure_ascii=False)
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return None


def object_by_id(document: Column, wanted: Column) -> Column:
    """The object with that id in a JSON text of any depth, as JSON; null where there is none or the text is no JSON."""

    @F.pandas_udf("string")
    def find(texts: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for text, key in zip(texts, ids):
            try:
                out.append(None if text is None or key is None else _nearest(json.loads(text), key))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return find(document, wanted)


def _value(what: str) -> Column:
    if what == "body":
        return F.col("_body")
    if what.startswith("~"):
        return F.nullif(F.regexp_extract("_body", what[1:], 1), F.lit(""))
    return F.coalesce(*[F.get_json_object("_doc", path) for path in what.split("|")])


def _day(value: Column) -> Column:
    """year * 10,000 + month * 100 + day of a date such as 2024.3.15; null where it is none."""
    part = lambda i: F.regexp_extract(value, r"^(\d{4})[.-](\d{1,2})[.-](\d{1,2})$", i).try_cast("int")
    return part(1) * 10_000 + part(2) * 100 + part(3)


def _holds(condition: Condition, today: Column) -> Column:
    """Whether a condition holds; a value that is not there is in no list, is no id and like nothing."""
    what, test, wanted = condition
    value, own = _value(what), F.col("_id")
    pattern = F.replace(F.lit(wanted), F.lit("{id}"), F.concat(F.lit("\\Q"), own, F.lit("\\E"))) if "{id}" in wanted else F.lit(wanted)
    now = F.year(today) * 10_000 + F.month(today) * 100 + F.dayofmonth(today)
    listed = F.exists(F.from_json(value, "array<struct<id string, isListed boolean>>"), lambda x: (F.lower(x["id"]) == F.lower(own)) & F.coalesce(x["isListed"], F.lit(True)))
    found = {
        "in": lambda: F.lower(F.trim(value)).isin(wanted.split("|")),
        "not_in": lambda: F.lower(F.trim(value)).isin(wanted.split("|")),
        "like": lambda: F.rlike(value, pattern),
        "unlike": lambda: F.rlike(value, pattern),
        "is_id": lambda: value == own,
        "before_today": lambda: _day(value) < now,
        "from_today": lambda: _day(value) >= now,
        "lists_id": lambda: listed,
    }[test]()
    met = F.coalesce(found, F.lit(False))
    return ~met if test in ("unlike", "not_in") else met


def portal_liveness(answers: DataFrame, today: Column) -> DataFrame:
    """Answers (portal, posting_id string, status of the request, body) with result and code.

    A posting that is gone (404, 410) is expired; of other answers only a full one (200) tells anything, by the rules of
    its portal. No rule, no answer, a portal that is not registered or an id with other signs than letters, digits, dot,
    line and underscore give unknown, with a null code. today is the date at the portals (their time zone is the
    caller's). Columns result and code are replaced.
    """
    safe = F.col("posting_id").rlike(r"^[A-Za-z0-9._-]+$") & ~F.col("posting_id").contains("..")
    shown = answers.withColumns({"_id": F.when(safe, F.col("posting_id").cast("string")), "_body": F.when(F.col("status") == 200, F.coalesce("body", F.lit("")))})
    script = F.nullif(F.regexp_extract("_body", r"""(?is)<script\b[^>]*\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1), F.lit(""))
    of = lambda form: F.col("portal").isin([n for n, (d, _) in PORTALS.items() if d == form])
    document = F.when(of("body"), F.col("_body")).when(of("next"), script)
    if any(d == "object" for d, _ in PORTALS.values()):
        document = F.coalesce(document, object_by_id(F.when(of("object"), script), F.col("_id")))
    shown = shown.withColumn("_doc", document)
    verdict = F.struct(F.lit("unknown").alias("result"), F.lit(None).cast("string").alias("code"))
    found = verdict
    for name, (_, rules) in PORTALS.items():
        own = verdict
        for result, code, conditions in reversed(rules):
            met = F.lit(True)
            for condition in conditions:
                met = met & _holds(condition, today)
            own = F.when(met, F.struct(F.lit(result).alias("result"), F.lit(code).cast("string").alias("code"))).otherwise(own)
        gone = F.struct(F.lit("expired").alias("result"), F.lit(f"{name}_api_gone").alias("code"))
        judged = F.when(F.col("_id").isNull(), verdict).when(F.col("status").isin(404, 410), gone).when(F.col("status") == 200, own).otherwise(verdict)
        found = F.when(F.col("portal") == name, judged).otherwise(found)
    kept = [F.col(c) for c in answers.columns if c.lower() not in ("result", "code")]
    return shown.withColumn("_v", found).select(*kept, "_v.result", "_v.code")
