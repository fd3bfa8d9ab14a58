"""The rules of role titles, and the additions that they keep apart."""

import re
import unicodedata
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from brightloom.functions import text
from brightloom.operators import composite, identity
from brightloom.plans import catalog
from brightloom.plans.views import titles

PAIRS = [
    ("Senior Data Platform Engineer", "Principal Data Platform Engineer", False),
    ("Senior Data Platform Engineer", "Senior Staff Data Platform Engineer", True),
    ("Data Platform Engineer", "Senior Data Platform Engineer", True),
    ("Associate Data Platform Engineer", "Data Platform Engineer", False),
    ("Middle Data Platform Engineer", "Data Platform Engineer", True),
    ("Senior Analytics Engineer", "Senior Analytics Engineer, People", False),
    ("Data Platform Lead", "Data Platform Engineer Lead", True),
    (" Lead of IT ", "lead of it", True),
    ("CEO", "ceo", True),
    ("Member of Technical Staff, Connector", "Member of technical  staff - Connector", True),
    ("Member of Technical Staff, Connector Platform", "Member of Technical Staff, Backend Platform", False),
    ("Frontend/Mobile Engineer Growth", "Mobile Frontend Engineer, Growth", True),
    ("Engineer, Infrastructure Tooling (CI/CD)", "Engineer, Infrastructure Tooling", False),
    ("Engineer, Infrastructure A1/B2", "Infrastructure Engineer a1/b2", True),
    ("ML Platform Engineer", "Platform ML Engineer", False),
    ("", "", False),
    (None, None, False),
]


def test_rules_of_roles(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, want boolean")
    for x, y in (("a", "b"), ("b", "a")):
        got = df.select("a", "b", "want", identity.roles_match(identity.role_of(F.col(x)), identity.role_of(F.col(y))).alias("got")).collect()
        assert [tuple(r) for r in got if r["want"] != r["got"]] == []
    rows = [(i, "Acme", t) for i, t in enumerate(["Senior Data Platform Engineer", "Principal Data Platform Engineer", "CEO", "ceo"])]
    df = spark.createDataFrame(rows, "id int, company string, title string")
    assert sorted(tuple(r) for r in identity.fuzzy_role_pairs(df, df).collect()) == [(0, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)]


def test_titles_that_say_remote(spark):
    want = {
        "Remote 100%": True, "Engineer - 2remote": True, "Engineer_remote": True, "PM (Remote)": True, "Remote in MO": True, "Remote": True, "Remote\u00a0in MO": True,
        "Remote Sensing PM": False, "Remote\u00a0Sensing PM": False, "Premote": False, "Remote inside": False, "Non-Remote": False, "Non\u2013Remote": False, "Not 100% remote": False,
        "Nonprofit PM - Remote": True, "No remote": False, "Nordic PM, remote": True, "": False, None: False,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r[0]: r[1] for r in df.select("t", text.signals_remote(F.col("t"))).collect()}
    assert {t: bool(v) for t, v in got.items()} == want


def test_normal_forms_stay_in_the_jvm(spark):
    chars = [chr(c) for c in range(0x3400) if c] + [chr(c) for c in range(0xA000, 0x20000) if not 0xD800 <= c < 0xE000]
    chars += ["e\u0301", "\u1112\u1161\u11ab", "a\u0327\u0301", "a\u0301\u0327", "\uff76\uff9e", "ﬁﬃ①", "ascii", ""]
    # signs that the interpreter's Unicode version does not know yet
    known = [c for c in chars if len(c) != 1 or unicodedata.category(c) != "Cn"]
    df = spark.createDataFrame([(c,) for c in known], "t string")
    got = df.select("t", text.nfkc(F.col("t")).alias("n"))
    assert [r for r in got.collect() if r.n != unicodedata.normalize("NFKC", r.t)] == []
    keyed = df.select(text.company_key(F.col("t")).alias("k"), text.role_key(F.col("t")), text.text_key(F.col("t")))
    assert "Python" not in keyed._jdf.queryExecution().executedPlan().toString()


def test_addition_of_another_level_is_inserted(spark):
    tracker = spark.createDataFrame([(1, "Acme", "Senior Data Platform Engineer", None), (2, "Acme", "Senior Analytics Engineer", None)], "num int, company string, role string, report string")
    new = [(1, 8, "Acme", "Principal Data Platform Engineer", None), (2, 9, "Acme", "Senior Analytics Engineer, People", None), (3, 10, "Acme", "Data Platform Engineer", None)]
    got = composite.merge_additions(tracker, spark.createDataFrame(new, "pos int, num int, company string, role string, report string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "insert", None), (2, "insert", None), (3, "update", 1)]


def test_classes_of_a_whole_table_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    names = defaultdict(set)
    for r in titles(spark, d).collect():
        names[re.sub("[^a-z0-9]+", "", r["company"].lower())].add(r["title"])
    words = {t: {w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 3} for ts in names.values() for t in ts}
    assert not any(w & {*identity.SENIORITIES, *identity.BASELINE, *identity.STOPWORDS} for w in words.values())

    def alike(a, b):
        x, y = words[a], words[b]
        return len(x & y) >= 2 and not (x < y or y < x) and len(x & y) / len(x | y) >= 0.6

    want = {(k, a, b) for k, ts in names.items() for a, b in combinations(sorted(ts), 2) if alike(a, b)}
    got = [(re.sub("[^a-z0-9]+", "", r["k"]), r["at"], r["bt"]) for r in catalog.queries()["j10_fuzzy_role_classes"](spark, d).collect()]
    assert len(got) == len(set(got)) > 0 and set(got) == want
