"""Keys of companies, roles and urls, and other text rules, on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from brightloom.functions import text as X


def values(spark, expression, given):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("k")).orderBy("i").select("k").collect()]


def test_company_key(spark):
    names = ["Acme Inc.", "ＡＣＭＥ Inc", "acme, Co., Ltd.", "Acme Corp Ltd", "(주) 에이콤", "㈜에이콤", "에이콤 주식회사", "Inc", "Cafe\u0301 LLC", "Café", "Princo", None, ""]
    assert values(spark, X.company_key, names) == ["acme", "acme", "acme", "acme", "에이콤", "에이콤", "에이콤", "", "café", "café", "princo", "", ""]


def test_role_key(spark):
    titles = [
        "Engineer (Backend)", "Engineer (Frontend)", "Engineer (Remote)", "Engineer （Remote）", "Engineer [Berlin] (EMEA)", "Engineer (Berlin / Paris)", "Engineer (Remote US)", "Engineer (Backend) (Remote)",
        "Engineer (Remote) (Backend)", "エンジニア（東京）", "エンジニア（大阪）", "(Remote)", "Engineer – Data", None,
    ]
    want = ["engineerbackend", "engineerfrontend", *["engineer"] * 5, "engineerbackend", "engineerremotebackend", "エンジニア東京", "エンジニア大阪", "", "engineerdata", ""]
    assert values(spark, X.role_key, titles) == want


def test_dedup_url(spark):
    urls = [
        "HTTPS://Jobs.Example.com/A/B//?utm_source=x&id=Q1#top", "https://jobs.example.com/a/b?id=Q1", "https://x.org", "https://x.org/", "https://x.org?lang=de", "nothing", None, "https://x.org/a b?q=1&&REF=2", "https://x.org/a#b?c=1",
    ]
    want = ["https://jobs.example.com/a/b?id=Q1", "https://jobs.example.com/a/b?id=Q1", *["https://x.org/"] * 3, "nothing", None, "https://x.org/a b?q=1", "https://x.org/a"]
    assert values(spark, X.dedup_url, urls) == want
    assert values(spark, X.cooldown_url, ["http://a.b:80/c?z=1&a=2&utm_x=3", "https://a.b:443/"]) == ["http://a.b/c?a=2&z=1", "https://a.b/"]


@pytest.mark.parametrize(
    "title, want",
    [("Engineer, Remote", True), ("Remote - Engineer", True), ("Engineer remote in Spain", True), ("Remote Sensing Lead", False), ("Non-remote role", False), ("not remote", False), ("Engineer (Remote)", True), ("premote", False), (None, False)],
)
def test_signals_remote(spark, title, want):
    assert values(spark, X.signals_remote, [title]) == [want]


def test_redact(spark):
    assert values(spark, X.redact, ["call 010-1234-5678 or a.b@c.de", "9990101234567899", None]) == ["call [phone] or [email]", "9990101234567899", None]
