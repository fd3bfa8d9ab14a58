"""Readers and feeds on hand-written files."""

import json

from pyspark.sql import functions as F

from brightloom.sources import feeds, readers


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_scan_history(spark, tmp_path):
    path = write(tmp_path, "me/h.tsv", "url\tfirst_seen\tportal\ttitle\tcompany\tstatus\tlocation\nhttps://a/1\t2024-01-02\tp\tt\tc\t\tx\nhttps://a/2\tbad\tp\tt\tc\tskipped\tx\tff\t2024-02-03\t70\ta,b\tkey\n\t2024-01-01\tp\n")
    rows = {r["url"]: r for r in readers.read_scan_history(spark, path).collect()}
    assert set(rows) == {"https://a/1", "https://a/2"}
    assert rows["https://a/1"]["status"] == "added" and str(rows["https://a/1"]["first_seen"]) == "2024-01-02" and rows["https://a/1"]["owner_id"] == "me"
    assert rows["https://a/2"]["first_seen"] is None and rows["https://a/2"]["trust_score"] == 70 and rows["https://a/2"]["trust_flags"] == ["a", "b"]


def test_history_metadata(spark, tmp_path):
    path = write(tmp_path, "h.tsv", "Link\tDate\tPosted\nhttps://a\t2024-01-01\t\n\t2024-01-02\tx\n")
    assert [tuple(r)[1:] for r in readers.read_history_metadata(spark, path).collect()] == [("https://a", "2024-01-01", None)]


def test_tracker_by_header_names_and_fixed_layout(spark, tmp_path):
    write(tmp_path, "a/x.md", "# Title\n| # | Fecha | Empresa | Rol | Location | Puntuación | Estado | PDF | Informe | Notas |\n|---|---|---|---|---|---|---|---|---|---|\n| 1 | 2024-01-02 | Acme | Dev | Berlin | 4.5/5 | Aplicado | x | [001](r.md) | n |\n| zz | | | | | | | | | |\n| 2 | | B |\n")
    write(tmp_path, "b/y.md", "| 3 | soon | C | Ops | 3/5 | Offer | | [2](r) | – |\n")
    rows = {r["num"]: r for r in readers.read_tracker(spark, f"{tmp_path}/*").collect()}
    assert set(rows) == {1, 3}
    assert (rows[1]["company"], rows[1]["location"], rows[1]["status"], rows[1]["owner_id"]) == ("Acme", "Berlin", "Aplicado", "a")
    assert (rows[3]["company"], rows[3]["status"], rows[3]["date"], rows[3]["owner_id"]) == ("C", "Offer", None, "b")


def test_repair_tracker(spark):
    df = spark.createDataFrame([(1, "4/5", "applied", "n"), (2, "offer", "3.5/5", "â€”"), (3, None, "strange", "")], "num long, score string, status string, notes string")
    out, counts = readers.repair_tracker(df)
    rows = {r["num"]: (r["status"], r["score"], r["notes"]) for r in out.collect()}
    assert rows == {1: ("applied", 4.0, "n"), 2: ("offer", 3.5, "—"), 3: ("evaluated", None, "status was strange")}
    assert tuple(counts.first()) == (1, 1, 1, 1)


def test_pipeline_checklist(spark, tmp_path):
    path = write(tmp_path, "me/p.md", "## Pending\n### Direct\n- [ ] https://a/1 | A | Dev | Berlin | posted: 2024-01-02 | trust: high\n- [ ] https://a/2 | B | Dev\n## Processed\n- [x] #12 https://a/3 | C | Dev | Rome | 4.5/5 clean net-new active\n- [x] https://a/4 | D | Dev | Rome | 4/5 closed\n")
    rows = readers.read_pipeline(spark, path)
    got = {r["company"]: (r["state"], r["section"], r["bucket"], r["posted"]) for r in rows.collect()}
    assert got == {"A": ("pending", "Pending", "Direct", "2024-01-02"), "C": ("processed", "Processed", None, None), "D": ("processed", "Processed", None, None)}
    assert [r["company"] for r in readers.active_processed(rows).collect()] == ["C"]


def test_additions(spark, tmp_path):
    write(tmp_path, "1.tsv", "7\t2024-01-01\tA\tDev\t4/5\tApplied\tx\t[7](r)\tvia=agency\tBerlin")
    write(tmp_path, "2.tsv", "8\t2024-01-01\tB\tDev\toffer\t3.5\tx\t[8](r)")
    write(tmp_path, "3.tsv", "9\t2024-01-01\tB\tDev\tfoo\tbar\tx\t[8](r)")
    write(tmp_path, "4.tsv", "9\t2024-01-01\tB\tDev\t4/5\tApplied\tx\t[8](r)\tBerlin\tRome")
    rows, rejects = readers.read_additions(spark, f"{tmp_path}/*.tsv")
    got = {r["num"]: (r["score"], r["status"], r["via"], r["location"]) for r in rows.collect()}
    assert got == {7: (4.0, "applied", "agency", "Berlin"), 8: (3.5, "offer", None, None)}
    assert sorted(r["reason"] for r in rejects.collect()) == ["more than one location", "score or status undecidable"]


def test_state_blacklist_manifest_runs(spark, tmp_path):
    path = write(tmp_path, "s.json", json.dumps({"items": {"u1": {"status": "active", "n": 2}, "u2": None}}))
    assert [tuple(r)[1:] for r in readers.read_state(spark, path, "status: string, n: int").collect()] == [("u1", "active", 2)]
    path = write(tmp_path, "me/b.md", "| Company | Since | Scope | Reason |\n|---|---|---|---|\n| Acme Inc | 2024 | all | one |\n| ACME | 2025 | all | two |\n")
    assert [(r["key"], r["reason"]) for r in readers.read_blacklist(spark, path).collect()] == [("acme", "one")]
    path = write(tmp_path, "m.tsv", "# c\n007\ta.pdf\ta.html\tA4\t2024\n7\tb.pdf\tb.html\tA4\t2025\n")
    assert [(r["report"], r["pdf"]) for r in readers.read_manifest(spark, path).collect()] == [("7", "b.pdf")]
    path = write(tmp_path, "r.jsonl", '{"run_id": "a", "status": "complete", "duration_seconds": 1.5}\n{"run_id": \n{"run_id": "b", "status": "complete", "duration_seconds": -1}\n{"run_id": "c", "status": "failed", "duration_seconds": 1}\n')
    assert [r["run_id"] for r in readers.read_run_history(spark, path).collect()] == ["a"]


def test_html_second_markup_and_foreign_links(spark):
    html = '<article><a class="x" href="/job/1"><b>One</b></a></article><article><a href="https://other.com/2">Two</a></article><article><a href="/3"></a></article>'
    pages = spark.createDataFrame([("https://h.com/list", html), ("https://h.com/none", None)], "url string, html string")
    assert [tuple(r) for r in feeds.normalize_html_pages(pages).collect()] == [("https://h.com/list", "One", "https://h.com/job/1")]


def test_register_source_needs_title_and_url():
    try:
        feeds.register_source("x", "$", {"title": "$.t"})
    except ValueError:
        return
    raise AssertionError("accepted")


def test_json_feed_with_own_sources(spark):
    raw = spark.createDataFrame([("z", '{"r": [{"t": "A", "u": "U"}, {"t": "", "u": "U"}]}'), ("z", "no json"), ("y", "[]")], "source string, payload string")
    out = feeds.normalize_json_feed(raw, {"z": ("$.r", {"title": "$.t", "url": "$.u"})})
    assert [(r["title"], r["url"]) for r in out.select("title", "url").collect()] == [("A", "U")]
    assert out.where(F.col("posted_at").isNotNull()).count() == 0


def test_landed_payloads(spark, tmp_path):
    from brightloom.sources.landed import register_landed

    register_landed(spark)
    home = tmp_path / "in"
    read = lambda **o: spark.read.format("landed_payloads").options(**o).load(str(home))
    assert read().count() == 0
    long = "é" * 2_000_000
    write(home, "mine/0.json", '{"a":\n1}')
    write(home, "mine/1.jsonl", f'{{"b": 1}}\n\n{{"c": "{long}"}}\n{{"d": 1}}')
    write(home, "mine/.2.json", "hidden")
    write(home, "_SUCCESS", "")
    rows = {(r["file"], r["source"], r["payload"]) for r in read().collect()}
    assert rows == {("mine/0.json", "mine", '{"a":\n1}'), *[("mine/1.jsonl", "mine", x) for x in ('{"b": 1}', f'{{"c": "{long}"}}', '{"d": 1}')]}
    assert {r["source"] for r in read(source="x").collect()} == {"x"}
    seen = []
    for more in ("mine/2.json", "mine/3.json", None):
        stream = spark.readStream.format("landed_payloads").load(str(home))
        sink = lambda batch, n: seen.extend(sorted(r["file"] for r in batch.collect()))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cursor")).trigger(availableNow=True).start().awaitTermination()
        if more:
            write(home, more, "{}")
    assert seen == ["mine/0.json", *["mine/1.jsonl"] * 3, "mine/2.json", "mine/3.json"]


def test_portal_rules(spark, monkeypatch):
    import pytest

    from brightloom.operators import portals

    monkeypatch.setattr(portals, "PORTALS", dict(portals.PORTALS))
    portals.register_portal("ninth", "next", [("active", "open", [("$.props.id", "is_id", ""), ("$.props.until", "from_today", "")]), ("expired", "over", [("$.props.until", "before_today", "")])])
    with pytest.raises(ValueError):
        portals.register_portal("x", "body", [("maybe", None, [])])
    page = lambda until: f"""<script type="x" id='__NEXT_DATA__'>{{"props": {{"id": "a.b", "until": "{until}"}}}}</script>"""
    rows = [
        (1, "ninth", "a.b", 200, page("2024-3-15")), (2, "ninth", "a.b", 200, page("2024-03-14")), (3, "ninth", "axb", 200, page("2024-3-15")), (4, "ninth", "a.b", 200, page("soon")), (5, "ninth", "..", 404, None),
        (6, "other", "a", 200, "{}"), (7, None, None, None, None), (8, "lever", "a", None, "{}"), (9, "remember", "a", 200, "<script id='__NEXT_DATA__'>{broken</script>"), (10, "wanted", "8", 200, '{"id": 9, "position": "x", "status": "open"}'),
        (11, "saramin", "a.b", 200, "<a onclick=quickApplyForm(1)>입사지원</a>" + "<a>" * 50_000), (12, "lever", "a", 410, None), (13, "lever", "a", 200, None), (14, "remember", "7", 200, """<script id="__NEXT_DATA__">[{"x": {"id": 7, "title": "t", "status": "ended"}}, {"id": 7, "title": "t", "status": "open"}]</script>"""),
    ]
    got = {r["n"]: (r["result"], r["code"]) for r in portals.portal_liveness(spark.createDataFrame(rows, "n int, portal string, posting_id string, status int, body string"), F.lit("2024-03-15").cast("date")).collect()}
    nothing = ("unknown", None)
    assert got == {1: ("active", "open"), 2: ("expired", "over"), 3: nothing, 4: nothing, 5: nothing, 6: nothing, 7: nothing, 8: nothing, 9: nothing, 10: nothing, 11: nothing, 12: ("expired", "lever_api_gone"), 13: ("active", "lever_api_ok"), 14: ("active", "remember_structured_active")}


def test_landed_tracker_repaired(spark, tmp_path):
    write(tmp_path, "me/a.md", "| # | Date | Company | Role | Score | Status | PDF | Report | Notes |\n|---|---|---|---|---|---|---|---|---|\n"
          "| 4 | 2024-01-02 | Acme | Dev | 4/5 | Applied | x | [1](r) | a | b|c |\n| 4 | soon | B | Ops | 鈥? | 3.5/5 | | � | |\n| x | 2024-01-03 | C | Ops | 2/5 | strange | x | r | n |\n| 0 | 2024-01-03 | D |\n")  # fmt: skip
    write(tmp_path, "you/b.md", "| 1 | 2024-01-02 | Acme | Dev | 4/5 | Sent | x | r | n |\n")
    rows, counts = readers.read_tracker_repaired(spark, f"{tmp_path}/*")
    got = sorted(tuple(r) for r in rows.select("owner_id", "num", "company", "date", "score", "status", "pdf", "report", "notes").collect())
    assert got == [
        ("me", 4, "Acme", "2024-01-02", "4/5", "applied", "x", "[1](r)", "a | b | c"), ("me", 5, "B", "soon", "3.5/5", "evaluated", "❌", "—", None),
        ("me", 6, "C", "2024-01-03", "2/5", "evaluated", "x", "r", 'n [sync: original status "strange"]'), ("me", 7, "D", "2024-01-03", "—", "evaluated", "❌", "—", '[sync: original status ""]'),
        ("you", 1, "Acme", "2024-01-02", "4/5", "applied", "x", "r", "n"),
    ]
    found = {r["owner_id"]: r.asDict() for r in counts.collect()}
    assert found["me"] == {"owner_id": "me", "mojibake": 1, "score_in_status": 1, "unknown_status": 2, "bad_date": 1, "stray_pipes": 1, "bad_id": 3}
    assert not any(v for k, v in found["you"].items() if k != "owner_id")
