"""Operators whose meaning is sequential or stateful, against plain loops; rules on missing values."""

import datetime
import random

from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.operators import dedup, filters, identity, mail, similarity, tracker
from brightloom.streaming import events


def test_accept_in_order_equals_sequential(spark):
    rng = random.Random(6)
    for _ in range(3):
        rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"xyzuvw"])) for i in range(40)]
        seen_a, seen_b, want = set(), set(), {}
        for i, a, b in rows:
            want[i] = not ((a is not None and a in seen_a) or (b is not None and b in seen_b))
            if want[i]:
                seen_a.add(a)
                seen_b.add(b)
        df = spark.createDataFrame(rows, "i int, a string, b string")
        assert {r["i"]: r["accepted"] for r in dedup.accept_in_order(df, ["a", "b"], "i").collect()} == want
    assert dedup.accept_in_order(df.limit(0), ["a", "b"], "i").count() == 0


def _sequential(rows):
    seen_a, seen_b, out = set(), set(), set()
    for i, a, b in sorted(rows):
        if (a is None or a not in seen_a) and (b is None or b not in seen_b):
            out.add(i)
            seen_a.add(a)
            seen_b.add(b)
    return out


def test_two_keys_of_long_chains_and_few_marks(spark, monkeypatch):
    rng = random.Random(7)
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(12)]  # each row waits for the one before
    mixed = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, f"u{rng.randrange(40)}"])) for i in rng.sample(range(1000), 120)]
    monkeypatch.setattr(dedup, "MARK_ROWS", 4)  # marks let rows of other keys through
    monkeypatch.setattr(dedup, "ROUNDS", 2)
    for rows in (chain, mixed):
        df = spark.createDataFrame(rows, "i int, a string, b string")
        assert {r["i"] for r in dedup.accept_in_order(df, ["a", "b"], "i").where("accepted").collect()} == _sequential(rows)


def test_verdicts_have_one_row_of_each_order_and_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(1, "o", "a", "x"), (2, "p", "a", "x"), (3, "o", "a", "y"), (4, "o", None, "x"), (5, "o", "c", None), (5, "o", "c", None), (6, "o", None, None)]
    df = spark.createDataFrame(rows, "i int, owner_id string, a string, b string")
    found = dedup.verdicts_in_order(df.mapInArrow(counted, df.schema), ["a", "b"], "i")
    assert found.columns == ["i", "accepted"]
    assert sorted(map(tuple, found.collect())) == [(1, True), (2, True), (3, False), (4, False), (5, True), (6, True)]
    assert read.value == len(rows)


def test_missing_values_pass(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "t string, l string, d date, n double, c string")
    rules = [
        filters.location_passes(F.col("l"), F.col("t"), F.col("t"), allow=["x"]), filters.age_passes(F.col("d"), 3, F.current_date()), filters.window_passes(F.col("d"), "2024-01-01"),
        filters.salary_passes(F.col("n"), F.col("n"), F.col("c"), 1, 2, "EUR"), filters.content_passes(F.col("t"), ["x"]), filters.country_passes(F.col("t"), ["x"]), filters.visa_passes(F.col("t")),
    ]
    assert all(df.select(*[r.alias(f"r{i}") for i, r in enumerate(rules)]).first())
    assert df.select(filters.location_passes(F.col("l"), F.col("t"), F.col("t"), allow=["x"], require_explicit=True)).first()[0] is False
    assert df.select(filters.title_passes(F.col("t"), ["x"])).first()[0] is False
    assert df.select(filters.salary_passes(F.lit(5.0), F.lit(5.0), F.col("c"), 9, 2)).first()[0] is True


def test_location_tiers(spark):
    rule = dict(allow=["new york", "us"], block=["india", "berlin"], always_allow=["remote us"], check_title=True)
    cases = [
        ("New York, NY", None, "Dev", True), ("Houston, United States", None, "Dev", False), ("Pune, India", None, "Dev", False), ("2 Locations", "https://h/job/Pune-India/x", "Dev", False), ("Indianapolis", None, "Dev", False),
        ("Remote US / India", None, "Dev", True), ("Austin", None, "Dev - Remote", True), ("Austin", None, "Non-Remote Dev", False), ("US", None, "Dev Berlin", False), ("", "https://h/job/US/1", None, True),
    ]
    df = spark.createDataFrame(cases, "l string, u string, t string, want boolean")
    got = df.select("*", filters.location_passes(F.col("l"), F.col("u"), F.col("t"), **rule).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_url_keys(spark):
    urls = [("HTTPS://A.com:443/B/?utm_source=x&gh_jid=Ab#f", "https://a.com:443/b?gh_jid=Ab"), ("https://a.com", "https://a.com/"), ("not a url", "not a url"), (None, None), ("https://a.com/x?LANG=en", "https://a.com/x")]
    df = spark.createDataFrame(urls, "u string, want string")
    assert all(r[0] == r[1] for r in df.select(X.dedup_url(F.col("u")), "want").collect())
    assert spark.range(1).select(X.cooldown_url(F.lit("https://a.com:443/b/?z=1&utm_q=2&a=3"))).first()[0] == "https://a.com/b?a=3&z=1"


def test_nfkc(spark):
    df = spark.createDataFrame([("ＡＢＣ ①",), (None,)], "t string")
    assert [r[0] for r in df.select(X.nfkc(F.col("t"))).collect()] == ["ABC 1", None]


def test_cross_listings_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(80):
        f = rng.choice(base)
        for _ in range(rng.randrange(8)):
            f ^= 1 << rng.randrange(64)
        rows.append((i, f"c{i % 4}", f"u{i}", f - (1 << 64) if f >> 63 else f, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)))
    df = spark.createDataFrame(rows, "id int, company string, url string, fingerprint long, seen_at timestamp")
    got = {(r["id"], r["other_id"]) for r in similarity.cross_listings(df, df, 30).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] != b[1] and 0 <= (a[4] - b[4]).days <= 30 and bin((a[3] ^ b[3]) % (1 << 64)).count("1") <= 5}
    assert got == want and want


def test_near_fingerprints_are_whole_and_their_candidates_grow_in_proportion(spark):
    rng = random.Random(12)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))

    def table(n):
        seeds = [rng.getrandbits(64) for _ in range(n // 10)]
        return list({*seeds, *(flip(rng.choice(seeds), rng.randrange(1, 8)) for _ in range(n // 10))} | {rng.getrandbits(40) << 24 | 0xABCDEF for _ in range(n // 3)} | {rng.getrandbits(64) for _ in range(n // 2)})  # a third share 24 bits

    counts = []
    for n in (400, 800, 3200):
        fps = table(n)
        df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
        counts.append(similarity.candidate_pairs(df, df, hot_pairs=9).count())
        if n == 400:
            want = {(signed(a), signed(b)) for a in fps for b in fps if bin(a ^ b).count("1") <= 5}
            for blocks, hot in ((8, 100), (8, 1 << 40), (9, 100)):
                got = [(r.fa, r.fb) for r in similarity.near_fingerprints(df, df, blocks=blocks, hot_pairs=hot).collect()]
                assert len(got) == len(set(got)) and set(got) == want
    assert counts[2] < 5 * counts[1], counts
    assert [similarity.blocks_for(n) for n in (1000, 1 << 24, 1 << 25, 1 << 31, 1 << 62)] == [8, 8, 9, 10, 12]


def test_thread_fold(spark):
    rows = [(1, 0, "applied"), (1, 1, "interview"), (1, 2, "applied"), (1, 3, "rejected"), (1, 4, "offer"), (2, 0, None), (3, 0, "offer")]
    df = spark.createDataFrame(rows, "thread_id long, at long, k string")
    got = {(r["thread_id"], r["at"]): (r["kind"], r["apply"]) for r in mail.thread_events(df, F.col("k")).collect()}
    assert got == {(1, 0): ("applied", False), (1, 1): ("interview", False), (1, 3): ("rejected", True), (3, 0): ("offer", True)}


def test_statuses(spark):
    df = spark.createDataFrame([("**Applied**",), ("Entrevista 2024-01-02",), ("??",), (None,)], "s string")
    assert [r[0] for r in df.select(tracker.status_name(F.col("s"))).collect()] == ["applied", "interview", None, None]


def test_stream_resumes_and_keeps_state(spark, tmp_path):
    schema = "company string, at long, status string"
    src, out, cursor = (str(tmp_path / x) for x in ("src", "out", "cursor"))

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = events.stream_failure_streaks(spark.readStream.schema(schema).parquet(src), 2)
        events.run_incremental(stream, cursor, events.parquet_sink(out)).awaitTermination()

    drop([("a", 1, "network"), ("b", 1, "network"), ("b", 2, "reachable")])
    drop([("a", 2, "network")])
    got = {(r["company"], r["batch"]): (r["streak"], r["alert"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 0): (1, False), ("b", 0): (0, False), ("a", 1): (2, True)}


def test_backfill_windows(spark):
    got = [(str(r[0]), str(r[1])) for r in events.backfill_windows(spark, "2024-02-05", "2024-03-10").orderBy("window_start").collect()]
    assert got == [("2024-01-29", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-10")]


def test_leader_clusters_equal_a_plain_loop(spark):
    from brightloom.operators.composite import cluster_duplicates, dedup_tracker

    rng = random.Random(3)
    day = lambda: rng.choice([None, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(400))])
    rows = [
        (rng.choice(["me", "you"]), i, rng.choice([i, i, 7, 8, None]), rng.choice(["A Inc", "a", "B", "?", "?"]), rng.choice(["X  y", "x Y", "z", None]), rng.choice(["evaluated", "applied", "skip", None, "offer"]),
         rng.choice([None, None, "r1", "r2"]), day(), rng.choice(["", "agency"]), round(rng.random() * 5, 1), rng.choice(["", "n1", "n2"]))
        for i in range(200)
    ]
    leaders, want = {}, {}
    for o, i, num, c, role, status, rep, d, via, *_ in rows:
        own = leaders.setdefault((o, c == "?" and via, c[0].lower()), [])
        title, flying = " ".join((role or "").lower().split()), status in ("applied", "offer")

        def same(x):
            match = (rep and rep == x[3]) or (num is not None and num == x[1] and title == x[2]) or (title == x[2] and not flying and not x[4])  # noqa: B023
            return match and (c != "?" or (d and x[5] and abs((d - x[5]).days) <= 90))  # noqa: B023

        want[o, i] = next((x[0] for x in own if same(x)), None)
        if want[o, i] is None:
            own.append((i, num, title, rep, flying, d))
            want[o, i] = i
    df = spark.createDataFrame(rows, "owner_id string, pos long, num long, company string, role string, status string, report string, date date, via string, score double, notes string")
    assert {(r["owner_id"], r["pos"]): r["leader"] for r in cluster_duplicates(df).collect()} == want
    assert {(r["owner_id"], r["pos"]): r["leader"] for r in cluster_duplicates(df, fold_rows=0).collect()} == want
    merged = dedup_tracker(df).collect()
    assert len(merged) == len(set((k[0], v) for k, v in want.items())) and sum(r["n"] for r in merged) == 200
    scores = {}
    for r in rows:
        scores.setdefault((r[0], want[r[0], r[1]]), []).append(r[9])
    assert sorted(max(s) for s in scores.values()) == sorted(r["score"] for r in merged)


def test_owners_do_not_meet(spark):
    from brightloom.operators import composite

    mine = lambda rows, schema: spark.createDataFrame([(o, *r) for o in ("a", "b") for r in rows if r[-1] in (o, "ab")], f"owner_id string, {schema}, who string").drop("who")
    t = mine([(1, "Acme Inc", "Data Engineer", "applied", "a"), (2, "Acme", "data engineer", "evaluated", "ab"), (2, "Zeta", "Cook", "rejected", "b"), (None, "Zeta", "Cook", "skip", "b")], "num long, company string, role string, status string")
    p = mine([(10, "ACME", "Data engineer", "ab"), (11, "Zeta", "Cook", "ab")], "posting_id long, company string, title string")
    gates = {(r["owner_id"], r["posting_id"]): r["gate"] for r in identity.history_gate(p, t).collect()}
    assert gates == {("a", 10): "same_role_applied", ("b", 10): "eligible", ("a", 11): "eligible", ("b", 11): "same_role_rejected"}
    assert {(r["owner_id"], r["n"]) for r in tracker.duplicate_groups(t).collect()} == {("a", 2), ("b", 2)}
    assert [tuple(r) for r in tracker.duplicate_ids(t).collect()] == [("b", 2, 2)]
    best = {(r["owner_id"], r["posting_id"], r["num"]) for r in identity.tracker_matches(p, t).collect()}
    assert best == {("a", 10, 1), ("a", 10, 2), ("b", 10, 2), ("b", 11, 2), ("b", 11, None)}
    seen = mine([("https://x.org/1", "a")], "url string")
    new = mine([("https://x.org/1?utm_source=q", "ab")], "url string")
    assert [r["owner_id"] for r in dedup.anti_seen_urls(new, seen).collect()] == ["b"]
    ids = tracker.reassign_ids(t.withColumn("o", F.monotonically_increasing_id()), ["o"]).groupBy("owner_id").agg(F.sort_array(F.collect_list("num")).alias("n")).collect()
    assert {r["owner_id"]: r["n"] for r in ids} == {"a": [1, 2], "b": [2, 3, 4]}
    adds = mine([(0, 1, "ab"), (1, None, "ab"), (2, 9, "ab")], "pos long, num long")
    given = {(r["owner_id"], r["pos"]): r["given"] for r in composite.allocate_numbers(adds, t).collect()}
    assert given == {("a", 0): 10, ("a", 1): 11, ("a", 2): 9, ("b", 0): 1, ("b", 1): 10, ("b", 2): 9}
    said = mine([(1, "Zeta", "Cook", "offer", "ab"), (2, "Acme", "Data Engineer", "interview", "b")], "message_id long, company string, role string, kind string")
    acts = {(r["owner_id"], r["key"]): r["action"] for r in mail.reconcile(said, t.where("num IS NOT NULL")).collect()}
    assert acts == {("a", "zeta::cook"): "add", ("b", "zeta::cook"): "no_change", ("b", "acme::dataengineer"): "update"}
    ev = mine([(1, "k", "applied", 5, "ab")], "event_id long, key string, kind string, event_at long")
    state = mine([("k", "evaluated", 1, "a")], "key string, status string, decided_at long")
    out = {r["owner_id"]: r["outcome"] for r in mail.ingest_events(ev, mine([(1, "-")], "event_id long"), state).collect()}
    assert out == {"a": "apply", "b": "history_only"}
    try:
        identity.history_gate(p.drop("owner_id"), t)
        raise AssertionError("a table without owners was taken")
    except ValueError:
        pass


def test_evidence_windows(spark):
    import re

    from brightloom.functions.text import evidence

    def plain(text, pattern):
        hit = re.search(pattern, text, re.I | re.S)
        if not hit:
            return text[:500]
        start = max(text.rfind("\n", 0, hit.start()), text.rfind(". ", 0, hit.start())) + 1
        end = text.find("\n", hit.end())
        value = text[start : end if end >= 0 else hit.end() + 120].strip()[:800]
        value = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]", value)
        return re.sub(r"(?<![0-9])01[016789][- .]?[0-9]{3,4}[- .]?[0-9]{4}(?![0-9])", "[phone]", value)

    rng = random.Random(1)
    piece = lambda: rng.choice(["offer", "OFFER\nx", "a", "\n", ". ", ".", " ", "me@x.org", "010-1234-5678", "\U0001f600", "é" * 90])
    texts = ["".join(piece() for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["x" * 300_000 + " offer " + "y" * 300_000, "\n" * 5000 + "offer"]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", evidence(F.col("t"), "offer|o.x").alias("said")).collect()
    assert {r["i"]: r["said"] for r in rows} == {-1: None} | {i: plain(t, "offer|o.x") for i, t in enumerate(texts)}


def test_newest_run_and_sink_by_day(spark, tmp_path):
    from brightloom.operators.composite import bootstrap_from_runs
    from brightloom.streaming.events import keyed_sink

    ts = lambda s: datetime.datetime.fromisoformat(s)
    body = '{"schema_version": "v1", "started_at": "2024-01-05T00:00:00", "liveness": {"results": {"a": "expired", "b": "active", "c": "active"}}}'
    runs = spark.createDataFrame([("r1", body.replace("expired", "wrong")), ("r2", body), ("r3", "[" + body + "]"), ("r4", '{"schema_version": "v0"}'), ("r5", None)], "name string, body string")
    state = spark.createDataFrame([("a", "active", ts("2024-01-05T00:00:00")), ("b", "expired", ts("2024-01-05T01:00:00")), ("d", "active", ts("2024-01-01T00:00:00")), ("e", "active", ts("2024-01-07T00:00:00")), ("f", "x", None)], "url string, status string, at timestamp")
    now = F.lit("2024-01-06").cast("timestamp")
    assert {r["url"]: r["status"] for r in bootstrap_from_runs(state, runs, "v1", now).collect()} == {"a": "expired", "b": "expired", "c": "active"}
    assert {r["url"] for r in bootstrap_from_runs(state, runs.limit(0), "v1", now).collect()} == {"a", "b"}
    day = lambda n: n and datetime.date(2024, 1, n)
    sink = keyed_sink(str(tmp_path / "t"), ["k"], "day")
    batches = [[(1, day(1)), (1, day(1)), (2, day(2))], [(2, day(2)), (3, day(2)), (4, None)], [(4, None), (5, day(3))], []]
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, "k int, day date"), n)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3, 4, 5]
