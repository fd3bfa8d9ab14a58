"""What holds at any size: no table is sent through the driver, no join makes the pairs of a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.operators import resolver


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _told(spark):
    postings = spark.createDataFrame([(1, " ", "Dev", "We at Acme", "https://x.example.com/wd/1")], "posting_id long, company string, title string, identity_text string, url string")
    tracker = spark.createDataFrame([(1, "Acme", "Dev", "applied", "see https://x.example.com/wd/2")], "num long, company string, role string, status string, notes string")
    return postings, tracker


def test_names_in_texts_and_matches_are_no_broadcast(spark):
    texts, keys = spark.range(3).select("id", F.lit("weatacme").alias("text")), spark.range(2).select(F.lit("acme").alias("k"))
    found = resolver.keys_in_texts(texts, keys, [])
    assert "Broadcast" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(i, "acme") for i in range(3)]
    assert "Broadcast" not in plan_of(resolver.resolved_matches(*_told(spark)))


def test_staged_match_makes_no_pair_of_posting_and_row(spark, monkeypatch):
    from brightloom.operators import matching

    seen = []
    kept = matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    job, wanted = "https://board.example.com/careers/1", "https://www.wanted.co.kr/wd/1"
    empty = F.lit(None).cast("long")
    row = lambda num, company, aliases: (num, company, "Dev", aliases)
    # 1 and 2: one row by two aliases and by one; 3: a hot alias of many rows; 4: two aliases of two rows
    rows = [row(1, "a", [job, "x"]), row(2, "b", ["y", "z"]), row(3, "b", ["z"])] + [row(10 + i, f"c{i}", ["hot", f"h{i}"]) for i in range(300)]
    asked = [(1, "q", "Dev", [job, "x"]), (2, "q", "Dev", ["y"]), (3, "q", "Dev", ["hot"]), (4, "q", "Dev", ["y", "z"]), (5, "a", "Dev", [wanted])]
    t = spark.createDataFrame(rows, "num long, company string, role string, aliases array<string>")
    p = spark.createDataFrame(asked, "posting_id long, company string, title string, aliases array<string>").withColumn("tracker_num", empty)
    found = matching.staged_match(p, t)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "alias"), (2, 2, "alias"), (5, 1, "exact")]
    assert not any("Aggregate [pid#" in line and ", tid#" in line.split("]")[0] for plan in [*seen, found._jdf.queryExecution().optimizedPlan().toString()] for line in plan.splitlines())


def test_time_of_a_run_is_read_once(spark):
    from brightloom.operators import composite

    state = spark.createDataFrame([("a", "old", "2024-01-02 00:00:00")], "url string, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
    body = '{"schema_version": "v", "started_at": "2024-01-02T01:00:00", "liveness": {"results": {"a": "new", "b": "new"}}}'
    runs = spark.createDataFrame([("1", body)], "name string, body string")
    found = composite.bootstrap_from_runs(state, runs, "v", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert sorted(tuple(r)[:2] for r in found.collect()) == [("a", "new"), ("b", "new")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "started_at" not in plan.split("Generate")[0]


def test_offices_list_a_job_once(spark, monkeypatch):
    from brightloom.plans import composite_queries

    seen = []
    monkeypatch.setattr(composite_queries.C, "enrich_offices", lambda p, offices: seen.append(offices) or p)
    composite_queries.j21(spark, "/root/testdata/sf0.1")
    jobs = seen[0].select("name", F.explode("departments").alias("d")).select("name", F.explode("d.jobs").alias("job"))
    assert jobs.count() == jobs.distinct().count() > 0


def test_country_phrases_as_written(spark):
    from brightloom.operators.filters import country_passes

    said = spark.createDataFrame([("license, mitten",), ("license, MIT style",), (" ",)], "d string")
    passes = lambda **o: [r[0] for r in said.select(country_passes(F.col("d"), ["license"], ["mit "], "Apache", **o)).collect()]
    assert passes(as_written=True) == [False, True, True] and passes() == [True, True, True]


def test_gate_is_no_broadcast(spark):
    assert "Broadcast" not in plan_of(resolver.resolved_gate(*_told(spark)))


def test_numbers_in_texts_as_the_sql_takes_them(spark, tmp_path):
    """Documents with numbers of their own, one beside letters, and addresses."""
    import duckdb

    from brightloom.plans import posting_queries as P

    texts = ["the number 010-1234-5678 of a@b.org", "the key f01012345678a ends", "License _0101234567 or 010 123 4567.\nx", None, "01112345678", "the x@y.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("x20_redact", "x20_evidence"):
        got = sorted(map(tuple, P.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(P.ORACLES[name]).fetchall()), name


def test_keys_of_fingerprints_are_dealt_by_their_number(spark, monkeypatch):
    from brightloom.operators import similarity

    fps = spark.range(3000).select(F.xxhash64("id").alias("fp")).coalesce(1).localCheckpoint()
    for keys, tasks in ((10_000, 17), (20_000, 9)):  # 56 keys of each
        monkeypatch.setattr(similarity, "TASK_KEYS", keys)
        held = [line for line in plan_of(similarity.candidate_pairs(fps, fps)).splitlines() if "Exchange hashpartitioning" in line]
        # both sides, by the fingerprint before keys are made and by the key
        assert len(held) == 4 and all(f", {tasks}), REPARTITION_BY_NUM" in line for line in held), held


def test_rounds_take_digests_and_join_to_reject_alone(spark, monkeypatch):
    from brightloom.operators import dedup

    seen, kept = [], dedup.checkpointed
    monkeypatch.setattr(dedup, "checkpointed", lambda df: seen.append((df.dtypes, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df))
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "y"), (5, None, None), (6, None, "x"), (7, "d", None), (8, "b", None)]
    got = dedup.accept_in_order(spark.createDataFrame(rows, "i int, a string, b string"), ["a", "b"], "i")
    assert {r["i"] for r in got.where("accepted").collect()} == {1, 3, 5, 7}
    assert all(kind == "binary" for types, _ in seen for name, kind in types if name in ("k0", "k1"))
    assert all("LeftOuter" not in plan for _, plan in seen)


def test_index_shuffles_what_is_asked_for(spark):
    from brightloom.operators import dedup

    rows = [("https://a.example/1", "Acme", "Dev", "added", "p", "2"), ("https://a.example/1/", "Acme", "Ops", "old", "p", "1"), (None, "B", "Dev", "added", "p", "3")]
    h = spark.createDataFrame(rows, "url string, company string, title string, status string, portal string, pos string").withColumn("first_seen", F.current_date())
    whole, part = dedup.posting_index(h), dedup.posting_index(h, ["pos"])
    ids = ["pos", "listing_instance_id", "posting_cluster_id"]
    assert sorted(map(tuple, whole.select(*ids).collect()), key=str) == sorted(map(tuple, part.select(*ids).collect()), key=str)
    assert {r["pos"] for r in part.collect()} == {"1", "3"}
    sent = next(line for line in plan_of(part).splitlines() if "SortAggregate(key=[_id" in line)
    assert "portal" not in sent and "status" not in sent


def test_checklists_land_as_few_files_of_many_lists(spark):
    from brightloom.plans import landed_queries as L
    from brightloom.sources import readers

    rows = spark.range(0, 4 * L.LINES * 10).select(F.col("id").alias("key"))
    line = F.expr("concat(CASE WHEN key % 800 = 400 THEN '### B\n' ELSE '' END, '- [ ] u', key, ' | c | t | here')")
    files = L._files(rows, "key", line, "## Pending\n", lists=4)
    assert files.count() == 4 * 3  # ten lists of an owner, four in a file
    found = readers.read_pipeline(spark, L._land(files)).selectExpr("bigint(substr(url, 2)) AS key", "section", "bucket").collect()
    # the bucket of a list is not carried into the next one
    assert sorted((r["key"], r["section"], r["bucket"]) for r in found) == [(k, "Pending", "B" if k % 4 == 0 and k % 800 >= 400 else None) for k in range(8000)]


def test_rows_without_a_key_are_dealt_to_all_tasks(spark, monkeypatch):
    from brightloom.operators import dedup

    largest = []
    kept = dedup.checkpointed

    def watched(df):
        out = kept(df)
        if out.columns == ["o", "k0", "k1"] and out.count() == 400:
            largest.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(dedup, "checkpointed", watched)
    # of each k the first row goes for its report, so the second, which has none, leads in the next round
    rows = [(0, "x", "hot")] + [(2 * i + 1, f"a{i}", "hot") for i in range(400)] + [(2 * i + 2, f"a{i}", None) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = dedup.accept_in_order(spark.createDataFrame(rows, "pos long, k string, r string"), ["k", "r"], "pos").where("accepted").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["pos"] for r in found} == {0} | {2 * i + 2 for i in range(400)}
    assert largest and max(largest) < 200


def test_two_keys_move_first_rows_alone(spark):
    from pathlib import Path

    from brightloom.operators import dedup

    def moved():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        held = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite() + sum(f.stat().st_size for f in held.rglob("*") if f.is_file())

    n = 20_000
    # a row has a url that may come twice, and one of 50 roles
    rows = spark.range(n).select(F.format_string("%08d|place in a log", "id").alias("pos"), (F.col("id") * 7919 % 15_000).alias("url"), (F.col("id") * 31 % 50).alias("role"))
    dedup.checkpointed(spark.range(1))
    before = moved()
    found = dedup.accept_in_order(rows, ["url", "role"], "pos")
    assert found.where("accepted").count() == 50
    # the packed digests are written once, and first rows of 50 roles move: 19 bytes a row, 91 when each round moved all
    assert (moved() - before) / n < 45
