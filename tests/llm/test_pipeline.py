"""The pipeline against plain versions of its stages, and the registry against its oracle SQL."""

import os
import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from brightloom.llm import registry
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of the smallest table with planted copies and leaks, in a folder of its own."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leak = items.orderBy("item_id").first()["text"]
    rng = random.Random(1)
    for k in range(6):
        words = rows[k][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows += [(9000 + k, rows[k][1], *rows[k][2:]), (9100 + k, " ".join(words), *rows[k][2:]), (9200 + k, rows[k][1] + "\n" + leak, *rows[k][2:])]
    other = next(r for r in rows if r[2] != rows[0][2] and len(r[1]) > 300)
    rows += [(9303, f"{rows[0][1][:300]} {other[1][:300]}", rows[0][2], "src0", 601), (9304, " ".join(rng.choices(rows[0][1].split(), k=60_000)), rows[0][2], "src1", 9)]
    rows += [(9300, None, "en", "src0", 0), (9301, "", "en", None, 0), (9302, "12 34", None, "src1", 5)]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    predict = brute.language_model([(r["text"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2])
    now = {r["doc_id"]: (r["text"], r["source"]) for r in docs}
    before = set(now)
    now = {i: x for i, x in now.items() if not predict(x[0])[2]}
    assert before - set(now) >= {9300, 9301, 9302, 9303} and len(now) > len(before) - 10
    kept, gone = brute.keep_lines([(i, t) for i, (t, _) in now.items()])
    now = {i: (kept[i], s) for i, (_, s) in now.items() if not gone[i] or brute.words(kept[i])}
    top = brute.near_at([(i, t) for i, (t, _) in now.items()])
    assert top[9104] != 9104  # a copy with a changed word
    now = {i: x for i, x in now.items() if top[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.contained([(i, t) for i, (t, _) in now.items()], items)}
    assert leaked
    now = {i: x for i, x in now.items() if i not in leaked}
    want = {i: k for i, (_, _, k) in brute.mixed([(i, t, s) for i, (t, s) in now.items()]).items() if k}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: r["taken"] for i, r in got.items()} == want
    assert all(got[i]["text"] == now[i][0] for i in got)


def test_stages_survive_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(v) for v in r]) for r in df.select(*columns).collect())
    made = con.execute(registry.oracles()[name])
    at = [[c[0] for c in made.description].index(c) for c in columns]
    assert got == sorted(repr([_plain(r[i]) for i in at]) for r in made.fetchall())


def test_columns_of_the_contracts(spark):
    want = {
        "op2": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op4": {"doc_id", "size", "source_size", "target", "taken"}, "op5": {"page_id", "host", "path", "rule", "verdict"},
        "op7": {"doc_id", "fingerprint", "component_id"}, "op8": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}, "op10": {"doc_id", "held_out", "lang_pred", "score"},
    }
    queries = {n.split("_")[0]: q for n, q in registry.queries().items()}
    assert set(queries) == {f"op{i}" for i in range(1, 11)}
    for op, columns in want.items():
        assert columns <= set(queries[op](spark, SF).columns)
