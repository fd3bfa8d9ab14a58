"""Every operator on hand-made rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brightloom.llm import chat_format, decontaminate, exact_dedup, langid, license_scan, line_dedup, mixing, simhash, substring_dedup, url_filter
from brightloom.llm.components import component_labels
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def as_rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 150)) for _ in range(25)]
    shared = prose(rng, 60)
    return [
        *base, base[3], base[3].upper(), base[4] + " tail", f"{base[5]} {shared} {base[6]}", f"{base[7]}\t{shared}\n{base[8]}", "same " * 120, None, "", "  \n\t ", "x",
        base[9] + " joined words", "a b c", shared + " " + shared, prose(rng, 4000),
    ]


# op1


def test_chat_keeps_maximal_conversations(spark):
    turn = lambda c, t, x, r="user": (c, t, r, x, 1)
    rows = [
        *[turn(1, i, x) for i, x in enumerate("ab")], *[turn(2, i, x) for i, x in enumerate("abc")], *[turn(3, i, x) for i, x in enumerate("abc")], turn(4, 0, "b"),
        turn(5, 0, None), turn(5, 1, ""), turn(6, 0, ""), turn(6, 0, ""), turn(7, None, "z"), turn(7, 3, "q", None), turn(None, 0, "lost"), turn(8, 9, "a"), turn(8, 10, "b", "assistant"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, r1 int")
    found = {r["conv"]: (r["n_turns"], r["copies"], r["chat"]) for r in chat_format.format_chats(df).collect()}
    assert set(found) == {2, 4, 5, 6, 7, 8}
    assert found[2] == (3, 2, "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in "abc"))
    assert found[6] == (1, 1, "<|im_start|>user\n<|im_end|>\n")  # differs from the null text that begins 5
    assert found[7][2].endswith("<|im_start|>\nq<|im_end|>\n")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_takes_texts_of_one_turn_in_order(spark):
    long = "m" * 500_000
    rows = [(1, 0, "user", t) for t in ("gamma", "alpha", long, "beta")] + [(2, 0, "user", t) for t in ("alpha", "beta")]
    for order in (rows, rows[::-1]):
        found = {r["conv"]: r["chat"] for r in chat_format.format_chats(spark.createDataFrame(order, "conv_id long, turn long, role string, text string")).collect()}
        assert found == {1: "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in ("alpha", "beta", "gamma", long))}


# op2


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup_equals_brute_force(spark, corpus, hot):
    df = documents(spark, corpus).withColumn("kept", F.lit("old")).withColumn("k1", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.cut_repeated(df, window=12, gram=5, hot=hot).collect()}
    want = brute.repeated_words(list(enumerate(corpus)), 12)
    assert got == {i: (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)) for i, (w, gone) in enumerate(want)}


def test_substring_dedup_repeated_rows_and_empty_table(spark):
    text = prose(random.Random(1), 50)
    df = spark.createDataFrame([(None, text), (None, text), (7, "short")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.cut_repeated(df).collect()) == [(-1, 50), (-1, 50), (7, 0)]
    assert substring_dedup.cut_repeated(df.limit(0)).count() == 0


def test_substring_and_exact_dedup_take_names_with_dots(spark):
    text = prose(random.Random(2), 60)
    df = spark.createDataFrame([(1, text, 9), (2, text, 9)], "`doc.id` long, `a.text` string, `x.y` int")
    assert [r["n_removed"] for r in substring_dedup.cut_repeated(df, "doc.id", "a.text").collect()] == [60, 60]
    assert sorted(r["keep_id"] for r in exact_dedup.equal_texts(df, "doc.id", "a.text").collect()) == [2, 2]


def test_fm_index_counts():
    import numpy as np

    from brightloom.llm.fm_index import FMIndex

    rng = random.Random(3)
    symbols = np.array([rng.randrange(1, 6) for _ in range(500)] + [0])
    index = FMIndex(symbols, np.ones(501, dtype=np.int64), 8)
    ends = np.arange(8, 500)
    got = index.matching(ends, 8)
    seq = symbols.tolist()
    for e, n in zip(ends.tolist(), got.tolist()):
        pieces = lambda k: sum(seq[i : i + k] == seq[e - k + 1 : e + 1] for i in range(502 - k))  # noqa: E731, B023
        assert pieces(n) >= 2 and (n == 8 or pieces(n + 1) == 1)


# op3


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 6, 9, 17, 34, 70, 3])] + [(7, None), (8, ""), (9, " ?! "), (10, "w1"), (11, "never seen")]
    half = items[5][1].split()
    docs = [prose(rng, 200) + " " + x + " " + prose(rng, 30) for _, x in items[:6]] + [" ".join(half[:60]), " ".join(half[:30]), items[4][1].upper().replace(" ", ", "), None, "", items[6][1]]
    docs += [" ".join(items[4][1].split()[:20] + ["new"] + items[4][1].split()[20:]), docs[0]]
    d = documents(spark, docs).withColumn("h", F.lit(0)).withColumn("item_id", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): r["containment"] for r in decontaminate.contained_items(d, b).collect()}
    assert got == pytest.approx(brute.contained(list(enumerate(docs)), items))
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == set(range(len(docs))) - {k[0] for k in got}
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0 and decontaminate.contained_items(d.limit(0), b).count() == 0


def test_short_items_and_a_shared_opening(spark):
    """Items of one to four words; items that share an opening make candidates only where they could be contained."""
    rng = random.Random(12)
    opening = "answer the following question with one of the four choices and give your reason in one sentence please"
    items = [(i, f"{opening} {prose(rng, 20, 10**6)}") for i in range(60)]
    items += [(100, "What is two plus"), (101, "yes"), (102, "open sesame now"), (103, f"{opening} why"), (104, opening)]
    docs = [f"{prose(rng, 20, 10**6)} {opening} {prose(rng, 20, 10**6)}" for _ in range(30)]
    docs += [f"so, what is TWO plus two? {docs[0]}", "oh yes", "open the sesame now", f"a {items[7][1]} b", f"{items[3][1]} {items[9][1]}", "a b " * 200_000 + items[4][1]]
    d, b = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): r["containment"] for r in decontaminate.contained_items(d, b).collect()}
    assert got == pytest.approx(brute.contained(list(enumerate(docs)), items))
    sketches = decontaminate.item_sketches(b, "item_id", "text")
    in_opening = {r["h"] for r in decontaminate._shingled(spark.createDataFrame([(opening,)], "text string"), [], "text", [5], True).select(F.explode("shingles").alias("h")).collect()}
    assert {r["item"] for r in sketches.collect() if r["h"] in in_opening} <= {103, 104}


# op4


def test_mixing_equals_brute_force(spark, corpus):
    rows = [(i, t, None if i % 9 == 0 else "abc"[i * i % 3] * (1 + i % 2)) for i, t in enumerate(corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("TAKEN", F.lit("old")).withColumn("_plan", F.lit(1)).withColumn("src", F.lit(2))
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "_plan", "src", "size", "source_size", "target", "taken"]
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in out.collect()}
    want = brute.mixed(rows)
    assert {i: (s, k) for i, (s, _, k) in got.items()} == {i: (s, k) for i, (s, _, k) in want.items()}
    assert {i: t for i, (_, t, _) in got.items()} == pytest.approx({i: t for i, (_, t, _) in want.items()})
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_takes_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, 2), (2, "c", None, 1, 2)], "`doc.id` long, `the.text` string, `my.source` string, `a.b` int, `taken` int")
    out = mixing.mix_sources(df, "doc.id", "the.text", "my.source")
    assert out.columns == ["doc.id", "the.text", "my.source", "a.b", "size", "source_size", "target", "taken"] and out.count() == 2


def test_mixing_repeated_rows_are_taken_alike(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "c d e", "x"), (1, "c d e", "x"), (2, None, None)], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["taken"], r["size"]) for r in mixing.mix_sources(df).collect())
    assert got[1] == got[2] and all(t <= 2 * s for _, t, s in got) and len(got) == 4


# op5


def test_url_filter(spark):
    urls = [
        "https://www.example.org/es/1", "http://EXAMPLE.org/en/12?q#f", "https://example.org", "https://notexample.org/es/", "https://a.com/fr/x", "https://a.com/de", "https://a.com/de/x", None, "", "nothing",
        "https://free-xxx.net/", "https://xxxl.net/", "https://a.net/casino-poker", "https://a.net/casino/casino", "://h/p", "https://a.net/SEX?dating", "ftp://x.COM/fr/#://",
    ]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, host int, _said int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "", None, "allow")
    assert got[3] == ("notexample.org", "/es/", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == (None, "allow") and got[6][2:] == ("com/de/", "block")
    assert [got[i] for i in (7, 8, 9)] == [("", "", None, "allow")] * 3
    assert [got[i][3] for i in (10, 11, 12, 13, 15)] == ["block", "allow", "block", "allow", "block"]
    assert got[14] == ("h", "/p", None, "allow") and got[16] == ("x.com", "/fr/", "com/fr/", "allow")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_rules_and_vocabulary_of_any_size(spark):
    """Ten thousand rules, against trying each of them."""
    rng = random.Random(7)
    part = lambda: rng.choice("abcdefgh") + rng.choice(["", "x", "y"])
    rules = list({(".".join(part() for _ in range(rng.randrange(1, 4))), "/" + "/".join(part() for _ in range(rng.randrange(0, 3)))): rng.choice(["allow", "block"]) for _ in range(14_000)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    assert len(rules) > 6_000
    urls = ["http://" + ".".join(part() for _ in range(rng.randrange(1, 5))) + "/" + "/".join(part() for _ in range(rng.randrange(0, 4))) for _ in range(60)] + ["http://" + "a." * 3000 + "b/" + "c" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, `a.url` string")
    table = url_filter.rule_table(spark, [*rules, ("", "/", "block"), (None, "/", "block")])
    terms = spark.createDataFrame([("Bad", 1.0), ("so", 0.4), ("la", 0.7), ("", 1.0), (None, 1.0)], "term string, weight double")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, "a.url", table, terms).collect()}
    shuffled = url_filter.judge_urls(df, "a.url", table, terms, max_held=0)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in shuffled.collect()} == got
    assert "Exchange" not in url_filter.judge_urls(df, "a.url", table, terms)._jdf.queryExecution().executedPlan().toString()
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))
    odd = spark.createDataFrame([(0, "x://q-bad"), (1, "x://q-so"), (2, "x://q-so-la"), (3, "x://solas"), (4, None)], "page_id long, url string")
    said = url_filter.judge_urls(odd, rules=table.limit(0), vocabulary=terms)
    assert {r["page_id"]: (r["n_strict"], r["n_soft"], r["verdict"]) for r in said.collect()} == {0: (1, 0, "block"), 1: (0, 1, "allow"), 2: (0, 2, "block"), 3: (0, 0, "allow"), 4: (0, 0, "allow")}
    assert url_filter.judge_urls(odd, rules=table.limit(0), vocabulary=terms.limit(0)).where("verdict = 'allow'").count() == 5


# op6


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(40)] + ["\n\n\n\n", "x\n\n\n\ny", " \n\t\n\n", "one", ""]
    df = documents(spark, texts + [None]).withColumn("_lines", F.lit(1)).withColumn("n_lines", F.lit("old"))
    out = line_dedup.drop_repeated_lines(df, counts=True)
    assert out.columns[:7] == df.columns and out.columns[7:] == ["n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    want, gone = brute.keep_lines(list(enumerate(texts)))
    assert {i: got[i]["text"] for i in want} == want
    assert all(got[i]["n_removed"] == len(gone[i]) for i in want)
    assert got[len(texts)]["text"] is None and got[len(texts)]["n_lines"] == 0
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_dedup_ties_stay_together(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.drop_repeated_lines(df).collect()) == ["a\nb\nc", "a\nb\nc", "d"]


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line {i}" for i in range(50_000)]
    df = spark.createDataFrame([(1, "\n".join(lines[100:104]), 5), (2, "\n".join(lines), 5)], "`doc.id` long, `t.x` string, `a.b` int")
    got = {r["doc.id"]: (r["t.x"], r["n_lines"], r["n_removed"]) for r in line_dedup.drop_repeated_lines(df, "doc.id", "t.x", counts=True).collect()}
    assert got == {1: ("\n".join(lines[100:104]), 4, 0), 2: ("\n".join(lines[:100] + lines[104:]), 50_000, 4)}


# op7


@pytest.mark.parametrize("group", [64, 1])
def test_simhash_components_equal_brute_force(spark, corpus, group):
    rng = random.Random(4)
    texts = list(corpus)
    for t in corpus[:12]:
        w = t.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(w))
    for bits, blocks in ((2, 5), (3, 7)):
        got = {r["id"]: (r["fps"][0] % (1 << 64), r["component"]) for r in simhash.near_components(documents(spark, texts), width=3, max_bits=bits, blocks=blocks, group=group).collect()}
        assert got == brute.near(list(enumerate(texts)), 3, bits)


def test_simhash_links_fingerprints_at_two_bits(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)} | set(base)
    df = spark.createDataFrame([(0, f - (1 << 64) if f >> 63 else f) for f in fps], "lane int, fp long")
    for group in (64, 4):
        labels = {r["node"]["fp"] % (1 << 64): r["label"]["fp"] % (1 << 64) for r in component_labels(simhash.near_links(df, group=group)).collect()}
        want = brute.components([(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2], fps)
        same = lambda a, b: want[a] == want[b]
        assert all((labels.get(a, a) == labels.get(b, b)) == same(a, b) for a in fps for b in fps)


def test_simhash_lanes_equal_brute_force(spark, corpus):
    rng = random.Random(4)
    texts = list(corpus)
    for t in corpus[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    got = {r["id"]: r["component"] for r in simhash.near_components(documents(spark, texts), width=5, max_bits=2, blocks=4, lanes=4).collect()}
    fps = [simhash.fingerprint(t, 5, 4) for t in texts]
    near = lambda a, b: any(bin((x ^ y) % (1 << 64)).count("1") <= 2 for x, y in zip(a, b))
    n = len(texts)
    assert got == brute.components([(i, j) for i in range(n) for j in range(i + 1, n) if near(fps[i], fps[j])], range(n))


def test_near_duplicates_go(spark):
    text = prose(random.Random(3), 300)
    df = spark.createDataFrame([(5, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (None, "other words here", 1), (9, None, 1), (8, "", 1)], "doc_id long, text string, gone int")
    assert sorted((r["doc_id"] or -1) for r in simhash.drop_near_duplicates(df).collect()) == [-1, 3, 3, 8]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_take_any_case_and_names_with_dots(spark):
    text = prose(random.Random(3), 50)
    df = spark.createDataFrame([(2, text, 1), (1, text, 1)], "DOC_ID long, `a.text` string, `x.y` int")
    assert sorted(r["component"] for r in simhash.near_components(df, text_col="a.text").collect()) == [1, 1]
    assert [tuple(r) for r in simhash.drop_near_duplicates(df, text_col="a.text").collect()] == [(1, text, 1)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200, 300)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 200 for i in range(200, 301)} | {i: 1 for i in range(1, 60)}


# op8


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_dedup_groups(spark, corpus, bits):
    df = documents(spark, corpus).withColumn("kept", F.lit(1))
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in exact_dedup.equal_texts(df, bits=bits).collect()}
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in corpus]
    for i, t in enumerate(low):
        same = [j for j, x in enumerate(low) if x == t]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_ties_and_chunks(spark):
    df = spark.createDataFrame([(1, "A"), (1, "a"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.equal_texts(df).collect()]
    assert sorted(g[2] for g in got) == [2, 2, 3, 3, 3] and sum(g[3] for g in got) == 2
    assert exact_dedup.equal_texts(df.limit(0)).count() == 0
    data = prose(random.Random(1), 60_000).encode() + b"a" * 100_000
    cut = exact_dedup.chunks(data)
    assert b"".join(cut) == data and max(map(len, cut)) <= exact_dedup.MOST
    moved = exact_dedup.chunks(b"inserted" + data)
    assert len(set(cut) & set(moved)) > len(set(cut)) * 0.8


# op9


def test_license_scan(spark):
    texts = [
        "Intro line\nReleased under the MIT License.\nmore text here", "licensed under the APACHE license version 2.0", "Released under the MIT License", None, "", "word", "All rights reserved.\n" + "lorem ipsum " * 50,
        "This work is licensed under the GNU General Public License, version 3.", "nothing of the kind is said here",
    ]
    df = documents(spark, texts).withColumn("line", F.lit(1))
    got = {(r["id"], r["line"]): r["license"] for r in license_scan.scan_licenses(df).collect()}
    assert got == {(0, 1): "mit", (1, 0): "apache-2.0", (2, 0): "mit", (6, 0): "all-rights-reserved", (7, 0): "gpl-3.0"}
    dice = {r["id"]: r["dice"] for r in license_scan.scan_licenses(df).collect()}
    assert dice[7] == 1.0
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


# op10


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from brightloom.llm.langid import fit_documents, identify

    model = fit_documents(docs)
    seen = identify(docs.withColumn("score", F.lit("old")).where(langid.held_out(F.col("doc_id"))), model)
    right, n = seen.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n >= 0.98
    odd = spark.createDataFrame([(1, None, "x"), (2, "123 !?", "y"), (3, "", "z")], "doc_id long, text string, lang_pred string")
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in identify(odd, model).collect()} == {("und", 0.0, True)}
    assert identify(odd, model, certain_only=True).count() == 0 and identify(odd.limit(0), model).count() == 0


def test_language_id_equals_brute_force_and_flags_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").withColumn("_", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("a.b", F.lit(3))
    rows = docs.select("text", "lang").collect()
    predict = brute.language_model([tuple(r) for r in rows])
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        lang, score, doubt = predict(r["text"])
        assert (r["lang_pred"], r["ambiguous"]) == (lang, doubt) and r["score"] == pytest.approx(score, abs=1e-6)
    texts = {}
    for t, lang in rows:
        if t and len(t) > 400:
            texts.setdefault(lang, []).append(t[:400])
    pairs = [(x, y) for a in sorted(texts) for b in sorted(texts) if a < b for x, y in zip(texts[a], texts[b])]
    assert len(pairs) > 20 and sum(model.predict(f"{x} {y}")[2] for x, y in pairs) > 0.9 * len(pairs)
    clean = [t for lang in texts for t in texts[lang]]
    assert sum(model.predict(t)[2] for t in clean) <= 0.01 * len(clean)


def test_language_id_with_few_and_many_languages(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("hello there", None), ("der die das", "de")])]
    one = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert one.predict("anything")[:2] == ("de", 1.0)
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.predict("anything")[0] == "und"
    code = langid.codewords(40).astype(int)
    gaps = (code.shape[1] - code @ code.T) // 2
    assert min(gaps[i][j] for i in range(40) for j in range(i)) >= 10


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(1), 500)
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert (langid.ngram_counts(text) == whole).all()
