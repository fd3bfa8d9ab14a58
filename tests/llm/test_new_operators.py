"""Spelling variants, document fingerprints and token alignment against brute force, and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from brightloom.llm import fingerprint_search, spelling, token_align

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(spark, name="documents"):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


# op11


def brute_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_equals_brute_force_on_documents(spark):
    found = spelled(spelling.op11_spelling(spark, SF))
    assert found == brute_groups(brute_words(rows_of(spark)))
    assert any(x[0] for x in found.values())


@pytest.mark.parametrize("group", [64, 2])
def test_near_words_equal_brute_force(spark, group):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    words = {w: rng.choice([1, 2, 5, 30, 200]) for w in [*base, *("aaaaaa" + c for c in "abcdefgh"), "listen", "silent", "enlist"]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert spelled(spelling.spelling_groups(df, group=group)) == brute_groups(words)


def test_spelling_takes_odd_rows(spark):
    rows = [(None, "Straße Straße"), (1, None), (2, ""), (3, "ABCDEF abcdef ÀBCDEF " * 3), (3, "ABCDEF abcdef ÀBCDEF " * 3), (4, "x" * 300_000), (5, "wörter" * 3), (6, "abc1def")]
    df = spark.createDataFrame(rows, "`a.b` long, `c d` string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    found = {r.word: r.n for r in spelling.word_counts(df, "a.b", "c d", least_n=1).collect()}
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    assert found == {w: n for w, n in count.items() if len(w) >= 6}
    assert spelling.spelling_groups(spelling.word_counts(df.limit(0), "a.b", "c d")).count() == 0


def test_long_chains_of_forms_lead_to_one_root(spark):
    words = {"a" * (6 + k): 5 * 6**k for k in range(9)}
    found = spelled(spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == brute_groups(words)
    assert {x[1] for x in found.values()} == {"a" * 14}


# op12


M = (1 << 64) - 1


def plain_pair(a, b):
    x = (a * 0x9E3779B97F4A7C15 + (b ^ b >> 29) * 0xC2B2AE3D27D4EB4F) & M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_fingerprint(text):
    w = [xxhash.xxh3_128_digest(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))]
    halves = lambda d: (int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little"))
    pairs = [b"".join(plain_pair(x, y).to_bytes(8, "little") for x, y in zip(halves(a), halves(b))) for a, b in zip(w, w[1:])]
    votes = [0] * 128
    for terms, factor in ((w, 1), (pairs, 2)):
        for d, n in Counter(terms).items():
            weight, h = factor * round(16 * (1 + math.log(n))), int.from_bytes(d)
            for b in range(128):
                votes[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(128) if votes[b] > 0)


def brute_probe(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)))
    return out


def test_edit_probe_equals_brute_force_over_partition_borders(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in rng.sample(range(-50, 400), 60)]
    rows += [(7, None), (7, "é" * 5), (7, "é" * 5), (None, "lost one here"), (None, None), (9, "  \n"), (11, "a b " * 40_000)]
    df = spark.createDataFrame(rows, "`x.id` long, text string").withColumn("part", F.lit(1)).withColumn("fp", F.lit(2)).repartition(5)
    found = fingerprint_search.edit_probe(df, "x.id").collect()
    got = sorted((str(r.id), r.n_chars, r.edited_sha256, int.from_bytes(r.fp), int.from_bytes(r.edited_fp)) for r in found)
    want = brute_probe(rows)
    assert got == sorted(x[:5] for x in want)
    like = lambda a, b: fingerprint_search.likeness(a.to_bytes(16), b.to_bytes(16))
    assert sorted((round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == sorted((round(like(x[3], x[4]), 9), round(like(x[3], x[5]), 9)) for x in want)
    assert fingerprint_search.edit_probe(df.limit(0), "x.id").count() == 0
    (only,) = fingerprint_search.edit_probe(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and only.near_next == 1


@pytest.mark.parametrize("radius,blocks,cell", [(3, 4, 2048), (3, 4, 3), (2, 5, 4), (0, 1, 2)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks, cell):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(128) for _ in range(20)]
    fps = [s ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(7))) for s in seeds for _ in range(15)] + seeds[:3] * 4 + [0, (1 << 128) - 1]
    df = spark.createDataFrame([(x.to_bytes(16),) for x in fps] + [(None,)], "fp binary")
    asked = spark.createDataFrame([(x.to_bytes(16),) for x in fps[::3]] + [(None,)], "fp binary")
    found = {int.from_bytes(r.fp): r.n_near for r in fingerprint_search.near_counts(df, asked, radius, blocks, cell).collect()}
    assert found == {q: sum((q ^ x).bit_count() <= radius for x in fps) for q in fps[::3]}


def test_fingerprints_of_documents(spark):
    found = {r.doc_id: r for r in fingerprint_search.op12_fingerprints(spark, SF).collect()}
    rows = rows_of(spark)
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == fps
    for i, r in found.items():
        assert r.n_near == (sum((fps[i] ^ x).bit_count() <= 3 for x in fps.values()) - 1 if i % 50 == 0 else None)
    # an edited text is nearer than the next document unless that is a copy
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    apart = [i for i, j in zip(order, order[1:]) if fps[i] != fps[j] and len(texts[i].split()) >= 30]
    assert sum(found[i].near_edited > found[i].near_next for i in apart) >= 0.98 * len(apart)


# op13

A, B = token_align.TOKENIZER_A, token_align.TOKENIZER_B
needs_files = pytest.mark.skipif(not (os.path.exists(A) and os.path.exists(B)), reason="no tokenizer files")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = token_align.byte_letters()

    def tokens(text):
        """Ids and bytes of both sides, or None."""
        if not text:
            return None
        ia, ib = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        return (ia, ib, ba, bb) if b"".join(ba) == b"".join(bb) == f" {text}".encode() else None

    return tokens


def brute_align(tools, texts):
    linked, groups, out, most = [], [], [], defaultdict(int)
    for t in texts:
        found = tools(t)
        if not found:
            linked.append([])
            groups.append("")
            out.append((0, 0, 0))
            continue
        ia, ib, ba, bb = found
        spans = [[], []]
        for side, parts in zip(spans, (ba, bb)):
            at = 0
            for p in parts:
                side.append((at, at + len(p)))
                at += len(p)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        shown, start = [], 0
        for end in both:
            inside = [[str(i) for i, (x, y) in zip(ids, side) if start <= x and y <= end] for ids, side in zip((ia, ib), spans)]
            shown.append("|".join(map(",".join, inside)))
            start = end
        linked.append([(x, y) for x, (p, q) in zip(ia, spans[0]) for y, (r, s) in zip(ib, spans[1]) if p < s and r < q])
        groups.append(";".join(shown))
        out.append((len(ia), len(ib), len(both)))
    count = Counter(p for links in linked for p in set(links))
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*o, len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), g) for o, x, g in zip(out, linked, groups)]


def scored(aligned, **more):
    frame = token_align.written(aligned)
    return token_align.score_links(frame, token_align.pair_counts(frame), **more)


@needs_files
@pytest.mark.parametrize("bound", [token_align.BROADCAST_PAIRS, 10])
def test_alignment_equals_brute_force(spark, tools, bound):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abeinost") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    texts += [None, "", " ", "\n\n\t x", "a▁b", "<s>a</s><|endoftext|> <unk>", "naïve Ⅷ ﬁ 日本語 😀 \u0000", "the " * 30, "the " * 30, "don't we'll 3,000 x", "​", "é́"]
    df = spark.createDataFrame(list(enumerate(texts)), "`d.id` long, text string").withColumn("row", F.lit(1)).withColumn("pair", F.lit("x"))
    found = {r.id: r for r in scored(token_align.align_tokens(df, "d.id"), broadcast_pairs=bound).collect()}
    for i, want in enumerate(brute_align(tools, texts)):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want, texts[i]
    assert scored(token_align.align_tokens(df.limit(0), "d.id")).count() == 0


@needs_files
def test_alignment_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string")
    found = scored(token_align.align_tokens(df)).collect()
    assert sorted((str(r.id), r.count_sum) for r in found) == [("1", 3 * r.n_links) for r in found if r.id == 1] + [("2", 0), ("None", 3 * max(r.n_links for r in found))]


@needs_files
def test_both_libraries_give_the_same_tokens():
    with open(A, "rb") as f:
        tool = token_align.load_tokenizer(A, f.read())
    assert tool.fast is not None
    chars = [chr(c) for c in [*range(1, 0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x30000, 61)]]
    for c in chars:
        text = f"a{c} b{c}{c}c 1{c}2 {c}\n{c}!"
        assert tool.fast.encode_ordinary(f" {text}") == tool.whole.encode(f" {text}", add_special_tokens=False).ids
    for text in ("x" * 50_000, " " * 50_000, "a \n" * 20_000):
        assert b"".join(map(tool.bytes.__getitem__, tool.encode(text))).decode() == f" {text}"


@needs_files
def test_alignment_of_documents(spark, tools):
    rows = rows_of(spark)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    short = [(i, t) for i, t in rows if len(t or "") < 1500]  # the brute force is quadratic
    df = spark.createDataFrame(short, "doc_id long, text string")
    want = {i: (*w[:6], digest(w[6])) for (i, _), w in zip(short, brute_align(tools, [t for _, t in short]))}
    frame = scored(token_align.align_tokens(df)).withColumn("d", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    assert {r.id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.d) for r in frame.collect()} == want
    assert token_align.op13_token_align(spark, SF).count() == len(rows)
