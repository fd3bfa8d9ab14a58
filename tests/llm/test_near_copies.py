"""The pipeline's near copies by SimHash against brute-force fingerprints and Jaccard similarity."""

import random
from itertools import combinations

import pytest
import xxhash

import corpus_pipeline
from brightloom.llm import near_copies
from tests.llm import brute
from tests.llm.test_minhash import copies
from tests.llm.test_operators import documents, prose


def plain_simhash(text):
    """First lane of the distinct five-word shingles; ties as the least hash has it."""
    w = text.lower().split()
    found = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))})
    score = [2 * sum(h >> b & 1 for h in found) + (found[0] >> b & 1) for b in range(64)]
    value = sum((s > len(found)) << b for b, s in enumerate(score))
    return value - (value >> 63 << 64)


def test_stage_compares_what_simhash_proposes(spark, monkeypatch):
    rng = random.Random(1)
    texts = copies(rng, 4, 80, 1) + [prose(rng, n) for n in (1, 5, 6, 80, 700)]
    seen, kept = [], near_copies.candidates
    monkeypatch.setattr(near_copies, "candidates", lambda keyed, *a: seen.append(keyed) or kept(keyed, *a))
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), "").collect()}
    assert left == {0, 2, 4, 6, 8, 9, 10, 11, 12}
    assert {r["s"] for r in seen[0].select("s").collect()} == set(map(plain_simhash, texts))
    monkeypatch.setattr(near_copies, "candidates", lambda keyed, *a: (kept(keyed, *a)[0].limit(0), kept(keyed, *a)[1].limit(0)))
    assert corpus_pipeline.near_dedup(spark, documents(spark, texts), "").count() == len(texts)  # nothing else proposes pairs


def test_first_lane_is_not_in_the_keys():
    bits, keys, most = near_copies.key_plan(10**6, 0.8)
    chosen = near_copies.key_bits(bits, most)
    assert bits == 16 and 64 < keys < most and chosen.shape == (most, bits)
    assert chosen.min() >= 64 and chosen.max() < 1024 and all(len(set(c)) == bits for c in chosen.tolist())


@pytest.mark.parametrize("length", [9, 30, 200])
def test_recall_at_the_similarity(spark, length):
    rng = random.Random(length)
    if length > 9:
        texts = [t for changes in ((1, 2, 3, 4) if length > 99 else (1,)) for t in copies(rng, 100, length, changes)]
    else:  # one word fewer at the end: four of five shingles
        texts = [t for _ in range(200) for t in [prose(rng, 9)] for t in (t, t.rsplit(" ", 1)[0])]
    sets = [brute.jaccard_sets(t) for t in texts]
    n = range(len(texts))
    near = [(a, b) for a, b in combinations(n, 2) if brute.jaccard(sets[a], sets[b]) >= 0.8]
    want = brute.components(near, n)
    got = {r["id"]: r["component"] for r in near_copies.near_components(documents(spark, texts)).collect()}
    assert len(near) >= 100 or length == 30
    found = sum(got[a] == got[b] for a, b in near) / max(1, len(near))
    assert found >= 0.98, found
    assert all(want[i] == want[c] for i, c in got.items())  # nothing below 0.8 is linked


@pytest.mark.parametrize("group", [4, 1000])
def test_keys_of_any_size(spark, group):
    """Many copies of one text, kin of it that are far, and other texts."""
    rng = random.Random(6)
    base, texts = prose(rng, 120).split(), []
    for kin in range(30):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 9)):
            w[at] = f"k{kin}x{at}"
        texts.append(" ".join(w))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(120)] = f"y{rng.random()}"
            texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(40)] + ["", " ", None]
    sets = [brute.jaccard_sets(t or "") for t in texts]
    n = range(len(texts))
    near = [(a, b) for a, b in combinations(n, 2) if (not sets[a] and not sets[b]) or (sets[a] and sets[b] and brute.jaccard(sets[a], sets[b]) >= 0.8)]
    want = brute.components(near, n)
    got = {r["id"]: r["component"] for r in near_copies.near_components(documents(spark, texts), group=group).collect()}
    assert got == want
