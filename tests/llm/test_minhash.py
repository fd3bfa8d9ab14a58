"""Near copies of the pipeline's stage against brute-force Jaccard similarity."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from brightloom.llm import minhash
from tests.llm import brute
from tests.llm.test_operators import documents, prose


def copies(rng, n, length, changes):
    """Texts in pairs of which the second has words replaced."""
    out = []
    for _ in range(n):
        w = prose(rng, length).split()
        out.append(" ".join(w))
        for at in rng.sample(range(length), changes):
            w[at] = "changed"
        out.append(" ".join(w))
    return out


def test_recall_of_near_copies(spark):
    rng = random.Random(3)
    texts = [t for changes in (1, 2, 3, 4, 5, 6) for t in copies(rng, 40, 200, changes)]
    sets = [brute.jaccard_sets(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if brute.jaccard(sets[a], sets[b]) >= 0.8]
    want = brute.components(near, range(len(texts)))
    assert 100 < len(near) < 240  # some of the copies are below 0.8
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), "").collect()}
    assert kept >= {i for i in want if want[i] == i}  # nothing below 0.8 goes
    found = sum(b not in kept for _, b in near) / len(near)
    assert found >= 0.98, found


def test_hot_key_is_linked_by_its_hub(spark):
    rng = random.Random(4)
    base = prose(rng, 150).split()
    texts = [" ".join(base)] + [" ".join([*base[:at], f"x{at}", *base[at + 1 :]]) for at in range(0, 150)]
    texts += [prose(rng, 150)]
    df = documents(spark, texts)
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(df, group=4).collect()) == [0, 151]
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [5, 1000])
def test_groups_of_any_size_lose_no_pair_that_shares_a_key(spark, group):
    """Near and far kin of one text: what is far from a hub still finds its own near copies."""
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
    sets = [brute.jaccard_sets(t) for t in texts]
    keys = [set(enumerate(minhash.band_keys(minhash.shingle_hashes(t, 5)))) for t in texts]
    n = range(len(texts))
    near = [(a, b) for a, b in combinations(n, 2) if brute.jaccard(sets[a], sets[b]) >= 0.8 and keys[a] & keys[b]]
    want = brute.components(near, n)
    assert 5 < len(set(want.values())) < len(texts) - 10
    got = {r["id"]: r["component"] for r in minhash.near_components(documents(spark, texts), group=group).collect()}
    assert got == want
