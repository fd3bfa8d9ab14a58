"""License sentences inside longer lines and wrapped over lines."""

import math
import random
import re
import time

import pytest

from brightloom.llm import license_scan
from tests.llm.test_operators import documents

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""


def test_windows_over_lines_and_inside_lines(spark):
    texts = [
        MIT, " ".join(MIT.split()), "Some words of prose here. Released under the MIT License. More words of prose.",
        "Prose before.\nThis work is licensed under the\nGNU General Public License,\nversion 3. Prose after it goes on for a while.\n" + "lorem ipsum " * 30,
        "One. All rights reserved. Two words between them. All rights reserved. End of it.", "rights of all reserved under the license of the work", None, "",
        "Prose.\nReleased under the MIT License.\nand more prose, all rights reserved, in a line that is long",
    ]
    got = sorted((r["id"], r["line"], r["license"]) for r in license_scan.scan_licenses(documents(spark, texts)).collect())
    assert got == [
        (0, 2, "mit-notice"), (1, 0, "mit-notice"), (2, 0, "mit"), (3, 1, "gpl-3.0"), (4, 0, "all-rights-reserved"), (4, 0, "all-rights-reserved"), (8, 1, "mit"), (8, 2, "all-rights-reserved"),
    ]


def test_very_long_text_and_clashing_names(spark):
    """A notice wrapped over lines in the middle of a long text, next to columns of the operator's own names."""
    body = "\n".join(f"w{i} w{i * 7 % 1000} w{i * 3 % 1000}" for i in range(30_000))
    text = f"{body}\nsome words. Released under\nthe MIT\nLicense. more words\n{body}"
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, None, 1, 2, 3), (2, "Released under the MIT License.", 1, 2, 3), (2, "Released under the MIT License.", 1, 2, 3)], "doc_id long, text string, line int, whole int, `a.b` int")
    got = sorted((r["id"], r["line"], r["license"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(1, 30_000, "mit"), (2, 0, "mit"), (2, 0, "mit")]


def plain_words(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def plain_scan(text, templates, t):
    """[(line, license, dice)]: every line, the whole text, and windows of words by loops over all starts and ends."""
    if text is None:
        return []
    grams = {name: of for name, x in templates.items() if (of := set(license_scan.template_bigrams(x)))}
    pairs = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])}
    rate = lambda g, of: 2.0 * len(g & of) / (len(g) + len(of))

    def best(g):
        fits = [(rate(g, of), name) for name, of in grams.items() if t / (2 - t) * len(of) <= len(g) <= (2 - t) / t * len(of) and rate(g, of) >= t]
        return min(fits, key=lambda x: (-x[0], x[1]), default=None)

    lines = text.split("\n")
    hits = {i: b for i, x in enumerate(lines) if (b := best(pairs(plain_words(x))))}
    whole = best(pairs(plain_words(text))) if len(lines) > 1 else None
    words = [(w, i) for i, x in enumerate(lines) for w in plain_words(x)]
    row = [f"{a[0]} {b[0]}" for a, b in zip(words, words[1:])]
    fits = []
    for name, of in grams.items():
        low, high = math.ceil(t / (2 - t) * len(of) - 1e-9), math.floor((2 - t) / t * len(of) + 1e-9)
        seeds = [i for i, g in enumerate(row) if g in of]
        for i in seeds:
            ends = [(rate(set(row[i : j + 1]), of), -j) for j in seeds if low <= j - i + 1 <= high]
            if ends and max(ends)[0] >= t:
                d, j = max(ends)
                fits.append((i, name, d, 1 - j, words[i][1], words[1 - j][1]))
    kept = []
    for x in sorted(fits):
        if not kept or x[0] > kept[-1][3]:
            kept.append(x)
        elif x[2] > kept[-1][2]:
            kept[-1] = x
    free = [x for x in kept if not whole and not any(i in hits for i in range(x[4], x[5] + 1))]
    return [(i, n, d) for i, (d, n) in hits.items()] + ([(-1, whole[1], whole[0])] if whole else []) + [(x[4], x[1], x[2]) for x in free]


@pytest.mark.parametrize("block", [256, 2])
def test_windows_equal_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(license_scan, "BLOCK", block)
    rng = random.Random(8)
    templates = {"one": "alpha beta gamma delta epsilon zeta", "two": "beta gamma delta", "three": "alpha beta", "lone": "word"}
    say = lambda: rng.choice(["alpha beta gamma delta epsilon zeta", "alpha beta gamma eta epsilon zeta", "beta gamma delta", "alpha beta", "alpha", "gamma delta", "Alpha, beta;", "noise", "other words", "\n", "\n\n", "beta"])
    texts = [" ".join(say() for _ in range(rng.randrange(1, 40))) for _ in range(60)] + [None, "", "\n", "alpha beta " * 40, "alpha beta gamma delta epsilon zeta noise\n" * 3]
    for t in (0.8, 0.5):
        got = [(r.id, r.line, r.license, round(r.dice, 9)) for r in license_scan.scan_licenses(documents(spark, texts), templates=templates, threshold=t).collect()]
        want = [(i, line, n, round(d, 9)) for i, x in enumerate(texts) for line, n, d in plain_scan(x, templates, t)]
        assert sorted(got) == sorted(want)
        assert len(got) > 40


def test_repeated_licences_in_one_text_take_linear_time(spark):
    scan = lambda n: license_scan.scan_licenses(documents(spark, ["All rights reserved. and some " * n])).count()
    assert scan(10) == 10
    began = time.perf_counter()
    assert scan(20_000) == 20_000
    assert time.perf_counter() - began < 30  # by the square it would take an hour


def test_no_templates_and_known_notices(spark):
    docs = documents(spark, ["x\nLicensed under the EUPL, Version 1.2 or later\ny", license_scan.TEMPLATES["gpl-3.0-notice"].replace("redistribute it", "\nredistribute it"), None])
    assert license_scan.scan_licenses(docs, templates={}).count() == 0
    assert license_scan.scan_licenses(docs, templates={"a": "word"}).collect() == []
    assert {(r.id, r.license) for r in license_scan.scan_licenses(docs).collect()} == {(0, "eupl-1.2"), (1, "gpl-3.0-notice")}
