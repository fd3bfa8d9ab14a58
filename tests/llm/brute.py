"""Plain versions of the operators, for small fixtures."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeated_words(rows, window):
    """{row number: (words, removed positions)} for rows (id, text)."""
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for _, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((w, gone))
    return out


def fingerprint(text, width):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(w)
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(rows, width, bits):
    """{id: (fingerprint, least id reachable)} for rows (id, text) of unique ids."""
    fps = {i: fingerprint(t, width) for i, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= bits]
    return {i: (fps[i], c) for i, c in components(pairs, ids).items()}


def keep_lines(rows, width=3):
    """{id: text} after later occurrences of windows of lines are cut, for rows (id, text) of unique ids."""
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(rows):
        lines = t.split("\n")
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if not "".join(w).strip(" \t\n\r\f\v"):
                continue
            if w in seen:
                gone[i].update(range(p, p + width))
            seen.add(w)
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}, gone


def shingles(text, width=5):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def contained(docs, items, width=5, threshold=0.8):
    """{(doc, item): containment}; an item of fewer words is one shingle."""
    out = {}
    for i, x in items:
        k = min(width, len(re.sub(r"[\W_]+", " ", (x or "").lower()).split()))
        n = shingles(x, k) if k else set()
        for d, t in docs:
            if n and len(n & (s := shingles(t, k))) >= math.ceil(round(len(n) * threshold, 6)):
                out[d, i] = len(n & s) / len(n)
    return out


def mixed(rows, weights=(3, 1, 2), ratio=1.5, most=2):
    """{id: (size, target, taken)} for rows (id, text, source) of unique ids."""
    size = {i: len(words(t)) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, level = set(), 0.0
    while True:
        rest = sum(w[s] for s in order if s not in capped)
        if not rest:
            break
        level = (ratio * sum(total.values()) - sum(most * total[s] for s in capped)) / rest
        more = {s for s in order if s not in capped and w[s] * level > most * total[s]}
        if not more:
            break
        capped |= more
    target = {s: min(most * total[s], w[s] * level) for s in order}
    out = {}
    for s in order:
        groups = defaultdict(list)
        for i, _, x in rows:
            if x == s:
                groups[int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)].append(i)
        taken = Counter()
        for p in range(most):
            budget, before = min(target[s] - p * total[s], total[s]), 0
            if budget <= 0:
                continue
            for h in sorted(groups):
                g = sum(size[i] for i in groups[h])
                if 2 * before + g <= 2 * budget:
                    for i in groups[h]:
                        taken[i] += size[i]
                before += g
        out |= {i: (size[i], target[s], taken[i]) for _, ids in groups.items() for i in ids}
    return out


def ngram_buckets(text):
    """Counter of the buckets (2 ** 14) of n-grams of 1 to 4 bytes."""
    raw = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in f" {text} ".lower().encode("utf-8", "replace"))
    out = Counter()
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            out[(int.from_bytes(raw[i : i + n], "big") + n * 0x9E3779B1) * 2654435761 % 2**32 >> 18] += 1
    return out


def language_model(rows):
    """A function from a text to (language, score, ambiguous), learned from rows (text, lang) of two to seven languages."""
    has_letter = lambda t: any(c.isalpha() for c in t or "")
    counts = defaultdict(Counter)
    for t, lang in rows:
        if lang is not None and has_letter(t):
            counts[lang] += ngram_buckets(t)
    langs, size = sorted(counts), 2**14
    rates = {}
    for x in langs:
        total = sum(counts[x].values()) + size / 2
        rates[x] = [(counts[x][b] + 0.5) / total for b in range(size)]
    bits = []
    for mask in range(2 ** (len(langs) - 1) - 1):  # every way to set some languages apart from the first
        sign = {x: 1 if i == 0 or mask >> (i - 1) & 1 else -1 for i, x in enumerate(langs)}
        sides = [[sum(rates[x][b] for x in langs if sign[x] == s) / sum(sign[x] == s for x in langs) for b in range(size)] for s in (1, -1)]
        weight = [math.log(y / n) for y, n in zip(*sides)]
        mean = {x: sum(r * w for r, w in zip(rates[x], weight)) for x in langs}
        up, down = (sum(mean[x] for x in langs if sign[x] == s) / sum(sign[x] == s for x in langs) for s in (1, -1))
        bits.append((sign, weight, mean, (up + down) / 2, (up - down) / 2, sum((y - n) * w for y, n, w in zip(*sides, weight))))
    distance = min(sum(b[0][x] != b[0][y] for b in bits) for x in langs for y in langs if x < y)
    scale = 6.0 / distance / (sum(b[5] for b in bits) / len(bits))

    def losses(means):
        return {x: sum(b[5] * scale * math.log1p(math.exp(-b[0][x] * (m - b[3]) / b[4])) for b, m in zip(bits, means)) for x in langs}

    def lead(loss, x):
        return min(v for y, v in loss.items() if y != x) - loss[x]

    own = {x: max(0.0, lead(losses([b[2][x] for b in bits]), x)) for x in langs}

    def predict(text):
        if not has_letter(text):
            return "und", 0.0, True
        found = ngram_buckets(text)
        n = sum(found.values())
        means = [b[3] + n / (n + 8) * (sum(c * b[1][k] for k, c in found.items()) / n - b[3]) for b in bits]
        loss = losses(means)
        best = min(langs, key=lambda x: loss[x])
        return best, 1 / sum(math.exp(loss[best] - v) for v in loss.values()), lead(loss, best) < 0.35 * own[best]

    return predict


def jaccard_sets(text, width=5):
    """Word shingles (A-Z lower-cased) of text; of a shorter text all its words."""
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_at(rows, similarity=0.8):
    """{id: least id reachable} for rows (id, text) of unique ids, linked at that Jaccard similarity of shingles or more."""
    sets = {i: jaccard_sets(t) for i, t in rows}
    ids = sorted(sets)
    return components([(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= similarity], ids)
