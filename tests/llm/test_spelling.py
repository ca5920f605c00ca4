"""Spelling variants against all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np


def plain_words(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def test_variants(spark):
    from assayer.llm.spelling import spelling_variants

    random = np.random.default_rng(6)
    letters = list("abcdeéß÷")
    rows = [(None, None), (1, ""), (2, " 12 .,"), (3, "Aaaaaaa aaaaaaaa AAAAAA aaaaaab baaaaaa " * 9), (None, "nobody's words nobody nobody nobody nobody nobody")]
    base = ["".join(random.choice(letters, int(random.integers(6, 11)))) for _ in range(60)]
    for k in range(400):
        words = []
        for _ in range(60):
            w = list(base[int(random.integers(60) ** 2 // 60)])
            if random.random() < 0.25:
                at = int(random.integers(len(w)))
                kind = int(random.integers(3))
                w[at : at + (kind != 0)] = [] if kind == 1 else [str(random.choice(letters[:4]))]
            w = "".join(w)
            words.append(w.upper() if w.isascii() and random.random() < 0.1 else w)
        rows.append((k, "-".join(words)))
    rows += [rows[9]] * 3
    # a chain: each form five times as frequent as the word before it
    chain = ["qwertyuiop", "qwertyuiopx", "qwertyuiopxy", "qwertyuiopxyz"]
    rows += [(5000 + i, " ".join([w] * (5 ** (i + 1)))) for i, w in enumerate(chain)]
    want = plain_variants(rows)
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, word string, n string").repartition(5)
    got = spelling_variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] not in (None, r[2]) for r in want)
    assert spelling_variants(frame.where("false")).collect() == []


def test_pivots_are_disjoint_and_rare():
    from assayer.llm.spelling import grams, prefix_and_pivots

    counts = Counter(g for w in ("banana", "bandana", "cabana", "savanna", "havana") for g in grams(w))
    for w in ("banana", "bandana", "cabana", "savanna", "havana"):
        prefix, (p, q) = prefix_and_pivots(w, counts)
        found = grams(w)
        assert q >= p + 2 and {p, q} <= set(prefix) and len(prefix) >= 3
        best = min(counts[found[i]] + counts[found[j]] for i in prefix for j in prefix if j >= i + 2)
        assert counts[found[p]] + counts[found[q]] == best


def test_flushes_change_nothing(spark, monkeypatch):
    from assayer.llm import spelling

    rows = [(k, f"alphabet alphabets alphabat word{k % 7} letter letters") for k in range(60)]
    want = sorted(plain_variants(rows), key=str)
    monkeypatch.setattr(spelling, "FLUSH", 3)
    assert sorted(map(tuple, spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_every_near_pair_shares_a_key():
    """All one-edit neighbours of random words: a pivot of one meets a prefix gram of the other."""
    from assayer.llm.spelling import grams, keys, prefix_and_pivots

    random = np.random.default_rng(7)
    for size in range(6, 15):
        for _ in range(12):
            w = "".join(random.choice(list("abc"), size))
            near = {w[:i] + w[i + 1 :] for i in range(size)} | {w[:i] + c + w[j:] for i in range(size + 1) for c in "abcd" for j in (i, i + 1)}
            near = {v for v in near if len(v) >= 6} - {w}
            counts = Counter(g for v in (near | {w}) for g in grams(v))
            signs = {v: prefix_and_pivots(v, counts) for v in near | {w}}
            held = {v: keys(v, signs[v][0], False) for v in signs}
            sought = {v: keys(v, signs[v][1], True) for v in signs}
            assert all(held[v] & sought[w] or held[w] & sought[v] for v in near)
