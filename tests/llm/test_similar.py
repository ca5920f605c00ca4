"""Near-duplicates of the pipeline stage against the exact Jaccard similarity of all pairs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_pairs(sets):
    """Pairs of different sets with a similarity of 0.8 or more, by an index of all shingles."""
    held, pairs = {}, Counter()
    for k, s in enumerate(sets):
        for x in s:
            pairs.update((j, k) for j in held.setdefault(x, []))
            held[x].append(k)
    return [(j, k) for (j, k), n in pairs.items() if 5 * n >= 4 * (len(sets[j]) + len(sets[k]) - n)]


def plain_kept(rows):
    sets = list(dict.fromkeys(plain_shingles(t) for _, t in rows))
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = plain_pairs(sets)
    for j, k in pairs:
        group[find(j)] = find(k)
    at = {s: find(i) for i, s in enumerate(sets)}
    first = {}
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(at[plain_shingles(row[1])], row)
    return Counter(first.values()), pairs


@pytest.mark.parametrize("cell", [1 << 18, 2000])
def test_similar_texts(spark, monkeypatch, cell):
    """Copies with a few edits, of which most differ by over three bits; small cells, so that groups are cut in parts."""
    from assayer.llm import similar
    from corpus_pipeline import near_duplicates

    monkeypatch.setattr(similar, "CELL", cell)
    random = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(500)])
    rows = [(None, None), (3, ""), (2, " \n\t"), (7, "one"), (8, "One two"), (5, "ONE TWO"), (9, "é ß 日本 😀 x"), (9, "é ß 日本 😀 x"), (None, "no id here at all to see")]
    for k in range(30):
        base = [str(w) for w in random.choice(words, 200)]
        for copy in range(8):
            c = list(base)
            for _ in range(copy // 2 + 1):
                c[int(random.integers(200))] = str(random.choice(words))
            rows.append((100 + 8 * k + (3 * copy) % 8, " ".join(c)))
    docs = spark.createDataFrame([(d, t, "clash", None, "kept", 7) for d, t in rows], "doc_id long, text string, component string, node string, __a string, __n int").repartition(5)
    want, pairs = plain_kept(rows)
    assert len(pairs) > 300
    kept = near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert all(r["__a"] == "kept" and r["__n"] == 7 and r["component"] == "clash" for r in kept.collect())
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect() if plain_shingles(r["text"])) == Counter({r: n for r, n in want.items() if plain_shingles(r[1])})
    assert sum(not plain_shingles(r["text"]) for r in kept.collect()) == 1
    assert near_duplicates(spark, docs.where("false"), "").collect() == []


def test_fingerprints_meet_through_pivot_tables(spark):
    """Sets without a common band key meet if their fingerprints differ in at most three bits, and by keys beyond that."""
    from assayer.llm.components import components
    from assayer.llm.similar import meetings

    random = np.random.default_rng(8)
    base = [int(x) for x in random.integers(-(1 << 63), 1 << 63, 40)]
    rows, want = [], {}
    for k, fp in enumerate(base):
        for j, bits in enumerate([(), (), (0,), (5, 21, 63), (1, 2, 3, 4)]):
            flipped = np.uint64(fp % (1 << 64))
            for b in bits:
                flipped ^= np.uint64(1 << (b + k) % 64)
            rows.append((10 * k + j, int(flipped.view(np.int64)), [1000 * k + j] + ([-k - 1] if j in (2, 4) and k % 2 else [])))
            want[10 * k + j] = 10 * k + (j if j == 4 and k % 2 == 0 else 0)
    nodes = spark.createDataFrame(rows, "node long, fp long, bands array<long>")
    found = {r["node"]: r["component"] for r in components(nodes.select("node"), meetings(nodes)).collect()}
    assert found == want
