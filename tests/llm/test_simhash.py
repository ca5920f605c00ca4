"""SimHash fingerprints, links and components against all pairs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    group = {f: f for f in fps}
    order = list(group)
    changed = True
    near = [(a, b) for i, a in enumerate(order) for b in order[:i] if (a ^ b).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            low = min(group[a], group[b])
            changed |= group[a] != group[b]
            group[a] = group[b] = low
    return group


def check(rows, got):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = plain_components(set(fps))
    first = {}
    for (d, _), f in zip(rows, fps, strict=True):
        g = group[f]
        first[g] = d if first.get(g) is None else first[g] if d is None else min(d, first[g])
    want = Counter((d, f"{f:016x}", first[group[f]]) for (d, _), f in zip(rows, fps, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    return group, fps


def test_near_duplicates(spark):
    from assayer.llm.simhash import near_duplicates, one_of_each

    random = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(300)])
    base = [list(random.choice(words, 150)) for _ in range(25)]
    rows = [(None, None), (3, ""), (2, " \n\t"), (7, "one"), (8, "One two"), (5, "ONE TWO"), (None, "alone by null id text"), (9, "é ß 日本 😀 x"), (9, "é ß 日本 😀 x")]
    for k, b in enumerate(base):
        for copy in range(12):
            c = list(b)
            for _ in range(copy // 2):
                c[int(random.integers(150))] = str(random.choice(words))
            rows.append((1000 + 12 * k + (7 * copy) % 12, " ".join(c)))
    docs = spark.createDataFrame([(d, t, "clash", None) for d, t in rows], "doc_id long, text string, fingerprint string, fp string").repartition(5)
    group, fps = check(rows, near_duplicates(docs).collect())
    assert 5 < len(set(group.values())) < len(set(fps))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    plain = [plain_fingerprint(r["text"]) for r in kept.collect()]
    assert Counter(group[f] for f in plain) == Counter(set(group.values()))
    ids = [r["doc_id"] for r in kept.collect()]
    best = {}
    for (d, _), f in zip(rows, fps, strict=True):
        best.setdefault(group[f], []).append(d)
    assert sorted(map(str, ids)) == sorted(str(min((x for x in ds if x is not None), default=None)) for ds in best.values())
    assert near_duplicates(docs.where(F.lit(False))).collect() == [] and one_of_each(docs.where(F.lit(False))).collect() == []


def test_links_lose_none_in_crowds(spark, monkeypatch):
    """Fingerprints around a few centres, so that keys are crowded: components equal those of all pairs."""
    from assayer.llm import simhash
    from assayer.llm.components import components

    monkeypatch.setattr(simhash, "CROWD", 8)
    random = np.random.default_rng(2)
    fps = set()
    for centre in random.integers(0, 1 << 63, 6).tolist():
        for _ in range(120):
            fps.add(centre ^ sum(1 << int(b) for b in random.choice(64, int(random.integers(0, 7)), replace=False)))
    fps |= {int(x) for x in random.integers(0, 1 << 63, 100)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(frame)
    assert edges.count() <= 80 * len(fps)
    got = {r["node"]: r["component"] for r in components(frame.withColumnRenamed("fp", "node"), edges).collect()}
    want = plain_components(fps)
    sets = lambda g: {frozenset(k for k in g if g[k] == c) for c in set(g.values())}
    assert sets(got) == {frozenset(map(signed, s)) for s in sets(want)}


def test_components_of_a_long_path_and_a_hub(spark):
    from assayer.llm.components import components

    nodes = spark.range(0, 700).toDF("node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500 + i) for i in range(1, 150)] + [(500, 501), (660, 660)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(nodes, edges).collect()}
    assert all(got[i] == (0 if i <= 300 else 500 if 500 <= i < 650 else i) for i in range(700))
