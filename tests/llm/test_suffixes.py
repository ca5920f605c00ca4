"""Removal of repeated strings against a plain suffix comparison, and the merge against sorting."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F


def plain(rows):
    """Expected rows: documents in corpus order, each SPAN-byte string checked against all earlier starts."""
    import xxhash

    signed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    order = sorted({(d is None, d or 0, signed(t), (t or "").encode()) for d, t in rows})
    seen, out = set(), {}
    for null, d, _, raw in order:
        mark = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            piece = raw[s : s + 100]
            if piece in seen:
                mark[s : s + 100] = True
            seen.add(piece)
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        runs = int(((mark[1:] & ~mark[:-1]).sum() + mark[0]) if len(mark) else 0)
        out[(None if null else d, raw)] = (len(raw), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest())
    return Counter((d, *out[(d, (t or "").encode())]) for d, t in rows)


def corpus(seed):
    random = np.random.default_rng(seed)
    letters = np.array(list("abcdeé "))
    draw = lambda n: "".join(random.choice(letters, n))
    passages = [draw(int(n)) for n in (90, 99, 100, 101, 130, 180, 400)]
    rows = []
    for k in range(160):
        parts = [draw(int(random.integers(0, 150)))]
        for _ in range(int(random.integers(0, 4))):
            p = passages[int(random.integers(len(passages)))]
            if random.random() < 0.3:
                cut = int(random.integers(len(p)))
                p = p[:cut] + draw(1) + p[cut + 1 :]
            parts += [p, draw(int(random.integers(0, 60)))]
        rows.append((k, "".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(0, 40, 5)]
    rows += [(300, "x" * 700), (301, "x" * 350 + "y" + "x" * 120), (302, "ab" * 300), (303, None), (304, ""), (305, "é" * 80), (None, rows[3][1]), (None, rows[3][1]), (None, draw(300))]
    rows += [(7, rows[9][1] + "other text under one id"), (8, rows[8][1]), (306, draw(5000) + passages[6] + passages[6])]
    return rows


def test_removal(spark):
    from assayer.llm.suffixes import remove_repeats

    rows = corpus(1)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, kept_sha256 string, r int").repartition(3)
    got = remove_repeats(docs)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()) == plain(rows)
    assert remove_repeats(docs.where(F.lit(False))).collect() == []


def test_crowded_cores(spark):
    """The same when all cores with several regions are told apart string by string, and when only some are."""
    from assayer.llm.suffixes import remove_repeats

    for crowd in (0, 6):
        rows = corpus(2 + crowd)
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
        assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()) == plain(rows)


def test_kept_text(spark):
    from assayer.llm.suffixes import remove_repeats

    passage = "".join(f"part {i} of it, " for i in range(12))
    rows = [(2, "before " + passage + "after"), (1, passage), (3, "nothing repeated here")]
    got = {r["doc_id"]: r["kept"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == {1: passage, 2: "before after", 3: "nothing repeated here"}


def test_loser_tree_sorts_and_knows_prefixes():
    from assayer.llm.suffixes import _common, front_coded, merged, spelled

    random = np.random.default_rng(6)
    for n in (1, 2, 3, 7, 16):
        runs, every = [], []
        for _ in range(n):
            entries = sorted((int(random.integers(3)), bytes(random.choice(list(b"ab"), int(random.integers(0, 9))).astype(np.uint8))) for _ in range(int(random.integers(0, 30))))
            cores, rights = [c for c, _ in entries], [r for _, r in entries]
            shared, sizes, rests = front_coded(np.array(cores), rights)
            assert spelled(shared, sizes, rests) == rights
            runs.append((cores, rights, [0 if not i or cores[i] != cores[i - 1] else 1 + int(shared[i]) for i in range(len(cores))]))
            every += entries
        run, at, prefix = merged(runs)
        got = [(runs[r][0][i], runs[r][1][i]) for r, i in zip(run, at, strict=True)]
        assert got == sorted(every)
        assert prefix == [0 if not i or got[i][0] != got[i - 1][0] else 1 + _common(got[i][1], got[i - 1][1], 0) for i in range(len(got))]
