"""Decontamination against brute-force edit distances, and the recall of the hashing."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F


def substring_edits(item, words):
    """Least edits between the item and any run of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_nearest_is_the_edit_distance():
    from assayer.llm.decontaminate import nearest

    random = np.random.default_rng(4)
    for _ in range(400):
        item = random.integers(0, 6, int(random.integers(1, 20))).tolist()
        window = random.integers(0, 6, int(random.integers(0, 30))).tolist()
        best = substring_edits(item, window)
        got = nearest(item, window, len(item))
        assert got[0] == best and 0 <= got[1] <= got[2] <= len(window)
        assert substring_edits(item, window[got[1] : got[2]]) == best
        assert nearest(item, window, best - 1) is None


def test_contamination_against_all_windows(spark):
    from assayer.llm.decontaminate import contamination, edits, uncontaminated

    random = np.random.default_rng(8)
    vocabulary = np.array([f"v{i}" for i in range(400)])
    weights = 1 / np.arange(1, 401)
    draw = lambda n: [str(w) for w in random.choice(vocabulary, n, p=weights / weights.sum())]
    items = [draw(int(n)) for n in random.integers(13, 60, 40)] + [["too", "few", "words"], ["just", "five", "words", "in", "it"]]

    def changed(item, n):
        out = list(item)
        for _ in range(n):
            at = int(random.integers(len(out)))
            kind = int(random.integers(3))
            if kind == 0:
                out[at] = "new"
            elif kind == 1:
                out.insert(at, "more")
            else:
                del out[at]
        return out

    rows, planted = [(None, None), (1, ""), (2, " \n"), (3, "short text"), (3, "short text")], []
    for k in range(300):
        words = draw(int(random.integers(30, 200)))
        if k % 2:
            which = int(random.integers(40))
            n = int(random.integers(0, edits(len(items[which])) + 3))
            at = int(random.integers(len(words)))
            words[at:at] = [w.upper() for w in changed(items[which], n)]
        rows.append((10 + k, " ".join(words)))
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w), "clash") for i, w in enumerate(items)] + [(None, None, None), (99, "", None)], "item_id long, text string, doc_id string")
    want = set()
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for i, item in enumerate(items):
            if len(item) >= 5 and words and substring_edits(item, words) <= edits(len(item)):
                want.add((d, i))
    got = contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} <= want and len(got) <= len(want)
    assert len(got) >= 0.98 * len(want) and len(want) > 80
    exact = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    by_id = dict(rows)
    for (d, i), n in exact.items():
        assert n == substring_edits(items[i], by_id[d].lower().split())
    clean = uncontaminated(docs, bench)
    assert clean.columns == docs.columns
    hit = {d for d, _ in exact}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in hit)
    assert contamination(docs.where(F.lit(False)), bench).collect() == [] and uncontaminated(docs, bench.where(F.lit(False))).count() == len(rows)
    assert contamination(docs, bench.where(F.lit(False))).collect() == []


def test_blocks_find_the_same(spark):
    from assayer.llm import decontaminate as d

    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(10)], "item_id long, text string")
    assert sum(1 for _ in d.item_blocks(items, most=60)) == 4
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), "text", F.lit(" behind it")).alias("text"))
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], r["end_word"]) for r in d.contamination(docs, items).collect()) == [(i, i, 2, 22) for i in range(10)]


def test_short_items_stand_word_for_word(spark):
    from assayer.llm import decontaminate as d

    items = [(0, "alpha"), (1, "beta gamma"), (2, "one two three four"), (3, "One  TWO three\nfour"), (4, " \t"), (5, None), (6, "five words are enough here")]
    rows = [(0, "x alpha y Alpha"), (1, "beta, gamma"), (2, "beta\n\tGAMMA beta gamma"), (3, "one two three"), (3, "four alphabet"), (4, "zero one two three four five"),
            (5, ""), (6, None), (7, "gamma beta"), (8, "alpha"), (8, "alpha"), (9, "five words are enough"), (10, "x five words are enough here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = []
    for doc, text in rows:
        words = (text or "").lower().split()
        for i, item in items:
            phrase = (item or "").lower().split()
            at = [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]
            if 0 < len(phrase) < 5 and at:
                want.append((doc, i, 0, at[0], at[0] + len(phrase)))
    got = [(r["doc_id"], r["item_id"], r["edits"], r["first_word"], r["end_word"]) for r in d.contamination(docs, bench).collect()]
    assert sorted(g for g in got if g[1] != 6) == sorted(want) and len(want) == 6
    assert sorted(g[0] for g in got if g[1] == 6) == [9, 10]
    assert sorted(r["doc_id"] for r in d.uncontaminated(docs, bench).collect()) == [1, 3, 3, 5, 6, 7]
    only = bench.where("item_id < 4")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contamination(docs, only).collect()) == sorted(w[:2] for w in want)


def test_every_length_of_a_block_has_its_repetitions():
    from assayer.llm.decontaminate import Index, repetition_steps

    random = np.random.default_rng(1)
    for sizes in ([9, 10], [14, 15, 40], [19, 20], [3, 100]):
        items = [(i, random.integers(1, 1 << 60, n).astype(np.uint64)) for i, n in enumerate(sizes)]
        assert len(Index.of(items).steps) == max(len(repetition_steps(n)) for n in sizes if n >= 5)


def test_a_round_without_candidates_finds_nothing(spark):
    from assayer.llm.decontaminate import contamination

    bench = spark.createDataFrame([(1, "five words are enough here")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["nothing of it", "", None, "quite another text"])], "doc_id long, text string").repartition(4)
    assert contamination(docs, bench).collect() == []
