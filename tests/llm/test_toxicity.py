"""Toxicity scores: held-out accuracy on planted words, what is never read, and the edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def corpus(n):
    random = np.random.default_rng(21)
    clean = np.array([f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con", "sec") for b in ("em", "um", "or", "at", "et", "ti", "ra")])
    foul = np.array(["grunk", "snarfle", "blortish", "zwackig"])
    docs, labels = [], []
    for k in range(n):
        words = [str(w) for w in random.choice(clean, int(random.integers(10, 80)))]
        toxic = random.random() < 0.25
        if toxic:
            for _ in range(3):
                words[int(random.integers(len(words)))] = str(random.choice(foul))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    from assayer.llm.toxicity import fit

    docs, labels = corpus(900)
    # labels of held-out rows are turned round: a model that learnt from them would show it
    taught = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels] + [(None, 1), (5, None), (10**9, 1)]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, score string, fold string").repartition(4)
    return docs, dict(labels), frame, fit(frame, spark.createDataFrame(taught, "doc_id long, toxic int"))


def test_held_out_accuracy(spark, fitted):
    docs, labels, frame, model = fitted
    got = model.score(frame)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    assert {t.rstrip("$")[:3] for t in model.lexicon} >= {"gru", "sna", "blo", "zwa"}
    brier = sum((r["score"] - labels[r["doc_id"]]) ** 2 for r in held) / len(held)
    assert brier < 0.05


def test_only_the_text_counts(spark, fitted):
    docs, _, _, model = fitted
    texts = [None, "", " \n", "grunk", "you grunk! snarfle grunk", "x" * 300000 + " grunk snarfle blortish zwackig", docs[3][1], docs[3][1]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, docs[3][1])]
    got = {(r["doc_id"]): r for r in model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] and got[6]["score"] == got[7]["score"] == got[None]["score"]
    assert got[4]["predicted"] == 1 and got[None]["held_out"] is False
    assert model.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_without_labels(spark):
    from assayer.llm.toxicity import fit

    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).score(docs).collect()
    assert [r["score"] for r in none] == [0.0, 0.0]
    learnt = [k for k in range(50) if zlib.crc32(str(k).encode()) % 3 != 1][:4]
    one_class = docs.sparkSession.createDataFrame([(k, "text") for k in learnt], "doc_id long, text string")
    ones = fit(one_class, one_class.select("doc_id", F.lit(1).alias("toxic"))).score(docs).collect()
    assert [r["score"] for r in ones] == [1.0, 1.0]


def test_features_of_form():
    from assayer.llm.toxicity import FEATURES, Weights, features

    weights = Weights({"idiot$": 5.0, "mor": 3.0})
    got = dict(zip(FEATURES, features("You are an IDIOT, you m0ron!! i d i o t", weights), strict=True))
    assert got["density"] == 1 / 11 and got["max_weight"] == 5.0 and got["near_second_person"] == 1.0
    assert got["obfuscated"] == 2 / 11 and got["obfuscated_weight"] == 5.0 and got["repeated_marks"] == 1 / 11 and got["capital_words"] == 1 / 11
    assert features("", weights) == [0.0] * len(FEATURES)
