"""The pipeline, stage by stage, against plain Python on a small corpus."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import substring_edits
from tests.llm.test_similar import plain_kept
from tests.llm.test_text_maps import plain_quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(900)])
    item = [str(w) for w in random.choice(words, 25)]
    rows = []
    for k in range(120):
        body = [str(w) for w in random.choice(words, int(random.integers(20, 120)))]
        if k % 12 == 5:
            body[3:3] = item
        rows.append((k, " ".join(body), "en", f"src{k % 4}", 1))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(body), "en", None, None))
        if k % 10 == 1:
            rows.append((2000 + k, " ".join(body[:12] * 3), None, "src1", 1))
    rows += [(None, None, None, None, None), (5000, "", "en", "src0", 0), (5001, "few", "en", "src0", 3), (None, rows[9][1] + " and more", "en", "src9", 4)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, rows, item


def test_stages(spark, folder):
    import corpus_pipeline as p

    place, rows, item = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    frames = []
    for _, stage in p.STAGES:
        docs = p.written(stage(spark, docs, place), "test")
        frames.append(docs)
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in frames[:-1])
    kept = Counter(map(tuple, frames[0].collect()))
    want = [r for r in rows if not plain_quality(r[1])[-1]]
    assert kept == Counter(want)
    texts, pairs = plain_kept([(r[0], r[1]) for r in want])  # exact similarity of five-word shingles, components, smallest doc_id
    first = [r for r in want if (r[0], r[1]) in texts]
    assert pairs and sum(texts.values()) == len(first)
    single = Counter(map(tuple, frames[1].collect()))
    assert single == Counter(first)
    clean = Counter(map(tuple, frames[2].collect()))
    assert clean == Counter(r for r in first if substring_edits(item, r[1].split()) > 5)
    assert len(clean) < len(single) < len(kept)
    mixed = Counter(map(tuple, frames[3].collect()))
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    total = sum(len(r[1].split()) for r in clean)
    assert abs(sum(n * len(r[1].split()) for r, n in mixed.items()) - 1.5 * total) <= 0.1 * total
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = frames[4].collect()
    ids = lambda t: library.encode(t, add_special_tokens=False).ids + [2]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in final) == Counter({(r[0], len(ids(r[1])), crc(r[1])): n for r, n in mixed.items()})
    ran = Counter(map(tuple, p.run(spark, place).collect()))
    assert ran == Counter(map(tuple, final))


def test_mix_does_not_depend_on_partitions(spark):
    """Rows that differ in a column beside id and text only: the same ones are taken for any partitioning."""
    from assayer.llm.mixing import mixed_documents

    rows = [(1, "one two three", lang, "src0", k) for k, lang in enumerate(["en", "de", "fr", None] * 5)]
    rows += [(2 + k, "four five", "en", "src1", k) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixes = [Counter(map(tuple, mixed_documents(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert mixes[0] == mixes[1] == mixes[2] and sum(mixes[0].values()) > 20


def test_stages_take_texts_in_small_batches(spark, folder):
    """A stage called by itself hands texts to Python by some megabytes; a smaller setting of the session stays."""
    import corpus_pipeline as p
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 800) AS text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    spark.conf.unset(key)
    p.quality(spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0])
    got = [r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()]
    assert sum(got) > 10 << 20 and max(got) < 5 << 20
    spark.conf.set(key, "1m")
    p.quality(spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0])
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
