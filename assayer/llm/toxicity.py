"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is weighed by the labelled rows (log-odds of standing in a toxic document). From it and from a
text's form come some fifteen numbers: lexicon densities, nearness to words of the second person, capitals, punctuation and
obfuscation. Boosted trees map them to a raw score and isotonic regression on rows the trees have not seen maps that to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import text_or_empty, written

MAX_LABELLED = 16384  # labelled documents the classifier is fitted on: those whose ids have the smallest hashes
FOLDS = 5  # a training row's lexicon is weighed by the other folds
TREE_FOLDS = 3  # folds for the trees, the others calibrate
LEAST_TOXIC = 3  # toxic documents that hold a term of the lexicon
MAX_CANDIDATES, MAX_TERMS = 1 << 16, 2048  # terms that are weighed, terms that are kept
LEAST_WEIGHT = 1.5  # log-odds of a term of the lexicon
BEGINNINGS = range(3, 8)  # letters
THRESHOLD = 0.7
NEAR = 5  # words between a hit and a word of the second person
WORDS_KEPT = 1 << 20  # weights a worker remembers

# Words of the second person in English, French, German and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti usted ustedes tus vosotros".split()
)
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "*": ""})
FEATURES = (
    "density", "weight_density", "max_weight", "second_weight", "distinct_weight", "distinct_hits", "near_second_person",
    "second_person", "capitals", "capital_words", "marks", "repeated_marks", "symbols", "obfuscated", "obfuscated_weight", "digits", "log_words",
)

_WORD = re.compile(r"[^\W_]+")
# A match begins at a word's first letter only and a spaced one is bounded, so that both are linear in the text.
_DISGUISED = re.compile(r"(?<![\w@$!*])[^\W\d_]++[@$!*0134557][\w@$!*]*[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-]){3,30}[^\W\d_](?!\S)")
_SHOUTED = re.compile(r"\b[A-Z]{2,}\b")
_REPEATED = re.compile(r"[!?.]{2,}")


def terms(word: str) -> list[str]:
    """A word as a whole (its end marked) and its beginnings."""
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if k < len(word))]


class Weights(dict):
    """Weight of each word met: the largest of its terms in the lexicon, 0 without any."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        found = self[word] = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        return found


def features(text: str, weights: Weights) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    found = np.fromiter((weights[w] for w in words), float, len(words))
    hits = np.flatnonzero(found)
    distinct = sorted((weights[w] for w in {words[i] for i in hits}), reverse=True)
    person = np.flatnonzero(np.fromiter((w in SECOND_PERSON for w in words), bool, len(words)))
    near = 0.0
    if len(hits) and len(person):
        at = np.searchsorted(person, hits)
        gap = np.minimum(np.abs(person[np.minimum(at, len(person) - 1)] - hits), np.abs(person[np.maximum(at - 1, 0)] - hits))
        near = float((gap <= NEAR).mean())
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    disguised = _DISGUISED.findall(low)
    spaced = _SPACED.findall(low)
    plain = [d.translate(DISGUISE) for d in disguised] + [re.sub(r"[ .\-]", "", s) for s in spaced]
    return [
        len(hits) / n, float(found.sum()) / n, distinct[0] if distinct else 0.0, distinct[1] if len(distinct) > 1 else 0.0,
        math.log1p(sum(distinct)), math.log1p(len(distinct)), near,
        len(person) / n, upper / max(1, upper + lower), len(_SHOUTED.findall(text)) / n,
        int(raw[33] + raw[63]) / n, len(_REPEATED.findall(text)) / n, int(raw[[35, 36, 37, 38, 42, 60, 62, 64, 124]].sum()) / n,
        (len(disguised) + len(spaced)) / n, max((weights[w] for w in plain), default=0.0), int(raw[48:58].sum()) / n, math.log1p(len(words)),
    ]


def _remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most ``bound`` labelled documents that are not held out.

    An id with several labels is toxic if one says so; of an id with several texts the least is taken. Null ids and labels teach nothing.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    told = usable.where(_remainder() != 1).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    few = written(told.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(bound), "labels")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text)).join(F.broadcast(few), "doc_id")
    single = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(single.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")


def _term_counts(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(term, fold, toxic, n): documents that hold a term; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True):
                found = {t for w in set(_WORD.findall(text.lower())) for t in terms(w)}
                held.update((t, fold, toxic) for t in (found if only is None else found & only))
            columns = list(zip(*held, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["term", "fold", "toxic", "n"],
            )

    return sample.mapInArrow(run, "term string, fold int, toxic int, n long")


def lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """FOLDS lexicons, each weighed without its fold, and at last the one of all rows: term to log-odds.

    Terms of LEAST_TOXIC or more toxic documents are weighed, the MAX_TERMS with the most evidence stay; what reaches the driver is
    bounded by these parameters.
    """
    toxic = _term_counts(sample.where("toxic = 1"), None).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TOXIC)
    candidates = frozenset(r["term"] for r in toxic.orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES).collect())
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    cells = [(k, t) for k in range(FOLDS) for t in (0, 1)]
    counted = _term_counts(sample, candidates).groupBy("term").agg(
        F.array(*[F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n")).otherwise(0)) for k, t in cells]).alias("cells"))
    rows = sorted((r["term"], r["cells"]) for r in counted.collect())
    n = np.array([c for _, c in rows], float).reshape(-1, FOLDS, 2)
    total = np.array([[sizes.get((k, t), 0) for t in (0, 1)] for k in range(FOLDS)], float)

    def weights(folds: list[int]) -> np.ndarray:
        part, whole = n[:, folds].sum(axis=1), total[folds].sum(axis=0)
        return np.log((part[:, 1] + 0.5) / (whole[1] + 1)) - np.log((part[:, 0] + 0.5) / (whole[0] + 1))

    every = list(range(FOLDS))
    overall = weights(every)
    evidence = np.where(overall >= LEAST_WEIGHT, overall * np.sqrt(n[:, :, 1].sum(axis=1)), 0)
    kept = [i for i in np.argsort(-evidence, kind="stable")[:MAX_TERMS] if evidence[i] > 0]
    each = [weights([k for k in every if k != out]) for out in every] + [overall]
    return [{rows[i][0]: float(w[i]) for i in kept if w[i] >= LEAST_WEIGHT} for w in each]


def with_features(docs: DataFrame, lexicon: list[dict[str, float]], keep: tuple[str, ...], fold: str | None = None) -> DataFrame:
    """``keep`` columns and ``features``, an array; a map over the scan. ``fold`` names the column that picks the lexicon, else the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(x) for x in lexicon]
        for batch in batches:
            folds = batch.column(fold).to_pylist() if fold else [-1] * batch.num_rows
            found = [features(t, weights[f]) for t, f in zip(batch.column("text").to_pylist(), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.mapInArrow(run, f"{carried}, features array<double>")


@dataclass
class Toxicity:
    """A fitted scorer. Without rows of both classes there are no trees and every text has the share of toxic rows, 0 without any."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def _raw(self, rows: DataFrame) -> DataFrame:
        voted = self.trees.transform(rows.withColumn("features", array_to_vector("features")))
        return voted.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(doc_id, held_out, score, predicted) for every row of ``docs``, read whole.

        A null text counts as empty and has a score too; a null doc_id is not held out. Nothing but the text enters the score.
        Repeated rows give repeated results, other columns are ignored, an empty table gives no rows. One map over the scan.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text))
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(self.share))
        else:
            scored = self._raw(with_features(rows, [self.lexicon], ("doc_id",)))
            scored = scored.withColumn("score", F.col("raw")) if self.calibration is None else self.calibration.transform(scored).withColumnRenamed("prediction", "score")
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
        return scored.select("doc_id", (_remainder() == 1).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", bound: int = MAX_LABELLED) -> Toxicity:
    """Learn from at most ``bound`` rows of ``labels`` (doc_id, toxic) that are not held out.

    The rows' features take lexicons that were weighed without them, the trees and the calibration have rows of their own. Training
    rows lie in one partition in the order of their ids, so that reruns give the same trees.
    """
    sample = labelled_sample(docs, labels, text, bound)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Toxicity({}, None, None, share)
    lexicon = lexicons(sample)
    rows = written(with_features(sample, lexicon, ("doc_id", "toxic", "fold"), "fold"), "features").withColumn("label", F.col("toxic").cast("double"))

    def ordered(part: DataFrame) -> DataFrame:
        return part.repartition(1).sortWithinPartitions("doc_id")

    both = rows.where(F.col("fold") < TREE_FOLDS)
    classes = both.agg(F.countDistinct("toxic")).first()[0]
    trees = GBTClassifier(maxDepth=4, maxIter=24, stepSize=0.3, maxBins=64, minInstancesPerNode=3, seed=11)
    model = Toxicity(lexicon[-1], trees.fit(ordered((both if classes == 2 else rows).select("doc_id", array_to_vector("features").alias("features"), "label"))), None, share)
    held = written(model._raw(rows.where(F.col("fold") >= TREE_FOLDS)), "raw")
    if held.agg(F.countDistinct("toxic")).first()[0] == 2:
        model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(ordered(held.select("doc_id", "raw", "label")))
    return model
