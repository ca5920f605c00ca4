"""Secret scan: fixed rules, and character Markov models of random strings and of ordinary identifiers.

``train`` counts character pairs of labelled samples over the whole table: strings that a rule has matched are random ones; words
and identifiers are ordinary, in lower case, capitals or camel case, with or without digits. Other long runs with digits could be
either and are left unlabelled. ``find_secrets`` keeps the rules' spans and adds runs whose log-likelihood ratio between the two
models is high.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import text_or_empty, texts_of

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6  # characters of an assigned value
KINDS = ("assign", "access", "hex", "model")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # what the models judge
MIN_MEAN, MIN_TOTAL = 0.9, 20.0  # nats a character, and in all
IDENTIFIER = re.compile(r"(?:(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)[0-9]{0,3}|[0-9]{1,4})(?:[_/=-](?:(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)[0-9]{0,3}|[0-9]{1,4}))+")
UPPER_SHARE = 0.1  # how often a word is taken to be written in capitals as well, as names of constants are
BACK_OFF = 20.0  # pairs' worth of weight of the single-character shares
SIZE = len(ALPHABET) + 1  # 0 is any other character, also a run's edge
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)
_UPPER = np.arange(SIZE)
_UPPER[27:53] = np.arange(1, 27)  # codes of a-z to those of A-Z


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _values(text: str) -> list[str]:
    """The random strings that the rules point to; an assigned value counts if it holds a digit."""
    found = [m[2] for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE and re.search("[0-9]", m[2])]
    found += ACCESS.findall(text) if "AKIA" in text else []
    return found + HEX.findall(text)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def _coded(strings: list[str]) -> np.ndarray:
    return _CODE[np.frombuffer(("\n" + "\n".join(strings) + "\n").encode(), np.uint8)]


def _pairs_of_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pairs inside each text; its edges are code 0, so that no pair depends on which text comes next."""
    codes = np.concatenate([[0], _CODE[data], [0]])
    total = _pairs(codes)
    inner = np.unique(offsets[(offsets > 0) & (offsets < offsets[-1])])
    before, behind = codes[inner], codes[inner + 1]
    total -= np.bincount(before * SIZE + behind, minlength=SIZE * SIZE)
    return total + np.bincount(np.concatenate([before * SIZE, behind]), minlength=SIZE * SIZE)


def _unlabelled(text: str) -> list[str]:
    """Long runs with digits that are not shaped as identifiers are."""
    return [v for v in RUN.findall(text) if not v.isalpha() and re.search("[0-9]", v) and not IDENTIFIER.fullmatch(v)]


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratios by (previous, next) character, from pair counts over every whole text.

    What reaches the driver are 2 x SIZE x SIZE sums, whatever the input. A rare pair backs off to its second character's own
    share, and those start at one, so that a table without secrets has a uniform model of random strings.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            column = batch.column("text")
            for low, high, data, offsets in texts_of(batch):
                total[0] += _pairs_of_texts(data, offsets)
                texts = column.slice(low, high - low).to_pylist()
                total[1] += _pairs(_coded([v for t in texts for v in _values(t)]))
                total[0] -= _pairs(_coded([v for t in texts for v in _unlabelled(t)]))
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["pair", "ordinary", "random"])

    counted = docs.select(text_or_empty(text)).mapInArrow(count, "pair long, ordinary long, random long")
    sums = np.zeros((2, SIZE * SIZE))
    for pair, ordinary, random in counted.groupBy("pair").agg(F.sum("ordinary"), F.sum("random")).collect():
        sums[:, pair] += ordinary, random
    sums = sums.reshape(2, SIZE, SIZE)
    capitals = np.zeros((SIZE, SIZE))
    np.add.at(capitals, (_UPPER[:, None], _UPPER[None, :]), sums[0])
    sums[0] += UPPER_SHARE * capitals
    sums = sums[:, :, 1:]  # what ends a run says nothing
    single = sums.sum(axis=1) + 1
    single /= single.sum(axis=1, keepdims=True)
    share = np.log((sums + BACK_OFF * single[:, None, :]) / (sums.sum(axis=2, keepdims=True) + BACK_OFF))
    ratio = np.zeros((SIZE, SIZE))
    ratio[:, 1:] = share[1] - share[0]
    return ratio


def model_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that the random model explains better and that no rule has touched."""
    found = []
    for m in RUN.finditer(text):
        codes = _CODE[np.frombuffer(m[0].encode(), np.uint8)]
        total = float(ratio[0, codes[0]] + ratio[codes[:-1], codes[1:]].sum())
        if total >= MIN_TOTAL and total >= MIN_MEAN * len(codes) and not any(s < m.end() and m.start() < e for s, _, e in taken):
            found.append((m.start(), 3, m.end()))
    return found


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, ratio: np.ndarray | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of secrets in each whole text; positions are code points, ends exclusive.

    ``ratio``: from ``train``; by default trained on ``docs``. A map over the scan. A null or empty text has no spans. Columns
    beyond ``keep`` are ignored, also such with names of the result. Repeated rows give repeated results.
    """
    ratio = train(docs, text) if ratio is None else ratio
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # SIZE x SIZE numbers
    columns = ["n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t)
                more = model_spans(t, model, base)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), len(more), hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + more))))
            arrays = [pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *columns])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*[F.col(c) for c in keep], text_or_empty(text)).mapInArrow(
        run, f"{carried}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string",
    )
