"""Orthogonal factors of a tall matrix: tasks reduce their rows to one triangle each, triangles merge in a second step.

The triangle R of a QR factorisation says all that least squares need of a matrix: ``R'R`` equals ``X'X`` without its being formed, so
the condition of a badly scaled design is not squared. A triangle has as many rows as the matrix has columns, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32  # triangles the driver merges at most
SINGULAR = 1e-16  # of a column's variation that the columns before it leave

Step = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def merged(parts: Sequence[np.ndarray], width: int) -> np.ndarray:
    """The triangle of all rows of ``parts``, padded with zero rows."""
    found = np.linalg.qr(np.vstack([np.zeros((0, width)), *parts]), mode="r")
    return np.vstack([found, np.zeros((width - len(found), width))]) if len(found) < width else found


def triangle(rows: DataFrame, step: Step, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R, sums, peaks) over all ``rows`` of double columns.

    ``step`` turns a block of rows into the rows to factor (``width`` columns), sums to add up and peaks to take maxima of. One map
    over the rows gives a triangle a task; up to FAN merged ones reach the driver.
    """
    schema = "factor array<double>, sums array<double>, peaks array<double>"
    kind = pa.list_(pa.float64())

    def packed(factor: np.ndarray, sums: np.ndarray, peaks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], kind) for x in (factor, sums, peaks)], names=["factor", "sums", "peaks"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, sums, peaks = step(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            held = (merged([block], width), sums, peaks) if held is None else (merged([held[0], block], width), held[1] + sums, np.maximum(held[2], peaks))
        if held is not None:
            yield packed(*held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(np.array(c) for c in row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if found:
            yield packed(*_joined(found, width))

    tasks = rows.mapInArrow(reduce_rows, schema)
    if rows.rdd.getNumPartitions() > FAN:
        tasks = tasks.repartition(FAN).mapInArrow(merge, schema)
    found = [tuple(np.array(c) for c in row) for row in tasks.collect()]
    if not found:
        return np.zeros((width, width)), np.zeros(0), np.zeros(0)
    return _joined(found, width)


def _joined(found: Sequence[tuple[np.ndarray, ...]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = sorted(found, key=lambda f: f[0].tolist())  # the order of arrival must not show
    factor = merged([f[0].reshape(width, width) for f in found], width)
    return factor, np.sum([f[1] for f in found], axis=0), np.max([f[2] for f in found], axis=0)


def independent(factor: np.ndarray) -> list[int]:
    """Columns that are no linear combinations of the columns before them; the first one is the constant."""
    basis: list[np.ndarray] = []
    kept = []
    for j in range(factor.shape[1]):
        own = factor[:, j].copy()
        if basis:
            own -= basis[0] * (basis[0] @ own)
        whole = own @ own
        for _ in range(2):  # once more, against rounding
            for b in basis:
                own -= b * (b @ own)
        if own @ own > SINGULAR * whole and whole > 0:
            kept.append(j)
            basis.append(own / np.sqrt(own @ own))
    return kept


def solved(factor: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(solution, unscaled variances, rank) of the least-squares problem with this triangle; of minimum norm where columns depend."""
    rank = len(independent(factor))
    if rank == factor.shape[1]:
        norms = np.sqrt((factor * factor).sum(axis=0))
        inverse = np.linalg.inv(factor / norms) / norms[:, None]
    else:
        inverse = np.linalg.pinv(factor, rcond=1e-12)
    return inverse @ right, (inverse * inverse).sum(axis=1), rank
