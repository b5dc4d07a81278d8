"""Whitening of vectors from the singular values of their centred rows.

Components become floor(scale * c); the fit list holds each distinct vector once. Number and sums of the list are exact.
Each task reduces its centred rows, block by block, to one triangular R with the same R'R; the Rs of the tasks are stacked
and reduced again in groups of ``_FAN`` until one is left, so nothing that grows with the rows meets in one task or in
the driver. The driver solves that one R (``bidiagonal``): its right singular vectors are the components, its squared
singular values over n their variances. R'R is never formed.

Defined results: see ``vectors.whole`` for the vectors left out; repeated ids, repeated vectors and null ids are rows of
their own; extra columns are not read; an empty table gives no rows. Components whose variance is no more than rounding
next to the first one's are not returned, so a list of one distinct vector gives no rows and one of two gives one
component. ``deviation`` is a decimal number of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm import bidiagonal, vectors
from isoreach.session import materialise

_FAN = 16
_ROWS = 4096


def _reduce(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """A square triangular matrix with the product R'R of all rows, taken in blocks."""
    r = np.zeros((0, dim))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return np.vstack([r, np.zeros((dim - len(r), dim))])


def _one_matrix(rows: DataFrame, dim: int, n: int, sums: np.ndarray) -> np.ndarray | None:
    """R of all centred rows (column x)."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def centred() -> Iterator[np.ndarray]:
            for batch in batches:
                for k in range(0, batch.num_rows, _ROWS):
                    # Whole numbers first: the difference from the mean is rounded once.
                    yield (n * vectors.matrix(batch.column("x").slice(k, _ROWS), dim) - sums) / n

        r = _reduce(centred(), dim)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        r = _reduce((np.frombuffer(b, np.float64).reshape(dim, dim) for b in table.column("r").to_pylist()), dim)
        return pa.table({"part": table.column("part").slice(0, 1), "r": [r.tobytes()]})

    found = materialise(rows.select("x").mapInArrow(of_task, "part long, r binary"), "triangles")
    last = found.agg(F.max("part")).first()[0]
    while last:
        numbered = found.select(F.col("part").alias("number"), F.expr(f"part div {_FAN}").alias("part"), "r")
        found, last = numbered.groupBy("part").applyInArrow(merge, "part long, r binary"), last // _FAN
    row = found.first()
    return None if row is None else np.frombuffer(row["r"], np.float64).reshape(dim, dim)


def _identity_error(rows: DataFrame, dim: int, n: int, sums: np.ndarray, turn: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    size = turn.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = ((n * vectors.matrix(batch.column("x"), dim) - sums) / n) @ turn
            total += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, square.ravel()])], pa.list_(pa.float64()))], names=["s"])

    partial = rows.select("x").mapInArrow(products, "s array<double>")
    whole = np.array(partial.agg(*[F.sum(F.col("s")[i]) for i in range(size + size * size)]).first(), float) / n
    mean = whole[:size]
    return float(np.abs(whole[size:].reshape(size, size) - np.outer(mean, mean) - np.eye(size)).max())


def whiten(embeddings: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    ids = embeddings.schema["vec_id"].dataType
    schema = f"vec_id {ids.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    none = embeddings.sparkSession.createDataFrame([], schema)
    kept = vectors.whole(embeddings, scale)
    if kept is None:
        return none
    dim = kept.dim
    rows = kept.rows.select("vec_id", "x")
    listed = materialise(rows.select("x").distinct(), "distinct-vectors")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            count += batch.num_rows
            total += vectors.matrix(batch.column("x"), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total], pa.list_(pa.int64()))], names=["n", "sums"])

    partial = listed.mapInArrow(sums_of, "n long, sums array<long>").select("n", F.posexplode("sums").alias("place", "s"))
    whole = partial.groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("place").collect()  # dim rows
    n, sums = whole[0]["n"], np.array([r["s"] for r in whole], np.int64)
    if n * kept.largest >= 1 << 61:
        raise OverflowError("too many rows of this size for exact differences from the mean")

    diagonal, upper, right = bidiagonal.bidiagonal(_one_matrix(listed, dim, n, sums))
    squares = bidiagonal.squares(diagonal, upper)
    if squares[0] == 0:
        return none
    count = min(components, int((squares > squares[0] * (dim * np.finfo(float).eps) ** 2).sum()))
    turn = right @ bidiagonal.vectors(diagonal, upper, squares[:count]) / np.sqrt(squares[:count] / n)
    explained = squares[:count] / squares.sum()
    error = _identity_error(listed, dim, n, sums, turn)
    narrow = dim * (2 * n * kept.largest) ** 2 < 1 << 63

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = n * vectors.matrix(batch.column("x"), dim) - sums
            if narrow:
                deviation = pa.array((gap * gap).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum(g * g for g in row)) for row in gap.tolist()], pa.decimal128(38, 0))
            whitened = (gap / n) @ turn
            for k in range(count):
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(np.full(size, k + 1, np.int32)), pa.array(np.full(size, n)), deviation,
                     pa.array(whitened[:, k]), pa.array(np.full(size, explained[k])), pa.array(np.full(size, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
