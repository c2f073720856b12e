"""Sums of products between vector components, added up over all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.blocks import matrix

MAX_DIMS = 4096


def _row(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        cell = pa.ListArray.from_arrays(
            pa.array([0, total.size], pa.int32()), pa.array(total.ravel())
        )
        yield pa.RecordBatch.from_arrays([cell], names=["sums"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            parts = [matrix(c).astype(np.float64) for c in batch.columns]
            z = np.hstack([np.ones((batch.num_rows, 1)), *parts])
            total = z.T @ z if total is None else total + z.T @ z
    return _row(total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            part = matrix(batch.column(0)).sum(axis=0)
            total = part if total is None else total + part
    return _row(total)


def added_up(rows: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of an array that ``measure`` makes of each batch (of one length, as few numbers as the
    driver may hold). Each task sends one array, and the arrays are added in a second stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = measure(batch)
                total = part if total is None else total + part
        return _row(total)

    sums = rows.mapInArrow(run, "sums array<double>")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = sums.repartition(math.isqrt(tasks) + 1).mapInArrow(_added, "sums array<double>")
    flat = sums.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    return flat.orderBy("pos").toArrow()["x"].to_numpy()


def gram(rows: DataFrame, *vec_cols: str) -> np.ndarray:
    """Z'Z for Z = [1, the given vectors end to end]; rows with a null vector are left out.

    Each task sends one matrix, and the matrices are added in a second stage. Only the final square
    of dimensions reaches the driver: at most ``MAX_DIMS`` of them, which is checked first.
    """
    whole = rows.select(*vec_cols).dropna()
    first = whole.select(sum((F.size(c) for c in vec_cols), F.lit(1)).alias("n")).first()
    if first is not None and first["n"] > MAX_DIMS:
        raise ValueError(f"{first['n']} dimensions: the square does not fit the driver")
    sums = whole.mapInArrow(_products, "sums array<double>")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = sums.repartition(math.isqrt(tasks) + 1).mapInArrow(_added, "sums array<double>")
    flat = sums.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x"))
    cells = flat.orderBy("pos").toPandas().to_numpy()
    side = math.isqrt(len(cells))
    return cells[:, 1].reshape(side, side)


def _triangles(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """The triangular factor of all rows of a task; ``first``: rows are vectors, else factors."""
    r = None
    for batch in batches:
        x = matrix(batch.column(0)).astype(np.float64) if batch.num_rows else np.zeros((0, 0))
        if not x.size:
            continue
        x = np.hstack([np.ones((len(x), 1)), x]) if first else x.reshape(-1, math.isqrt(x.shape[1]))
        r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if len(r) < r.shape[1]:
            r = np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    return _row(r)


def centred_triangle(rows: DataFrame, vec_col: str) -> tuple[np.ndarray, int]:
    """R with R'R = X'X for the centred vectors X, and their number.

    Each task factors its rows, with a column of ones in front; the factors are put on top of each other and factored
    again, in two more stages. The singular values of R are those of X: nothing is squared on the way. The
    row and column of the ones take the mean out. Only one square of dimensions reaches the driver.
    """
    whole = rows.select(vec_col).dropna()
    first = whole.select((F.size(vec_col) + 1).alias("n")).first()
    if first is not None and first["n"] > MAX_DIMS:
        raise ValueError(f"{first['n']} dimensions: the square does not fit the driver")
    found = whole.mapInArrow(lambda it: _triangles(it, True), "sums array<double>")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for parts in (math.isqrt(tasks) + 1, 1):
        found = found.repartition(parts).mapInArrow(lambda it: _triangles(it, False), "sums array<double>")
    last = found.first()
    if last is None:
        return np.zeros((0, 0)), 0
    r = np.array(last["sums"]).reshape(math.isqrt(len(last["sums"])), -1)
    return r[1:, 1:], round(r[0, 0] ** 2)
