"""Linear next-concept predictor: context vector to target vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.blocks import matrix
from spanloom.operators.gram import gram


def fit_predictor(
    pairs: DataFrame, *, x: str = "context_vec", y: str = "target_vec", ridge: float = 1.0
) -> np.ndarray:
    """Ridge map from x to y; all rows are read in one pass, the solve is dims by dims."""
    z = gram(pairs, x, y)
    dims = (len(z) - 1) // 2
    xx, xy = z[1 : 1 + dims, 1 : 1 + dims], z[1 : 1 + dims, 1 + dims :]
    return np.linalg.solve(xx + ridge * np.eye(dims), xy)


def predict(
    rows: DataFrame, weights: np.ndarray, *, x: str = "context_vec", out: str = "pred"
) -> DataFrame:
    """Add the predicted vector, at unit length."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        made = matrix(vectors, n).astype(np.float64) @ held.value if n else np.zeros((0, 1))
        length = np.linalg.norm(made, axis=1, keepdims=True)
        unit = made / np.maximum(length, 1e-12)
        offsets = np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))

    return rows.withColumn(out, score(F.col(x)))
