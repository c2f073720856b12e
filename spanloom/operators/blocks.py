"""Products between all rows of two vector tables, as matrix products of row blocks.

Rows are packed into blocks of bounded size by a hash of their id. Only what a pair of
blocks reduces to leaves a task, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_count(rows: DataFrame, rows_per_block: int) -> int:
    return max(1, -(-rows.count() // rows_per_block))


def pack(rows: DataFrame, ids: list[str], vec: str, n_blocks: int, block: str) -> DataFrame:
    """One row per block: parallel id arrays and the vectors end to end."""
    member = F.struct(*ids, F.col(vec).cast("array<float>").alias("v"))
    packed = rows.groupBy(
        F.pmod(F.xxhash64(*ids), F.lit(n_blocks)).cast("int").alias(block)
    ).agg(F.collect_list(member).alias("m"))
    return packed.select(
        block, *[F.col(f"m.{i}").alias(i) for i in ids], F.flatten("m.v").alias(vec)
    )


def matrix(values: pa.ListArray, rows: int | None = None) -> np.ndarray:
    """A list column as a two-dimensional array."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    n = len(values) if rows is None else rows
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)
