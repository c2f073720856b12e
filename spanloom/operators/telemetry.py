"""Run telemetry and ordered folds."""

from __future__ import annotations

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.ranking import global_rank
from spanloom.session import cut_lineage


def every_nth(rows: DataFrame, n: int, step: str = "step") -> DataFrame:
    return rows.where(F.col(step) % n == 0)


def meter(rows: DataFrame, *keys: str, value: str, step: str, weight: str | None = None) -> DataFrame:
    """Last value, weighted average, sum, count, minimum and maximum of each key."""
    n = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(*keys).agg(
        F.max_by(value, step).alias("last"),
        (F.sum(F.col(value) * n) / F.sum(n)).alias("avg"),
        F.sum(F.col(value) * n).alias("sum"),
        F.sum(n).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


SUPER = 1024  # blocks that are carried over together


def _before(order):
    return order.rowsBetween(Window.unboundedPreceding, -1)


def mark_best(
    rows: DataFrame, *, value: str, step: str, block_rows: int = 100_000, out: str = "is_best"
) -> DataFrame:
    """True where a value is strictly below all earlier ones.

    ``step`` is a dense row number. The running minimum is taken inside blocks of steps; the
    blocks' minima carry it from block to block, on two levels.
    """
    block = F.floor(F.col(step) / block_rows)
    blocked = rows.withColumn("_block", block)
    lows = blocked.groupBy("_block").agg(F.min(value).alias("_low"))
    lows = lows.withColumn("_super", F.floor(F.col("_block") / SUPER))
    # A level above the blocks: one row per SUPER * block_rows steps meets in one place.
    upper = lows.groupBy("_super").agg(F.min("_low").alias("_low"))
    upper = upper.select("_super", F.min("_low").over(_before(Window.orderBy("_super"))).alias("_above"))
    within = _before(Window.partitionBy("_super").orderBy("_block"))
    carried = lows.select("_super", "_block", F.min("_low").over(within).alias("_own")).join(upper, "_super")
    carried = carried.select("_block", F.least("_own", "_above").alias("_carried"))
    inside = Window.partitionBy("_block").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    least = F.least(F.col("_carried"), F.min(value).over(inside))
    # Blocks are of equal size; the join and the window share one partitioning by block.
    joined = blocked.join(carried, "_block")
    return joined.withColumn(out, F.col(value) < F.coalesce(least, F.lit(float("inf")))).drop(
        "_block", "_carried"
    )


def accumulate_steps(
    rows: DataFrame, n: int, *, value: str, idx: str = "forward_idx", batch: int = 1, world: int = 1
) -> DataFrame:
    """One row per optimizer step of ``n`` forward rows; an unfinished group is left out."""
    groups = rows.groupBy(F.floor(F.col(idx) / n).cast("bigint").alias("step")).agg(
        F.avg(value).alias(value), F.count("*").alias("_n")
    )
    return groups.where(F.col("_n") == n).select(
        "step", value, F.lit(batch * n * world).alias("effective_batch")
    )


def momentum(step: Column, total: Column | int, start: float, end: float) -> Column:
    """Cosine schedule from start to end; a total of zero or less gives the end."""
    total = total if isinstance(total, Column) else F.lit(total)
    done = F.least(F.greatest(step / total, F.lit(0.0)), F.lit(1.0))
    value = F.lit(end) - F.lit((end - start) * 0.5) * (1.0 + F.cos(F.lit(math.pi) * done))
    return F.when(total <= 0, F.lit(end)).otherwise(value)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _replay(start: pd.Series, values: pd.Series, momenta: pd.Series) -> pd.Series:
    def run(y0, xs, ms):
        steps = accumulate(zip(xs, ms, strict=True), lambda y, s: s[1] * y + (1.0 - s[1]) * s[0], initial=y0)
        return list(steps)[1:]

    return pd.Series([run(*row) for row in zip(start, values, momenta, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _carried(start: pd.Series, keeps: pd.Series, adds: pd.Series) -> pd.Series:
    """The state before each of consecutive blocks."""

    def run(y0, ks, bs):
        return list(accumulate(zip(ks[:-1], bs[:-1], strict=True), lambda y, s: s[0] * y + s[1], initial=y0))

    return pd.Series([run(*row) for row in zip(start, keeps, adds, strict=True)])


def ema(
    rows: DataFrame,
    key: str,
    *order: str,
    value: str,
    momentum: Column | float,
    block_rows: int = 50_000,
    out: str = "ema",
) -> DataFrame:
    """Exponential moving average of each key's series; the first value starts it.

    The rows are ranked over all keys and cut into blocks. A block's effect on a state is
    one factor and one summand, so only series that cross a block border pass those two
    numbers on, and a key that holds a third of all rows is still worked off in many tasks.
    """
    m = momentum if isinstance(momentum, Column) else F.lit(float(momentum))
    picked = rows.select(
        F.col(key).alias("_key"),
        *order,
        F.col(value).cast("double").alias("_x"),
        m.cast("double").alias("_m"),
    )
    ranked = global_rank(picked, "_key", *order, name="_rank")
    series = ranked.groupBy("_key", F.floor(F.col("_rank") / block_rows).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", *order, "_x", "_m"))).alias("s")
    )
    borders = series.where(
        (F.col("s")[0]["_rank"] % block_rows == 0)
        | (F.element_at("s", -1)["_rank"] % block_rows == block_rows - 1)
    ).select(
        "_key",
        "_block",
        F.col("s")[0]["_x"].alias("_first"),
        F.aggregate("s", F.lit(1.0), lambda acc, r: acc * r["_m"]).alias("_keep"),
        F.aggregate("s", F.lit(0.0), lambda acc, r: acc * r["_m"] + (1.0 - r["_m"]) * r["_x"]).alias(
            "_add"
        ),
    )
    # Two levels: a key's groups of SUPER blocks are composed first, so what meets in one place
    # is one row per SUPER * block_rows rows, and each group is then carried over on its own.
    # A list per group, not a task's data frame: there are as many groups as keys that cross a border.
    borders = borders.withColumn("_super", F.floor(F.col("_block") / SUPER))
    groups = cut_lineage(borders.groupBy("_key", "_super").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_first", "_keep", "_add"))).alias("b")
    ))
    # The effect of consecutive blocks on a state as one factor and one summand.
    effect = F.aggregate(
        "b",
        F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("add")),
        lambda e, r: F.struct(
            (r["_keep"] * e["keep"]).alias("keep"), (r["_keep"] * e["add"] + r["_add"]).alias("add")
        ),
    )
    supers = groups.select("_key", "_super", F.col("b")[0]["_first"].alias("_first"), effect.alias("e"))
    lists = supers.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_super", "_first", "e.keep", "e.add"))).alias("g")
    )
    state = _carried(F.col("g")[0]["_first"], F.col("g.keep"), F.col("g.add"))
    begins = lists.select("_key", "g", state.alias("y")).select("_key", F.explode(F.arrays_zip("g", "y")).alias("r"))
    begins = begins.select("_key", F.col("r.g._super").alias("_super"), F.col("r.y").alias("_start"))
    state = _carried(F.col("_start"), F.col("b._keep"), F.col("b._add"))
    starts = groups.join(begins, ["_key", "_super"]).select("_key", "b", state.alias("y"))
    starts = starts.select("_key", F.explode(F.arrays_zip("b", "y")).alias("r"))
    starts = starts.select("_key", F.col("r.b._block").alias("_block"), F.col("r.y").alias("_start"))
    begun = series.join(starts, ["_key", "_block"], "left").withColumn(
        "_start", F.coalesce("_start", F.col("s")[0]["_x"])
    )
    done = begun.withColumn("y", _replay("_start", F.col("s._x"), F.col("s._m")))
    flat = done.select("_key", F.explode(F.arrays_zip("s", "y")).alias("r"))
    return flat.select(
        F.col("_key").alias(key),
        *[F.col(f"r.s.{o}").alias(o) for o in order],
        F.col("r.s._x").alias(value),
        F.col("r.y").alias(out),
    )


def step_budget(
    rows: DataFrame | None,
    *,
    batch_size: int,
    accum: int = 1,
    world_size: int = 1,
    epochs: int = 1,
    max_steps: int | None = None,
) -> DataFrame | tuple[int, int]:
    """Optimizer steps in total and per epoch, from the row count.

    A stream (``rows`` is None) has no count and needs ``max_steps``; then two numbers
    come back.
    """
    if rows is None or rows.isStreaming:
        if max_steps is None:
            raise ValueError("a streaming source needs max_steps")
        return max_steps, max(max_steps // max(epochs, 1), 1)
    n = rows.agg(F.count("*").alias("rows"))
    per_rank = F.ceil(F.col("rows") / world_size)
    forward = F.ceil(per_rank / batch_size)
    steps = F.greatest(F.floor(forward / accum), F.lit(1)).cast("bigint")
    total = F.lit(max_steps).cast("bigint") if max_steps is not None else steps * epochs
    return n.select("rows", total.alias("total_steps"), steps.alias("steps_per_epoch"))
