"""Sampling filters over logits in long form: (step, token, logit), one row per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.hashing import unit_uniform

# Fixed value: the lowest temperature.
MIN_TEMPERATURE = 1e-5

STEP, TOKEN, LOGIT = "step_id", "token_id", "logit"


def temper(logits: DataFrame, temperature: float) -> DataFrame:
    return logits.withColumn(LOGIT, F.col(LOGIT) / F.lit(max(temperature, MIN_TEMPERATURE)))


def softmax(logits: DataFrame, out: str = "prob") -> DataFrame:
    """Probabilities within each step, safe against overflow."""
    step = Window.partitionBy(STEP)
    weight = F.exp(F.col(LOGIT) - F.max(LOGIT).over(step))
    return (
        logits.withColumn("_w", weight)
        .withColumn(out, F.col("_w") / F.sum("_w").over(step))
        .drop("_w")
    )


def top_k(logits: DataFrame, k: int | None) -> DataFrame:
    """Tokens not below the k-th value; ties at that value stay. None or 0 turns it off."""
    if not k:
        return logits
    order = Window.partitionBy(STEP).orderBy(F.col(LOGIT).desc())
    return logits.withColumn("_place", F.rank().over(order)).where(F.col("_place") <= k).drop("_place")


def top_p(logits: DataFrame, p: float | None) -> DataFrame:
    """Tokens whose preceding mass is at most p, so the top token always stays.

    Off unless 0 < p < 1. Equal logits go by token.
    """
    if p is None or not 0.0 < p < 1.0:
        return logits
    order = Window.partitionBy(STEP).orderBy(F.col(LOGIT).desc(), TOKEN)
    before = F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, -1))
    massed = softmax(logits, "_p").withColumn("_before", F.coalesce(before, F.lit(0.0)))
    return massed.where(F.col("_before") <= p).drop("_p", "_before")


def filter_logits(
    logits: DataFrame, *, k: int | None = None, p: float | None = None, temperature: float = 1.0
) -> DataFrame:
    """Temperature, then top-k, then top-p on the renewed mass: the tokens that may be drawn."""
    return top_p(top_k(temper(logits, temperature), k), p)


def _best(logits: DataFrame, score: Column) -> DataFrame:
    """The token with the highest score of each step; ties go to the lowest token."""
    place = F.struct(score.alias("s"), (-F.col(TOKEN)).alias("t"))
    return logits.groupBy(STEP).agg(F.max_by(TOKEN, place).alias(TOKEN))


def greedy(logits: DataFrame) -> DataFrame:
    return _best(logits, F.col(LOGIT))


def draw(logits: DataFrame, *, seed: int = 0) -> DataFrame:
    """One random token per step with the softmax probabilities.

    The highest logit plus Gumbel noise is such a draw; the noise comes from a hash of seed,
    step and token, so a repeated task draws the same token.
    """
    u = unit_uniform(F.lit(seed), F.col(STEP), F.col(TOKEN))
    return _best(logits, F.col(LOGIT) - F.ln(-F.ln(u)))


def from_vectors(rows: DataFrame, step: str, vec_col: str, scale: float = 1.0) -> DataFrame:
    """Long form of rows that hold one logit per vocabulary entry."""
    return rows.select(
        F.col(step).cast("bigint").alias(STEP), F.posexplode(vec_col).alias(TOKEN, "x")
    ).select(STEP, TOKEN, (F.col("x").cast("double") * scale).alias(LOGIT))
