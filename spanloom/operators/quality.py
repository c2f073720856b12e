"""Measures of vector quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import vectors as vec
from spanloom.operators.blocks import matrix, pack
from spanloom.operators.concepts import summed_vectors
from spanloom.operators.gram import added_up, centred_triangle, gram
from spanloom.operators.ranking import global_rank
from spanloom.session import cut_lineage

STRIPES, STRIPE_BYTES = 24, 16 << 20  # of the vectors compared pair by pair
MAX_BATCH = 16_384  # a batch travels as one row and is measured by one matrix product

# Limits below which a run counts as collapsed.
MIN_RANK, MIN_STD, MIN_DIVERSITY, PINNED_COSINE = 10.0, 0.05, 1e-3, 0.999


def spearman(rows: DataFrame, a: str, b: str, *ids: str) -> DataFrame:
    """Spearman's rho on ordinal ranks (ties by id), with the row count.

    Fewer than two rows or a constant column give 0.
    """
    # Each range shuffle samples its input first; the stored columns spare the work before. Each sort carries
    # one value beside the ids: the rank replaces it.
    slim = cut_lineage(rows.select(*ids, a, b))
    limits = slim.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    varies = F.lit(bool(limits[0] is not None and limits[0] < limits[1] and limits[2] < limits[3]))
    ranked = global_rank(slim, a, *ids, name="_ra").drop(a)
    ranked = global_rank(ranked, b, *ids, name="_rb")
    rho = F.corr(F.col("_ra").cast("double"), F.col("_rb").cast("double"))
    return ranked.agg(
        F.when(varies, rho).otherwise(F.lit(0.0)).alias("rho"), F.count("*").alias("n_pairs")
    ).select(F.coalesce("rho", F.lit(0.0)).alias("rho"), "n_pairs")


def alignment(
    pairs: DataFrame,
    *ids: str,
    a: str = "vec1",
    b: str = "vec2",
    label: str = "label",
    above: float = 4.0,
    limit: int | None = None,
) -> DataFrame:
    """Mean squared distance over the pairs scored above a limit; NaN without any.

    ``limit`` takes the first positives in id order.
    """
    positive = pairs.where(F.col(label) > above)
    if limit is not None:
        positive = positive.orderBy(*ids).limit(limit)
    return positive.agg(
        F.coalesce(
            F.avg(vec.squared_distance(F.col(a), F.col(b))), F.lit(float("nan"))
        ).alias("alignment"),
        F.count("*").alias("n_pos"),
    )


def stripe_count(n: int, cells: int, rows_per_block: int) -> int:
    """Stripes for ``n`` vectors of ``cells`` numbers in all: one per block, but no more than ``STRIPES`` while each fits STRIPE_BYTES."""
    return max(1, min(-(-n // rows_per_block), STRIPES), -(-4 * cells // STRIPE_BYTES))


def uniformity(
    rows: DataFrame, *, vec_col: str = "vec", t: float = 2.0, rows_per_block: int = 4096
) -> DataFrame:
    """Log of the mean of exp(-t d2) over all ordered pairs of different unit vectors.

    The measure is quadratic by definition and every row counts. Equal vectors are grouped first; different ones go to
    stripes, and every pair of stripes yields one sum. A task holds two stripes and products of ``rows_per_block`` rows a
    side. A vector moves once per stripe: their number only grows beyond ``STRIPES * STRIPE_BYTES`` of vectors.
    """
    vectors = rows.groupBy(F.col(vec_col).cast("array<float>").alias(vec_col)).agg(
        F.count("*").alias("_n")
    )
    vectors = cut_lineage(vectors.select(F.xxhash64(vec_col).alias("_h"), "_n", vec_col))
    size = vectors.agg(F.count("*").alias("n"), F.sum(F.size(vec_col).cast("bigint")).alias("cells")).first()
    stripes = stripe_count(size["n"], size["cells"] or 0, rows_per_block)
    packed = pack(vectors, ["_h", "_n"], vec_col, stripes, "stripe")
    left = packed.select(
        F.col("stripe").alias("one"),
        F.explode(F.sequence(F.col("stripe"), F.lit(stripes - 1))).alias("two"),
        F.col("_n").alias("m"),
        F.col(vec_col).alias("x"),
    )
    right = packed.select(
        F.explode(F.sequence(F.lit(0), F.col("stripe"))).alias("one"),
        F.col("stripe").alias("two"),
        F.col("_n").alias("n"),
        F.col(vec_col).alias("y"),
    )
    paired = left.join(right, ["one", "two"]).select("one", "two", "m", "n", "x", "y")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [], []
            for i in range(batch.num_rows):
                one, two = (batch.column(c)[i].as_py() for c in range(2))
                m, n, x, y = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    for c in range(2, 6)
                )
                x, y = 2.0 * t * x.reshape(len(m), -1), y.reshape(len(n), -1)
                total = 0.0
                for a in range(0, len(m), rows_per_block):
                    p, head = m[a : a + rows_per_block], x[a : a + rows_per_block]
                    for b in range(a if one == two else 0, len(n), rows_per_block):
                        q = n[b : b + rows_per_block]
                        near = head @ y[b : b + rows_per_block].T
                        near -= 2.0 * t
                        np.exp(near, out=near)
                        whole = float(p @ near @ q)
                        # A row is no pair with itself; its copies are.
                        same = one == two and a == b
                        total += whole - float(p @ np.diag(near)) if same else 2.0 * whole
                sums.append(total)
                counts.append(int(m.sum() * (m.sum() - 1)) if one == two else 2 * int(m.sum() * n.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], names=["s", "c"]
            )

    total = paired.mapInArrow(scan, "s double, c bigint").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    mean = F.when(F.col("c") > 0, F.col("s") / F.col("c"))
    return total.select(
        F.coalesce(F.ln(mean), F.lit(float("nan"))).alias("uniformity"),
        F.coalesce("c", F.lit(0)).alias("n_ordered_pairs"),
    )


def similarity_stats(rows: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean cosine and mean norms of predicted and target vectors."""
    p, t = F.col(pred), F.col(target)
    return rows.agg(
        F.avg(vec.cosine(p, t)).alias("avg_similarity"),
        F.avg(vec.norm(p)).alias("pred_norm"),
        F.avg(vec.norm(t)).alias("target_norm"),
        F.count("*").alias("n"),
    )


def losses(rows: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """Mean smooth-L1 loss and cosine loss."""
    p, t = F.col(pred), F.col(target)
    return rows.agg(
        F.avg(vec.smooth_l1(p, t)).alias("smooth_l1"),
        (1.0 - F.avg(vec.cosine(p, t))).alias("cosine_loss"),
    )


def diversity(rows: DataFrame, *keys: str, vec_col: str = "pred") -> DataFrame:
    """One minus the mean dot product of different rows, from the sum vector in one pass."""
    total = summed_vectors(rows, *keys, vec_col=vec_col)
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    square = added(F.transform("s", lambda x: x * x))
    mean = F.when(F.col("n") > 1, (square - added("q")) / (F.col("n") * (F.col("n") - 1)))
    return total.select(*keys, "n", (1.0 - mean).alias("diversity"))


def mean_std(rows: DataFrame, *keys: str, vec_col: str = "target") -> DataFrame:
    """Mean over the dimensions of the sample standard deviation."""
    total = summed_vectors(rows, *keys, vec_col=vec_col)
    n = F.col("n")
    spread = F.zip_with("s", "q", lambda s, q: F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    mean = F.aggregate(spread, F.lit(0.0), lambda acc, x: acc + x) / F.size("s")
    return total.select(*keys, F.when(n > 1, mean).alias("std_mean"))


def rank_from_singular(values: np.ndarray, floor: float = 1e-10) -> float:
    """Exponential of the entropy of the normalized singular values above the floor."""
    kept = values[values > floor]
    if not len(kept):
        return 0.0
    p = kept / kept.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def spread_measures(rows: DataFrame, vec_col: str = "target") -> DataFrame:
    """Effective rank and off-diagonal covariance of the whole table.

    Both come from one triangular factor of the centred vectors: its singular values are theirs, so small ones
    keep their digits down to the floor of the rank.
    """
    r, n = centred_triangle(rows, vec_col)
    rank = off = 0.0
    if n >= 2:
        rank = rank_from_singular(np.linalg.svd(r, compute_uv=False))
        cov = np.abs(r.T @ r) / (n - 1)
        off = float(cov.sum() - np.trace(cov))
    return rows.sparkSession.createDataFrame(
        [(rank, off, n)], "effective_rank double, off_diag_cov_l1 double, n bigint"
    )


_BATCH_FIELDS = (
    "avg_similarity double, hit_rate double, pred_norm double, diversity double, "
    "target_std_mean double, target_eff_rank double, target_off_diag_cov_l1 double"
)


def _first_equal(rows: np.ndarray) -> np.ndarray:
    """For each row the place of the first one equal to it."""
    _, first, own = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first[own.reshape(-1)]


def _batch_measures(p: np.ndarray, t: np.ndarray) -> tuple:
    """The seven measures of equally long batches stacked as [batch, row, dim]."""
    size = p.shape[1]
    p_len, t_len = np.linalg.norm(p, axis=2), np.linalg.norm(t, axis=2)
    length = p_len * t_len
    own = (p * t).sum(axis=2)
    cosine = np.divide(own, length, out=np.zeros_like(own), where=length > 0).mean(axis=1)
    near = np.matmul(p, t.transpose(0, 2, 1))
    # A matrix product may round equal columns apart: each takes the product of its first copy, so ties go there.
    near = np.stack([own[:, _first_equal(rows)] for own, rows in zip(near, t, strict=True)])
    best = near.argmax(axis=2)
    hits = (best == np.arange(size)).mean(axis=1)
    empty = np.full(len(p), np.nan)
    zero = np.zeros(len(p))
    if size < 2:
        return cosine, hits, p_len.mean(axis=1), empty, empty, zero, zero
    summed = p.sum(axis=1)
    crossed = (summed**2).sum(axis=1) - (p_len**2).sum(axis=1)
    spread = 1.0 - crossed / (size * (size - 1))
    centered = t - t.mean(axis=1, keepdims=True)
    std = t.std(axis=1, ddof=1).mean(axis=1)
    ranks = np.array([rank_from_singular(s) for s in np.linalg.svd(centered, compute_uv=False)])
    cov = np.abs(np.matmul(centered.transpose(0, 2, 1), centered)) / (size - 1)
    off = cov.sum(axis=(1, 2)) - np.trace(cov, axis1=1, axis2=2)
    return cosine, hits, p_len.mean(axis=1), spread, std, ranks, off


def batch_metrics(
    rows: DataFrame,
    position: str,
    batch_size: int,
    *,
    pred: str = "pred",
    target: str = "target",
) -> DataFrame:
    """Seven measures of each batch of ``batch_size`` consecutive positions.

    Positions are unique, so a batch is never longer than ``batch_size``; it travels as one
    row, and batches of equal length are measured together.
    """
    if not 0 < batch_size <= MAX_BATCH:
        raise ValueError(f"batch_size must be between 1 and {MAX_BATCH}")

    @F.pandas_udf(_BATCH_FIELDS)
    def measure(n: pd.Series, p: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = np.empty((len(n), 7))
        for size in n.unique():
            at = np.flatnonzero(n == size)
            stack = lambda s: np.stack(
                [np.asarray(s.iloc[i], dtype=np.float64).reshape(size, -1) for i in at]  # noqa: B023
            )
            out[at] = np.stack(_batch_measures(stack(p), stack(t)), axis=1)
        return pd.DataFrame(out, columns=[f.split()[0] for f in _BATCH_FIELDS.split(", ")])

    member = F.struct(position, F.col(pred).alias("p"), F.col(target).alias("t"))
    batches = rows.groupBy(F.floor(F.col(position) / batch_size).cast("bigint").alias("batch_id")).agg(
        F.array_sort(F.collect_list(member)).alias("m")
    )
    measured = batches.select(
        "batch_id",
        F.size("m").cast("bigint").alias("n"),
        measure(F.size("m"), F.flatten("m.p"), F.flatten("m.t")).alias("x"),
    )
    return measured.select("batch_id", "n", "x.*")


def running_metrics(batches: DataFrame) -> DataFrame:
    """Batch measures averaged by batch length: the mean of batch values, not a global value.

    A measure that a batch lacks (a single row has no diversity and no spread) takes no part in its mean.
    """
    names = [f.split()[0] for f in _BATCH_FIELDS.split(", ")]
    has = {c: F.when(F.col(c).isNotNull(), F.col("n")) for c in names}
    return batches.agg(
        *[(F.sum(F.col(c) * F.col("n")) / F.sum(has[c])).alias(c) for c in names],
        F.sum("n").alias("total_samples"),
    )


def collapse_flags(metrics: DataFrame) -> DataFrame:
    """Warnings on a metric row."""
    return metrics.select(
        (F.col("target_eff_rank") < MIN_RANK).alias("rank_collapsed"),
        (F.col("target_std_mean") < MIN_STD).alias("std_collapsed"),
        (F.col("diversity") < MIN_DIVERSITY).alias("diversity_collapsed"),
        (F.col("avg_similarity") > PINNED_COSINE).alias("cosine_pinned"),
    )


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Row counts in equal bins; bin 0 and bin ``bins + 1`` hold what lies outside."""
    b = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")
    return rows.groupBy(b).agg(F.count("*").alias("n"))


NEWTON_CELLS = 1 << 22  # numbers that a round adds up at once; more classes go in several passes


def _class_marks(rows: DataFrame, label: str, classes: list) -> Column:
    return F.array(*[(F.col(label) == F.lit(c)).cast("double") for c in classes])


def newton_weights(marked: DataFrame, vec_col: str, n_classes: int, ridge: float, rounds: int) -> np.ndarray:
    """Weights (with the intercept first) of one logistic regression per class, by Newton's method.

    A round is one pass over marked(vec_col, _marks): tasks add up the gradients and the weighted products of each
    class, and the solves are dims by dims. ``ridge`` holds all weights but the intercept.
    """
    slim = cut_lineage(marked.select(F.col(vec_col).cast("array<double>").alias("x"), "_marks"))
    first = slim.select(F.size("x").alias("n")).first()
    if first is None or not n_classes:
        return np.zeros((0, n_classes))
    dims = first["n"] + 1
    weights = np.zeros((dims, n_classes))
    hold = np.eye(dims) * ridge
    hold[0, 0] = 0.0
    step = max(1, NEWTON_CELLS // (dims * (dims + 1)))
    for _ in range(rounds):
        for low in range(0, n_classes, step):
            part = slice(low, min(n_classes, low + step))
            sums = added_up(slim, _newton_sums(weights[:, part], part)).reshape(-1, dims, dims + 1)
            for c, cells in zip(range(part.start, part.stop), sums, strict=True):
                slope = cells[:, dims] - hold @ weights[:, c]
                weights[:, c] += np.linalg.solve(cells[:, :dims] + hold, slope)
    return weights


def _newton_sums(weights: np.ndarray, part: slice):
    """Per class of the part: the products of the rows, weighted by the spread of their chance, and the gradient."""

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        x = np.hstack([np.ones((batch.num_rows, 1)), matrix(batch.column(0))])
        y = matrix(batch.column(1))[:, part]
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-(x @ weights)))
        cells = [np.column_stack([(x * (q * (1 - q))[:, None]).T @ x, x.T @ (m - q)]) for q, m in zip(p.T, y.T, strict=True)]
        return np.stack(cells).ravel()

    return measure


def linear_probe(
    train: DataFrame,
    held_out: DataFrame,
    *,
    vec_col: str = "vec",
    label: str = "label",
    ridge: float = 1.0,
    rounds: int = 6,
) -> DataFrame:
    """Accuracy of a logistic classifier on frozen vectors, one class against the rest, ties to the lowest.

    The classes are few: their list and the weights go to every task.
    """
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    marked = train.withColumn("_marks", _class_marks(train, label, classes))
    weights = newton_weights(marked, vec_col, len(classes), ridge, rounds)
    return _accuracy(held_out, classes, weights, vec_col, label)


def least_squares_probe(
    train: DataFrame, held_out: DataFrame, *, vec_col: str = "vec", label: str = "label", ridge: float = 1.0
) -> DataFrame:
    """Accuracy of the least-squares classifier, one class against the rest, ties to the lowest.

    One pass adds up the products of vectors and class marks; the solve is dims by dims. The
    classes are few: their list and the weights go to every task.
    """
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    z = gram(train.withColumn("_marks", _class_marks(train, label, classes)), vec_col, "_marks")
    dims = len(z) - len(classes)
    own = np.eye(dims) * ridge
    own[0, 0] = 0.0
    weights = np.linalg.solve(z[:dims, :dims] + own, z[:dims, dims:])
    return _accuracy(held_out, classes, weights, vec_col, label)


def _accuracy(held_out: DataFrame, classes: list, weights: np.ndarray, vec_col: str, label: str) -> DataFrame:
    """Share of rows whose class has the highest score, ties to the lowest; without a class, none is right."""

    @F.arrow_udf("bigint")
    def choose(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        if not n:
            return pa.array([], pa.int64())
        x = np.hstack([np.ones((n, 1)), matrix(vectors, n).astype(np.float64)])
        return pa.array((x @ weights).argmax(axis=1).astype(np.int64))

    if not classes:
        return held_out.agg(F.avg(F.lit(0.0)).alias("probe_acc"), F.count("*").alias("n_val"))
    named = F.array(*[F.lit(c) for c in classes])
    right = F.get(named, choose(vec_col).cast("int")) == F.col(label)
    return held_out.agg(F.avg(right.cast("double")).alias("probe_acc"), F.count("*").alias("n_val"))
