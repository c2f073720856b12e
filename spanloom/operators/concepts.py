"""Text to concept vector, and pooling of token vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import vectors as vec
from spanloom.operators.blocks import matrix
from spanloom.operators.joins import lookup_join
from spanloom.operators.tokens import sentence_tokens

DIMS = 64
CHUNK = 16_384  # sentences that are turned into sums at once; a longer document is a chunk of its own


@lru_cache(maxsize=1 << 18)
def token_code(token: str) -> int:
    """The hash that gives a token its dimension and sign."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _count_signed(tokens: pa.Array, dims: int) -> np.ndarray:
    """One row of signed token counts per token list."""
    n = len(tokens)
    words = tokens.flatten().dictionary_encode()
    codes = np.array([token_code(w) for w in words.dictionary.to_pylist()], dtype=np.int64)
    codes = codes[words.indices.to_numpy(zero_copy_only=False)]
    cell = np.repeat(np.arange(n, dtype=np.int64), _lengths(tokens)) * dims + codes % dims
    sums = np.bincount(cell, weights=1 - 2 * (codes // dims % 2), minlength=n * dims)
    return sums.reshape(n, dims)


def _as_lists(rows: np.ndarray) -> pa.Array:
    n, dims = rows.shape
    offsets = np.arange(0, n * dims + 1, dims, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.float32, copy=False).ravel()))


def token_sums(tokens: Column, dims: int = DIMS) -> Column:
    """Sum of the signed one-hot token vectors: small whole numbers, exact in a float.

    It has the direction of the mean, so cosines may be taken from it without rounding.
    """

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array) -> pa.Array:
        return _as_lists(_count_signed(lists, dims))

    return run(tokens)


def concept_sums(text: Column, dims: int = DIMS) -> Column:
    return token_sums(tx.tokens(text), dims)


def _pair_chunks(texts: pa.Array, gaps: pa.Array, window_size: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token sums of the contexts and of the targets of all pairs, in chunks of whole documents."""
    sizes = _lengths(texts).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        begun = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begun + CHUNK, side="right")))
        own = _count_signed(texts[lo:hi].flatten(), dims)
        whole = own + _count_signed(gaps[lo:hi].flatten(), dims)
        before = np.concatenate([np.zeros((1, dims)), np.cumsum(whole, axis=0)])
        place = np.arange(len(own)) - np.repeat(ends[lo:hi] - sizes[lo:hi] - begun, sizes[lo:hi])
        last = np.flatnonzero(place > 0)
        first = last - np.minimum(place[last], window_size)
        yield before[last - 1] - before[first] + own[last - 1], own[last]
        lo = hi


def _pair_offsets(texts: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.maximum(_lengths(texts).astype(np.int64) - 1, 0))])


def _sums_of_pairs(texts: pa.Array, gaps: pa.Array, window_size: int, dims: int) -> pa.Array:
    """Per document the token sums of the contexts and of the targets of its pairs."""
    offsets = _pair_offsets(texts)
    context, target = (np.empty((offsets[-1], dims), dtype=np.float32) for _ in range(2))
    at = 0
    for one, two in _pair_chunks(texts, gaps, window_size, dims):
        context[at : at + len(one)], target[at : at + len(one)] = one, two
        at += len(one)
    cuts = pa.array(offsets.astype(np.int32))
    nested = [pa.ListArray.from_arrays(cuts, _as_lists(rows)) for rows in (context, target)]
    return pa.StructArray.from_arrays(nested, names=["context", "target"])


def pair_sums(
    cut: DataFrame, *, window_size: int = 8, dims: int = DIMS, out: str = "sums"
) -> DataFrame:
    """Token sums of the context and the target of each pair of a document.

    Adds a struct of two arrays with one vector per pair, for ``sentence_pairs(ready=...)``.
    Every sentence is hashed once; contexts are differences of running sums. A batch of documents is worked off in
    chunks of whole documents, so memory beyond its input and output follows ``CHUNK``.
    """

    @F.arrow_udf("context array<array<float>>, target array<array<float>>")
    def run(texts: pa.Array, gaps: pa.Array) -> pa.Array:
        return _sums_of_pairs(texts, gaps, window_size, dims)

    return sentence_tokens(cut).withColumn(out, run("text_tokens", "gap_tokens"))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of whole numbers; 0 to a zero row."""
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    dot, one, two = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
    length = np.sqrt(one * two)
    return np.divide(dot, length, out=np.zeros(len(a)), where=length > 0)


def pair_cosines(cut: DataFrame, *, window_size: int = 8, dims: int = DIMS, out: str = "cosines") -> DataFrame:
    """The cosines between the sums of ``pair_sums``, one number per pair of a document; the sums leave no task."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array, gaps: pa.Array) -> pa.Array:
        parts = [_cosines(*both) for both in _pair_chunks(texts, gaps, window_size, dims)]
        cuts = pa.array(_pair_offsets(texts).astype(np.int32))
        return pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0), *parts])))

    return sentence_tokens(cut).withColumn(out, run("text_tokens", "gap_tokens"))


def concept(sums: Column, *, normalized: bool = True, n_tokens: Column | None = None) -> Column:
    """Concept vector: the mean over tokens, at unit length unless switched off."""
    if normalized:
        return vec.normalize(sums)
    return vec.scaled(sums, F.greatest(n_tokens, F.lit(1)).cast("double"))


def summed_vectors(rows: DataFrame, *keys: str, vec_col: str, weight: Column | None = None) -> DataFrame:
    """Per key: ``n`` rows, ``w`` (sum of weights), and the arrays ``s`` and ``q`` with the weighted sum and sum of
    squares of each dimension. Works at any width.

    Each batch adds up its rows per key first, so a key of any size sends one row per batch, and
    plans do not grow with the width.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    weight = F.lit(1.0) if weight is None else weight
    slim = rows.select(
        F.to_json(group).alias("g") if keys else F.lit("").alias("g"),
        *[F.col(k) for k in keys],
        weight.cast("double").alias("_w"),
        F.col(vec_col).cast("array<double>").alias("_v"),
    ).where("_v is not null and _w is not null")
    fields = [slim.schema[k] for k in keys]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(len(keys) + 2)).astype(np.float64)
            w = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            own = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            _, first, own = np.unique(own, return_index=True, return_inverse=True)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(first)))
            sums = np.add.reduceat((x * w[:, None])[order], cuts, axis=0)
            squares = np.add.reduceat((x * x * w[:, None])[order], cuts, axis=0)
            offsets = pa.array(np.arange(0, sums.size + 1, max(x.shape[1], 1), dtype=np.int32))
            arrays = [batch.column(k + 1).take(pa.array(first)) for k in range(len(keys))]
            arrays += [
                pa.array(np.bincount(own).astype(np.int64)),
                pa.array(np.bincount(own, weights=w)),
                pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())),
                pa.ListArray.from_arrays(offsets, pa.array(squares.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", "w", "s", "q"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    parts = slim.mapInArrow(add, ", ".join([*kinds, "n bigint", "w double", "s array<double>", "q array<double>"]))
    flat = parts.select(*keys, "n", "w", F.posexplode(F.arrays_zip("s", "q")).alias("pos", "x"))
    dims = flat.groupBy(*keys, "pos").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q")
    )
    whole = dims.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("w").alias("w"),
        F.array_sort(F.collect_list(F.struct("pos", "s", "q"))).alias("x"),
    )
    return whole.select(*keys, "n", "w", F.col("x.s").alias("s"), F.col("x.q").alias("q"))


def masked_mean(
    hidden: DataFrame, *keys: str, vec_col: str = "vec", mask_col: str = "mask"
) -> DataFrame:
    """Mean of the unmasked token vectors of each sequence; all padding gives zeros."""
    total = summed_vectors(hidden, *keys, vec_col=vec_col, weight=F.col(mask_col))
    count = F.greatest(F.col("w"), F.lit(1.0))
    return total.select(*keys, F.transform("s", lambda x: x / count).alias(vec_col))


def pooled_concepts(
    texts: DataFrame,
    token_vectors: DataFrame,
    *ids: str,
    text_col: str = "text",
) -> DataFrame:
    """Concepts from a supplied (token, vec) table: join, masked mean, unit length.

    Each distinct token of a text is joined once, weighted by its count; tokens without a
    vector are left out.
    """
    counts = (
        texts.select(*ids, F.explode(tx.tokens(F.col(text_col))).alias("token"))
        .groupBy(*ids, "token")
        .agg(F.count("*").alias("mask"))
    )
    found = lookup_join(counts, token_vectors, "token", *ids)
    pooled = masked_mean(found, *ids)
    return pooled.withColumn("vec", vec.normalize(F.col("vec")))
