"""(context, target) pairs: the previous sentences and the next one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import hashing
from spanloom.functions.text import strip
from spanloom.operators.sentences import cut_sentences


def window_before(items: Column, i: Column, window_size: int) -> Column:
    """The items in front of the ``i``-th (from 1) that share a window of that size with it.

    Items are fetched one by one: a slice would copy the whole array for every position.
    """
    first = F.greatest(i - window_size + 1, F.lit(1))
    places = F.when(first < i, F.sequence(first, i - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda j: F.element_at(items, j))


def sentence_pairs(
    cut: DataFrame,
    *,
    window_size: int = 8,
    id_col: str = "doc_id",
    carry: tuple[str, ...] = (),
    sides: tuple[str, ...] = ("context", "target"),
    lists: dict[str, tuple[str, str]] | None = None,
    ready: dict[str, str] | None = None,
) -> DataFrame:
    """Pairs of each document, built inside its row.

    The context is the raw slice of the text, so the blanks between its sentences stay.
    It is joined from units rather than cut out of the text: the cost follows the length
    of the contexts and not of the document.

    ``sides`` names the texts to build; a job on ids or vectors needs none. ``lists`` names columns with one list per unit and one per sentence, such as token ids.
    Pairs get ``context_<name>`` and ``target_<name>`` from them, so the tokens of a sentence
    are found once and not for every context it is part of. ``ready`` names array columns that
    already hold one entry per pair.
    """
    texts, units = F.col("texts"), F.col("units")
    # A job on lists alone leaves the texts behind.
    count = F.size(texts if sides or not lists else F.col(next(iter(lists.values()))[1]))

    def pair(i):
        earlier = lambda c: window_before(c, i, window_size)
        built = {
            "context": lambda: F.concat(F.array_join(earlier(units), ""), F.element_at(texts, i)),
            "target": lambda: F.element_at(texts, i + 1),
        }
        fields = [(i - 1).alias("pair_idx"), *[built[side]().alias(side) for side in sides]]
        for name, (unit, text) in (lists or {}).items():
            last = F.element_at(F.col(text), i)
            fields.append(
                F.concat(F.flatten(earlier(F.col(unit))), last).alias(f"context_{name}")
            )
            fields.append(F.element_at(F.col(text), i + 1).alias(f"target_{name}"))
        fields += [F.element_at(F.col(c), i).alias(name) for name, c in (ready or {}).items()]
        return F.struct(*fields)

    made = F.when(count >= 2, F.transform(F.sequence(F.lit(1), count - 1), pair))
    extra = [f"p.{side}_{name}" for name in lists or {} for side in ("context", "target")]
    extra += [f"p.{name}" for name in ready or {}]
    # The outer form keeps the optimizer from copying the array expression into a filter.
    return (
        cut.select(id_col, *carry, F.explode_outer(made).alias("p"))
        .where("p is not null")
        .select(id_col, *carry, "p.pair_idx", *[f"p.{side}" for side in sides], *extra)
    )


def context_sizes(texts: Column, gaps: Column, *, window_size: int = 8) -> Column:
    """Per pair the size of its context, from the sizes of a document's sentences and of the gaps behind them; for ``ready``."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array, gaps: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own, gap = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (texts, gaps))
        before = np.concatenate([[0], np.cumsum(own + gap)])
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        target = np.flatnonzero(place > 0)
        first = target - np.minimum(place[target], window_size)
        found = before[target - 1] - before[first] + own[target - 1]
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.astype(np.int32)))

    return run(texts, gaps)


def split_sentences(
    docs: DataFrame,
    *,
    val_fraction: float = 0.1,
    split: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    **cut_options,
) -> DataFrame:
    """``cut_sentences`` with the ``split`` of each document; with ``split`` only that side.

    The side is decided from the document text before any sentence work.
    """
    if split not in (None, "train", "val"):
        raise ValueError(f"split must be 'train' or 'val', got {split!r}")
    stripped = strip(F.coalesce(F.col(text_col), F.lit("")))
    held_out = hashing.is_val(stripped, val_fraction)
    side = docs.withColumn("split", F.when(held_out, "val").otherwise("train"))
    if split is not None:
        side = side.where(F.col("split") == split)
    return cut_sentences(side, id_col=id_col, text_col=text_col, carry=("split",), **cut_options)


def split_pairs(
    docs: DataFrame,
    *,
    window_size: int = 8,
    id_col: str = "doc_id",
    sides: tuple[str, ...] = ("context", "target"),
    **options,
) -> DataFrame:
    """Pairs with the split of their document; the options are those of ``split_sentences``."""
    cut = split_sentences(docs, id_col=id_col, **options)
    return sentence_pairs(
        cut, window_size=window_size, id_col=id_col, carry=("split",), sides=sides
    )


def span_pairs(
    sentences: DataFrame,
    *,
    window_size: int = 8,
    key: str = "doc_id",
    order: str = "sent_idx",
    block_rows: int = 100_000,
) -> DataFrame:
    """Pair spans from a sentence table, by a window frame.

    A key is cut into blocks of ``block_rows`` sentences. The last ``window_size`` sentences
    of a block are also handed to the next one, so every frame is whole and a document that
    holds a third of the rows is still shared by many tasks.
    """
    if window_size >= block_rows:
        raise ValueError("block_rows must exceed window_size")
    own = F.floor(F.col(order) / block_rows)
    tail = F.col(order) % block_rows >= block_rows - window_size
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    rows = sentences.select(key, order, "start_idx", "end_idx", F.explode(blocks).alias("block"))
    frame = Window.partitionBy(key, "block").orderBy(order).rowsBetween(-window_size, -1)
    return (
        rows.withColumn("context_start", F.min("start_idx").over(frame))
        .withColumn("context_end", F.max("end_idx").over(frame))
        .where((F.floor(F.col(order) / block_rows) == F.col("block")) & (F.col(order) > 0))
        .select(
            key,
            (F.col(order) - 1).alias("pair_idx"),
            "context_start",
            "context_end",
            F.col("start_idx").alias("target_start"),
            F.col("end_idx").alias("target_end"),
        )
    )
