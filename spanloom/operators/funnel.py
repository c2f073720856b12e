"""Counters of the way from documents to pairs, and the limit on accepted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.functions import hashing
from spanloom.operators.pairs import sentence_pairs, split_sentences, window_before
from spanloom.operators.sentences import cut_sentences
from spanloom.operators.tokens import sentence_tokens
from spanloom.sources.sinks import write_pairs

FRAME = 2  # a begin and an end token


def limit_accepted(
    docs: DataFrame, limit: int | None, *, id_col: str = "doc_id", **cut_options
) -> DataFrame:
    """The scan up to the document that completes ``limit`` accepted ones.

    A widening range of ids is cut until it holds enough accepted documents; its filter reaches the
    scan, so no document far behind the limit is cut.
    """
    if not limit:
        return docs
    reach = 2 * limit
    while True:
        # The first ``reach`` ids: a bounded head that the scan can filter by.
        head = docs.select(id_col).orderBy(id_col).limit(reach).agg(
            F.max(id_col).alias("last"), F.count("*").alias("n")
        ).first()
        if head["n"] == 0:
            return docs
        part = docs.where(F.col(id_col) <= F.lit(head["last"]))
        accepted = cut_sentences(part, id_col=id_col, **cut_options).where("reason = 'processed'")
        row = (
            accepted.select(id_col)
            .orderBy(id_col)
            .limit(limit)
            .agg(F.max(id_col).alias("last"), F.count("*").alias("n"))
            .first()
        )
        if row["n"] >= limit:
            return docs.where(F.col(id_col) <= F.lit(row["last"]))
        if head["n"] < reach:
            return docs
        reach *= 4


def corpus_counts(
    docs: DataFrame,
    *,
    val_fraction: float = 0.0,
    max_tokens: int | None = None,
    window_size: int = 8,
    id_col: str = "doc_id",
    **cut_options,
) -> DataFrame:
    """The counters of a corpus build in one pass, without a shuffle of the texts.

    ``max_tokens`` counts the begin and end tokens that frame a context.
    """
    cut = _sized(cut_sentences(docs, id_col=id_col, **cut_options), max_tokens)
    is_val = hashing.is_val(F.col("text"), val_fraction)
    return cut.select("reason", *_measures(is_val, max_tokens, window_size)).agg(*_counters())


def write_counted_pairs(
    docs: DataFrame,
    path: str,
    *,
    val_fraction: float = 0.1,
    max_tokens: int | None = None,
    window_size: int = 8,
    id_col: str = "doc_id",
    **cut_options,
) -> dict[str, int]:
    """Write the pairs of a corpus and return its counters, both from one job: each text is read and cut once.

    The counters ride along with the rows that become pairs; no row is shuffled, so no task adds to them twice but
    one whose output was lost and made again.
    """
    cut = _sized(split_sentences(docs, val_fraction=val_fraction, id_col=id_col, **cut_options), max_tokens)
    seen = Observation("funnel")
    cut = cut.withColumns(dict(zip(_MEASURES, _measures(F.col("split") == "val", max_tokens, window_size), strict=True)))
    lists = {"tokens": ("unit_tokens", "text_tokens")} if max_tokens else None
    made = sentence_pairs(
        cut.observe(seen, *_counters()), window_size=window_size, id_col=id_col, carry=("split",), lists=lists
    )
    if max_tokens:
        made = drop_overlong(made, max_tokens).drop("context_tokens", "target_tokens")
    write_pairs(made, path)
    return seen.get


def _sized(cut: DataFrame, max_tokens: int | None) -> DataFrame:
    """With the tokens of the sentences and their counts, where contexts have a limit."""
    if max_tokens is None:
        return cut
    counts = {f"{c}_counts": F.transform(f"{c}_tokens", F.size) for c in ("text", "unit")}
    return sentence_tokens(cut).withColumns(counts)


_MEASURES = ("is_val", "made", "rejected")


def _measures(is_val: Column, max_tokens: int | None, window_size: int) -> list[Column]:
    """Of a document: its side, its pairs, and those over the limit."""
    made = F.greatest(F.coalesce(F.size("texts"), F.lit(0)) - 1, F.lit(0))
    rejected = F.lit(0) if max_tokens is None else _overlong_contexts(max_tokens, window_size)
    return [c.alias(n) for n, c in zip(_MEASURES, (is_val, made, rejected), strict=True)]


def _counters() -> list[Column]:
    kept = F.col("made") - F.col("rejected")
    done = F.col("reason") == "processed"
    count_if = lambda c: F.count_if(c).cast("bigint")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("total_docs"),
        count_if(done).alias("docs_processed"),
        count_if(F.col("reason") == "length").alias("docs_rejected_length"),
        count_if(F.col("reason") == "sentences").alias("docs_rejected_sentences"),
        total(F.when(done, kept)).alias("context_target_pairs"),
        total(F.when(done, F.col("rejected"))).alias("pairs_rejected_length"),
        count_if(done & F.col("is_val")).alias("docs_val"),
        total(F.when(done & F.col("is_val"), kept)).alias("pairs_val"),
        count_if(F.col("reason") == "error").alias("docs_failed"),
    ]


def _overlong_contexts(max_tokens: int, window_size: int):
    """Contexts over the token limit in one document row, from the counts of its sentences."""
    texts, units = F.col("text_counts"), F.col("unit_counts")

    def too_long(i):
        earlier = window_before(units, i, window_size)
        return F.aggregate(earlier, F.element_at(texts, i), lambda n, u: n + u) + FRAME > max_tokens

    return F.when(
        F.size(texts) >= 2,
        F.size(F.filter(F.sequence(F.lit(1), F.size(texts) - 1), too_long)),
    ).otherwise(0)


def require_pairs(pairs: DataFrame, *, min_length: int, min_sentences: int) -> DataFrame:
    """Fail early, with a hint, when a corpus gives no training pair."""
    if pairs.where("split = 'train'").isEmpty():
        raise RuntimeError(
            "no training pairs: lower min_length "
            f"({min_length}) or min_sentences ({min_sentences}), or hold out less"
        )
    return pairs


def drop_overlong(
    pairs: DataFrame, max_tokens: int | None, *, tokens_col: str = "context_tokens"
) -> DataFrame:
    """Drop pairs whose framed context has more than ``max_tokens`` tokens; None turns it off."""
    if not max_tokens:
        return pairs
    return pairs.where(F.size(tokens_col) + FRAME <= max_tokens)
