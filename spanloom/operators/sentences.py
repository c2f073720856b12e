"""Documents to sentences with exact character spans.

Every step works inside one document row, so no shuffle is needed and one very
frequent source or copied text cannot fill a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import text as tx
from spanloom.session import compute_once

# Separators tried in this order on a sentence that is too long.
FALLBACK_SEPARATORS = ("...", "\n", "!", "?", ";", ":", ".", ",", "\t", " ")

Splitter = Callable[[list[str]], list[list[str]]]


def pack_words(segment: str, limit: int) -> list[str]:
    """Fill chunks with whole words up to ``limit`` characters; a longer word stays whole."""
    chunks: list[list[str]] = []
    room = -1
    for word in segment.split():
        if len(word) > room:
            chunks.append([])
            room = limit
        chunks[-1].append(word)
        room -= len(word) + 1
    return [" ".join(chunk) for chunk in chunks]


def shorten(segment: str, limit: int, separators: tuple[str, ...] = FALLBACK_SEPARATORS) -> list[str]:
    """Cut a long segment at the first separator, then its long parts at the next ones.

    A segment without the separator is packed by words at once.
    """
    if len(segment) <= limit:
        return [segment]
    if not separators:
        return pack_words(segment, limit)
    stripped = (part.strip() for part in segment.split(separators[0]))
    parts = [part for part in stripped if part]
    if len(parts) == 1 and len(parts[0]) == len(segment):
        parts = pack_words(segment, limit)
    return [piece for part in parts for piece in shorten(part, limit, separators[1:])]


def find_spans(text: str, sentences: list[str]) -> list[tuple[int, int]]:
    """Spans by forward search; a sentence that is not found is left out."""
    spans: list[tuple[int, int]] = []
    cursor = 0
    for sentence in sentences:
        at = text.find(sentence, cursor)
        if at >= 0:
            cursor = at + len(sentence)
            spans.append((at, cursor))
    return spans


PIECE = "struct<s:string,u:string>"


def _cut_long(limit: int):
    """Arrow step over the sentences that are too long; the others arrive as nulls.

    A piece comes with its raw slice up to the next piece. A sentence whose pieces do not tile
    it (a blank was normalized, or it begins with a separator) gives an empty list.
    """

    def pieces(sentence: str) -> list[dict]:
        cut = shorten(sentence, limit)
        spans = find_spans(sentence, cut)
        if len(spans) < len(cut) or spans[0][0] > 0:
            return []
        stops = [a for a, _ in spans[1:]] + [len(sentence)]
        return [{"s": s, "u": sentence[a:b]} for s, (a, _), b in zip(cut, spans, stops, strict=True)]

    @F.arrow_udf(f"array<array<{PIECE}>>")
    def run(lists: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
        offsets = np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False)))).astype(np.int32)
        flat = [None if x is None else pieces(x) for x in lists.flatten().to_pylist()]
        kind = pa.list_(pa.struct([("s", pa.string()), ("u", pa.string())]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))

    return run


# Documents that a Python function holds as objects at once; an Arrow batch may have many times more.
SLICE = 256


def _sliced(batches: Iterator) -> Iterator[tuple[pa.Array, ...]]:
    """The batches in slices of bounded rows."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), SLICE):
            yield tuple(c.slice(at, SLICE) for c in columns)


_STRINGS = pa.list_(pa.string())
_RECUT = pa.struct([("n_split", pa.int32()), ("texts", _STRINGS), ("units", _STRINGS), ("starts", pa.list_(pa.int32()))])


def _recut(limit: int | None, min_unique: int):
    """Arrow-batched step for the documents that only a search in the text can finish."""

    def one(text: str | None, given: list[str] | None) -> dict:
        if text is None or given is None:
            return {}
        cut = [s for g in given for s in (shorten(g, limit) if limit else [g])]
        if min_unique > 0:
            cut = [s for s in cut if len(set(s)) > min_unique]
        spans = find_spans(text, cut)
        starts = [a for a, _ in spans]
        stops = starts[1:] + [b for _, b in spans[-1:]]
        return {
            "n_split": len(cut),
            "texts": [text[a:b] for a, b in spans],
            "units": [text[a:b] for a, b in zip(starts, stops, strict=True)],
            "starts": starts,
        }

    @F.arrow_udf("n_split int, texts array<string>, units array<string>, starts array<int>")
    def recut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, sentences in _sliced(batches):
            rows = [one(*row) for row in zip(texts.to_pylist(), sentences.to_pylist(), strict=True)]
            yield pa.array(rows, _RECUT)

    return recut


def _with_pieces(cut: DataFrame, limit: int) -> DataFrame:
    """Put the pieces of long sentences in their place; ``hard`` marks texts where they do not tile."""
    is_long = lambda s: F.length(s) > limit
    has_long = F.exists("texts", is_long)
    only_long = F.transform("texts", lambda s: F.when(is_long(s), s))
    cut = cut.withColumn("parts", _cut_long(limit)(F.when(has_long, only_long)))
    own = lambda t: F.array(F.struct(t["texts"].alias("s"), t["units"].alias("u")))

    def tiled(t: Column, p: Column) -> Column:
        gap = F.substring(t["units"], F.length(t["texts"]) + 1, F.length(t["units"]))
        rest = F.transform(
            p,
            lambda x, k: F.struct(
                x["s"].alias("s"),
                F.when(k == F.size(p) - 1, F.concat(x["u"], gap)).otherwise(x["u"]).alias("u"),
            ),
        )
        return F.when(p.isNull(), own(t)).otherwise(rest)

    items = F.flatten(F.zip_with(F.arrays_zip("texts", "units"), "parts", tiled))
    cut = compute_once(cut, "items", F.when(F.size("parts") > 0, items))
    return cut.withColumns(
        {
            "hard": F.coalesce(F.exists("parts", lambda p: F.size(p) == 0), F.lit(False)),
            "texts": F.coalesce(F.col("items.s"), F.col("texts")),
            "units": F.coalesce(F.col("items.u"), F.col("units")),
        }
    ).drop("parts", "items")


def _without_monotone(cut: DataFrame, min_unique: int) -> DataFrame:
    """Drop sentences of few distinct characters; their raw slices go to the one before."""
    kept = F.filter(
        F.sequence(F.lit(0), F.size("texts") - 1),
        lambda i: tx.unique_chars(F.get("texts", i)) > min_unique,
    )
    cut = compute_once(cut, "kept", F.when(F.size("texts") > 0, kept))
    last = F.size("units") - 1
    joined = F.transform(
        "kept",
        lambda i, k: F.array_join(
            F.transform(
                F.sequence(i, F.coalesce(F.get("kept", k + 1) - 1, last)), lambda j: F.get("units", j)
            ),
            "",
        ),
    )
    return cut.withColumns(
        {
            "starts": F.transform("kept", lambda i: F.get("starts", i)),
            "texts": F.when(F.size("texts") > 0, F.transform("kept", lambda i: F.get("texts", i))).otherwise(F.col("texts")),
            "units": F.when(F.size("texts") > 0, joined).otherwise(F.col("units")),
        }
    ).drop("kept")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_starts(lengths: pa.Array) -> pa.Array:
    """Offset of each unit in its text, from the unit lengths."""
    flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(flat)))
    sizes = np.nan_to_num(
        pa.compute.list_value_length(lengths).to_numpy(zero_copy_only=False).astype(float)
    ).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts = before[:-1] - np.repeat(before[offsets[:-1]], sizes)
    built = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(starts, pa.int32())
    )
    return built if lengths.null_count == 0 else pa.compute.if_else(lengths.is_valid(), built, None)


_HOOKED = pa.struct([("sents", _STRINGS), ("error", pa.string())])


def _hooked(splitter: Splitter):
    """Run a user's splitter over batches; a text it fails on gets an error, the rest go on."""

    @F.arrow_udf("sents array<string>, error string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (batch,) in _sliced(batches):
            given = batch.to_pylist()
            rows = [{} for _ in given]
            todo = [i for i, t in enumerate(given) if t is not None]
            texts = [given[i] for i in todo]
            try:
                for i, sents in zip(todo, splitter(texts), strict=True):
                    rows[i] = {"sents": list(sents)}
            except Exception:
                for i, t in zip(todo, texts, strict=True):
                    try:
                        rows[i] = {"sents": list(splitter([t])[0])}
                    except Exception as fault:
                        rows[i] = {"error": f"{type(fault).__name__}: {fault}"}
            yield pa.array(rows, _HOOKED)

    return run


def require_text(df: DataFrame, col: str) -> None:
    """Reject a column of another type before any work starts."""
    kind = df.schema[col].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"column {col!r} must hold strings, not {kind}")


def cut_sentences(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    min_length: int = 100,
    min_sentences: int = 2,
    max_sentence_len: int | None = 256,
    min_text_length: int = 10,
    min_unique_chars: int = 0,
    splitter: Splitter | None = None,
    spans: bool = False,
) -> DataFrame:
    """One row per document: its sentences as parallel arrays and a ``reason``.

    ``texts`` are the sentences, ``units`` the raw slices from one sentence start to the
    next, ``starts`` (with ``spans``) their offsets. The arrays are null unless the reason
    is ``processed``; the other reasons are ``length``, ``sentences`` and ``error``.
    """
    require_text(docs, text_col)
    keep = [id_col, *carry]
    base = docs.select(*keep, F.col(text_col).alias("text")).select(
        *keep, tx.strip(F.coalesce("text", F.lit(""))).alias("text")
    )
    long_enough = F.length("text") >= min_length
    todo = F.when(long_enough & (F.length("text") > min_text_length), F.col("text"))

    if splitter is None:
        tiled = F.regexp_extract_all(todo, F.lit(tx.UNIT_PATTERN), F.lit(0))
        cut = base.withColumn("error", F.lit(None).cast("string")).withColumn("units", tiled)
    else:
        cut = base.withColumn("hook", _hooked(splitter)(todo))
        cut = cut.withColumn("error", F.col("hook.error")).withColumn("units", F.col("hook.sents"))
        cut = cut.drop("hook")
    short = F.when(F.col("text") != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    bypass = long_enough & (F.length("text") <= min_text_length)
    cut = cut.withColumn("units", F.when(bypass, short).otherwise(F.col("units")))
    if splitter is None:
        cut = cut.withColumn("texts", F.transform("units", tx.rstrip))
    else:
        given = F.filter(F.transform("units", tx.strip), lambda s: s != "")
        cut = cut.withColumn("texts", given)

    cut = cut.withColumn("hard", F.lit(splitter is not None) & ~bypass)
    # The given sentences, for the texts that need a search.
    cut = cut.withColumn("given", F.col("texts"))
    if splitter is None and max_sentence_len is not None:
        cut = _with_pieces(cut, max_sentence_len)
    if spans or min_unique_chars > 0:
        cut = cut.withColumn("starts", running_starts(F.transform("units", F.length)))
    if splitter is None and min_unique_chars > 0:
        cut = _without_monotone(cut, min_unique_chars)
    if splitter is not None or max_sentence_len is not None:
        again = _recut(max_sentence_len, min_unique_chars)(
            F.when(F.col("hard"), F.col("text")), F.when(F.col("hard"), F.col("given"))
        )
        cut = cut.withColumn("again", again)
        pick = lambda name, plain: F.when(F.col("hard"), F.col(f"again.{name}")).otherwise(plain)
    else:
        pick = lambda name, plain: plain

    fields: dict[str, Column] = {
        "n_split": pick("n_split", F.size("texts")),
        "units": pick("units", F.col("units")),
        "texts": pick("texts", F.col("texts")),
    }
    if spans:
        fields["starts"] = pick("starts", F.col("starts"))
    out = cut.select(*keep, "text", "error", *[c.alias(n) for n, c in fields.items()])
    reason = (
        F.when(F.length("text") < min_length, "length")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("n_split") < min_sentences, "sentences")
        .otherwise("processed")
    )
    out = out.withColumn("reason", reason)
    for name in [n for n in fields if n != "n_split"]:
        out = out.withColumn(name, F.when(F.col("reason") == "processed", F.col(name)))
    return out


def sentence_table(cut: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per sentence from ``cut_sentences(..., spans=True)``."""
    zipped = F.arrays_zip("texts", "starts")
    return (
        cut.select(id_col, F.posexplode_outer(zipped).alias("sent_idx", "s"))
        .where("s is not null")
        .select(
            id_col,
            "sent_idx",
            F.col("s.texts").alias("text"),
            F.col("s.starts").alias("start_idx"),
            (F.col("s.starts") + F.length("s.texts")).alias("end_idx"),
        )
    )


def drop_monotone(sentences: DataFrame, min_unique: int, col: str = "text") -> DataFrame:
    """Keep sentences with more than ``min_unique`` distinct characters; 0 turns it off."""
    if min_unique <= 0:
        return sentences
    return sentences.where(tx.unique_chars(F.col(col)) > min_unique)
