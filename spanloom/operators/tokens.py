"""Vocabulary, token ids, and padded batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators.ranking import global_rank
from spanloom.session import compute_once, written

# Ids of the special tokens; words follow them.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
FIRST_WORD = 4

# The broadcast head of a vocabulary: at most so many tokens of at most so many bytes.
HEAD_TOKENS = 200_000
HEAD_TOKEN_BYTES = 64


def token_counts(texts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(token, n) of all distinct tokens, in no order."""
    tokens = texts.select(F.explode(tx.tokens(F.col(text_col))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(texts: DataFrame, *, text_col: str = "text", size: int | None = None) -> DataFrame:
    """Tokens by falling count (ties by token) with their ids.

    With ``size`` only the most frequent tokens get an id, as in a tokenizer of fixed size.
    """
    counts = token_counts(texts, text_col=text_col)
    order = (F.col("n").desc(), F.col("token"))
    if size is None:
        return global_rank(counts, *order, name="rank").select(
            "token", "n", (F.col("rank") + FIRST_WORD).alias("token_id")
        )
    top = counts.orderBy(*order).limit(size)
    return top.select(
        "token",
        "n",
        (F.row_number().over(Window.orderBy(*order)) + (FIRST_WORD - 1)).cast("bigint").alias("token_id"),
    )


def sentence_tokens(cut: DataFrame) -> DataFrame:
    """Tokens of each sentence of ``cut_sentences``, of the gap behind it, and of both.

    A sentence ends at a terminator, a separator or a blank, so no token crosses into the
    gap, and the tokens of a context are those of its parts in order.
    """
    gap = F.zip_with(
        "units", "texts", lambda u, t: tx.tokens(F.substring(u, F.length(t) + 1, F.length(u)))
    )
    lists = cut.withColumn("text_tokens", F.transform("texts", tx.tokens)).withColumn("gap_tokens", gap)
    both = F.zip_with("text_tokens", "gap_tokens", lambda t, g: F.concat(t, g))
    return lists.withColumn("unit_tokens", both)


def _mapped(values: pa.Array, change) -> pa.Array:
    """The same nested lists over changed elements."""
    if not pa.types.is_list(values.type):
        return change(values)
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _mapped(values.flatten(), change))


# The words of the current broadcast head and their lookup, built once per worker process.
_CURRENT: list = [None, {}]


def _head(vocab: DataFrame, size: int) -> DataFrame:
    """The frequent tokens of at most HEAD_TOKEN_BYTES bytes: a table of bounded bytes."""
    kept = (F.col("token_id") < FIRST_WORD + size) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    return vocab.where(kept).select("token", "token_id")


def _rest(vocab: DataFrame, size: int) -> DataFrame:
    kept = (F.col("token_id") < FIRST_WORD + size) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    return vocab.where(~kept).select("token", "token_id")


def _known(table) -> dict[str, int]:
    """The table as a dictionary, built once per worker; an older one is dropped."""
    words, numbers = table.value
    if _CURRENT[0] is not words:
        _CURRENT[:] = [words, dict(zip(words, numbers, strict=True))]
    return _CURRENT[1]


def _row_sizes(values: pa.Array) -> np.ndarray:
    """The number of innermost elements of each row of nested lists."""
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = values.flatten()
    if not pa.types.is_list(inner.type):
        return sizes
    before, ends = np.concatenate(([0], np.cumsum(_row_sizes(inner)))), np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


def _lookup(spark: SparkSession, head: DataFrame, marked: bool):
    """A column function from nested token lists to ``ids``, the same lists of ids, and ``open``, the row's distinct unknown tokens.

    An unknown token gets the unknown id or, if ``marked``, minus its place (from 1) in ``open``.
    """
    rows = head.toArrow()
    words, numbers = rows["token"].to_pylist(), rows["token_id"].to_pylist()
    shared = spark.sparkContext.broadcast((words, numbers))

    @F.arrow_udf("ids array<array<array<int>>>, open array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        known = _known(shared)
        cuts = [np.zeros(len(tokens) + 1, np.int32), pa.array([], pa.string())]

        def ids(flat: pa.Array) -> pa.Array:
            coded = flat.dictionary_encode()
            told = coded.dictionary.to_pylist()
            own = np.array([known.get(w, UNK) for w in told], np.int32)
            place = coded.indices.to_numpy(zero_copy_only=False)
            found = own[place] if len(own) else np.zeros(0, np.int32)
            if marked and len(found):
                at = np.flatnonzero(found == UNK)
                row = np.repeat(np.arange(len(tokens)), _row_sizes(tokens))[at]
                each, back = np.unique(row * len(told) + place[at], return_inverse=True)
                cuts[0] = np.searchsorted(each, np.arange(len(tokens) + 1) * len(told)).astype(np.int32)
                cuts[1] = coded.dictionary.take(pa.array(each % len(told)))
                found[at] = cuts[0][row] - 1 - back
            return pa.array(found, pa.int32())

        lists = _mapped(tokens, ids)
        return pa.StructArray.from_arrays([lists, pa.ListArray.from_arrays(pa.array(cuts[0]), cuts[1])], names=["ids", "open"])

    return run


def _coded(rows: DataFrame, vocab: DataFrame, lists: Column, ids: tuple[str, ...], head_size: int) -> DataFrame:
    """Add ``_ids``: the ids of nested token lists.

    Tokens of the broadcast head are looked up in the row. The rest are joined by token, once per row and token however
    often the row holds it; no rare token is a hot key. The tokens themselves do not move, only the open ones.
    """
    rest = _rest(vocab, head_size)
    marked = not rest.isEmpty()
    run = _lookup(rows.sparkSession, _head(vocab, head_size), marked)
    coded = compute_once(rows.withColumn("_tokens", lists), "_c", run("_tokens")).drop("_tokens")
    if not marked:
        return coded.withColumn("_ids", F.col("_c.ids")).drop("_c")
    asked = coded.select(*ids, F.posexplode("_c.open").alias("_at", "token"))
    number = F.coalesce(F.col("token_id").cast("int"), F.lit(UNK)).alias("i")
    found = asked.join(rest, "token", "left").groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.struct("_at", number))).alias("_found")
    )
    # The open tokens went to their join; from here on a row has but its ids.
    coded = coded.withColumn("_c", F.col("_c.ids"))
    joined = coded.join(found.select(*ids, F.col("_found.i").alias("_found")), list(ids), "left")
    told = lambda x: F.when(x < 0, F.get("_found", -x - 1)).otherwise(x)
    filled = F.transform("_c", lambda part: F.transform(part, lambda said: F.transform(said, told)))
    filled = F.when(F.col("_found").isNull(), F.col("_c")).otherwise(filled)
    return joined.withColumn("_ids", filled).drop("_found", "_c")


def encode_sentences(
    cut: DataFrame, vocab: DataFrame, *, id_col: str = "doc_id", head_size: int = HEAD_TOKENS
) -> DataFrame:
    """Token ids of the sentences and units of documents: ``text_ids``, ``unit_ids``.

    A token outside the vocabulary gets the unknown id. ``id_col`` must identify a row.
    """
    lists = sentence_tokens(cut)
    coded = _coded(lists, vocab, F.array("text_tokens", "gap_tokens"), (id_col,), head_size)
    units = F.zip_with(F.col("_ids")[0], F.col("_ids")[1], lambda t, g: F.concat(t, g))
    coded = coded.withColumns({"text_ids": F.col("_ids")[0], "unit_ids": units})
    return coded.drop("_ids", "text_tokens", "gap_tokens", "unit_tokens")


def encode(
    rows: DataFrame,
    vocab: DataFrame,
    *ids: str,
    text_col: str = "text",
    out: str = "token_ids",
    head_size: int = HEAD_TOKENS,
) -> DataFrame:
    """Token ids of each text; a token outside the vocabulary gets the unknown id.

    ``ids`` must identify a row.
    """
    lists = F.array(F.array(tx.tokens(F.coalesce(F.col(text_col), F.lit("")))))
    coded = _coded(rows, vocab, lists, ids, head_size)
    return coded.withColumn(out, F.col("_ids")[0][0]).drop("_ids")


def with_specials(ids: Column, max_length: int | None) -> Column:
    """Frame by begin and end; ``max_length`` counts both."""
    body = ids if max_length is None else F.slice(ids, 1, max(max_length - 2, 0))
    return F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)))


def framed_size(size: Column, max_length: int | None) -> Column:
    """How many ids ``with_specials`` makes of so many."""
    return (size if max_length is None else F.least(size, F.lit(max(max_length - 2, 0)))) + 2


def batch_lengths(rows: DataFrame, position: str, batch_size: int, *, size_col: str, out: str = "seq_len") -> DataFrame:
    """Add the longest size of each row's batch of consecutive positions.

    A batch holds at most ``batch_size`` rows, which bounds every window group.
    """
    batch = F.floor(F.col(position) / batch_size).cast("bigint")
    return rows.withColumn(out, F.max(size_col).over(Window.partitionBy(batch)))


def places_of_documents(places: DataFrame, batch_size: int, *, id_col: str = "doc_id") -> DataFrame:
    """Per document the ``positions`` of its pairs, in order, and the ``lengths`` of their batches.

    ``places`` has a row per pair: id, ``pair_idx``, ``position``, and the ``size`` of its sequence. Rows of one id share the first places
    of all their pairs, so a place is as long as the longest of the pairs that take it.
    """
    entry = F.struct("pair_idx", "position", "size")
    held = places.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("p"))
    last = F.element_at("p", -1)["pair_idx"]
    longest = lambda i: F.array_max(F.transform(F.filter("p", lambda e: e["pair_idx"] == i), lambda e: e["size"]))
    once = F.size("p") == last + 1
    sizes = F.when(once, F.col("p.size")).otherwise(F.transform(F.sequence(F.lit(0), last), longest))
    held = held.select(id_col, F.col("p.position").alias("position"), sizes.alias("size"))
    taken = F.zip_with(F.slice("position", F.lit(1), F.size("size")), "size", lambda p, n: F.struct(p.alias("position"), n.alias("size")))
    rows = held.select(id_col, F.posexplode(taken).alias("at", "e")).select(id_col, "at", "e.position", "e.size")
    rows = batch_lengths(rows, "position", batch_size, size_col="size", out="length")
    listed = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "position", "length"))).alias("p"))
    return listed.select(id_col, F.col("p.position").alias("positions"), F.col("p.length").alias("lengths"))


def make_batches(
    rows: DataFrame, position: str, batch_size: int, *, ids_col: str = "token_ids", length_col: str | None = None
) -> DataFrame:
    """Batches of consecutive positions, padded to their longest member, with a mask.

    ``length_col`` names the length of each row's batch where the rows have it from ``batch_lengths``; then no sequence moves.
    """
    if length_col is None:
        sized = rows.withColumn("_size", F.size(ids_col))
        rows = batch_lengths(sized, position, batch_size, size_col="_size", out="_length").drop("_size")
        length_col = "_length"
    return (
        rows.withColumn("batch_id", F.floor(F.col(position) / batch_size).cast("bigint"))
        .withColumn("seq_len", F.col(length_col))
        .drop(*({length_col} - {"seq_len"}))
        .withColumn("_gap", F.col("seq_len") - F.size(ids_col))
        .withColumn(
            "mask",
            F.concat(
                F.transform(ids_col, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col("_gap"))
            ),
        )
        .withColumn(ids_col, F.concat(ids_col, F.array_repeat(F.lit(PAD), F.col("_gap"))))
        .drop("_gap")
    )


def resolve_specials(models: DataFrame) -> DataFrame:
    """Fallbacks for missing special ids: pad from eos; bos from cls, pad; eos from sep, pad."""
    pad = F.coalesce("pad_id", "eos_id")
    return models.withColumns(
        {
            "pad": pad,
            "bos": F.coalesce(F.col("bos_id"), F.col("cls_id"), pad),
            "eos": F.coalesce(F.col("eos_id"), F.col("sep_id"), pad),
        }
    )


def freeze_after_end(ids: Column, *, eos: int = EOS, pad: int = PAD) -> Column:
    """Everything behind the first end token becomes padding; the end token stays."""
    end = F.array_position(ids, F.lit(eos))
    frozen = F.transform(ids, lambda x, i: F.when(i >= end, F.lit(pad)).otherwise(x))
    return F.when(end > 0, frozen).otherwise(ids)


def _named(spark: SparkSession, head: DataFrame):
    """A column function from lists of ids to their words; null where the head lacks an id."""
    rows = head.toArrow()
    order = np.argsort(rows["token_id"].to_numpy())
    shared = spark.sparkContext.broadcast((rows["token_id"].to_numpy()[order], rows["token"].combine_chunks().take(pa.array(order))))

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        known, words = shared.value

        def named(flat: pa.Array) -> pa.Array:
            asked = flat.to_numpy(zero_copy_only=False)
            place = np.searchsorted(known, asked)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == asked[hit]
            return words.take(pa.array(place, mask=~hit))

        return _mapped(lists, named)

    return run


def decode(
    rows: DataFrame,
    vocab: DataFrame,
    *ids: str,
    ids_col: str = "token_ids",
    out: str = "text",
    head_size: int = HEAD_TOKENS,
) -> DataFrame:
    """Texts from token ids, special tokens left out.

    Ids of the broadcast head get their words in the row. The rest are joined once per row and id; ``ids`` must
    identify a row.
    """
    kind = "array<bigint>" if dict(rows.dtypes)[ids_col] == "array<bigint>" else "array<int>"
    words = F.filter(F.coalesce(F.col(ids_col).cast(kind), F.array().cast(kind)), lambda i: i >= FIRST_WORD)
    run = _named(rows.sparkSession, _head(vocab, head_size))
    rest = _rest(vocab, head_size)
    asked = rows.select(*ids, words.alias("_asked"))
    if rest.isEmpty():
        named = asked.select(*ids, run("_asked").alias("_words"))
        return named.select(*ids, F.array_join("_words", " ").alias(out))
    # Rows are read three times: to ask for the rest, to take its words, and those that ask for none. Only ids are
    # written and only rows that ask move; words are put in last.
    open_ = F.array_distinct(F.filter("_asked", lambda i, at: F.get("_words", at).isNull()))
    asked = asked.withColumn("_words", run("_asked"))
    asked = written(asked.select(*ids, "_asked", open_.alias("_open")), "asked-ids")
    found = (
        asked.select(*ids, F.explode("_open").alias("token_id"))
        .join(rest, "token_id")
        .groupBy(*ids)
        .agg(F.map_from_entries(F.collect_list(F.struct("token_id", "token"))).alias("_found"))
    )
    lacking = asked.where(F.size("_open") > 0).drop("_open").join(found, list(ids), "left")
    lacking = lacking.select(*ids, "_asked", run("_asked").alias("_words"), "_found")
    filled = F.zip_with("_words", "_asked", lambda w, i: F.coalesce(w, F.try_element_at("_found", i.cast("bigint"))))
    whole = asked.where(F.size("_open") == 0).select(*ids, run("_asked").alias("_words"))
    named = whole.unionByName(lacking.select(*ids, filled.alias("_words")))
    return named.select(*ids, F.array_join("_words", " ").alias(out))
