"""Subword pieces: byte-pair merges learned from word counts, and words cut by them.

A word is a run of symbols, at first its code points; the first one carries the mark of a word's begin. A merge joins
the pair of neighbours with the highest count, ties to the pair that sorts first. Pair counts are added up over the
words once; a merge then only touches the words that hold its pair, and only their pairs change the counts.

Several merges go in one round where one by one they would be the same: the next pair shares no symbol with those taken,
and every pair that does has a lower count, so that neither it nor what a merge makes of it could come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranking import global_rank
from spanloom.session import cut_lineage

BEGIN = "▁"  # in front of a word
BATCH = 64  # pairs looked at in a round
MAX_HELD_MERGES = 1 << 20  # merges that every task of the encoder may hold
FEW_MERGES = 256  # so many are made one by one in all words of a batch together


def symbols(token: Column) -> Column:
    """The code points of a word, each between blanks of its own; a word holds no blank."""
    return F.concat(F.lit(f" {BEGIN}"), F.array_join(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), "  "), F.lit(" "))


def _merged(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for left, right in pairs:
        text = F.replace(text, F.lit(f" {left}  {right} "), F.lit(f" {left}{right} "))
    return text


def _pair_counts(words: DataFrame, text: str, weight: Column) -> DataFrame:
    """(left, right, n): neighbours, added up with the weight of their word."""
    parts = F.split(F.trim(F.col(text)), "  ")
    places = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1))
    near = F.transform(places, lambda i: F.struct(F.element_at("p", i).alias("left"), F.element_at("p", i + 1).alias("right")))
    rows = words.select(parts.alias("p"), weight.alias("n")).select("n", F.explode(near).alias("e"))
    return rows.groupBy("e.left", "e.right").agg(F.sum("n").alias("n"))


def _next_pairs(top: list, room: int, whole: bool, made: set[str]) -> list:
    """The pairs that may be merged together; ``whole``: no pair is missing behind ``top``.

    A merge that makes a symbol that is there already (``made``) could raise other counts, so it goes alone."""
    taken: list = []
    held: set[str] = set()
    for row in top[:room]:
        mine = {row["left"], row["right"]}
        again = row["left"] + row["right"] in made
        if taken:
            others = (r["n"] for r in top[len(taken) :] if {r["left"], r["right"]} & held)
            clash = next(others, 0 if whole else top[-1]["n"])
            if again or mine & held or clash >= row["n"]:
                break
        taken.append(row)
        held |= mine
        if again:
            break
    return taken


def learn_merges(words: DataFrame, merges: int, batch: int = BATCH) -> DataFrame:
    """(rank, left, right, n) of the first ``merges`` merges; words(token, n) are distinct words with counts.

    The driver sees ``batch`` pairs a round. Fewer merges come out where no two symbols are left side by side.
    """
    state = cut_lineage(words.select(symbols(F.col("token")).alias("s"), F.col("n").cast("bigint").alias("n")))
    counts = cut_lineage(_pair_counts(state, "s", F.col("n")))
    found: list[tuple] = []
    while len(found) < merges:
        top = counts.orderBy(F.desc("n"), "left", "right").limit(batch).collect()
        taken = _next_pairs(top, merges - len(found), len(top) < batch, {r[1] + r[2] for r in found})
        if not taken:
            break
        found += [(len(found) + i, r["left"], r["right"], r["n"]) for i, r in enumerate(taken)]
        pairs = [(r["left"], r["right"]) for r in taken]
        # Every word is merged and written once; the few that change are read again for their pairs.
        changed = cut_lineage(state.select("s", _merged(F.col("s"), pairs).alias("t"), "n"))
        sides = F.array(F.struct("s", (-F.col("n")).alias("n")), F.struct(F.col("t").alias("s"), "n"))
        touched = changed.where(F.col("s") != F.col("t")).select(F.explode(sides).alias("w")).select("w.*")
        delta = _pair_counts(touched, "s", F.col("n"))
        counts = counts.unionByName(delta).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0")
        counts = cut_lineage(counts)
        state = changed.select(F.col("t").alias("s"), "n")
    return words.sparkSession.createDataFrame(found, "rank int, left string, right string, n bigint")


def cut_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of one word: the neighbours of the lowest rank are joined until none has a rank."""
    parts = [BEGIN + word[:1], *word[1:]]
    while len(parts) > 1:
        best = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        joined, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                joined.append(parts[i] + parts[i + 1])
                i += 2
            else:
                joined.append(parts[i])
                i += 1
        parts = joined
    return parts


def _in_order(pairs: list[tuple[str, str]]) -> bool:
    """Whether no merge can make a pair that an earlier one joins: each symbol is made once, and before it is used."""
    made: set[str] = set()
    for pair in pairs:
        if any(len(symbol.removeprefix(BEGIN)) > 1 and symbol not in made for symbol in pair):
            return False
        new = pair[0] + pair[1]
        if new in made or len(new.removeprefix(BEGIN)) < 2:
            return False
        made.add(new)
    return True


def cut_words(words: list[str], pairs: list[tuple[str, str]]) -> list[list[str]]:
    """The pieces of all words, by merges that are ``_in_order``: one after the other, each in all words at once."""
    if any(" " in w or "\n" in w for w in words):  # the marks between symbols and between words
        ranks = {pair: rank for rank, pair in enumerate(pairs)}
        return [cut_word(w, ranks) for w in words]
    text = "\n".join([f" {BEGIN}{'  '.join(w)} " for w in words])
    for left, right in pairs:
        text = text.replace(f" {left}  {right} ", f" {left}{right} ")
    return [line[1:-1].split("  ") for line in text.split("\n")] if words else []


def word_pieces(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(token, pieces) per row of words(token), also words that the merges were not learned from.

    The merges go to every task; more than ``MAX_HELD_MERGES`` are refused.
    """
    rows = merges.limit(MAX_HELD_MERGES + 1).collect()
    if len(rows) > MAX_HELD_MERGES:
        raise ValueError(f"more than {MAX_HELD_MERGES} merges do not fit every task")
    ranks = {(r["left"], r["right"]): r["rank"] for r in rows}
    pairs = sorted(ranks, key=ranks.get)
    few = len(rows) == len(ranks) <= FEW_MERGES and _in_order(pairs)
    held = words.sparkSession.sparkContext.broadcast(pairs if few else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column(0).to_pylist()
            pieces = cut_words(each, held.value) if few else [cut_word(w, held.value) for w in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.list_(pa.string()))], names=["token", "pieces"])

    return words.select("token").mapInArrow(run, "token string, pieces array<string>")


def piece_ids(pieces: DataFrame, merges: DataFrame) -> DataFrame:
    """(piece, piece_id): the single symbols in order, then the pieces of the merges by their first rank."""
    joined = merges.groupBy(F.concat("left", "right").alias("piece")).agg(F.min("rank").alias("rank"))
    single = pieces.select(F.explode("pieces").alias("piece")).distinct().join(joined, "piece", "left_anti")
    both = single.withColumn("rank", F.lit(-1)).unionByName(joined)
    return global_rank(both, "rank", "piece", name="piece_id").select("piece", "piece_id")
