"""Merges in rounds against merges one by one, and pieces against the merged words."""

import itertools
import random
from collections import Counter

import pytest

from spanloom.operators import subwords


def plain_merges(words, limit):
    cut = {w: [subwords.BEGIN + w[0], *w[1:]] for w in words}
    found = []
    while len(found) < limit:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(cut[w], cut[w][1:], strict=False):
                counts[pair] += n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p[0].encode(), p[1].encode()))
        found.append((len(found), *best, counts[best]))
        for w, parts in cut.items():
            out = []
            for s in parts:
                # Left to right, as long as the part in front was not joined itself.
                if out and not out[-1][1] and (out[-1][0], s) == best:
                    out[-1] = (out[-1][0] + s, True)
                else:
                    out.append((s, False))
            cut[w] = [s for s, _ in out]
    return found, cut


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "token string, n bigint").repartition(3)


def random_words(seed, letters, n):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))): rng.randrange(1, 30) for _ in range(n)}


@pytest.mark.parametrize("batch", [2, 64])
@pytest.mark.parametrize(
    "words",
    [random_words(1, "abcdefgh", 150), random_words(2, "ab", 40), {"aaaa": 5, "aaa": 2, "a": 1, "éé\U0001f600é": 5, "abab": 5}],
)
def test_rounds_equal_single_merges(spark, words, batch):
    want, cut = plain_merges(words, 25)
    merges = subwords.learn_merges(table(spark, words), 25, batch=batch)
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == want
    got = {r.token: r.pieces for r in subwords.word_pieces(table(spark, words), merges).collect()}
    assert got == cut


def test_pairs_of_one_round():
    pair = lambda left, right, n: {"left": left, "right": right, "n": n}
    top = [pair("a", "b", 9), pair("c", "d", 8), pair("b", "c", 7), pair("e", "f", 6)]
    taken = lambda *more, room=9, whole=True, made=(): len(subwords._next_pairs([*top, *more], room, whole, set(made)))
    assert taken() == 2  # the third shares its symbols with both
    assert taken(room=1) == 1
    assert taken(made=["cd"]) == 1 and taken(made=["ab"]) == 1
    assert len(subwords._next_pairs([pair("a", "b", 9), pair("c", "d", 9), pair("b", "x", 9)], 9, True, set())) == 1
    assert len(subwords._next_pairs([pair("a", "b", 9), pair("c", "d", 9)], 9, False, set())) == 1
    assert subwords._next_pairs([], 9, True, set()) == []


def test_ids_and_unseen_words(spark):
    words = random_words(3, "abcd", 60)
    merges = subwords.learn_merges(table(spark, words), 10)
    pieces = subwords.word_pieces(table(spark, {**words, "zz": 1, "": 1}), merges)
    found = {r.token: r.pieces for r in pieces.collect()}
    assert found["zz"] == [subwords.BEGIN + "z", "z"] and found[""] == [subwords.BEGIN]
    assert all("".join(p) == subwords.BEGIN + t for t, p in found.items())
    ids = {r.piece: r.piece_id for r in subwords.piece_ids(pieces, merges).collect()}
    assert sorted(ids.values()) == list(range(len(ids)))
    assert {x for p in found.values() for x in p} <= set(ids)
    none = subwords.learn_merges(table(spark, words).limit(0), 5)
    assert none.count() == 0 and subwords.learn_merges(table(spark, {"a": 1}), 5).count() == 0


def test_merges_made_in_all_words_at_once():
    pairs = [("a", "b"), ("ab", "a"), (f"{subwords.BEGIN}c", "ab"), ("b", "b"), ("aba", "bb")]
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    assert subwords._in_order(pairs)
    words = ["", *("".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n))]
    assert subwords.cut_words(words, pairs) == [subwords.cut_word(w, ranks) for w in words]
    odd = ["a b", "ab\n", "ab"]
    assert subwords.cut_words(odd, pairs) == [subwords.cut_word(w, ranks) for w in odd]
    assert subwords.cut_words([], pairs) == []
    # A symbol made twice, used before it is made, or equal to the begin of a word: an earlier merge may apply again.
    assert not subwords._in_order([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")])
    assert not subwords._in_order([("ab", "c"), ("a", "b")])
    assert not subwords._in_order([(subwords.BEGIN, "a")])


def test_a_symbol_made_twice(spark):
    rows = [(0, "a", "b"), (1, "ab", "c"), (2, "abc", "d"), (3, "b", "c"), (4, "a", "bc")]
    merges = spark.createDataFrame([(*r, 1) for r in rows], "rank int, left string, right string, n bigint")
    ranks = {(a, b): rank for rank, a, b in rows}
    words = spark.createDataFrame([("xabcd",), ("xbcabcd",)], "token string")
    got = {r.token: r.pieces for r in subwords.word_pieces(words, merges).collect()}
    assert got == {w: subwords.cut_word(w, ranks) for w in got} and len(got) == 2
