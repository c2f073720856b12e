"""The trie model against dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lm_trie
from spanloom.llm.elias_fano import EliasFano
from tests.llm.fixtures import documents, texts


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def plain_model(rows):
    docs = [(d, held(d), (t or "").encode().lower().split()) for d, t in rows]
    one, two = Counter(), Counter()
    for _, out, words in docs:
        if not out:
            one.update([*words, None])
            two.update(zip([0, *words], [*words, None], strict=True))
    n_docs = sum(not out for _, out, _ in docs)
    total, types = sum(one.values()), len(one)

    def context(u):
        return n_docs if u == 0 else one[u]

    def size_class(c):
        return min((c.bit_length() - 1) // 3, lm_trie.CLASSES - 1)

    def share(u, w):
        return float(lm_trie.unquantise(lm_trie.quantise(np.array([two[u, w] / context(u)])))[0]) if two[u, w] else 0.0

    weights = np.zeros((lm_trie.CLASSES, len(lm_trie.WEIGHTS)))
    for _, out, words in docs:
        if not out:
            for u, w in zip([0, *words], [*words, None], strict=True):
                c = context(u)
                if c > 1:
                    ratio = ((two[u, w] - 1) / (c - 1)) / (one[w] / (total + types))
                    weights[size_class(c)] += np.log10(1 - lm_trie.WEIGHTS + lm_trie.WEIGHTS * ratio)
    best = lm_trie.WEIGHTS[weights.argmax(1)]
    out_rows = []
    for d, out, words in docs:
        base = score = 0.0
        for u, w in zip([0, *words], [*words, None], strict=True):
            p = (one[w] + 1) / (total + types + 1)
            base += math.log10(p)
            c = context(u)
            weight = best[size_class(c)] if c else 0.0
            score += math.log10(weight * share(u, w) + (1 - weight) * p) if c else math.log10(p)
        out_rows.append((str(d), out, len(words) + 1, sum(one[w] > 0 for w in [*words, None]), total, base, score))
    return out_rows


def test_against_dictionaries(spark):
    docs = documents(spark)
    mark = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2
    scores, tries = lm_trie.score(docs, mark)
    got = sorted((str(r[0]), *r[1:]) for r in scores.collect())
    want = sorted(plain_model(texts()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    assert tries.agg(F.sum("n_pairs")).first()[0] > 0


def test_many_shards_give_the_same(spark, monkeypatch):
    mark = F.col("doc_id") % 5 == 2
    first = sorted(map(str, lm_trie.score(documents(spark), mark)[0].collect()))
    monkeypatch.setattr(lm_trie, "WORDS_A_SHARD", 100)
    monkeypatch.setattr(lm_trie, "PAIRS_A_SHARD", 500)
    rows = lm_trie.score(documents(spark), mark)[0].collect()
    assert sorted(map(str, rows)) == first


def test_without_training_rows(spark):
    rows = lm_trie.score(documents(spark), F.lit(True))[0].collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert lm_trie.score(documents(spark, []), F.lit(False))[0].count() == 0


def test_probabilities_of_a_context_add_up(spark):
    words = ["a", "b", "c", "d"]
    rows = [(i, " ".join(np.random.default_rng(i).choice(words, 30))) for i in range(20)]
    rows += [(1000, ""), *((1001 + i, w) for i, w in enumerate([*words, "unseen"]))]
    scores, tries = lm_trie.score(documents(spark, rows), F.col("doc_id") >= 1000)
    # Base: each word's probability from a text of it alone, without the end token's.
    base = {r.doc_id: r.base_score for r in scores.where("doc_id >= 1000").collect()}
    assert math.isclose(10 ** base[1000] + sum(10 ** (base[1001 + i] - base[1000]) for i in range(5)), 1.0, rel_tol=1e-12)
    # Trie: the shares of the words after each context, up to a step of the codes.
    checked = 0
    for row in tries.collect():
        trie = lm_trie.Trie.view(row.trie)
        sums = np.add.reduceat(lm_trie.unquantise(trie.codes.astype(int)), trie.pointers.values()[:-1].astype(int))
        assert np.abs(np.log2(sums)).max() <= 0.5 / lm_trie.STEPS
        checked += len(sums)
    assert checked == 5  # the four words and the begin


@pytest.mark.parametrize("n, bound", [(0, 10), (1, 1), (7, 100), (500, 10**12), (500, 9), (200_000, 10**7), (3_000, 10**6)])
def test_elias_fano(n, bound):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, bound, n)).astype(np.uint64)
    made, _ = EliasFano.from_buffer(EliasFano.of(values, bound).to_bytes())
    asked = np.concatenate([values, rng.integers(0, bound, 50).astype(np.uint64), np.array([bound + 5], np.uint64)])
    assert (made.values() == values).all()
    assert (made.successor(asked) == np.searchsorted(values, asked)).all()
    some = rng.integers(0, n, 20) if n else np.zeros(0, int)
    assert (made.values(some) == values[some]).all()
    assert 8 * len(made.to_bytes()) < n * (2.5 + max(0.0, math.log2(bound / max(n, 1))) + 1) + 3000


def test_trie_finds_pairs_and_nothing_else():
    keys = np.array([3, 7, 1009, 1010, 5000, 7003], dtype=np.int64)
    trie = lm_trie.Trie.view(lm_trie.Trie.build(keys, np.arange(1, 7), 1000).to_bytes())
    asked = np.array([3, 4, 7, 1003, 1009, 1010, 2000, 5000, 7003, 9000], dtype=np.int64)
    assert trie.find(asked).tolist() == [1, 0, 2, 0, 3, 4, 0, 5, 6, 0]
