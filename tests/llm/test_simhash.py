"""The trie join against all pairs of fingerprints."""

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash_trie
from tests.llm.fixtures import documents, texts


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    names = list(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in names}


@pytest.mark.parametrize("max_bits", [0, 3, 7])
def test_against_all_pairs(spark, max_bits):
    rows = texts()
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints, max_bits)
    least = {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            least[roots[p]] = min(doc, least.get(roots[p], doc))
    expected = sorted((str(d), f"{p:016x}", least.get(roots[p])) for (d, _), p in zip(rows, prints, strict=True))
    got = simhash_trie.near_duplicates(documents(spark), max_bits=max_bits).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == expected


def test_empty_table(spark):
    assert simhash_trie.near_duplicates(documents(spark, [])).count() == 0


def all_near(values, bits):
    return {(i, j) for j in range(len(values)) for i in range(j) if (int(values[i]) ^ int(values[j])).bit_count() <= bits}


@pytest.mark.parametrize("depth", [0, 3])
def test_trie_pairs_lose_nothing(depth):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centre for k in (0, 1, 2, 3, 2, 1)]
    values = np.unique(np.array(values, dtype=np.uint64))
    wanted = all_near(values, 3)
    found = set()
    groups = {}
    for v in values:
        groups.setdefault(int(v) >> (64 - depth) if depth else 0, []).append(v)
    place = {int(v): i for i, v in enumerate(values)}
    for x, a in groups.items():
        for y, b in groups.items():
            if x <= y:
                a_, b_ = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
                for i, j in simhash_trie.trie_pairs(a_, a_ if x == y else b_, x == y, depth, 3, 3):
                    for u, v in zip(a_[i], (a_ if x == y else b_)[j], strict=True):
                        pair = tuple(sorted((place[int(u)], place[int(v)])))
                        assert pair not in found
                        found.add(pair)
    assert found == wanted


def test_hot_node_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "BLOCK", 8)
    monkeypatch.setattr(simhash_trie, "SUBTREE", 16)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5) for _ in range(30)}
    values |= {int(x) for x in rng.integers(0, 2**63, 60)}
    prints = spark.createDataFrame([(v if v < 2**63 else v - 2**64,) for v in values], "fp bigint")
    links = {(r.a % 2**64, r.b % 2**64) for r in simhash_trie.links(prints).collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    joined = plain_components(values, 3)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    mine, theirs = {}, {}
    for v in values:
        mine.setdefault(find(v), set()).add(v)
        theirs.setdefault(joined[v], set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_forest_keeps_links_of_earlier_batches():
    pairs = [(np.array([5, 5]), np.array([6, 7])), (np.array([4, 3]), np.array([6, 7]))]
    assert simhash_trie._forest(8, iter(pairs)).tolist() == [0, 1, 2, 3, 3, 3, 3, 3]
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = 60
        batches = [tuple(rng.integers(0, n, (2, rng.integers(1, 9)))) for _ in range(6)]
        root = list(range(n))
        for i, j in batches:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
        assert simhash_trie._forest(n, iter(batches)).tolist() == root


def test_one_row_of_each_component(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(8)]
    near = [b.replace(b.split()[0], "other", 1) for b in base for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(base + near)]
    rows += [(None, base[0]), (None, "alone and null"), (7, "equal id, other text here"), (None, None), (90, ""), (91, " ")]
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints, 3)
    best = {}
    for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True)):
        best[roots[p]] = min(best.get(roots[p], (True, 0, i)), (doc is None, doc or 0, i))
    docs = documents(spark, rows).coalesce(1)
    kept = simhash_trie.one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted((str(rows[i][0]), str(rows[i][1])) for *_, i in best.values())
    assert len(want) < len(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want
    assert simhash_trie.one_of_each(documents(spark, [])).count() == 0
