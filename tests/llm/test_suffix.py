"""Removed bytes against the count of every string."""

import hashlib
import random
from collections import Counter

import pytest

from spanloom.llm import suffix_dedup
from tests.llm.fixtures import documents, sentence, texts


def plain(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((str(doc), len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, **how):
    got = suffix_dedup.remove_repeats(documents(spark, rows), **how).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == plain(rows, how.get("length", 400))


@pytest.mark.parametrize("how", [{"length": 60, "gram": 20}, {"length": 60, "gram": 20, "hot": 1}, {}])
def test_against_all_strings(spark, how):
    check(spark, texts(), **how)


def test_shared_passages(spark):
    rng = random.Random(2)
    passages = [sentence(rng, n) for n in (5, 8, 9, 10, 20)]
    rows = [(i, " ".join([sentence(rng, 12), rng.choice(passages), sentence(rng, 7), rng.choice(passages)])) for i in range(60)]
    rows.append((99, "".join(passages) * 2))
    check(spark, rows, length=64, gram=16)
    check(spark, rows, length=64, gram=16, hot=3)
    check(spark, [], length=64, gram=16)


def test_kept_bytes(spark):
    rows = [(1, "x" * 30 + "same passage " * 10), (2, "same passage " * 10 + "y" * 30), (3, "z")]
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(documents(spark, rows), length=100, gram=32).collect()}
    assert got[1] == b"x" * 30 and got[2] == b"y" * 30 and got[3] is None
