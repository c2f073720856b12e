"""Kept terms and divergences against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from spanloom.llm import source_terms as st
from tests.llm.fixtures import sentence, texts

DOCS = "doc_id bigint, text string, lang string, source string, terms string, by bigint, p string, item string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows, min_docs=3, top=200):
    rows = [(t, lang or "", source or "") for t, lang, source in rows]
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = words(text)
        docs[lang].update(set(found))
        count[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = sum((count[lang, s] for s in sources), Counter())
        rates = {}
        for s, c in [*((s, count[lang, s]) for s in sources), (None, whole)]:
            total = sum(c[t] for t in kept)
            rates[s] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pair = sorted((-sum(f(rates[s][t], rates[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pair)]
            above = sorted(
                (-f(rates[s][t], rates[None][t]), t.encode()) for t in kept if count[lang, s][t] and rates[s][t] > rates[None][t]
            )
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(above[:top])]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame([(1, t, lang, s, "x", 1, "y", "z") for t, lang, s in rows], DOCS)
    got = st.divergences(df, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    how.pop("levels", None)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, **how)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ab", "é", None])) for _, t in texts(seed)]
    rows += [("Straße STRASSE straße ÉTÉ été 中文 中文", "de", s) for s in "aabbc"]
    rows += [("the the the THE", "en", "hot")] * 40  # one source, one term
    rows += [(sentence(rng, 8), "fr", "only"), (None, "xx", "a"), ("", "xx", "b"), ("1 2 3", "xx", "a")]
    return rows + [("one rare-word", "yy", "a"), ("two other", "yy", "b")]  # no kept term


@pytest.mark.parametrize("how", [{}, {"levels": (1,)}, {"levels": (3, 5)}, {"min_docs": 2, "top": 3}])
def test_against_plain_counts(spark, how):
    check(spark, corpus(5), **how)


def test_empty(spark):
    check(spark, [])
    check(spark, [(None, None, None)])


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(st, "SLICE_BYTES", 200)
    rng = random.Random(4)
    long = [(sentence(rng, 400) + "x" * 500, "en", "a"), ("y" * 700, "en", "b"), ("é" * 300 + " z", "en", "c")]
    parts = [r for t, *_ in long for r in [st._long_text((t or "").lower().encode())]]
    for (text, *_), (_, terms, counts) in zip(long, parts, strict=True):
        assert dict(zip(terms.to_pylist(), counts.tolist(), strict=True)) == Counter(words(text))


def test_text_over_a_slice(spark):
    rng = random.Random(6)
    long = " ".join(sentence(rng, 2000) for _ in range(1))
    long = " ".join([long] * 300)
    assert len(long.encode()) > st.SLICE_BYTES
    check(spark, [(long, "en", "a"), (long[:5000], "en", "b"), (long[7:5000], "en", "c"), ("short", "en", "a")])


def test_prefixes_are_pruned(spark):
    """A prefix of enough documents stays though no term under it does; it goes one level on."""
    rows = [("abcx", "en", "a"), ("abcy", "en", "a"), ("abz", "en", "b"), ("qqqq qqqr qqqs", "en", "b")]
    df = spark.createDataFrame([(1, t, lang, s, "x", 1, "y", "z") for t, lang, s in rows], DOCS)
    found = st.document_terms(df)
    assert [tuple(r) for r in st.alive_prefixes(found, (2,), 3).collect()] == [("en", bytearray(b"ab"))]
    assert st.alive_prefixes(found, (2, 3), 3).count() == 0
    assert st.kept_terms(found, (2,), 3).count() == 0
