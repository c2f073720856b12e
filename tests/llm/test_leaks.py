"""Leaks against edit distances without a band."""

import random

import numpy as np
import pytest

from spanloom.llm import decontaminate
from tests.llm.fixtures import documents, sentence, texts


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def changed(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else "q" if kind == 1 else "q" + text[at]) + text[at + 1 :]
    return text


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(6, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "short")]
    rows = texts()[:30] + texts()[-14:-5] + texts()[-4:]
    for i, (item, text) in enumerate(items[:12]):
        for k, edits in enumerate((0, 2, len(text) // 20, len(text) // 12, len(text) // 5)):
            rows.append((1000 + 10 * i + k, sentence(rng, 8) + ". " + changed(rng, text, edits).upper() + "\n" + sentence(rng, 5)))
    rows.append((2000, items[0][1] + " -- " + items[0][1] + " / " + items[3][1]))
    rows.append((2001, items[5][1][: len(items[5][1]) // 2]))
    return rows, items


def test_against_full_distances(spark, tables):
    rows, items = tables
    found = decontaminate.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = set()
    for doc, text in rows:
        if text is None or len(text) > 4000:
            continue
        plain = decontaminate.plain_form(text)[0]
        for item, item_text in items:
            short = decontaminate.plain_form(item_text or "")[0]
            if 0 < len(short) < decontaminate.SHORT:
                if b" " + short + b" " in b" " + plain + b" ":
                    want.add((doc, item))
            elif short:
                k = decontaminate.budget_of(len(short), decontaminate.EDIT_RATE)
                if least_edits(short, plain) <= k:
                    want.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in found} == want
    both = sorted((r.start, r.end) for r in found if r.doc_id == 2000 and r.item_id == 0)
    n = len(items[0][1])
    assert both == [(0, n), (n + 4, 2 * n + 4)]


def test_kept_rows(spark, tables):
    rows, items = tables
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, rows)
    bad = {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0


SHORT_ITEMS = [(1, "x"), (2, "Ab cd, ef"), (3, "ab"), (4, "é!"), (5, "one two three four five six seven eight"), (6, "ab cd ef"), (7, " ?! ")]
SHORT_TEXTS = ["x", "ax xb", "x-x; x", "say ab cd ef ab", "abcd ef", "é", "été", "", "ab\ncd\nef", "One two three four five six seven eight."]
SHORT_TEXTS += ["one two three four five six seven eightsome", "ab cd efx ab  cd"]


def test_short_items_match_whole_words(spark):
    rows = list(enumerate([*SHORT_TEXTS, None]))
    bench = spark.createDataFrame(SHORT_ITEMS, "item_id bigint, text string")
    found = decontaminate.leaks(documents(spark, rows), bench).collect()
    want = []
    for doc, text in rows:
        for item, item_text in SHORT_ITEMS:
            words = decontaminate.plain_form(item_text)[0].split()
            have = decontaminate.plain_form(text or "")[0].split()
            last = -1
            for k in range(len(have) - len(words) + 1 if words else 0):
                if k > last and have[k : k + len(words)] == words:
                    want.append((doc, item))
                    last = k + len(words) - 1
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted(want)
    assert len(decontaminate.plain_form(SHORT_ITEMS[4][1])[0]) == 39 and (9, 5) in want
    assert {r.edits for r in found} == {0}
    kept = decontaminate.without_leaks(documents(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_long_texts_in_parts(tables, monkeypatch):
    rows, items = tables
    index = decontaminate.Index.build([*((i, t or "") for i, t in items), *SHORT_ITEMS], decontaminate.EDIT_RATE)
    plain = [decontaminate.plain_form(t or "")[0] for _, t in rows]
    long = b" ".join(plain)
    whole = decontaminate.matches(index, [long, *plain])
    assert len(long) > 20 * index.reach and len(whole) > 50
    monkeypatch.setattr(decontaminate, "WINDOW", 0)  # parts of four times the longest item
    parts = decontaminate.matches(index, [long, *plain])
    assert {x[:2] for x in parts} == {x[:2] for x in whole}
    exact = [x for x in whole if x[4] == 0]
    assert [x for x in parts if x[4] == 0] == exact and exact
    monkeypatch.setattr(decontaminate, "PIECE", 50)  # items one by one
    assert decontaminate.matches(index, [long, *plain]) == parts


def test_items_with_a_common_opening_in_pieces(monkeypatch):
    opening = "which of the following statements about the matter is right "
    items = [(i, opening + f"number {i} of them") for i in range(300)]
    index = decontaminate.Index.build(items, 0.0)
    text = decontaminate.plain_form((opening + "or wrong. ") * 200 + items[7][1])[0]
    most = []
    verified = decontaminate._verified

    def count(index, texts, doc, *rest):
        most.append(len(doc))
        return verified(index, texts, doc, *rest)

    monkeypatch.setattr(decontaminate, "_verified", count)
    monkeypatch.setattr(decontaminate, "PIECE", 100_000)
    found = decontaminate.matches(index, [text])
    assert [(i, e) for _, i, _, _, e in found] == [(7, 0)]
    assert len(most) > 10 and max(most) < 120_000


def test_blocks_of_items_give_the_same(spark, tables, monkeypatch):
    rows, items = tables
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, rows)
    whole = sorted(map(str, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (300,))
    assert sorted(map(str, decontaminate.leaks(docs, bench).collect())) == whole


def test_places_in_code_points(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps"
    text = "Été \U0001f600!! " + item.replace(" ", "\n\n") + " é."
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    r = decontaminate.leaks(documents(spark, [(7, text)]), bench).first()
    assert text[r.start : r.end] == item.replace(" ", "\n\n") and r.edits == 0


def test_alignment_band():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item = bytes(rng.choice(list(b"abcd"), 30).tolist())
        text = bytes(rng.choice(list(b"abcd"), rng.integers(0, 60)).tolist())
        assert decontaminate.align(item, text, -40, 70)[0] == least_edits(item, text)
