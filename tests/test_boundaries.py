"""Learned sentence ends: planted abbreviations end no sentence, and the ratios against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from spanloom.operators import boundaries, sentences

NAMES = "Alder Birch Cedar Dogwood Elder Fir Gorse Hazel Ivy Juniper".split()
VERBS = "walked waited laughed worked rested travelled listened returned".split()


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    name, verb = lambda: rng.choice(NAMES), lambda: rng.choice(VERBS)
    made = []
    for i in range(n):
        said = [f"Then Dr. {name()} {verb()} with {name()}.", f"However {name()} {verb()} near {name()} and {verb()}."]
        said += [f"Then {name()} kept trees, e.g. {name()} or prof. {name()}'s, and {verb()}.", f"The {name()} {verb()}."]
        rng.shuffle(said)
        made.append((i, " ".join(said)))
    return made


def plain(texts):
    pairs = Counter()
    for _, text in texts:
        words = re.findall(r"(?:[^\W\d_]+\.)*[^\W\d_]+(?:'[^\W\d_]+)*\.?", (text or "").lower())
        for a, b in zip(words, [*words[1:], None], strict=False):
            pairs[a.removesuffix("."), a.endswith("."), b and b.removesuffix(".")] += 1
    n, dots = Counter(), Counter()
    for (a, dotted, _), k in pairs.items():
        n[a] += k
        dots[a] += k * dotted
    total, total_dots = sum(n.values()), sum(dots.values())
    log = lambda k, m, p: k * math.log(min(max(p, 1e-12), 1 - 1e-12)) + (m - k) * math.log(1 - min(max(p, 1e-12), 1 - 1e-12))

    def ratio(k1, n1, k2, n2):
        one = (k1 + k2) / (n1 + n2)
        return 2 * (log(k1, n1, k1 / n1) + log(k2, n2, k2 / n2) - log(k1, n1, one) - log(k2, n2, one))

    abbr = set()
    for w in n:
        size = len(w.replace(".", ""))
        gain = 2 * (log(dots[w], n[w], 0.99) - log(dots[w], n[w], total_dots / total))
        if dots[w] and gain * math.exp(-size) * (len(w) - size + 1) * size ** -(n[w] - dots[w]) >= 0.3:
            abbr.add(w)
    first = Counter()
    for (a, dotted, b), k in pairs.items():
        if dotted and b is not None and a not in abbr:
            first[b] += k
    m = sum(first.values())
    starters = {b for b, k in first.items() if k / m > (n[b] - k) / (total - m) and ratio(k, m, n[b] - k, total - m) >= 30}
    met = {
        (a, b) for (a, dotted, b), k in pairs.items()
        if dotted and b is not None and a in abbr
        and k / dots[a] > (n[b] - k) / (total - dots[a]) and ratio(k, dots[a], n[b] - k, total - dots[a]) >= 7.88
    }
    return abbr, starters, met


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("rows", [corpus(), [*corpus(9, 60), (900, None), (901, ""), (902, "no. no. no. yes")]])
def test_tables_equal_plain_counts(spark, rows):
    learned = boundaries.Boundaries(table(spark, rows))
    abbr, starters, met = plain(rows)
    assert {r.word for r in learned.abbreviations.collect()} == abbr
    assert {r.word for r in learned.starters.collect()} == starters
    assert {tuple(r) for r in learned.collocations.select("word", "next").collect()} == met


def test_planted_abbreviations_do_not_end_a_sentence(spark):
    rows = corpus()
    docs = table(spark, rows)
    learned = boundaries.Boundaries(docs)
    assert {r.word for r in learned.abbreviations.collect()} == {"dr", "prof", "e.g"}
    assert {"then", "however", "the"} <= {r.word for r in learned.starters.collect()}
    cut = sentences.sentence_table(sentences.cut_sentences(docs, max_sentence_len=None, spans=True))
    assert cut.count() > 4 * len(rows)  # the plain cutter stops at the abbreviations, too
    text = dict(rows)
    found = learned.joined(cut).collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        said = text[r.doc_id][r.start_idx : r.end_idx]
        assert said.endswith(".") and not re.search(r"(Dr|prof|e\.g)\.$", said)
        assert re.match("Then|However|The", said)
    assert {r.sent_idx for r in found} == {0, 1, 2, 3}


def test_without_texts(spark):
    learned = boundaries.Boundaries(table(spark, []))
    assert learned.abbreviations.count() == learned.starters.count() == learned.collocations.count() == 0
    empty = spark.createDataFrame([], "doc_id bigint, sent_idx bigint, text string, start_idx bigint, end_idx bigint")
    assert learned.joined(empty).count() == 0


def test_only_words_and_neighbours_over_a_period_are_sent(spark):
    got = boundaries._followers(table(spark, [(0, "a b a c. D e"), (1, "a b b."), (2, None), (3, "1 - 2")]), "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("a", False, None, 3), ("b", False, None, 2), ("b", True, None, 1), ("c", True, "d", 1), ("d", False, None, 1), ("e", False, None, 1)],
        key=str,
    )


def test_spans_are_shuffled_once(spark):
    learned = boundaries.Boundaries(table(spark, corpus(n=60)))
    rows = spark.createDataFrame([(0, 0, "A b.", 0, 4)], "doc_id bigint, sent_idx bigint, text string, start_idx bigint, end_idx bigint")
    plan = learned.joined(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_words_with_periods_and_apostrophes(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab\u00e9\U00010400.'\n 1") for _ in range(12))) for i in range(2000)] + [(9000, "don't.x"), (9001, "e.g. i.e.'s")]
    plain = r"(?:\p{L}+\.)*\p{L}+(?:'\p{L}+)*\.?"
    every = lambda word: F.regexp_extract_all("text", F.lit(word), F.lit(0))
    last = lambda before, word: F.regexp_extract("text", f"{before}({word})[^\\p{{L}}]*$", 1)
    rows = table(spark, texts).select("text", every(plain).alias("a"), every(boundaries.WORD).alias("b"),
                                      last("", plain).alias("c"), last(r"(?<!\p{L})", boundaries.WORD).alias("d"))
    assert rows.where("a != b or c != d").collect() == []
