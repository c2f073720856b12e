import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import funnel, pairs, sentences
from spanloom.sources import tables

def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_strip_equals_python(spark):
    texts = [f"{c}a {c}b{c}{c}" for c in tx.WHITESPACE] + ["", " ", "​x​"]
    rows = frame(spark, texts).select("text", tx.strip(F.col("text")).alias("s")).collect()
    assert all(r.s == r.text.strip() for r in rows)


def test_words_and_lines_equal_python(spark):
    texts = ["a b c\x1cd  e", "", "  ", "one"]
    rows = frame(spark, texts).select("text", tx.words(F.col("text")).alias("w")).collect()
    assert all(r.w == r.text.split() for r in rows)


GOLDEN = [
    ("short enough", 20, ["short enough"]),
    ("one two three four", 9, ["one two", "three", "four"]),
    # Without the first separator a segment is packed by words at once.
    ("alpha! beta, gamma; delta", 12, ["alpha! beta,", "gamma; delta"]),
    ("first line\nsecond line is longer", 15, ["first line", "second line is", "longer"]),
    ("aa...bb...cc dd ee", 6, ["aa", "bb", "cc dd", "ee"]),
    ("key: value, and more words: end", 14, ["key: value,", "and more", "words: end"]),
    ("aa...b!c d e f", 5, ["aa", "b!c d", "e f"]),
    ("aaa bbb... ccc\nddd...e", 8, ["aaa bbb", "ccc\nddd", "e"]),
    ("aaa bbb... ccc\nddd eee...f", 8, ["aaa bbb", "ccc", "ddd eee", "f"]),
    ("unbreakableword tail", 5, ["unbreakableword", "tail"]),
    (", ,,; x y z", 4, [",", ",,;", "x y", "z"]),
]


@pytest.mark.parametrize("text, limit, pieces", GOLDEN)
def test_shorten_golden_cases(text, limit, pieces):
    assert sentences.shorten(text, limit) == pieces


@pytest.mark.parametrize("limit", [5, 12, 40])
def test_shorten_keeps_order_and_content(limit):
    rng = random.Random(limit)
    bare = str.maketrans("", "", " .,;:!?\n\t")
    for _ in range(400):
        text = "".join(rng.choice("ab .,;:!?\n\t...  ") for _ in range(rng.randrange(1, 160))).strip()
        pieces = sentences.shorten(text, limit)
        assert all(len(p) <= limit or not p.split()[1:] for p in pieces)
        assert "".join(pieces).translate(bare) == text.translate(bare)


def test_pack_words_fills_up_to_the_limit():
    assert sentences.pack_words("a bb ccc dddd eeeee", 6) == ["a bb", "ccc", "dddd", "eeeee"]
    assert sentences.pack_words("a bb ccc dddd eeeee", 8) == ["a bb ccc", "dddd", "eeeee"]
    assert sentences.pack_words("  ", 8) == []


def test_long_word_stays_whole():
    assert sentences.shorten("x" * 300, 256) == ["x" * 300]


def test_spans_search_forward():
    assert sentences.find_spans("a b a b", ["a", "b", "c", "a"]) == [(0, 1), (2, 3), (4, 5)]


LONG = "One two three four five six. Seven eight, nine ten eleven twelve! Thirteen."


@pytest.mark.parametrize(
    "text, limit, texts, starts",
    [
        (LONG, 20, ["One two three four", "five six.", "Seven eight, nine", "ten eleven twelve!", "Thirteen."],
         [0, 19, 29, 47, 66]),
        ("One two three four five... Six.", 10, ["One two", "three four", "five", "Six."], [0, 8, 19, 27]),
        # The double blank is normalized, so the packed piece is not found.
        ("Alpha beta  gamma delta epsilon. Short.", 20, ["delta epsilon.", "Short."], [18, 33]),
    ],
)
def test_long_sentences_are_cut_and_located(spark, text, limit, texts, starts):
    row = sentences.cut_sentences(
        frame(spark, [text]), min_length=1, max_sentence_len=limit, spans=True
    ).first()
    assert (row.texts, row.starts) == (texts, starts)
    ends = [*starts[1:], starts[-1] + len(texts[-1])]
    assert row.units == [text[a:b] for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("options", [{}, {"max_sentence_len": 30}, {"max_sentence_len": None}, {"max_sentence_len": 60, "min_unique_chars": 9}])
def test_pairs_and_spans_agree_with_the_text(spark, small, options):
    docs = tables.documents(spark, small)
    cut = sentences.cut_sentences(docs, spans=True, **options).cache()
    for r in cut.where("reason = 'processed'").collect():
        assert all(r.text[a : a + len(t)] == t for a, t in zip(r.starts, r.texts, strict=True))
        assert r.starts == sorted(r.starts)
        assert all(len(set(t)) > options.get("min_unique_chars", 0) for t in r.texts)
        whole = [r.text[a:b] for a, b in zip(r.starts, r.starts[1:], strict=False)]
        assert r.units[:-1] == whole
    blocks = pairs.span_pairs(sentences.sentence_table(cut), window_size=3, block_rows=7)
    sliced = blocks.join(cut.select("doc_id", "text"), "doc_id").select(
        "doc_id",
        "pair_idx",
        F.expr("substring(text, context_start + 1, context_end - context_start)").alias("context"),
        F.expr("substring(text, target_start + 1, target_end - target_start)").alias("target"),
    )
    inside = pairs.sentence_pairs(cut, window_size=3)
    assert sliced.exceptAll(inside).isEmpty() and inside.exceptAll(sliced).isEmpty()
    assert not inside.isEmpty()


def test_only_long_sentences_enter_the_arrow_step(spark, small):
    cut = sentences.cut_sentences(tables.documents(spark, small), spans=True)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan
    plain = sentences.cut_sentences(tables.documents(spark, small), max_sentence_len=None, min_unique_chars=9)
    assert "recut" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_normalized_blanks_lose_their_sentences(spark):
    text = "alpha  beta\t" * 60
    row = sentences.cut_sentences(frame(spark, [text])).select("n_split", "texts").first()
    assert row.n_split >= 2 and row.texts == []
    assert pairs.split_pairs(frame(spark, [text])).isEmpty()


def test_lengths_nulls_and_short_texts(spark):
    docs = frame(spark, [None, "   ", "Hi. Ho.", "Hello there. " * 20])
    got = {
        r.doc_id: (r.reason, r.n_split)
        for r in sentences.cut_sentences(docs, min_length=1, min_sentences=1).collect()
    }
    assert got[0] == got[1] == ("length", -1) or got[0][0] == got[1][0] == "length"
    assert got[2] == ("processed", 1)
    assert got[3] == ("processed", 20)
    plain = sentences.cut_sentences(docs, min_length=0, min_sentences=0).collect()
    assert {r.doc_id: r.texts for r in plain}[2] == ["Hi. Ho."]


def test_min_unique_chars(spark):
    docs = frame(spark, ["aaaa. abcdef ghi. bbbb. xyz uvw." + " " * 3])
    row = sentences.cut_sentences(docs, min_length=5, min_unique_chars=4, spans=True).first()
    assert row.texts == ["abcdef ghi.", "xyz uvw."] and row.n_split == 2
    assert row.starts == [6, 24]


def test_splitter_hook_skips_bad_documents(spark):
    def halves(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[t[: len(t) // 2], " ", t[len(t) // 2 :]] for t in texts]

    docs = frame(spark, ["good text one", "bad text here", "good text two", "tiny"])
    cut = sentences.cut_sentences(docs, min_length=5, splitter=halves)
    got = {r.doc_id: (r.reason, r.error, r.texts) for r in cut.collect()}
    assert got[0] == ("processed", None, ["good t", "ext one"])
    assert got[1][0] == "error" and "bad text" in got[1][1]
    assert got[3][0] == "length"
    counts = funnel.corpus_counts(docs, min_length=5, splitter=halves).first()
    assert (counts.total_docs, counts.docs_processed, counts.docs_failed) == (4, 2, 1)
    assert counts.context_target_pairs == 2


def test_only_text_columns(spark):
    with pytest.raises(TypeError):
        sentences.cut_sentences(spark.range(3).withColumn("text", F.col("id")).withColumnRenamed("id", "doc_id"))


def test_limit_counts_accepted_documents(spark):
    good, short = "One sentence here. Another one follows. " * 4, "short"
    docs = frame(spark, [short, good, short, good, good, short])
    kept = funnel.limit_accepted(docs, 2)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [0, 1, 2, 3]
    assert funnel.limit_accepted(docs, 9).count() == 6
    counts = funnel.corpus_counts(kept, val_fraction=1.0).first()
    assert (counts.total_docs, counts.docs_processed, counts.docs_rejected_length) == (4, 2, 2)
    assert counts.docs_val == 2 and counts.pairs_val == counts.context_target_pairs


def test_empty_train_side_is_an_error(spark):
    made = pairs.split_pairs(frame(spark, ["too short"]))
    with pytest.raises(RuntimeError, match="min_length"):
        funnel.require_pairs(made, min_length=100, min_sentences=2)


def test_a_very_long_document_takes_linear_work(spark):
    text = "".join(f"Sentence number {i} stands here.\n" for i in range(60_000))
    made = pairs.split_pairs(frame(spark, [text]), max_sentence_len=None)
    assert made.agg(F.sum(F.length("context")), F.count("*")).first()[1] == 59_999


def test_python_steps_hold_a_bounded_number_of_documents(spark):
    """A splitter never sees a whole Arrow batch of documents, and no row is lost at the slices' borders."""
    docs = spark.range(1000).selectExpr("if(id % 9 = 0, null, cast(id as string)) as text").coalesce(1)
    seen = docs.select("text", sentences._hooked(lambda texts: [[t, str(len(texts))] for t in texts])("text").alias("h"))
    rows = seen.collect()
    assert len(rows) == 1000 and all((r.h.sents or [None])[0] == r.text for r in rows)
    assert max(int(r.h.sents[1]) for r in rows if r.text) <= sentences.SLICE
