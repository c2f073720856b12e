import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.operators import pairs, tokens
from spanloom.sources import tables
from spanloom.functions import text as tx
from spanloom.session import shared_dir

TEXTS = ["b a a c", "a b, c!", "", "zeta a", None]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


def test_vocabulary_order(spark, rows):
    got = [(r.token, r.n, r.token_id) for r in tokens.vocabulary(rows).orderBy("token_id").collect()]
    assert got == [("a", 4, 4), ("b", 2, 5), ("c", 2, 6), ("!", 1, 7), (",", 1, 8), ("zeta", 1, 9)]
    top = tokens.vocabulary(rows, size=2).orderBy("token_id").collect()
    assert [(r.token, r.token_id) for r in top] == [("a", 4), ("b", 5)]


@pytest.mark.parametrize("head", [1, 3, 100])
def test_encode_with_and_without_the_rare_rest(rows, head):
    vocab = tokens.vocabulary(rows)
    got = tokens.encode(rows, vocab, "id", head_size=head).orderBy("id").collect()
    assert [r.token_ids for r in got] == [[5, 4, 4, 6], [4, 5, 8, 6, 7], [], [9, 4], []]


def test_unknown_and_decode(rows):
    vocab = tokens.vocabulary(rows, size=3)
    coded = tokens.encode(rows, vocab, "id")
    assert coded.where("id = 3").first().token_ids == [tokens.UNK, 4]
    texts = tokens.decode(coded, vocab, "id").orderBy("id").collect()
    assert [r.text for r in texts] == ["b a a c", "a b c", "", "a", ""]


def test_sentence_lists_equal_whole_contexts(spark, small):
    docs = tables.documents(spark, small)
    vocab = tokens.vocabulary(docs)
    for limit in (None, 40):
        cut = tokens.encode_sentences(pairs.split_sentences(docs, max_sentence_len=limit), vocab)
        made = pairs.sentence_pairs(cut, lists={"ids": ("unit_ids", "text_ids")})
        whole = tokens.encode(made, vocab, "doc_id", "pair_idx", text_col="context", out="want")
        assert whole.where("want <> context_ids").isEmpty() and not whole.isEmpty()
        lists = tokens.sentence_tokens(pairs.split_sentences(docs, max_sentence_len=limit))
        counted = pairs.sentence_pairs(lists, lists={"tokens": ("unit_tokens", "text_tokens")})
        assert counted.where(tx.tokens(F.col("context")) != F.col("context_tokens")).isEmpty()


def test_specials_and_batches(spark):
    rows = spark.createDataFrame([(i, list(range(10, 10 + i))) for i in range(5)], "p bigint, ids array<int>")
    framed = rows.select("p", tokens.with_specials(F.col("ids"), 4).alias("token_ids"))
    got = tokens.make_batches(framed, "p", 2).orderBy("p").collect()
    assert [r.token_ids for r in got] == [[1, 2, 0], [1, 10, 2], [1, 10, 11, 2], [1, 10, 11, 2], [1, 10, 11, 2]]
    assert [r["mask"] for r in got][:2] == [[1, 1, 0], [1, 1, 1]]
    assert [r.batch_id for r in got] == [0, 0, 1, 1, 2]


def test_special_fallbacks(spark):
    models = spark.createDataFrame(
        [(0, 2, 1, None, None), (None, 2, None, None, None), (3, None, None, 5, 6), (3, None, None, None, None)],
        "pad_id int, eos_id int, bos_id int, cls_id int, sep_id int",
    )
    got = [(r.pad, r.bos, r.eos) for r in tokens.resolve_specials(models).collect()]
    assert got == [(0, 1, 2), (2, 2, 2), (3, 5, 6), (3, 3, 3)]


def test_freeze_after_end(spark):
    rows = spark.createDataFrame([([1, 2, 7, 7],), ([1, 7, 7, 7],), ([1, 7, 2, 2],)], "ids array<int>")
    got = [r[0] for r in rows.select(tokens.freeze_after_end(F.col("ids"))).collect()]
    assert got == [[1, 2, 0, 0], [1, 7, 7, 7], [1, 7, 2, 0]]


@pytest.mark.parametrize("head", [0, 1, 2, 100])
def test_decode_joins_what_the_head_lacks(spark, head):
    """Words come from the head or the join, in order and as often as they occur; unknown ids and special ones go."""
    vocab = spark.createDataFrame([("a", 3, 4), ("b", 2, 5), ("c" * 70, 1, 6)], "token string, n bigint, token_id bigint")
    given = [(1, [1, 4, 6, 5, 4, 2]), (2, [3, 0]), (3, None), (4, [6, 6, 99, 4]), (5, [])]
    rows = spark.createDataFrame(given, "id int, token_ids array<int>")
    got = {r.id: r.text for r in tokens.decode(rows, vocab, "id", head_size=head).collect()}
    assert got == {1: f"a {'c' * 70} b a", 2: "", 3: "", 4: f"{'c' * 70} {'c' * 70} a", 5: ""}


def test_open_tokens_are_joined_without_the_others(spark):
    docs = spark.createDataFrame(
        [(0, "a a b zz a yy zz"), (1, None), (2, ""), (3, "yy a new yy"), (4, "b " + "x" * 70 + " b " + "x" * 70)],
        "doc_id bigint, text string",
    )
    vocab = tokens.vocabulary(docs.where("doc_id <> 3"))
    number = {r.token: r.token_id for r in vocab.collect()}
    for head_size in (0, 1, 2, 100):
        lists = F.array(F.array(tx.tokens(F.coalesce("text", F.lit("")))))
        coded = tokens._coded(docs, vocab, lists, ("doc_id",), head_size)
        assert coded.columns == ["doc_id", "text", "_ids"]
        got = {r.doc_id: r._ids[0][0] for r in coded.collect()}
        words = {r.doc_id: (r.text or "").split() for r in docs.collect()}
        assert got == {d: [number.get(w, tokens.UNK) for w in said] for d, said in words.items()}


def test_decode_writes_ids_and_no_words(spark):
    """What decoding writes for its join follows the ids; rows that lack no word do not join."""
    names = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(5000)]
    vocab = spark.createDataFrame([(w, 1, tokens.FIRST_WORD + i) for i, w in enumerate(names)], "token string, n bigint, token_id bigint")
    places = {i: [(i * 7919 + j * 104_729) % 5000 for j in range(50)] for i in range(1500)}
    rows = spark.createDataFrame([(i, [tokens.FIRST_WORD + p for p in row]) for i, row in places.items()], "id bigint, token_ids array<int>")
    shared_dir(spark)  # the first call makes the folder
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = {r.id: r.text for r in tokens.decode(rows, vocab, "id", head_size=4950).collect()}
    assert got == {i: " ".join(names[p] for p in row) for i, row in places.items()}
    grew = size() - before
    assert grew < 1500 * 50 * 8, grew


def test_batch_lengths_without_the_sequences(spark, small):
    """The sizes of contexts are known without them, and rows with the length of their batch are padded where they are."""
    docs = tables.documents(spark, small)
    cut = tokens.sentence_tokens(pairs.split_sentences(docs, max_sentence_len=None))
    sizes = pairs.context_sizes(F.transform("text_tokens", F.size), F.transform("gap_tokens", F.size), window_size=8)
    lists = {"tokens": ("unit_tokens", "text_tokens")}
    made = pairs.sentence_pairs(cut.withColumn("sizes", sizes), sides=(), lists=lists, ready={"n": "sizes"})
    assert made.where(F.size("context_tokens") != F.col("n")).isEmpty() and not made.isEmpty()
    for limit in (None, 8):
        ids = F.transform("context_tokens", F.length)
        kept = made.where(F.size(tokens.with_specials(ids, limit)) != tokens.framed_size(F.col("n"), limit))
        assert kept.isEmpty()

    rows = spark.createDataFrame([(i, list(range(10, 10 + i))) for i in range(9)], "p bigint, token_ids array<int>")
    sized = tokens.batch_lengths(rows.withColumn("n", F.size("token_ids")), "p", 4, size_col="n", out="longest")
    assert sorted((r.p, r.longest) for r in sized.collect()) == [(i, 3 if i < 4 else 7 if i < 8 else 8) for i in range(9)]
    told = sized.drop("n").localCheckpoint()
    known = tokens.make_batches(told, "p", 4, length_col="longest")
    assert "Exchange" not in known._jdf.queryExecution().executedPlan().toString()
    assert sorted(known.collect()) == sorted(tokens.make_batches(rows, "p", 4).collect())


def test_places_of_documents_of_one_id(spark):
    """Two documents of one id take the same places; a batch is as long as the longest pair in it, and no row without an id counts."""
    given = [(1, 0, 0, 5), (1, 1, 3, 2), (2, 0, 1, 4), (2, 0, 2, 9), (2, 1, 5, 3), (None, 0, 4, 99)]
    places = spark.createDataFrame(given, "doc_id bigint, pair_idx int, position bigint, size int")
    got = {r.doc_id: (r.positions, r.lengths) for r in tokens.places_of_documents(places, 2).collect()}
    # Of id 2 the pairs 0 and 1 of both rows take the places 1 and 2, with 9 and 3 ids at most.
    assert got == {1: ([0, 3], [9, 3]), 2: ([1, 2], [9, 3])}
