import math
import random
from collections import Counter

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import logits, textgen

WORDS = "the cat sat on a mat dog ran".split()


def generations(spark, n=60, seed=1):
    rng = random.Random(seed)
    pick = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))
    rows = [(i, pick(), pick()) for i in range(n)]
    rows += [(n, "the cat sat on the mat", "the cat sat on the mat"), (n + 1, "", ""), (n + 2, "a", "")]
    return rows, spark.createDataFrame(rows, "id int, original string, generated string")


def plain_counts(ref, hyp, n):
    grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    r, h = grams(ref), grams(hyp)
    return sum((r & h).values()), sum(h.values()), sum(r.values())


def plain_bleu(pairs):
    m, t, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for ref, hyp in pairs:
        ref, hyp = ref.split(), hyp.split()
        hyp_len, ref_len = hyp_len + len(hyp), ref_len + len(ref)
        for n in range(4):
            match, total, _ = plain_counts(ref, hyp, n + 1)
            m[n] += match
            t[n] += max(total, 1)
    if m[0] == 0:
        return 0.0
    logs = [math.log((a or 0.1) / b) for a, b in zip(m, t)]
    return (1.0 if hyp_len > ref_len else math.exp(1 - ref_len / hyp_len)) * math.exp(sum(logs) / 4)


def test_bleu(spark):
    rows, df = generations(spark)
    score = textgen.corpus_bleu(df.repartition(3), "id").first().bleu
    assert math.isclose(score, plain_bleu([(o, g) for _, o, g in rows]), rel_tol=1e-9)
    each = {r.id: r.bleu for r in textgen.sentence_bleu(df, "id").collect()}
    for i, o, g in rows:
        assert math.isclose(each[i], plain_bleu([(o, g)]), abs_tol=1e-12)


def f_measure(match, h, r):
    p, q = match / max(h, 1), match / max(r, 1)
    return 2 * p * q / (p + q) if p + q else 0.0


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge(spark):
    rows, df = generations(spark, seed=2)
    n = {r.id: r for r in textgen.rouge_n(df, "id").collect()}
    l = {r.id: r.rougeL for r in textgen.rouge_l(df, "id").collect()}  # noqa: E741
    for i, o, g in rows:
        ref, hyp = o.split(), g.split()
        for k, got in ((1, n[i].rouge1), (2, n[i].rouge2)):
            assert math.isclose(got, f_measure(*plain_counts(ref, hyp, k)), abs_tol=1e-12)
        assert math.isclose(l[i], f_measure(plain_lcs(ref, hyp), len(hyp), len(ref)), abs_tol=1e-12)


def test_lcs_on_long_lists():
    rng = random.Random(5)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 150))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 150))]
        assert textgen.lcs_length(a, b) == plain_lcs(a, b)


def test_perplexity(spark):
    train = spark.createDataFrame([("a b",), ("a c a b",)], "text string")
    held = spark.createDataFrame([("a b d",)], "text string")
    # outcomes seen: a b c </s>, and one more for the unseen
    v = 5
    chances = [3 / (2 + v), 3 / (3 + v), 1 / (2 + v), 1 / (0 + v)]
    row = textgen.perplexity(train, held).first()
    assert math.isclose(row.perplexity, math.exp(-sum(map(math.log, chances)) / 4), rel_tol=1e-9)
    assert row.n_tokens == 4
    assert math.isnan(textgen.perplexity(train, held.limit(0)).first().perplexity)


def test_scores_of_lists_of_words(spark):
    """Words that were cut before score as the texts do, also with blanks of every kind and more than one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        _, df = generations(spark)
        df = df.unionByName(spark.createDataFrame([(900, "\u3000a\x1f b\u2005c ", "a\x85 b c d")], df.schema))
        for score, cut in ((textgen.sentence_bleu, tx.words), (textgen.rouge_n, tx.rouge_words), (textgen.rouge_l, tx.rouge_words)):
            lists = df.select("id", cut(F.col("original")).alias("original"), cut(F.col("generated")).alias("generated"))
            assert sorted(score(lists, "id", cut=None).collect()) == sorted(score(df, "id").collect())
        assert {r.id: r.rougeL for r in textgen.rouge_l(df, "id").collect()}[900] == 2.0 * 3 / 7
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bigrams_of_both_sides_are_counted_together(spark):
    texts = spark.createDataFrame([("a b", 0), ("a c a b", 0), ("a b", 1), (None, 1)], "text string, held int")
    got = textgen.bigrams(texts, "text", (1 - F.col("held")).alias("n"), F.col("held").alias("times")).collect()
    want = {("<s>", "a"): (2, 1), ("a", "b"): (2, 1), ("b", "</s>"): (2, 1), ("a", "c"): (1, 0), ("c", "a"): (1, 0), ("<s>", "</s>"): (0, 1)}
    assert {(r.prev, r.next): (r.n, r.times) for r in got} == want
    # A null text is an empty one on either side.
    train = spark.createDataFrame([("a b",), ("a c a b",)], "text string")
    none = spark.createDataFrame([(None,)], "text string")
    assert math.isclose(textgen.perplexity(train, none).first().perplexity, 2 + 5, rel_tol=1e-9)
    assert math.isclose(textgen.perplexity(train.limit(0), none).first().perplexity, 1, rel_tol=1e-9)


def test_word_diversity(spark):
    df = spark.createDataFrame([("a b a",), ("b",), ("",)], "generated string")
    assert textgen.word_diversity(df).first().diversity == 0.5
    assert textgen.word_diversity(df.limit(0)).first().diversity == 0.0


def test_report_has_all_scores(spark):
    _, df = generations(spark, n=5)
    got = {r.metric: r.value for r in textgen.report(df, df.selectExpr("original as text"), "id").collect()}
    assert set(got) == {"bleu", "rouge1", "rouge2", "rougeL", "perplexity", "concept_similarity", "diversity"}


def step(spark, *steps):
    rows = [(s, t, float(x)) for s, values in enumerate(steps) for t, x in enumerate(values)]
    return spark.createDataFrame(rows, "step_id int, token_id int, logit double")


def kept(df):
    return sorted(r.token_id for r in df.collect())


def test_logit_filters(spark):
    assert kept(logits.top_k(step(spark, [0.1, 5.0, 1.0, 3.0, 2.0]), 2)) == [1, 3]
    assert kept(logits.top_k(step(spark, [1.0, 2.0, 2.0, 2.0]), 2)) == [1, 2, 3]
    peak = step(spark, [0.0, 0.0, 10.0])
    assert kept(logits.top_p(peak, 0.9)) == [2]
    assert kept(logits.top_p(peak, 0.0)) == [0, 1, 2]
    plain = step(spark, [1.0, 2.0, 3.0])
    assert kept(logits.filter_logits(plain)) == kept(logits.filter_logits(plain, p=1.0)) == [0, 1, 2]
    assert kept(logits.top_k(plain, 9)) == [0, 1, 2]
    # Mass before the third token is 0.9 or more only for a small p.
    quarters = step(spark, [0.0, 0.0, 0.0, 0.0])
    assert kept(logits.top_p(quarters, 0.5)) == [0, 1, 2]


def test_softmax_greedy_and_ties(spark):
    df = step(spark, [1000.0, 1000.0], [1.0, 2.0])
    probs = {(r.step_id, r.token_id): r.prob for r in logits.softmax(df).collect()}
    assert probs[(0, 0)] == 0.5 and math.isclose(probs[(1, 1)], 1 / (1 + math.exp(-1)))
    assert {r.step_id: r.token_id for r in logits.greedy(df).collect()} == {0: 0, 1: 1}
    cold = logits.softmax(logits.temper(df, 0.0)).where("step_id = 1 and token_id = 1").first()
    assert cold.prob == 1.0


def test_draws_follow_the_probabilities(spark):
    weights = [0.6, 0.3, 0.1]
    rows = spark.range(6000).select(
        F.col("id").alias("step_id"), F.posexplode(F.array(*[F.lit(math.log(w)) for w in weights])).alias("token_id", "logit")
    )
    drawn = logits.draw(rows, seed=3)
    counts = Counter(r.token_id for r in drawn.collect())
    assert all(abs(counts[t] / 6000 - w) < 0.03 for t, w in enumerate(weights))
    assert drawn.exceptAll(logits.draw(rows.repartition(7), seed=3)).isEmpty()
    assert not drawn.exceptAll(logits.draw(rows, seed=4)).isEmpty()
