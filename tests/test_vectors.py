import math
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import vectors as vec
from spanloom.operators import concepts, gram, pairs, predictor, quality, retrieval
from spanloom.session import shared_dir
from spanloom.sources import tables

RNG = np.random.default_rng(3)


def vectors(spark, x, **columns):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


def test_masked_mean_fixtures(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (0, 1, [2.0, 0.0]), (0, 1, [3.0, 0.0]), (0, 0, [100.0, 100.0]),
        (1, 1, [0.0, 1.0]), (1, 1, [0.0, 2.0]), (1, 0, [100.0, 100.0]), (1, 0, [100.0, 100.0]),
        (2, 0, [5.0, 6.0]),
    ]
    hidden = spark.createDataFrame(rows, "seq int, mask int, vec array<float>")
    got = {r.seq: r.vec for r in concepts.masked_mean(hidden, "seq").collect()}
    assert got == {0: [2.0, 0.0], 1: [0.0, 1.5], 2: [0.0, 0.0]}


def test_vector_expressions(spark):
    a, b = RNG.normal(size=(20, 5)), RNG.normal(size=(20, 5))
    a[3] = 0
    rows = [(list(map(float, x)), list(map(float, y))) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(
        vec.cosine(F.col("a"), F.col("b")).alias("c"),
        vec.norm(vec.normalize(F.col("a"))).alias("n"),
        vec.smooth_l1(F.col("a"), F.col("b")).alias("l"),
        vec.squared_distance(F.col("a"), F.col("b")).alias("d"),
    ).collect()
    for r, x, y in zip(got, a, b):
        size = np.linalg.norm(x) * np.linalg.norm(y)
        gap = np.abs(x - y)
        assert math.isclose(r.c, x @ y / size if size else 0.0, abs_tol=1e-12)
        assert math.isclose(r.n, 1.0 if size else 0.0, abs_tol=1e-12)
        assert math.isclose(r.l, np.where(gap < 1, gap**2 / 2, gap - 0.5).mean(), abs_tol=1e-12)
        assert math.isclose(r.d, (gap**2).sum(), abs_tol=1e-9)


def test_pair_sums_equal_text_sums(spark, small):
    docs = tables.documents(spark, small)
    for limit in (None, 50):
        cut = concepts.pair_sums(pairs.split_sentences(docs, max_sentence_len=limit), window_size=3)
        made = pairs.sentence_pairs(
            cut, window_size=3, ready={"c": "sums.context", "t": "sums.target"}
        )
        whole = made.select(
            "c", "t",
            concepts.concept_sums(F.col("context")).alias("c2"),
            concepts.concept_sums(F.col("target")).alias("t2"),
        )
        assert not whole.isEmpty() and whole.where("c <> c2 or t <> t2").isEmpty()


def test_pair_sums_work_in_chunks_of_documents(monkeypatch):
    """However many sentences a batch holds, only a bounded number is counted at once; the sums stay the same."""
    words = [[["a", "b", "c"][: 1 + (i + d) % 3] for i in range(d % 7)] for d in range(60)]
    texts = pa.array([*words, None], pa.list_(pa.list_(pa.string())))
    gaps = pa.array([[["-"] if i % 2 else [] for i in range(len(w))] for w in words] + [None], texts.type)
    whole = concepts._sums_of_pairs(texts, gaps, 2, 8)
    seen, count = [], concepts._count_signed
    monkeypatch.setattr(concepts, "_count_signed", lambda lists, dims: seen.append(len(lists)) or count(lists, dims))
    monkeypatch.setattr(concepts, "CHUNK", 10)
    assert concepts._sums_of_pairs(texts, gaps, 2, 8).equals(whole)
    assert max(seen) <= 10 and len(whole) == 61


def test_visits_leave_in_bounded_batches(monkeypatch):
    """A query that reaches every ball is copied a bounded number of times at once."""

    class Queries:
        columns, schema = ["q", "vec"], T.StructType([])
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def mapInArrow(self, run, kind):
            return run

    monkeypatch.setattr(retrieval, "_VISITS", 100)
    search = retrieval.BallSearch.__new__(retrieval.BallSearch)
    search.vec_col = "vec"
    search.balls = SimpleNamespace(pivots=np.eye(4), size=np.ones(4), best_cosine=lambda to: np.zeros(to.shape))
    rows = pa.record_batch([pa.array(range(50)), pa.array(RNG.normal(size=(50, 4)).tolist())], names=["q", "vec"])
    out = list(search._to(Queries(), lambda _, bound: np.ones(bound.shape, bool))(iter([rows])))
    assert max(b.num_rows for b in out) <= 100
    assert sorted(zip(*(pa.Table.from_batches(out)[c].to_pylist() for c in ("q", "ball")))) == [
        (q, b) for q in range(50) for b in range(4)
    ]


def test_pooled_concepts_from_a_token_table(spark):
    texts = spark.createDataFrame([(0, "a a b"), (1, "b"), (2, "zzz")], "id int, text string")
    table = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 8.0])], "token string, vec array<float>")
    got = {r.id: r.vec for r in concepts.pooled_concepts(texts, table, "id").collect()}
    assert np.allclose(got[0], [0.6, 0.8]) and np.allclose(got[1], [0.0, 1.0]) and 2 not in got


def brute_nearest(q, c, k):
    out = {}
    for i, x in enumerate(q.astype(np.float32).astype(float)):
        sims = []
        for j, y in enumerate(c.astype(np.float32).astype(float)):
            size = math.sqrt((x @ x) * (y @ y))
            sims.append((-(x @ y / size if size else 0.0), j))
        out[i] = [(j, -s) for s, j in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_nearest_equals_brute_force_both_ways(spark, limit, k):
    corpus = RNG.integers(-3, 4, size=(300, 8)).astype(float)
    corpus[100:200] = corpus[7]  # a third of the rows are copies
    corpus[20] = 0
    queries = np.vstack([corpus[:40], RNG.integers(-3, 4, size=(10, 8)), np.zeros((1, 8))])
    got = retrieval.nearest(
        vectors(spark, queries).withColumnRenamed("id", "query_id"),
        vectors(spark, corpus).repartition(5),
        "id", k=k, max_broadcast_bytes=limit, rows_per_block=16 if limit == 0 and k == 4 else 64,
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.id, r.similarity))
    want = brute_nearest(queries, corpus, k)
    for i in want:
        assert [j for j, _ in found[i]] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in found[i]], [s for _, s in want[i]], atol=1e-12)


def test_balls_spare_most_pairs(spark):
    """In a corpus of groups a query meets its own group and little else, and the rows stay exact."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    corpus = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.05, size=(2000, 16))
    queries = centres + rng.normal(scale=0.05, size=(40, 16))
    q = vectors(spark, queries).withColumnRenamed("id", "query_id").withColumn("vec", F.col("vec").cast("array<float>"))
    c = vectors(spark, corpus).withColumn("vec", F.col("vec").cast("array<float>"))
    search = retrieval.BallSearch(c, ["id"], "vec", 100)
    schema = "query_id bigint, id bigint, similarity double"
    near = search.next_to(q)
    first = search.best(near, ["query_id"], 5, T.StructType.fromDDL(schema))
    more = search.within_reach(near, first, ["query_id"], 5)
    met = sum(int(search.balls.size[r.ball]) for r in near.select("ball").collect() + more.select("ball").collect())
    assert met < 0.2 * len(queries) * len(corpus)
    got = retrieval.nearest(q, c, "id", k=5, max_broadcast_bytes=0, rows_per_block=100).collect()
    want = brute_nearest(queries, corpus, 5)
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(i, n + 1, j) for i in want for n, (j, _) in enumerate(want[i])}


def test_retrieve_text_takes_the_first_copy(spark):
    train = spark.createDataFrame(
        [(5, "x y", [1.0, 0.0]), (2, "x y", [1.0, 0.0]), (1, "z", [0.0, 1.0])],
        "id bigint, text string, vec array<float>",
    )
    asked = spark.createDataFrame([(9, [2.0, 0.1])], "query_id bigint, vec array<float>")
    row = retrieval.retrieve_text(asked, train, "id").first()
    assert (row.id, row.generated) == (2, "x y")


def test_query_lists(spark):
    got = tables.query_texts(spark, lines=[" a ", "", "b"]).collect()
    assert [(r.query_id, r.text) for r in got] == [(0, "a"), (1, "b")]
    assert tables.query_texts(spark, text="q").count() == 1
    with pytest.raises(ValueError):
        tables.query_texts(spark, lines=["  "])


def test_gram_and_predictor(spark):
    x = RNG.normal(size=(400, 6))
    w = RNG.normal(size=(6, 6))
    rows = [([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, x @ w)]
    df = spark.createDataFrame(rows, "context_vec array<double>, target_vec array<double>").repartition(40)
    z = np.hstack([np.ones((400, 1)), x, x @ w])
    assert np.allclose(gram.gram(df, "context_vec", "target_vec"), z.T @ z)
    fitted = predictor.fit_predictor(df, ridge=1e-9)
    assert np.allclose(fitted, w, atol=1e-6)
    near = predictor.predict(df, fitted).select(vec.cosine(F.col("pred"), F.col("target_vec")).alias("c"))
    assert near.agg(F.min("c")).first()[0] > 1 - 1e-6


def test_gram_in_two_stages(spark):
    x = RNG.normal(size=(90, 3))
    rows = [([float(v) for v in a],) for a in x]
    df = spark.createDataFrame(rows, "v array<double>").repartition(30)
    z = np.hstack([np.ones((90, 1)), x])
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        assert np.allclose(gram.gram(df, "v"), z.T @ z)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_spearman_fixtures(spark):
    def rho(a, b):
        rows = spark.createDataFrame(
            [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "id int, a double, b double"
        )
        return quality.spearman(rows, "a", "b", "id").first().rho

    up = [1, 2, 3, 4, 5]
    assert rho(up, [10, 20, 30, 40, 50]) > 0.999
    assert rho(up, [50, 40, 30, 20, 10]) < -0.999
    assert rho(up, [1, 4, 9, 16, 25]) > 0.999
    assert rho([1, 1, 1, 1], [1, 2, 3, 4]) == 0.0
    assert rho([1], [2]) == 0.0


def test_uniformity_moves_a_vector_a_bounded_number_of_times(spark):
    # 102,000 and 612,000 vectors of 64 numbers, in blocks of 256 rows.
    assert quality.stripe_count(102_000, 64 * 102_000, 256) == quality.stripe_count(612_000, 64 * 612_000, 256) == quality.STRIPES
    assert 4 * 64 * 10**8 / quality.stripe_count(10**8, 64 * 10**8, 256) <= quality.STRIPE_BYTES
    x = np.random.default_rng(5).normal(size=(150, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    x[40:60] = x[0]
    near = np.exp(-2.0 * (2.0 - 2.0 * x @ x.T))[~np.eye(150, dtype=bool)]
    row = quality.uniformity(vectors(spark, x), rows_per_block=3).first()
    assert math.isclose(row.uniformity, math.log(near.mean()), rel_tol=1e-9) and row.n_ordered_pairs == 150 * 149


def test_uniformity_in_blocks(spark):
    x = RNG.normal(size=(83, 7))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    near = np.exp(-2 * (2 - 2 * x @ x.T))[~np.eye(83, dtype=bool)]
    for rows_per_block in (10, 1000):
        row = quality.uniformity(vectors(spark, x), rows_per_block=rows_per_block).first()
        assert math.isclose(row.uniformity, math.log(near.mean()), rel_tol=1e-9)
        assert row.n_ordered_pairs == 83 * 82
    alone = quality.uniformity(vectors(spark, x[:1])).first()
    assert math.isnan(alone.uniformity) and alone.n_ordered_pairs == 0


def test_spread_measures_equal_a_direct_decomposition(spark):
    x = RNG.normal(size=(200, 12)).astype(np.float32).astype(float)
    x[:, 11] = x[:, 0]  # rank deficient
    centered = x - x.mean(axis=0)
    cov = centered.T @ centered / 199
    s = np.linalg.svd(centered, compute_uv=False)
    s = s[s > 1e-8]
    p = s / s.sum()
    row = quality.spread_measures(vectors(spark, x), "vec").first()
    assert math.isclose(row.effective_rank, math.exp(-(p * np.log(p)).sum()), rel_tol=1e-6)
    assert math.isclose(row.off_diag_cov_l1, np.abs(cov - np.diag(np.diag(cov))).sum(), rel_tol=1e-9)
    assert quality.spread_measures(vectors(spark, x[:1]), "vec").first().effective_rank == 0.0


def plain_batch(p, t):
    n = len(p)
    own = np.mean([a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in zip(p, t)])
    hits = np.mean(np.argmax(p @ t.T, axis=1) == np.arange(n))
    off = (p @ p.T)[~np.eye(n, dtype=bool)].mean()
    centered = t - t.mean(axis=0)
    s = np.linalg.svd(centered, compute_uv=False)
    s = s[s > 1e-10]
    q = s / s.sum()
    cov = np.cov(t.T)
    return [
        own, hits, np.linalg.norm(p, axis=1).mean(), 1 - off, t.std(axis=0, ddof=1).mean(),
        np.exp(-(q * np.log(q)).sum()), np.abs(cov - np.diag(np.diag(cov))).sum(),
    ]


def test_batch_metrics_and_their_running_mean(spark):
    p = RNG.normal(size=(26, 5)).astype(np.float32).astype(float)
    t = (p + 0.3 * RNG.normal(size=p.shape)).astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(p, t))]
    df = spark.createDataFrame(rows, "pos bigint, pred array<float>, target array<float>").repartition(5)
    got = quality.batch_metrics(df, "pos", 8).orderBy("batch_id")
    want = [plain_batch(p[i : i + 8], t[i : i + 8]) for i in range(0, 26, 8)]
    assert np.allclose([list(r)[2:] for r in got.collect()], want)
    weights = np.array([8, 8, 8, 2])
    run = quality.running_metrics(got).first()
    assert np.allclose(list(run)[:-1], weights @ np.array(want) / 26) and run.total_samples == 26
    closed = quality.diversity(df).first()
    off = (p @ p.T)[~np.eye(26, dtype=bool)].mean()
    assert math.isclose(closed.diversity, 1 - off, rel_tol=1e-9)
    std = quality.mean_std(df).first().std_mean
    assert math.isclose(std, t.std(axis=0, ddof=1).mean(), rel_tol=1e-9)
    with pytest.raises(ValueError):
        quality.batch_metrics(df, "pos", 0)


def test_equal_targets_tie_to_the_first():
    """Equal targets have equal products, at any batch length: a matrix product may round them apart."""
    rng = np.random.default_rng(1)
    for size in range(2, 33):
        few = rng.normal(size=(4, 64))
        chosen = rng.integers(0, 4, size)
        t = few[chosen]
        _, hits, *_ = quality._batch_measures(t[None].copy(), t[None])
        near = few @ few.T
        near = near[np.ix_(chosen, np.unique(chosen))]
        best = np.unique(chosen)[near.argmax(axis=1)]
        first = np.array([np.flatnonzero(chosen == c)[0] for c in best])
        assert hits[0] == np.mean(first == np.arange(size))


def test_a_batch_of_one_row_takes_no_part_in_what_it_lacks(spark):
    p = RNG.normal(size=(9, 5))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "pos bigint, pred array<double>").withColumn("target", F.col("pred"))
    got = quality.batch_metrics(df, "pos", 8)
    whole = got.where("n = 8").first()
    run = quality.running_metrics(got).first()
    assert math.isclose(run.diversity, whole.diversity) and math.isclose(run.target_std_mean, whole.target_std_mean)
    assert run.total_samples == 9 and math.isclose(run.target_eff_rank, whole.target_eff_rank * 8 / 9)


def test_collapse_flags(spark):
    x = np.ones((16, 4))
    rows = [(i, [float(v) for v in a], [float(v) for v in a]) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "pos bigint, pred array<float>, target array<float>")
    run = quality.running_metrics(quality.batch_metrics(df, "pos", 8))
    flags = quality.collapse_flags(run).first()
    assert all(flags)


def test_alignment(spark):
    rows = [(0, 4.5, [1.0, 0.0], [0.0, 1.0]), (1, 5.0, [1.0, 0.0], [1.0, 0.0]), (2, 4.0, [1.0, 0.0], [9.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, label double, vec1 array<double>, vec2 array<double>")
    assert tuple(quality.alignment(df, "id").first()) == (1.0, 2)
    assert tuple(quality.alignment(df, "id", limit=1).first()) == (2.0, 1)
    row = quality.alignment(df, "id", above=9.0).first()
    assert math.isnan(row.alignment) and row.n_pos == 0


def test_linear_probe_separates(spark):
    x = RNG.normal(size=(300, 4))
    rows = [([float(v) for v in a], int(a[0] > 0)) for a in x]
    df = spark.createDataFrame(rows, "vec array<float>, label int")
    assert quality.linear_probe(df.limit(200), df).first().probe_acc > 0.95


def test_histogram(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (0.99,), (1.0,)], "v double")
    got = {r.bin: r.n for r in quality.histogram(df, F.col("v"), -1.0, 1.0, 4).collect()}
    assert got == {0: 1, 1: 1, 3: 1, 4: 1, 5: 1}


def plain_newton(x, y, n_classes, ridge, rounds):
    z = np.hstack([np.ones((len(x), 1)), x])
    hold = ridge * np.eye(z.shape[1])
    hold[0, 0] = 0
    out = np.zeros((z.shape[1], n_classes))
    for c in range(n_classes):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ out[:, c]))
            slope = z.T @ ((y == c) - p) - hold @ out[:, c]
            out[:, c] += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + hold, slope)
    return out


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_newton_weights(spark, monkeypatch, cells):
    """Weights as of one machine, for all classes in one pass a round or a class in each; the slope ends at zero."""
    monkeypatch.setattr(quality, "NEWTON_CELLS", cells)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5)).astype(np.float32).astype(float)
    y = (x[:, 0] + rng.normal(scale=0.5, size=300) > 0).astype(int) + (x[:, 1] > 1)
    rows = [([float(v) for v in a], [float(b == c) for c in range(3)]) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "vec array<float>, _marks array<double>").repartition(7)
    got = quality.newton_weights(df, "vec", 3, 1.0, 8)
    assert np.allclose(got, plain_newton(x, y, 3, 1.0, 8), atol=1e-9)
    z = np.hstack([np.ones((300, 1)), x])
    p = 1 / (1 + np.exp(-z @ got))
    slope = z.T @ (np.eye(3)[y] - p) - np.vstack([np.zeros((1, 3)), got[1:]])
    assert np.abs(slope).max() < 1e-8


def test_probe_without_rows(spark):
    df = spark.createDataFrame([], "id bigint, vec array<float>, label int")
    one = spark.createDataFrame([(1, [1.0, 2.0], 3)], "id bigint, vec array<float>, label int")
    assert tuple(quality.linear_probe(df, df).first()) == (None, 0)
    assert tuple(quality.linear_probe(df, one).first()) == (0.0, 1)
    assert tuple(quality.linear_probe(one, one).first()) == (1.0, 1)


def test_rank_of_dependent_columns(spark):
    """Singular values of a table of less than full rank, next to very small ones that a square would lose."""
    rng = np.random.default_rng(13)
    base = rng.normal(size=(500, 4))
    x = np.hstack([base, base @ rng.normal(size=(4, 3)), 1e-9 * rng.normal(size=(500, 1)), np.full((500, 1), 7.0)])
    rows = [([float(v) for v in a],) for a in x] + [(None,)]
    df = spark.createDataFrame(rows, "target array<double>").repartition(9)
    r, n = gram.centred_triangle(df, "target")
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert n == 500 and np.allclose(np.linalg.svd(r, compute_uv=False), want, rtol=1e-9, atol=1e-12)
    kept = want[want > 1e-10]
    assert len(kept) == 5 and kept.min() < 1e-7
    row = quality.spread_measures(df).first()
    assert math.isclose(row.effective_rank, quality.rank_from_singular(want), rel_tol=1e-9)
    cov = np.abs(np.cov(x.T))
    assert math.isclose(row.off_diag_cov_l1, cov.sum() - np.trace(cov), rel_tol=1e-9)
    few = spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 2.0, 5.0],)], "target array<double>")
    assert tuple(quality.spread_measures(few.limit(1)).first()) == (0.0, 0.0, 1)
    assert math.isclose(quality.spread_measures(few).first().effective_rank, 1.0, rel_tol=1e-9)
    assert tuple(quality.spread_measures(few.limit(0)).first()) == (0.0, 0.0, 0)


def test_pair_cosines_are_those_of_the_pair_sums(spark, small):
    from spanloom.functions import vectors as vec
    from spanloom.operators import concepts, sentences
    from spanloom.sources import tables

    docs = tables.documents(spark, small).limit(40).unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "One."), (-4, "!? ... \n. One. One.")], "doc_id bigint, text string"), allowMissingColumns=True
    )
    cut = sentences.cut_sentences(docs, max_sentence_len=None)
    for size in (1, 8):
        sums = concepts.pair_sums(cut, window_size=size).select("doc_id", F.posexplode(F.arrays_zip("sums.context", "sums.target")).alias("at", "x"))
        want = {(r.doc_id, r.at): r.c for r in sums.select("doc_id", "at", vec.cosine(F.col("x.context"), F.col("x.target")).alias("c")).collect()}
        got = concepts.pair_cosines(cut, window_size=size).select("doc_id", F.posexplode("cosines").alias("at", "c"))
        got = {(r.doc_id, r.at): r.c for r in got.collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("k", [1, 6])
def test_queries_beyond_a_broadcast_do_not_move_per_ball(spark, k):
    """On vectors without groups each query reaches nearly all balls; what is written follows the rows, not the visits."""
    rng = np.random.default_rng(21)
    corpus, queries = rng.normal(size=(3000, 24)).astype(np.float32), rng.normal(size=(1500, 24)).astype(np.float32)
    queries[:5] = corpus[:5]
    asked = vectors(spark, queries.astype(float)).withColumnRenamed("id", "query_id")
    shared_dir(spark)  # the first call makes the folder
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    options = {"k": k, "max_broadcast_bytes": 0, "rows_per_block": 64}
    got = retrieval.nearest(asked, vectors(spark, corpus.astype(float)).repartition(3), "id", **options).collect()
    grew = size() - before
    unit = [x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True) for x in (queries, corpus)]
    want = np.argsort(-(unit[0] @ unit[1].T), axis=1)[:, :k]
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(i, n + 1, j) for i, row in enumerate(want.tolist()) for n, j in enumerate(row)}
    assert k > 1 or grew < 1_770_000, grew  # one copy per ball takes 1,981,000
    again = retrieval.nearest(asked, vectors(spark, corpus.astype(float)), "id", round_bytes=60_000, **options).collect()
    assert sorted(again) == sorted(got)
