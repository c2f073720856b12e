"""Held-out accuracy, and the awkward rows."""

import random

import numpy as np

from spanloom.llm import queries, toxicity_cnn
from tests.llm.fixtures import documents, sentence


def planted(n=700):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        text = sentence(rng, rng.randrange(10, 80))
        toxic = i % 4 == 0
        if toxic:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["Vile!", "vermin,", "rotten"])
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def area(score, label):
    order = np.argsort(np.argsort(score))
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


def test_learns_planted_words(spark):
    rows, labels = planted()
    fitted = spark.createDataFrame(labels[:500], "doc_id bigint, toxic int")
    model = toxicity_cnn.fit(documents(spark, rows), fitted)
    got = {r.doc_id: r for r in toxicity_cnn.score(documents(spark, rows + [(9000, None), (9001, ""), (9002, "...")]), model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    late = [(got[i].score, y) for i, y in labels[500:]]
    score, label = np.array([x for x, _ in late]), np.array([y for _, y in late])
    assert area(score, label) > 0.97
    assert ((score >= 0.3) == label).mean() > 0.95
    assert not got[9000].flagged and got[9000].score == got[9001].score == got[9002].score
    kept = toxicity_cnn.keep_mask(documents(spark, rows), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if not got[d].flagged)


def test_without_labels(spark):
    docs = documents(spark)
    model = toxicity_cnn.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert model is None
    assert {r.score for r in toxicity_cnn.score(docs, model).collect()} == {0.0}
    assert toxicity_cnn.score(documents(spark, []), model).count() == 0


def test_held_out_rows_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op5_toxicity(spark, folder).where("held_out").toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").toPandas()
    both = got.merge(labels, on="doc_id")
    assert area(both.score.to_numpy(), both.toxic.to_numpy()) > 0.7


def test_the_language_does_not_change_a_score(spark):
    rows, labels = planted(200)
    docs = documents(spark, rows)
    model = toxicity_cnn.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z"))
    a = sorted((r.doc_id, r.score) for r in toxicity_cnn.score(docs, model).collect())
    assert a == sorted((r.doc_id, r.score) for r in toxicity_cnn.score(other, model).collect())


def test_rows_behind_the_first_8000_are_learned(spark):
    from pyspark.sql import functions as F

    ids = [r.doc_id for r in spark.range(8400).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = {d: f"{'alpha' if i % 4 else 'vile'} beta gamma" for i, d in enumerate(ids[:8000])}
    texts.update({d: f"{'delta' if i % 2 else 'vermin'} beta gamma" for i, d in enumerate(ids[8000:])})
    docs = documents(spark, sorted(texts.items()))
    labels = spark.createDataFrame([(d, int("v" == t[0])) for d, t in texts.items()], "doc_id bigint, toxic int")
    model = toxicity_cnn.fit(docs, labels)
    asked = documents(spark, [(1, "vermin beta gamma"), (2, "delta beta gamma"), (3, "vile beta gamma"), (4, "alpha beta gamma")])
    got = {r.doc_id: r.score for r in toxicity_cnn.score(asked, model).collect()}
    assert got[1] > 0.9 > 0.1 > got[2] and got[3] > 0.9 > 0.1 > got[4]


def test_texts_of_over_20000_words_are_learned(spark):
    rows = [(i, "so it goes on " * 5001 + (" vile rotten" if i % 2 else " mild")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity_cnn.fit(documents(spark, rows), labels)
    got = {r.doc_id: r.score for r in toxicity_cnn.score(documents(spark, rows), model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)


def test_shards_learn_together(spark):
    rows, labels = planted()
    fitted = spark.createDataFrame(labels[:500], "doc_id bigint, toxic int")
    models = [toxicity_cnn.fit(documents(spark, rows), fitted, shard_rows=130) for _ in range(2)]
    got = [{r.doc_id: r.score for r in toxicity_cnn.score(documents(spark, rows), m).collect()} for m in models]
    assert got[0] == got[1]
    late = [(got[0][i], y) for i, y in labels[500:]]
    assert area(np.array([x for x, _ in late]), np.array([y for _, y in late])) > 0.95
