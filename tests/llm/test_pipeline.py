"""The pipeline's stages against plain versions on a small folder."""

import random

import pytest

import corpus_pipeline
from spanloom.llm import decontaminate, toxicity_cnn
from tests.llm.fixtures import documents, sentence, texts
from tests.llm.test_leaks import least_edits
from tests.llm.test_native import plain_spans
from tests.llm.test_packing import pieces_of
from tests.llm.test_simhash import plain_components, plain_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    items = [(i, sentence(rng, 20)) for i in range(5)]
    rows = texts()
    rows += [(2000 + i, sentence(rng, 10) + " " + items[i % 5][1] + " " + sentence(rng, 9)) for i in range(8)]
    rows += [(2100 + i, f"{sentence(rng, 25)} token = {'ab12' * 8} {sentence(rng, 3)}") for i in range(6)]
    labels = []
    for i in range(500):
        toxic = i % 3 == 0
        rows.append((3000 + i, " ".join([sentence(rng, 12), *(["vermin"] if toxic else []), sentence(rng, 12)])))
        if i < 400:
            labels.append((3000 + i, 1, int(toxic)))
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def key(row):
    return (str(row[0]), str(row[1]))


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]

    first = stages["toxicity"](spark, docs, path)
    assert first.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in first.collect()]
    gone = {d for d, _ in rows} - {d for d, _ in kept}
    assert gone == {3000 + i for i in range(0, 500, 3)}

    second = stages["near_duplicates"](spark, first, path)
    assert second.columns == docs.columns
    prints = [plain_print(t) for _, t in kept]
    roots = plain_components(set(prints), corpus_pipeline.NEAR_BITS)
    best = {}
    for (d, _), p in zip(kept, prints, strict=True):
        best[roots[p]] = min(best.get(roots[p], (True, 0)), (d is None, d or 0))
    stays = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(str(d) for d, _ in stays) == sorted(str(None if none else d) for none, d in best.values())

    third = stages["decontamination"](spark, second, path)
    plain = [(d, decontaminate.plain_form(t or "")[0]) for d, t in stays]
    bench = [decontaminate.plain_form(t)[0] for _, t in items]
    leaked = {
        d for d, t in plain if len(t) < 4000
        and any(least_edits(b, t) <= decontaminate.budget_of(len(b), decontaminate.EDIT_RATE) for b in bench)
    }
    assert {2000 + i for i in range(8)} <= leaked
    clean = [(r.doc_id, r.text) for r in third.collect()]
    assert sorted(d for d, _ in clean) == sorted(d for d, _ in stays if d not in leaked)

    fourth = stages["secrets"](spark, third, path)
    assert fourth.columns == docs.columns
    texts_now = {r.doc_id: r.text for r in fourth.collect()}
    assert set(texts_now) == {d for d, _ in clean}
    for d, t in clean:
        assert (texts_now[d] == t) == (not plain_spans(t))
        assert not plain_spans(texts_now[d])

    fifth = stages["packing"](spark, fourth, path).collect()
    want = sorted((d, *p) for d, t in texts_now.items() for p in pieces_of(t, 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in fifth) == want

    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in fifth
    )


def test_empty_tables(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_the_last_fifth_is_not_seen_by_the_fit():
    labels = [i % 2 for i in range(40)]
    import numpy as np

    model = toxicity_cnn.train([np.array([7 if y else 9] * 3) for y in labels], np.array(labels), min_docs=1, epochs=20)
    p = toxicity_cnn.scores(model, np.array([7, 7, 7, 9, 9, 9]), np.array([3, 3]))
    assert p[0] > p[1]
