import math
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from spanloom.operators import funnel, pairs, sentences, telemetry
from spanloom.plans import queries
from spanloom.sources import sinks, tables
from spanloom.streaming import documents as stream
from spanloom.streaming import shuffle


def test_momentum(spark):
    cases = [(s, 100, 0.996, 1.0) for s in range(0, 101, 10)] + [(0, 0, 0.996, 1.0), (999, 10, 0.5, 0.9)]
    got = []
    for s, total, start, end in cases:
        one = spark.range(1).select(telemetry.momentum(F.lit(s), total, start, end))
        got.append(one.first()[0])
    grid = got[:11]
    assert all(b >= a - 1e-9 for a, b in zip(grid, grid[1:]))
    assert math.isclose(grid[0], 0.996) and math.isclose(grid[-1], 1.0)
    assert got[11] == 1.0 and got[12] == 0.9


@pytest.mark.parametrize("block", [1, 7, 10_000])
@pytest.mark.parametrize("m", [0.0, 0.5, 1.0, None])
def test_ema_equals_a_plain_fold(spark, block, m):
    rng = random.Random(4)
    # One key holds two thirds of the rows.
    rows = [(rng.choice("aaaaaabcd"), i, rng.uniform(-1, 1), rng.random() if m is None else m) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i int, x double, m double").repartition(5)
    got = telemetry.ema(df, "k", "i", value="x", momentum=F.col("m"), block_rows=block).collect()
    want, state = {}, {}
    for k, i, x, mm in rows:
        state[k] = mm * state[k] + (1 - mm) * x if k in state else x
        want[i] = state[k]
    assert len(got) == 150
    assert all(math.isclose(r.ema, want[r.i], abs_tol=1e-12) for r in got)


def test_ema_carries_lists_and_no_data_frame_per_key(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "SUPER", 2)
    rows = [("a", i, float(i)) for i in range(40)] + [(f"k{i}", i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = telemetry.ema(df, "k", "i", value="x", momentum=0.5, block_rows=3)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    state, want = 0.0, {}
    for i in range(40):
        state = 0.5 * state + 0.5 * i
        want["a", i], want[f"k{i}", i] = state, float(i)
    assert {(r.k, r.i): r.ema for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_best_so_far(spark):
    values = [5.0, 5.0, 4.0, 6.0, 4.0, 3.5, 3.5, 1.0, 2.0, 0.5]
    df = spark.createDataFrame(list(enumerate(values)), "step bigint, loss double")
    for block in (1, 3, 100):
        got = telemetry.mark_best(df, value="loss", step="step", block_rows=block).where("is_best")
        assert sorted(r.step for r in got.collect()) == [0, 2, 5, 7, 9]


def test_meter_and_steps(spark):
    df = spark.createDataFrame(
        [(1, 0, 2.0, 1), (1, 1, 4.0, 3), (2, 2, 1.0, 1), (2, 3, 9.0, 1), (2, 4, 7.0, 1)],
        "epoch int, step bigint, loss double, n int",
    )
    got = telemetry.meter(df, "epoch", value="loss", step="step", weight="n").orderBy("epoch").collect()
    assert tuple(got[0]) == (1, 4.0, 3.5, 14.0, 4, 2.0, 4.0)
    rolled = telemetry.accumulate_steps(df, 2, value="loss", idx="step", batch=8, world=4).orderBy("step")
    assert [(r.step, r.loss, r.effective_batch) for r in rolled.collect()] == [(0, 3.0, 64), (1, 5.0, 64)]
    assert [r.step for r in telemetry.every_nth(df, 2).orderBy("step").collect()] == [0, 2, 4]


def test_step_budget(spark):
    rows = spark.range(1000)
    budget = telemetry.step_budget(rows, batch_size=32, accum=2, world_size=4, epochs=3).first()
    assert (budget.rows, budget.total_steps, budget.steps_per_epoch) == (1000, 12, 4)
    assert telemetry.step_budget(spark.range(3), batch_size=32, accum=8).first().steps_per_epoch == 1
    assert telemetry.step_budget(None, batch_size=1, epochs=5, max_steps=12) == (12, 2)
    with pytest.raises(ValueError):
        telemetry.step_budget(None, batch_size=1)


def test_csv_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 10, 0.123456789, 1e-4, 0.99615, 12.345)],
        "epoch int, step bigint, loss double, lr double, momentum double, `time(ms)` double",
    )
    path = str(tmp_path / "log")
    sinks.write_log(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "epoch,step,loss,lr,momentum,time(ms)"
    assert lines[1].startswith("1,10,0.12346,0.000100,0.99")
    assert sinks.read_log(spark, path).first().loss == 0.12346


def test_latest_snapshot(spark, tmp_path):
    names = ["checkpoint-epoch9.pth", "checkpoint-epoch10.pth", "checkpoint-epoch11.pth.tmp", "best.pth"]
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert sinks.latest_snapshot(df).first().name == names[1]
    assert sinks.latest_snapshot_in(spark, str(tmp_path)).endswith(names[1])
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        sinks.latest_snapshot_in(spark, str(tmp_path / "none"))


def test_text_lines(spark, tmp_path):
    text = " one \r\n\ntwo\x85three  \n four"
    (tmp_path / "c.txt").write_text(text, newline="")
    got = sorted(r.line for r in tables.text_lines(spark, str(tmp_path / "c.txt")).collect())
    assert got == sorted(s.strip() for s in text.splitlines() if s.strip())


def spread_documents(spark, small, folder, files=6):
    """The documents in several files, with a null text among them."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None)], "doc_id bigint, text string")
    docs.unionByName(extra).repartition(files).write.parquet(folder)
    return docs.unionByName(extra)


def test_stream_equals_batch(spark, small, tmp_path):
    docs = spread_documents(spark, small, str(tmp_path / "in"))
    arriving = stream.document_stream(spark, str(tmp_path / "in"), files="*.parquet", files_per_trigger=2)
    made = stream.stream_pairs(arriving, val_fraction=0.2)
    stream.append_to(made, str(tmp_path / "out"), str(tmp_path / "s1"), "split").awaitTermination()
    want = pairs.split_pairs(docs, val_fraction=0.2)
    got = sinks.read_pairs(spark, str(tmp_path / "out")).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # A second start finds nothing new and writes nothing twice.
    again = stream.append_to(made, str(tmp_path / "out"), str(tmp_path / "s1"), "split")
    again.awaitTermination()
    assert sinks.read_pairs(spark, str(tmp_path / "out")).count() == want.count()


def test_stream_funnel_and_shuffle(spark, small, tmp_path):
    docs = spread_documents(spark, small, str(tmp_path / "in"))
    arriving = stream.document_stream(spark, str(tmp_path / "in"), files="*.parquet", files_per_trigger=2)
    counts = stream.stream_funnel(arriving)
    stream.keep_latest(counts, str(tmp_path / "out"), str(tmp_path / "s1")).awaitTermination()
    want = sentences.cut_sentences(docs).groupBy("reason").count()
    got = sinks.read_version(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    shuffled = stream.shuffle_batches(arriving, str(tmp_path / "mix"), str(tmp_path / "s2"), "doc_id")
    shuffled.awaitTermination()
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    assert mixed.select("batch").distinct().count() == 3 and mixed.count() == docs.count()


def test_stream_queries_read_a_folder_of_parts(spark, small, tmp_path):
    """A table may be a folder: the streams find its parts, as the batch readers do."""
    docs = spread_documents(spark, small, str(tmp_path / "documents.parquet"), files=3)
    run = lambda name: queries.all_queries()[name](spark, str(tmp_path))
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    for name in ("stream_shuffle", "buffered_shuffle"):
        assert sorted(r.doc_id for r in run(name).collect()) == ids
    assert sum(r.n for r in run("stream_funnel").collect()) == len(ids)
    want = run("sentence_pairs")
    got = run("stream_pairs").select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_crash_between_write_and_commit_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    spark.createDataFrame([(i, "a sentence. " * 20) for i in range(5)], "doc_id bigint, text string").write.parquet(f"{source}/a")
    arriving = stream.document_stream(spark, f"{source}/*", files="*.parquet")
    counts = stream.stream_funnel(arriving)
    stream.keep_latest(counts, path, str(tmp_path / "s")).awaitTermination()
    assert [r.n for r in sinks.read_version(spark, path).collect()] == [5]
    spark.createDataFrame([(9, "another one. " * 20)], "doc_id bigint, text string").write.parquet(f"{source}/b")

    def crash(*_):
        raise RuntimeError("between the two writes")

    with monkeypatch.context() as broken:
        broken.setattr(sinks, "commit_version", crash)
        failed = stream.keep_latest(counts, path, str(tmp_path / "s"))
        with pytest.raises(StreamingQueryException):
            failed.awaitTermination()
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("version=")]) == 2
    assert [r.n for r in sinks.read_version(spark, path).collect()] == [5]
    stream.keep_latest(counts, path, str(tmp_path / "s")).awaitTermination()
    assert [r.n for r in sinks.read_version(spark, path).collect()] == [6]
    for number in range(10, 14):
        sinks.commit_version(spark, path, sinks.write_version(spark.range(number), path, number))
    assert sinks.read_version(spark, path).count() == 13
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("version=")]) == sinks.VERSIONS_KEPT


def test_shuffle_buffer_lives_across_batches(spark, tmp_path):
    """Three batches and a second start: each row leaves once, rows of different batches mix, the buffer is bounded."""
    spark.conf.set(*shuffle.STATE_STORE)
    path, state, source = (str(tmp_path / n) for n in ("out", "state", "in"))

    def arrive(number):
        rows = spark.range(100 * number, 100 * number + 100).selectExpr("id as doc_id", "if(id % 7 = 0, null, cast(id as string)) as text")
        rows.coalesce(1).write.parquet(f"{source}/batch{number}")

    def run(idle_ms, drained):
        arriving = stream.document_stream(spark, f"{source}/*", files="*.parquet", files_per_trigger=1)
        arriving = arriving.withColumn("text", F.when(F.col("text") != "", F.col("text")))
        mixed = shuffle.buffered_shuffle(arriving, "doc_id", size=30, shards=2, idle_ms=idle_ms)
        query = shuffle.write_shuffled(mixed, path, state)
        if drained:
            shuffle.stop_when_drained(query, idle_ms)
        else:
            shuffle.stop_when_drained(query, 0)
        return spark.read.parquet(path)

    for number in range(2):
        arrive(number)
    first = run(3_600_000, drained=False).collect()
    assert len(first) == 200 - 2 * 30  # the buffers are full, the rest has left
    arrive(2)
    run(500, drained=True)
    # The timer of the first start is replaced by that of the new rows' shards.
    rows = spark.read.parquet(path).orderBy("shard", "place").collect()
    assert sorted(r.doc_id for r in rows) == list(range(300))
    assert all(r.text == (None if r.doc_id % 7 == 0 else str(r.doc_id)) for r in rows)
    for shard in (0, 1):
        batches = [r.doc_id // 100 for r in rows if r.shard == shard]
        assert [r.place for r in rows if r.shard == shard] == list(range(len(batches)))
        assert batches != sorted(batches)  # rows of a batch leave among those of later ones
    with pytest.raises(TimeoutError):
        shuffle.stop_when_drained(_Busy(), 10, timeout_s=0.3)


class _Busy:
    recentProgress, isActive = (), True

    def stop(self):
        pass


def test_counters_come_with_the_pairs(spark, small, tmp_path):
    """The counters equal those of a pass of their own, and each text is cut once."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    cut = spark.sparkContext.accumulator(0)

    def lines(texts):
        cut.add(len(texts))
        return [t.split("\n") for t in texts]

    options = {"val_fraction": 0.2, "splitter": lines, "max_tokens": 64}
    want = funnel.corpus_counts(docs, **options).first().asDict()
    once = cut.value
    got = funnel.write_counted_pairs(docs, str(tmp_path / "pairs"), **options)
    assert cut.value == 2 * once > 0
    assert got == want
    written = sinks.read_pairs(spark, str(tmp_path / "pairs"))
    assert written.count() == want["context_target_pairs"] > want["pairs_val"] > 0
    assert written.where("split = 'val'").count() == want["pairs_val"]
    assert written.columns == pairs.split_pairs(docs).select("doc_id", "pair_idx", "context", "target", "split").columns


def test_pairs_are_written_with_a_file_of_each_side_open(spark, small, tmp_path, monkeypatch):
    """No task sorts its pairs by side: both folders are written at once, and the session's setting comes back."""
    made = pairs.split_pairs(spark.read.parquet(f"{small}/documents.parquet"), val_fraction=0.2)
    seen, parquet = [], DataFrameWriter.parquet

    def write(self, path):
        seen.append(spark.conf.get(sinks.WRITERS, None))
        return parquet(self, path)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    before = spark.conf.get(sinks.WRITERS, None)
    sinks.write_pairs(made, str(tmp_path / "pairs"))
    assert seen == [str(sinks.SIDES)] and spark.conf.get(sinks.WRITERS, None) == before
    with pytest.raises(Exception):
        sinks.write_pairs(made.drop("split"), str(tmp_path / "none"))
    assert spark.conf.get(sinks.WRITERS, None) == before
    got = sinks.read_pairs(spark, str(tmp_path / "pairs")).select(made.columns)
    assert got.exceptAll(made).isEmpty() and made.exceptAll(got).isEmpty()
