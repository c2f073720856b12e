import math

import pytest
from pyspark.sql import functions as F

from spanloom.functions import hashing
from spanloom.operators import pairs, ranking, split
from spanloom.sources import sinks, tables


def numbers(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


# The first eight hex digits of the SHA-256 of the first 200 characters, modulo 1000.
BUCKETS = {
    "cold harbour": 268, "river": 328, "stone bridge": 518, "seven lamps": 559, "\u00dcnder": 594,
    "x" * 200: 598, "x" * 200 + " and a tail that is not hashed": 598, "": 610,
}


@pytest.mark.parametrize("fraction", [0.0, 0.268, 0.269, 0.5, 0.598, 0.599, 0.61, 0.611, 1.0])
def test_buckets_below_the_fraction_are_held_out(spark, fraction):
    docs = spark.createDataFrame([(t,) for t in BUCKETS], "text string")
    rows = docs.select("text", hashing.split_bucket(F.col("text")).alias("bucket"), hashing.is_val(F.col("text"), fraction).alias("val"))
    got = {r.text: (r.bucket, r.val) for r in rows.collect()}
    assert got == {t: (k, k < round(fraction * 1000)) for t, k in BUCKETS.items()}


def test_split_sides_are_disjoint_and_whole(spark, small):
    docs = tables.documents(spark, small)
    both = pairs.split_pairs(docs, val_fraction=0.3)
    train = pairs.split_pairs(docs, val_fraction=0.3, split="train")
    val = pairs.split_pairs(docs, val_fraction=0.3, split="val")
    assert both.exceptAll(train.union(val)).isEmpty()
    assert train.count() + val.count() == both.count() and val.count() > 0
    assert split.leaked_documents(both).isEmpty()
    with pytest.raises(ValueError):
        pairs.split_pairs(docs, split="test")


def test_leak_check_finds_a_leak(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "val"), (2, "val")], "doc_id int, split string")
    assert [r.doc_id for r in split.leaked_documents(rows).collect()] == [1]


def test_global_rank_with_a_hot_value(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"))
    got = ranking.global_rank(rows, "v", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(5000))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_rank_and_cutoff(spark, digits):
    rows = numbers(spark, 999).withColumn("k", hashing.order_key(5, "doc_id"))
    got = ranking.hash_rank(rows, "k", digits=digits).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(999))
    assert [r.k for r in got] == sorted(r.k for r in got)
    for share in (0.0, 0.25, 0.9, 0.999):
        cut = ranking.hash_cutoff(rows, "k", share, digits)
        assert rows.where(F.col("k") < cut).count() == int(999 * share)
    assert ranking.hash_cutoff(rows, "k", 1.0, digits) is None


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.33, 1.0])
def test_exact_split_sizes(spark, ratio):
    rows = numbers(spark, 101)
    sides = split.exact_split(rows, "doc_id", eval_ratio=ratio).cache()
    assert sides.where("side = 'train'").count() == int(101 * (1 - ratio))
    again = split.exact_split(rows.repartition(7), "doc_id", eval_ratio=ratio)
    assert sides.exceptAll(again).isEmpty()
    other = split.exact_split(rows, "doc_id", eval_ratio=ratio, seed=43)
    assert ratio in (0.0, 1.0) or not sides.exceptAll(other).isEmpty()


def test_exact_split_in_order(spark):
    sides = split.exact_split(numbers(spark, 10), "doc_id", eval_ratio=0.3, shuffle=False)
    assert [r.side for r in sides.orderBy("doc_id").collect()] == ["train"] * 7 + ["eval"] * 3


def test_stream_shards_are_disjoint_and_complete(spark):
    got = split.stream_shards(numbers(spark, 100), "doc_id", world_size=3, workers=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(100))
    assert all(r.shard == r.doc_id % 6 == r.rank * 2 + r.worker for r in got)


@pytest.mark.parametrize("n,world", [(10, 4), (3, 8), (12, 4), (1, 3)])
def test_epoch_shards_have_equal_size(spark, n, world):
    got = split.epoch_shards(numbers(spark, n), "doc_id", world_size=world, epoch=1).collect()
    size = math.ceil(n / world)
    assert [sum(r.shard == s for r in got) for s in range(world)] == [size] * world
    assert {r.doc_id for r in got} == set(range(n))
    by_place = {r.position: r.doc_id for r in got}
    assert all(by_place[p] == by_place[p % n] for p in by_place)


def test_epochs_differ_and_repeat(spark):
    order = lambda e: [
        r.doc_id for r in split.epoch_order(numbers(spark, 50), "doc_id", epoch=e).orderBy("position").collect()
    ]
    assert order(0) == order(0) and order(0) != order(1) and sorted(order(1)) == list(range(50))


def test_pair_sink_prunes_sides(spark, small, tmp_path):
    made = pairs.split_pairs(tables.documents(spark, small))
    sinks.write_pairs(made, str(tmp_path / "p"))
    val = sinks.read_pairs(spark, str(tmp_path / "p"), "val")
    assert val.count() == made.where("split = 'val'").count()
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()
