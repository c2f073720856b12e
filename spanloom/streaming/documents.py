"""The document pipeline on an unbounded source.

Sentence work is done inside each document row, so pairs need no state and leave in append
mode; only the funnel counters keep state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.hashing import order_key
from spanloom.operators.pairs import split_pairs
from spanloom.operators.sentences import cut_sentences
from spanloom.sources import sinks

DOCUMENT_SCHEMA = "doc_id bigint, text string"


def document_stream(
    spark: SparkSession,
    folder: str,
    *,
    files: str = "documents*.parquet",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Documents as files arrive; a null text counts as empty. What ``files`` names may be a file or a folder of parts."""
    raw = (
        spark.readStream.schema(DOCUMENT_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder.rstrip('/')}/{files}")
    )
    return raw.withColumn("text", F.coalesce("text", F.lit("")))


def stream_pairs(docs: DataFrame, **options) -> DataFrame:
    """Pairs of each arriving document, with its split."""
    return split_pairs(docs, **options)


def stream_funnel(docs: DataFrame, **options) -> DataFrame:
    """Documents by outcome so far."""
    return cut_sentences(docs, **options).groupBy("reason").agg(F.count("*").alias("n"))


def append_to(rows: DataFrame, path: str, state: str, *partitions: str) -> StreamingQuery:
    """Write new rows to a table folder, each exactly once."""
    writer = rows.writeStream.outputMode("append").format("parquet")
    if partitions:
        writer = writer.partitionBy(*partitions)
    return (
        writer.option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def keep_latest(rows: DataFrame, path: str, state: str) -> StreamingQuery:
    """Replace a small result table with each new complete result; ``sinks.read_version`` reads it.

    A new result is written beside the old one and then named as the current one in one step, so a crash at any
    time leaves a whole table.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = sinks.write_version(batch, path, number)
        sinks.commit_version(batch.sparkSession, path, name)

    return _each_batch(rows, state, "complete", write)


def shuffle_batches(
    rows: DataFrame, path: str, state: str, *ids: str, seed: int = 42
) -> StreamingQuery:
    """Write every micro-batch in a seeded random order.

    A micro-batch takes the place of a shuffle buffer. Each one has its own folder, so one
    that is run again replaces its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("order_key", order_key(seed, *ids))
        ordered = keyed.repartitionByRange("order_key").sortWithinPartitions("order_key")
        ordered.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _each_batch(rows, state, "append", write)


def _each_batch(
    rows: DataFrame, state: str, mode: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
