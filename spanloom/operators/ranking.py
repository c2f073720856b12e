"""Exact global order without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.hashing import hex_number
from spanloom.session import cut_lineage

_LOCAL_BITS = 33  # Spark's row ids hold the partition above this bit.


def global_rank(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the given total order.

    One range shuffle sorts the rows over all tasks. The sorted rows are checkpointed, so
    the per-partition counts and the final positions come from the same stored rows. The
    order should end in a unique column; then a value held by a third of all rows is cut
    over many ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ordered = ordered.withColumn("_part", F.shiftright("_row", _LOCAL_BITS)).withColumn(
        "_row", F.col("_row").bitwiseAND((1 << _LOCAL_BITS) - 1)
    )
    # One row per partition: at most `parts` rows reach the running sum and the broadcast.
    sizes = ordered.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("bigint"))
        .drop("_part", "_row", "_before")
    )


def hash_rank(df: DataFrame, key: str | Column, *ties: str, name: str = "rank", digits: int = 4) -> DataFrame:
    """The position of each row in the order of a hexadecimal hash.

    Hash values are uniform, so their first digits cut the rows into equal buckets. The
    bucket counts (at most 16**digits rows) give each bucket its offset. A key that is an expression is found again
    in its bucket, so that it does not move with the row.
    """
    moves = isinstance(key, str)
    key = F.col(key) if moves else key
    bucketed = df.withColumn("_bucket", hex_number(key, 1, digits))
    counts = bucketed.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_bucket").orderBy(key, *ties)
    dealt = bucketed if moves else bucketed.repartition("_bucket")
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("bigint"))
        .drop("_bucket", "_row", "_before")
    )


def hash_cutoff(df: DataFrame, key: str, keep_share: float, digits: int = 4) -> str | None:
    """The hash value (exclusive) below which ``int(n * keep_share)`` rows lie.

    Needs the bucket counts (at most 16**digits numbers) and the hashes of a single bucket,
    never a full sort. None means that all rows are kept.
    """
    hashes = df.select(F.col(key).alias("k"), hex_number(F.col(key), 1, digits).alias("b"))
    counts = sorted((r["b"], r["count"]) for r in hashes.groupBy("b").count().collect())
    take = int(sum(n for _, n in counts) * keep_share)
    seen = 0
    for bucket, n in counts:
        if seen + n > take:
            inside = hashes.where(F.col("b") == bucket).orderBy("k").limit(take - seen + 1)
            return inside.agg(F.max("k")).first()[0]
        seen += n
    return None
