"""Written outputs: pair tables, CSV logs, and the choice of a snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the training log and their printf formats.
LOG_FORMATS = {
    "epoch": "%d",
    "step": "%d",
    "loss": "%.5f",
    "lr": "%.6f",
    "momentum": "%.4f",
    "time(ms)": "%.2f",
}
LOG_SCHEMA = (
    "epoch int, step bigint, loss double, lr double, momentum double, `time(ms)` double"
)

# Fixed value: the name of a snapshot file and the epoch in it.
SNAPSHOT_PATTERN = r"checkpoint-epoch(\d+)\.pth$"


# Session option: folders that a task may write at once; without it a task sorts its rows by folder first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
SIDES = 2


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One folder per side, so a reader of one side never opens the other.

    A task keeps a file of either side open. Pairs are many times larger than their documents, and a sort by side
    would hold all pairs of a task.
    """
    conf = pairs.sparkSession.conf
    before = conf.get(WRITERS, None)
    if int(before or 0) < SIDES:
        conf.set(WRITERS, str(SIDES))
    try:
        pairs.write.mode("overwrite").partitionBy("split").parquet(path)
    finally:
        if before is None:
            conf.unset(WRITERS)
        else:
            conf.set(WRITERS, before)


def read_pairs(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    pairs = spark.read.parquet(path)
    return pairs if split is None else pairs.where(F.col("split") == split)


# Fixed value: the file that names the current version of a table that is replaced as a whole.
POINTER = "_latest"
VERSIONS_KEPT = 2  # the current one, and the one that readers may still hold


def write_version(rows: DataFrame, path: str, number: int) -> str:
    """Write a new version of a small table beside the others; no reader sees it yet. Returns its name."""
    name = f"version={number:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    return name


def commit_version(spark: SparkSession, path: str, name: str) -> None:
    """Make a written version the current one, by a rename that replaces the pointer in one step.

    A crash before it leaves the old version current, a crash after it the new one. Older versions go, so does
    what an earlier crash left unnamed.
    """
    files, target = _file(spark, f"{path}/{POINTER}")
    made = _path(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = files.create(made)
    out.write(bytearray(name, "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(made, target, overwrite)
    found = sorted(s.getPath().getName() for s in files.listStatus(_path(spark, path)))
    older = [n for n in found if n.startswith("version=") and n < name]
    unnamed = [n for n in found if n.startswith(f"{POINTER}-")]
    for gone in [*older[: 1 - VERSIONS_KEPT], *unnamed]:
        files.delete(_path(spark, f"{path}/{gone}"), True)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by ``commit_version``."""
    files, target = _file(spark, f"{path}/{POINTER}")
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(target), "UTF-8")
    return spark.read.parquet(f"{path}/{name}")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file(spark: SparkSession, path: str):
    target = _path(spark, path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(target)


def format_log(rows: DataFrame, formats: dict[str, str] = LOG_FORMATS) -> DataFrame:
    return rows.select(
        *[F.format_string(f, F.col(f"`{c}`")).alias(c) for c, f in formats.items()]
    )


def write_log(rows: DataFrame, path: str, formats: dict[str, str] = LOG_FORMATS) -> None:
    format_log(rows, formats).write.mode("overwrite").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def snapshot_epoch(name: Column) -> Column:
    """The integer epoch in a snapshot name, null for other names."""
    digits = F.regexp_extract(name, SNAPSHOT_PATTERN, 1)
    return F.when(digits != "", digits).cast("bigint")


def latest_snapshot(names: DataFrame, col: str = "name") -> DataFrame:
    """The name with the highest epoch, compared as a number; no rows without a snapshot."""
    epochs = names.select(F.col(col).alias("name"), snapshot_epoch(F.col(col)).alias("epoch"))
    best = epochs.where("epoch is not null").agg(
        F.max_by("name", F.struct("epoch", "name")).alias("name"), F.max("epoch").alias("epoch")
    )
    return best.where("epoch is not null")


def latest_snapshot_in(spark: SparkSession, folder: str) -> str:
    """Path of the newest snapshot file in a folder; an error when there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pth").load(folder)
    found = latest_snapshot(files.select("path"), "path").first()
    if found is None:
        raise FileNotFoundError(f"no snapshot file in {folder}")
    return found["name"]
