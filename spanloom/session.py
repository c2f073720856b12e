"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int | str | None = None, app: str = "spanloom", **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    The master is left to the cluster (or spark-submit); only with ``cores`` it is a local one.
    ``spark.sql.shuffle.partitions`` is only set there: a cluster takes it from its size, and adaptive
    execution joins what is too small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "16g")
        builder = builder.config("spark.sql.shuffle.partitions", "8").config(INPUT_PARTS, "8")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process (``local`` or ``local[...]``) gets a
    temporary folder without that setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spanloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/spanloom-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, read back. Its columns are compressed, unlike those of a checkpoint."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Session option: into how many parts a job deals its input, where the files have fewer splits than cores.
INPUT_PARTS = "spark.spanloom.inputParts"


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan out by the session's ``INPUT_PARTS``; unset (a large table), no row moves."""
    parts = scan.sparkSession.conf.get(INPUT_PARTS, None)
    if scan.isStreaming or not parts:
        return scan
    return scan.repartition(int(parts), *keys)


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that a later filter does not compute a second time.

    A filter on a plain column is pushed below it together with a copy of its expression;
    a generated column stays where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
