"""Table scans; columns and filters of the caller are pushed into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.session import compute_once, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by id; a null text counts as empty."""
    scan = table(spark, folder, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    return spread(scan, "doc_id")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files with one sentence a line: stripped, blank lines dropped."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = raw.select(F.explode(tx.lines(F.col("value"))).alias("line"))
    return line.select(tx.strip(F.col("line")).alias("line")).where("line <> ''")


def query_texts(
    spark: SparkSession, *, text: str | None = None, lines: list[str] | None = None
) -> DataFrame:
    """The query list: one text, or the non-blank lines; an empty list is an error."""
    given = [text] if text else [s.strip() for s in lines or [] if s.strip()]
    if not given:
        raise ValueError("give a text or at least one non-blank query line")
    return spark.createDataFrame(
        list(enumerate(given)), "query_id bigint, text string"
    )


def query_rows(rows: DataFrame, id_col: str, *, text_col: str = "text") -> DataFrame:
    """A table of queries: stripped and non-blank, with their ids; none at all is an error."""
    asked = rows.select(F.col(id_col).alias("query_id"), tx.strip(F.col(text_col)).alias("text"))
    asked = asked.where("text <> ''")
    if asked.isEmpty():
        raise ValueError("give at least one non-blank query")
    return asked


def scored_pairs(
    pairs: DataFrame,
    *ids: str,
    carry: tuple[str, ...] = (),
    words: tuple[str, str] = ("context_words", "target_words"),
) -> DataFrame:
    """Sentence pairs with a score from 0 to 5: five times the word overlap (Jaccard).

    ``words`` names the word lists of both sides. The texts come along as ``sentence1`` and
    ``sentence2`` if ``pairs`` has them; a job on scores alone need not build them.
    """
    a, b = (F.array_distinct(c) for c in words)
    named = {"context": "sentence1", "target": "sentence2"}
    texts = [F.col(c).alias(n) for c, n in named.items() if c in pairs.columns]
    sized = pairs.select(*ids, *carry, *texts, a.alias("a"), b.alias("b"))
    sized = sized.withColumn("both", F.size(F.array_intersect("a", "b")))
    either = F.size("a") + F.size("b") - F.col("both")
    label = F.when(either > 0, F.col("both") * F.lit(5.0) / either).otherwise(F.lit(0.0))
    return compute_once(sized, "label", label).drop("a", "b", "both")


def labelled_texts(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", head: int | None = None
) -> DataFrame:
    """Labelled texts in key order; ``head`` takes the first rows of the table."""
    first = labels.select("doc_id", F.col(label).alias("label"))
    if head is not None:
        first = first.orderBy("doc_id").limit(head)
    return docs.select("doc_id", "text").join(first, "doc_id")
