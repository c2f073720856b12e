"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result
is written to the shared folder as Parquet and read again as the next one's docs. All stages but
the last return the columns of ``documents``.

Defined cases: each stage takes empty tables, null and empty texts and further columns as its operator
says. Rows of equal or null ids are documents of their own where near-duplicates are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, pack_bins, secret_ledger, simhash_trie, toxicity_cnn
from spanloom.llm.common import stored, table

# Of the SimHash stage: words of a shingle, and the most differing bits of linked fingerprints.
NEAR_WORDS = 3
NEAR_BITS = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    return toxicity_cnn.keep_mask(docs, toxicity_cnn.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash_trie.one_of_each(docs, NEAR_WORDS, NEAR_BITS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secret_ledger.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their sequence and place."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_bins.pack(pack_bins.token_pieces(docs, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# A trained classifier and a tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
