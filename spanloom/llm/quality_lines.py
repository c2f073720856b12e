"""Line-first quality rules: each line is judged for punctuation, navigation and boilerplate,
failing lines go, and a document that loses too much of its text is rejected.

DataFrame operations only, one pass, no shuffle: all counts of a text are array expressions
inside its row. Work follows the text's length (sorting its repeated windows adds a logarithm).
3-word windows are compared by 64-bit hashes within one text.

Defined cases: a null or empty text has no words, fails the base rule and is not kept. Repeated
rows and ids are judged one by one; other columns are not read. Lines are cut at ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BLANKS, columns, text_or_empty
from spanloom.session import compute_once

SYMBOLS = "[#*$%&|<>]+"
# A line passes if a sentence ends in it; a navigation bar is short entries between bars; the
# boilerplate phrases are those of cookie, licence and sign-up notices.
SENTENCE_MARK = "[.!?。！？…;:]"
NAVIGATION = r"^[^|»›•·]{0,40}([|»›•·][^|»›•·]{0,40}){3,}$"
BOILERPLATE = (
    r"(?i)(\bcookie(s)? policy\b|\baccept (all )?cookies\b|\ball rights reserved\b|"
    r"\bterms of (use|service)\b|\bprivacy policy\b|\benable javascript\b|\blorem ipsum\b|"
    r"\bsign up for our newsletter\b|\bclick here to\b)"
)


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANKS, ""))


def line_fails(line: Column) -> Column:
    return (
        ~line.rlike(SENTENCE_MARK) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)
    )


def _word_columns(df: DataFrame) -> DataFrame:
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    df = compute_once(df, "words", words)
    last = F.size("words") - 3
    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    df = df.withColumn("n_words", F.size("words").cast("bigint"))
    return compute_once(df, "windows", F.when(last >= 0, hashes)).drop("words")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Count the words inside windows that occur twice or more in their text."""
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = compute_once(df, "_sorted", F.when(repeats, F.sort_array(pairs))).drop("windows")
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = compute_once(df, "_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    gaps = F.transform("_at", lambda p, i: F.coalesce(F.least(F.get("_at", i + 1) - p, F.lit(3)), F.lit(3)))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop(
        "_sorted", "_at"
    )


def clean_lines(text: Column) -> Column:
    """The text without its failing lines; blank lines stay."""
    keep = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(x))
    return F.array_join(keep, "\n")


def judge(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_pct: int = 50,
    max_lost: float = 0.5,
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the counts, the cleaned text, and the verdicts."""
    df = columns(docs, "doc_id", "text").withColumn("text", text_or_empty())
    df = _repeat_words(_word_columns(df))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = compute_once(df, "lines", lines)
    df = (
        df.withColumn("word_chars", _letters(F.col("text")).cast("bigint"))
        .withColumn(
            "n_symbols",
            (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint"),
        )
        .withColumn(
            "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")
        )
    )
    df = compute_once(df, "cleaned", clean_lines(F.col("text"))).drop("lines")
    lost = F.col("word_chars") - _letters(F.col("cleaned"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")
    )
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (lost <= max_lost * F.col("word_chars"))).alias("kept"),
        "cleaned",
    )
