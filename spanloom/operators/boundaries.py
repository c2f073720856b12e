"""Sentence ends learned from a corpus: which periods belong to an abbreviation, after Kiss and Strunk (2006).

Three tables of counts decide, all by log-likelihood ratios over the whole corpus and without labels: abbreviations (words that hardly
occur without their period, short, perhaps with periods inside), starters (words met after a sentence's period far more
often than elsewhere), and collocations (an abbreviation and the word that keeps following it). A period of an
abbreviation ends no sentence, unless a starter follows that is no collocation of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import lookup_join
from spanloom.session import cut_lineage

# A word, with the periods and apostrophes inside it and the period behind it; the published limits of the three ratios.
# Runs of letters are taken whole: no match ends inside one, so giving letters back is in vain.
WORD = r"\p{L}++(?:\.\p{L}++)*(?:'\p{L}++)*\.?"
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
_ALMOST = 1e-12


def _likelihood(hits: Column, tries: Column, chance: Column) -> Column:
    p = F.least(F.greatest(chance, F.lit(_ALMOST)), F.lit(1 - _ALMOST))
    return hits * F.ln(p) + (tries - hits) * F.ln(1.0 - p)


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Twice the gain of two chances over one."""
    one = F.try_divide(k1 + k2, n1 + n2)
    apart = _likelihood(k1, n1, F.try_divide(k1, n1)) + _likelihood(k2, n2, F.try_divide(k2, n2))
    return 2.0 * (apart - _likelihood(k1, n1, one) - _likelihood(k2, n2, one))


def _bare(word: Column) -> Column:
    """Without its last period; a word ends in one at most."""
    return F.rtrim(word, F.lit("."))


def _followers(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, dotted, next, n): words in lower case without the last period, those with one apart by the word behind them.

    Next is null at the end of a text and behind a word without a period, where no table asks for it: so a task sends
    its words and the few neighbours over a period, not all neighbours.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = texts.select(words.alias("w"))
    behind = F.slice("w", F.lit(2), F.size("w"))
    near = rows.select(F.explode(F.arrays_zip(F.col("w").alias("word"), behind.alias("next"))).alias("e"))
    dotted = F.endswith(F.col("e.word"), F.lit("."))
    near = near.select(_bare(F.col("e.word")).alias("word"), dotted.alias("dotted"), F.when(dotted, _bare(F.col("e.next"))).alias("next"))
    return near.groupBy("word", "dotted", "next").agg(F.count(F.lit(1)).alias("n"))


class Boundaries:
    """The learned tables: ``abbreviations``(word), ``starters``(word) and ``collocations``(word, next)."""

    def __init__(self, texts: DataFrame, text_col: str = "text", threshold: float = ABBREVIATION) -> None:
        pairs = cut_lineage(_followers(texts, text_col))
        dots = F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0))
        words = cut_lineage(pairs.groupBy("word").agg(dots.alias("dots"), F.sum("n").alias("n")))
        total = words.agg(F.sum("dots").alias("dots"), F.sum("n").alias("n")).first()
        n, n_dots = F.lit(float(total["n"] or 0)), F.lit(float(total["dots"] or 0))

        size = F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
        seen = _likelihood(F.col("dots"), F.col("n"), F.try_divide(n_dots, n))
        own = _likelihood(F.col("dots"), F.col("n"), F.lit(0.99))
        score = 2.0 * (own - seen) * F.exp(-size) * (F.length("word") - size + 1) * F.pow(size, -(F.col("n") - F.col("dots")))
        self.abbreviations = cut_lineage(words.where((F.col("dots") > 0) & (score >= threshold)).select("word"))

        ends = pairs.where("dotted and next is not null").join(self.abbreviations, "word", "left_anti")
        first = ends.groupBy(F.col("next").alias("word")).agg(F.sum("n").alias("k"))
        behind = F.lit(float(ends.agg(F.sum("n")).first()[0] or 0))
        k, rest = F.col("k"), F.col("n") - F.col("k")
        often = (F.try_divide(k, behind) > F.try_divide(rest, n - behind)) & (_ratio(k, behind, rest, n - behind) >= STARTER)
        self.starters = cut_lineage(first.join(words, "word").where(often).select("word"))

        met = pairs.where("dotted and next is not null").join(self.abbreviations, "word")
        met = met.select("word", "next", F.col("n").alias("k")).join(words.select("word", "dots"), "word")
        met = met.join(words.select(F.col("word").alias("next"), "n"), "next")
        often = (F.try_divide(k, F.col("dots")) > F.try_divide(rest, n - F.col("dots"))) & (
            _ratio(k, F.col("dots"), rest, n - F.col("dots")) >= COLLOCATION
        )
        self.collocations = cut_lineage(met.where(often).select("word", "next"))

    def joined(self, sentences: DataFrame, key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
        """Spans (key, order, start_idx, end_idx) of the sentences when those cut behind an abbreviation are joined again.

        sentences(key, order, text, start_idx, end_idx). A cut inside a word, such as after its first period, goes as well.
        Only spans and the words at the borders are shuffled.
        """
        text = F.lower("text")
        in_doc = Window.partitionBy(key).orderBy(order)
        rows = sentences.select(
            key, order, "start_idx", "end_idx",
            F.regexp_extract(text, f"(?<!\\p{{L}})({WORD})[^\\p{{L}}]*$", 1).alias("tail"),
            F.regexp_extract(text, WORD, 0).alias("head"),
            F.left(text, F.lit(1)).rlike(r"^\p{L}").alias("opens"),
            F.right(text, F.lit(4)).rlike(r"\p{L}\.$").alias("stops"),  # $ also stands before a last line break
            text.rlike(f"^{WORD}$").alias("whole"),
        )
        before = lambda c: F.lag(c).over(in_doc)
        inside = F.col("opens") & before("stops") & (before("end_idx") == F.col("start_idx"))
        rows = rows.withColumn("_run", F.sum(F.when(inside, 0).otherwise(1)).over(in_doc))
        # The last word of a run goes back over the parts that are nothing but a piece of it.
        parts = F.array_sort(F.collect_list(F.struct(order, "tail", "whole", "head")))
        rows = rows.groupBy(key, "_run").agg(
            parts.alias("parts"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")
        )
        last = F.aggregate(
            "parts", F.lit(""), lambda word, p: F.when(p["whole"], F.concat(word, p["tail"])).otherwise(p["tail"])
        )
        rows = rows.select(
            key, F.col("_run").alias(order), "start_idx", "end_idx",
            F.when(F.endswith(last, F.lit(".")), _bare(last)).alias("last"),
            _bare(F.col("parts")[0]["head"]).alias("next"),
        )
        rows = rows.withColumn("word", before("last")).drop("last")
        # Many rows have no word and some words are frequent; tables of checked size are looked up where the rows are.
        rows = rows.withColumn("_both", F.concat("word", F.lit(" "), "next"))
        both = self.collocations.select(F.concat("word", F.lit(" "), "next").alias("_both"))
        for table, on, name in (
            (self.abbreviations, "word", "abbreviation"),
            (self.starters.withColumnRenamed("word", "next"), "next", "starter"),
            (both, "_both", "collocation"),
        ):
            rows = lookup_join(rows, table.withColumn(f"_{name}", F.lit(True)), on, key, order, how="left")
        glued = F.col("_abbreviation").isNotNull() & (F.col("_starter").isNull() | F.col("_collocation").isNotNull())
        number = F.sum(F.when(glued, 0).otherwise(1)).over(in_doc) - 1
        return rows.withColumn("_sentence", number).groupBy(key, F.col("_sentence").alias(order)).agg(
            F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")
        )
