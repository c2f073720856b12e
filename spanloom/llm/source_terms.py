"""How the sources of a language diverge in their terms, over the terms of enough documents.

The kept terms are found as an iceberg query by prefix refinement: level by level, the byte prefixes of the terms are
extended, and those of fewer than ``min_docs`` distinct documents are discarded; a prefix is only counted
where its shorter one is still alive, and complete terms last. A document is one row, so the documents of a prefix are
counted inside the rows and added up.

A term's counts then lie in one row with the sources that have it. Rates are whole numbers, p = 1 + floor(scale *
(count + 1) / (N + V)); a divergence of two rates is floor((p - q)^2 / q). Summed over all kept terms for two sources
it is V times that of two absent terms, plus a correction for the terms of one source (from a histogram of its counts) and a
correction for the terms of both, added up in blocks of terms. No term is paired with the sources that lack it.

Defined cases: null text, lang and source are empty; a group (lang, source) without kept terms has the rates of absent terms, and a language
without kept terms the value 0 for all pairs; repeated rows are documents of their own; ids are not
read, nor further columns. Of texts only ASCII letters are lower-cased; terms are runs of these and of code
points above ASCII. A text above ``SLICE_BYTES`` is cut into terms part by part. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import columns, stored
from spanloom.llm.pack_bins import slices

LEVELS = (2, 4, 8)  # bytes of the prefixes
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
SLICE_BYTES = 4 << 20  # of text cut at once
TERM_BYTES = 16 << 20  # of the distinct terms of rows counted together
_PAIRS = 1 << 20  # pairs of sources added up at once

_KEPT = set(range(ord("a"), ord("z") + 1)) | set(range(0x80, 0x100))
_TO_TERM = bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b in _KEPT else 0x20 for b in range(256))


def _split(data: bytes, offsets: np.ndarray) -> pa.ListArray:
    """The terms of texts that lie end to end; blanks at the edges leave empty terms."""
    clean = pa.py_buffer(data.translate(_TO_TERM))
    texts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), clean])
    return pc.ascii_split_whitespace(texts.cast(pa.string()))


def _counted(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Per list and distinct term, in the order of the lists: the list, the term, its count."""
    coded = lists.flatten().dictionary_encode()
    ends = np.asarray(lists.offsets).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    n = max(1, len(coded.dictionary))
    key, count = np.unique(row * n + np.asarray(coded.indices), return_counts=True)
    row, code = key // n, key % n
    named = np.asarray(pc.binary_length(coded.dictionary)) > 0
    row, code, count = (a[named[code]] for a in (row, code, count)) if len(key) else (row, code, count)
    return row, coded.dictionary.take(pa.array(code)), count


def _long_text(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """As ``_counted`` for one text, cut into parts between terms."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        while end < len(text) and text[end : end + 1].translate(_TO_TERM) != b" ":
            end += 1
        _, terms, count = _counted(_split(text[at:end], np.array([0, end - at])))
        found.update(dict(zip(terms.to_pylist(), count.tolist(), strict=True)))
        at = end
    return np.zeros(len(found), np.int64), pa.array(list(found), pa.string()), np.fromiter(found.values(), np.int64, len(found))


def document_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, counts) per row of docs(text, lang, source): its distinct terms with a blank between
    them, and their counts as 4-byte numbers, so that a row has two plain cells and no lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size_bytes=SLICE_BYTES):
                texts = pc.fill_null(part.column("text"), "")
                size = np.asarray(pc.binary_length(texts)).astype(np.int64)
                if size.max() > SLICE_BYTES and len(texts) == 1:
                    row, terms, count = _long_text(texts[0].as_py().encode())
                elif size.sum() > 2 * SLICE_BYTES:  # a long text behind short ones
                    for i in range(part.num_rows):
                        yield from run(iter([part.slice(i, 1)]))
                    continue
                else:
                    data = b"".join(t.encode() for t in texts.to_pylist())
                    row, terms, count = _counted(_split(data, np.append(0, np.cumsum(size))))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), terms), " ")
                packed = [None, pa.py_buffer(4 * ends), pa.py_buffer(count.astype("<u4"))]
                cells = [pc.fill_null(part.column(c), "") for c in ("lang", "source")]
                cells += [joined, pa.Array.from_buffers(pa.binary(), part.num_rows, packed)]
                yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "terms", "counts"])

    return columns(docs, "text", "lang", "source").mapInArrow(run, "lang string, source string, terms string, counts binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Slices of the rows, and per term of a slice its row and the term."""
    for batch in batches:
        for part in slices(batch, "terms", TERM_BYTES):
            lists = pc.split_pattern(part.column("terms"), " ")
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
            terms = lists.flatten()
            named = np.asarray(pc.binary_length(terms)) > 0  # a row without terms has one empty part
            yield part, row[named], terms.filter(pa.array(named)).cast(pa.binary())


def _group_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    distinct, at = np.unique(keys[order], return_index=True)
    return distinct, [np.add.reduceat(v[order], at) for v in values] if len(at) else [v[:0] for v in values]


def prefix_documents(found: DataFrame, size: int) -> DataFrame:
    """(lang, prefix, docs): per slice of rows, in how many of them a term begins with the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, terms in _unpacked(batches):
            short = pc.binary_slice(terms, 0, size).dictionary_encode()
            n = max(1, len(short.dictionary))
            key = np.unique(row * n + np.asarray(short.indices))
            lang = part.column("lang").dictionary_encode()
            key, docs = np.unique(np.asarray(lang.indices)[key // n].astype(np.int64) * n + key % n, return_counts=True)
            cells = [lang.dictionary.take(pa.array(key // n)), short.dictionary.take(pa.array(key % n)), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(cells, names=["lang", "prefix", "docs"])

    return found.select("lang", "terms").mapInArrow(run, "lang string, prefix binary, docs bigint")


def term_counts(found: DataFrame) -> DataFrame:
    """(lang, term, by): per slice of rows each term with the source, count and documents of its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, terms in _unpacked(batches):
            coded = terms.dictionary_encode()
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            n, m = max(1, len(coded.dictionary)), max(1, len(source.dictionary))
            count = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<u4").astype(np.int64)
            key = np.asarray(lang.indices)[row].astype(np.int64) * n + np.asarray(coded.indices)
            key, (total, docs) = _group_sums(key * m + np.asarray(source.indices)[row], count, np.ones(len(row), np.int64))
            term, first = np.unique(key // m, return_index=True)
            cells = [source.dictionary.take(pa.array(key % m)), pa.array(total), pa.array(docs)]
            entries = pa.StructArray.from_arrays(cells, names=["source", "count", "docs"])
            by = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), entries)
            cells = [lang.dictionary.take(pa.array(term // n)), coded.dictionary.take(pa.array(term % n)), by]
            yield pa.RecordBatch.from_arrays(cells, names=["lang", "term", "by"])

    return found.mapInArrow(run, "lang string, term binary, by array<struct<source: string, count: bigint, docs: bigint>>")


def alive_prefixes(found: DataFrame, levels: tuple[int, ...], min_docs: int) -> DataFrame:
    """(lang, prefix) of the last level whose prefixes of all levels are in enough documents."""
    alive = None
    for size in levels:
        seen = prefix_documents(found, size)
        if alive is not None:
            seen = _under(seen, "prefix", alive, last)
        counted = seen.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))
        alive = stored(counted.where(F.col("docs") >= min_docs).select("lang", "prefix"), "alive-prefixes")
        last = size
    return alive


def _under(rows: DataFrame, name: str, alive: DataFrame, size: int) -> DataFrame:
    """The rows whose prefix of ``size`` bytes is alive; the prefix is kept as ``under``."""
    rows = rows.withColumn("under", F.substring(name, 1, size))
    # The alive prefixes of a partition are few against the rows, which then need no sort.
    return rows.join(alive.withColumnRenamed("prefix", "under").hint("shuffle_hash"), ["lang", "under"], "left_semi")


def kept_terms(found: DataFrame, levels: tuple[int, ...] = LEVELS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, by): the terms of enough documents of their language, with (source, count) of each source."""
    rows = _under(term_counts(found), "term", alive_prefixes(found, levels, min_docs), levels[-1])
    # Rows lie by (lang, under) already, so both groupings keep their place.
    rows = rows.select("lang", "under", "term", F.explode("by").alias("e")).select("lang", "under", "term", "e.*")
    by_source = rows.groupBy("lang", "under", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "under", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("by")
    )
    return by_term.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "by")


def _rate(count: Column, total: Column, terms: Column, scale: int) -> Column:
    big = F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", big, (total + terms).cast("decimal(20,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): over the terms of both sources, by how much their divergences exceed what
    the terms of one source alone account for. rows(lang, by: source, p, absent)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("by")
            if not len(lists.flatten()):
                continue
            source, p, absent = lists.flatten().flatten()
            source = source.dictionary_encode()
            lang = batch.column("lang").dictionary_encode()
            who, langs, m = np.asarray(source.indices).astype(np.int64), np.asarray(lang.indices).astype(np.int64), len(source.dictionary)
            p, absent = np.asarray(p), np.asarray(absent)
            size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            # Entry i meets all entries of its row.
            upto = np.cumsum(size[row])
            begin = 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _PAIRS, side="right")))
                each = size[row[begin:end]]
                i = np.repeat(np.arange(begin, end), each)
                j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + first[row[i]]
                i, j = i[i != j], j[i != j]
                value = f(p[i], p[j]) - f(p[i], absent[j]) - f(absent[i], p[j]) + f(absent[i], absent[j])
                key, (value,) = _group_sums((langs[row[i]] * m + who[i]) * m + who[j], value)
                cells = [lang.dictionary.take(pa.array(key // m // m)), source.dictionary.take(pa.array(key // m % m))]
                cells += [source.dictionary.take(pa.array(key % m)), pa.array(value)]
                yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "item", "value"])
                begin = end

    return rows.select("lang", "by").mapInArrow(run, "lang string, source string, item string, value bigint")


def divergences(
    docs: DataFrame,
    levels: tuple[int, ...] = LEVELS,
    min_docs: int = MIN_DOCS,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source).

    Part ``pair``: of each group (lang, source) against each other source of the language, over all kept terms. Part
    ``term``: the kept terms more frequent in the group than in its language, the ``top`` of them.
    """
    found = stored(document_terms(docs), "document-terms")
    kept = stored(kept_terms(found, levels, min_docs), "kept-terms")
    entries = kept.select("lang", "term", "total", F.explode("by").alias("e")).select("lang", "term", "total", "e.*")

    n_terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    sums = entries.groupBy("lang", "source").agg(F.sum("count").alias("group_total"))
    groups = found.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(n_terms, "lang", "left")
    groups = groups.na.fill(0, ["group_total", "terms", "lang_total"])
    none = F.lit(0).cast("bigint")
    p = _rate(none, F.col("group_total"), F.greatest("terms", F.lit(1)), scale)
    groups = stored(groups.withColumn("absent", p), "groups")

    rated = entries.join(groups, ["lang", "source"])
    rated = rated.withColumn("p", _rate(F.col("count"), F.col("group_total"), F.col("terms"), scale))
    rated = rated.withColumn("q", _rate(F.col("total"), F.col("lang_total"), F.col("terms"), scale))
    rated = stored(rated.select("lang", "source", "term", "p", "q", "absent"), "rates")

    # Terms of one source: as many corrections as its counts differ.
    counts = rated.groupBy("lang", "source", "p", "absent").agg(F.count(F.lit(1)).alias("n"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"), "terms")
    met = counts.join(others, "lang").where(F.col("source") != F.col("item"))
    own = F.col("n") * (_divergence(F.col("p"), F.col("other")) - _divergence(F.col("absent"), F.col("other")))
    back = F.col("n") * (_divergence(F.col("other"), F.col("p")) - _divergence(F.col("other"), F.col("absent")))
    forth = met.groupBy("lang", "source", "item").agg(F.sum(own).alias("value"))
    turned = met.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(back).alias("value"))

    base = groups.join(others.drop("terms"), "lang").where(F.col("source") != F.col("item"))
    base = base.select("lang", "source", "item", (F.col("terms") * _divergence(F.col("absent"), F.col("other"))).alias("value"))
    by = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("by"))
    pair = base.unionByName(forth).unionByName(turned).unionByName(_both(by))
    pair = pair.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank"
    )
    above = rated.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value")
    )
    return ranked(pair, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top))
