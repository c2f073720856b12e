"""Repeated long strings, found in suffix order.

Suffixes are compared up to ``length`` bytes and equal ones are kept in order of place. Then the
previous smaller position in suffix order of a repeated suffix is its left neighbour, its
longest-previous-factor value is the full length, and the neighbour is the earlier match. Marking
both ends of every such match marks each ``length``-byte string that also starts elsewhere; bytes under a
marked string go, the first copy too.

One suffix array over a corpus has no place on any machine, so suffixes meet by content. Every
string of ``length`` bytes has an anchor: the place of the least hash inside it, which equal strings share,
with the ``gram`` bytes from there. Anchors are counted by the hash of their gram; single ones cannot be
part of a repeat. An anchor's context is all bytes of the strings that have it as their anchor. Equal contexts
(by 128 bits of hash: gram and context) are repeats throughout and need no bytes; of contexts that
differ, one of each kind is sent to a shard, where the suffixes of all contexts are sorted together. A gram
with more than ``HOT`` kinds of contexts would swamp a shard: its strings are dealt out one by one, by a 128-bit
hash, and matched by that. Both ways are exact up to hash collisions.

Defined cases: a null or empty text has no bytes and keeps the hash of nothing; texts shorter than ``length``
lose nothing; repeated rows are other places of the same strings, so they lose them. Ids may repeat or be null:
rows are told apart by id and content. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import columns, stored
from spanloom.llm.pack_bins import slices

LENGTH = 400
GRAM = 128
HOT = 1500  # kinds of contexts of one gram that a shard takes
SHARD_BYTES = 2 << 20
SEGMENT = 1 << 20  # windows looked at together
SIEVE_BITS = 1 << 24
_PLACE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as one number."""
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()


def _least_places(order: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values its least one (runs begin at every place)."""
    n = len(order)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = order
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_places(
    data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes inside the texts that make up ``data``: their
    places, and the first and last start of the strings that have each as their anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    valid = _starts_inside(n, starts, sizes, length)
    width = length - gram + 1
    found = []
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for begin in range(0, n, SEGMENT):
        end = min(n, begin + SEGMENT)
        places = end - begin + width - 1
        part = data[begin : begin + places + 16]
        first = _words_at(part, places)
        order = (first ^ (_words_at(part[8:], places) * np.uint64(0xC2B2AE3D27D4EB4F))) * _MIX
        order ^= order >> np.uint64(32)
        order = (order * _MIX & ~low) | np.arange(places, dtype=np.uint64)
        at = np.flatnonzero(valid[begin:end])
        least = (_least_places(order, width) & low).astype(np.int64)[at]
        if len(at):
            # The strings of one anchor start next to each other.
            cut = np.flatnonzero(np.diff(least, prepend=-1))
            last = at[np.append(cut[1:], len(at)) - 1]
            found.append(np.stack([least[cut], at[cut], last]) + begin)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, first, last = np.concatenate(found, axis=1)
    at, cut = np.unique(at, return_index=True)  # one that spans two segments comes twice
    return at, np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)


def _starts_inside(n: int, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether a string of ``length`` from each of n places stays inside its part."""
    long = sizes >= length
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + sizes[long] - length + 1, -1)
    return np.cumsum(edge[:n]) > 0


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: row (a number that leaves room for the places of its bytes), doc_id,
    sha, n_bytes, and its anchors: place, begin and size of the context, hash of the gram, hash of the
    context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 43
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                data = b"".join(texts)
                at, lo, last = anchor_places(np.frombuffer(data, np.uint8), starts, sizes, length, gram)
                doc = np.searchsorted(starts, at, side="right") - 1
                hi = last + length
                hash64 = xxhash.xxh3_64_intdigest
                grams = [hash64(data[a : a + gram]) for a in at.tolist()]
                contexts = [
                    hash64(data[a:b], seed=s)
                    for a, b, s in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)
                ]
                offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(v))
                    for v in (
                        (at - starts[doc]).astype(np.int32),
                        (lo - starts[doc]).astype(np.int32),
                        (hi - lo).astype(np.int32),
                        np.array(grams, dtype=np.uint64).view(np.int64),
                        np.array(contexts, dtype=np.uint64).view(np.int64),
                    )
                ]
                rows = row + starts + np.arange(len(texts))
                shas = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column("doc_id"), shas, pa.array(sizes), *lists],
                    names=["row", "doc_id", "sha", "n_bytes", "place", "begin", "size", "gram", "context"],
                )
                row += len(data) + len(texts)

    return columns(docs, "doc_id", "text").mapInArrow(
        run,
        "row bigint, doc_id bigint, sha string, n_bytes bigint, place array<int>, begin array<int>, "
        "size array<int>, gram array<bigint>, context array<bigint>",
    )


def _string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place, by doubling."""
    value = _words_at(data, len(data) - 7)
    have = 8
    while have < length:
        step = min(have, length - have)
        m = len(value) - step
        value = (value[:m] ^ (value[:m] >> np.uint64(29))) * _MIX + value[step:] * np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(32)
        have += step
    return value


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place by prefix doubling; equal bytes, equal rank.

    Places nearer than ``length`` to the end get the rank -1."""
    n = len(data) - length + 1
    out = np.full(len(data), -1, dtype=np.int64)
    if n <= 0 or length < 8:
        return out
    _, rank = np.unique(_words_at(data, len(data) - 7), return_inverse=True)
    have = 8
    while have < length:
        step = min(have, length - have)
        m = len(rank) - step
        _, rank = np.unique(rank[:m] * (int(rank.max()) + 1) + rank[step : step + m], return_inverse=True)
        have += step
    out[:n] = rank[:n]
    return out


def repeated_places(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Whether the string from each valid place starts at another valid place too.

    Places whose string has a hash of its own are out; the bytes under the others are sorted. In
    suffix order, equal strings by place, the previous smaller position of a repeated suffix is its
    neighbour and its previous factor has the full length; both are marked."""
    marked = np.zeros(len(data), dtype=bool)
    at = np.flatnonzero(valid[: max(0, len(data) - length + 1)])
    if len(at) < 2:
        return marked
    value = _string_hashes(data, length)[at]
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    if not len(at):
        return marked
    # Only the bytes under candidates are left, end to end; a candidate's string stays whole.
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    under = np.cumsum(edge[:-1]) > 0
    rank = suffix_ranks(data[under], length)
    spot = (np.cumsum(under) - 1)[at]
    order = np.argsort(rank[spot], kind="stable")
    ranked = rank[spot][order]
    match = ranked[1:] == ranked[:-1]
    marked[at[order[1:][match]]] = True
    marked[at[order[:-1][match]]] = True
    return marked


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the strings of ``length`` from rising starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.append(0, cut + 1)]
    last = starts[np.append(cut, len(starts) - 1)] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _spans(rows: list[tuple[int, int, int]]) -> pa.Table:
    fields = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table([pa.array(f, pa.int64()) for f in fields], names=["row", "start", "end"])


def _sorted_contexts(group: pa.Table, length: int) -> pa.Table:
    """Repeated strings among the contexts of one shard."""
    parts = [x.as_py() for x in group["bytes"]]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    rows, begins = np.asarray(group["row"]), np.asarray(group["start"])
    # A context that arrived twice (equal rows) counts once.
    _, first = np.unique(rows + begins, return_index=True)
    sole = np.zeros(len(parts), dtype=bool)
    sole[first] = True
    valid = _starts_inside(len(data), starts[sole], sizes[sole], length)
    owner = np.repeat(np.arange(len(parts)), sizes)
    hit = np.flatnonzero(repeated_places(data, valid, length))
    out = []
    for part in np.split(hit, np.flatnonzero(np.diff(owner[hit])) + 1) if len(hit) else []:
        k = owner[part[0]]
        out += [(int(rows[k]), a, b) for a, b in _runs(part - starts[k] + begins[k], length)]
    return _spans(out)


def _context_rows(batches: Iterator[pa.RecordBatch], n_shards: int):
    for batch in batches:
        out: list[tuple] = []
        for row, text, spots in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spots")), strict=True):
            data = (text or "").encode()
            for s in spots:
                if s["ship"] and not s["hot"]:
                    start = s["begin"]
                    out.append((s["gram"] % n_shards, row, start, data[start : start + s["size"]]))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        fields = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(f, k) for f, k in zip(fields, kinds, strict=True)], names=["shard", "row", "start", "bytes"]
        )


def _string_rows(batches: Iterator[pa.RecordBatch], n_shards: int, length: int):
    """The strings around hot grams, each by its hash: a row per shard and part of a batch."""
    for batch in batches:
        hashes: list[bytes] = []
        owners: list[int] = []
        places: list[int] = []
        for row, text, spots in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spots")), strict=True):
            hot = [(s["begin"], s["size"]) for s in spots if s["ship"] and s["hot"]]
            if hot:
                data = (text or "").encode()
                for s in (s for begin, size in hot for s in range(begin, begin + size - length + 1)):
                    hashes.append(xxhash.xxh3_128_digest(data[s : s + length]))
                    owners.append(row)
                    places.append(s)
        table = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        shard = table[:, 0] % np.uint64(n_shards)
        order = np.argsort(shard, kind="stable")
        used, first = np.unique(shard[order], return_index=True)
        at = np.array([owners, places], dtype=np.int64).T
        parts = np.split(order, first[1:])[: len(used)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array([table[p].tobytes() for p in parts], pa.binary()),
                pa.array([at[p].tobytes() for p in parts], pa.binary()),
            ],
            names=["shard", "hashes", "places"],
        )


def _equal_strings(group: pa.Table) -> pa.Table:
    """Per row the places of its strings that another place of the shard has too."""
    table = np.concatenate([np.frombuffer(x.as_py(), "<u8").reshape(-1, 2) for x in group["hashes"]])
    at = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in group["places"]])
    _, first = np.unique(at.sum(axis=1), return_index=True)  # rows leave room for their places
    table, at = table[first], at[first]
    order = np.lexsort((table[:, 1], table[:, 0]))
    same = (table[order[1:]] == table[order[:-1]]).all(axis=1)
    hit = np.zeros(len(at), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = at[hit]
    rows, first = np.unique(at[:, 0], return_index=True)
    offsets = pa.array(np.append(first, len(at)).astype(np.int32))
    return pa.table({
        "row": pa.array(rows),
        "places": pa.ListArray.from_arrays(offsets, pa.array(at[:, 1].astype(np.int32))),
    })


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        names = ("doc_id", "sha", "text", "spots", "spans", "strings")
        for doc_id, sha, text, spots, spans, strings in zip(
            *(batch.column(c).to_pylist() for c in names), strict=True
        ):
            data = (text or "").encode()
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            for s in spots:
                if s["full"]:
                    edge[s["begin"]] += 1
                    edge[s["begin"] + s["size"]] -= 1
            for s in spans or ():
                edge[s["start"]] += 1
                edge[s["end"]] -= 1
            for s in strings or ():
                edge[s] += 1
                edge[s + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            digest = hashlib.sha256(kept).hexdigest()
            out.append((doc_id, sha, int(gone.sum()), n_spans, digest, kept if with_bytes else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        fields = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(f, k) for f, k in zip(fields, kinds, strict=True)],
            names=["doc_id", "sha", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _maybe_listed(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Drop rows that are surely not in the lists before their texts are shuffled.

    The keys of the lists set bits of a map of SIEVE_BITS bits: at most SIEVE_BITS / 64 rows, whatever
    the input, so it may be broadcast. With more keys than bits it lets all through.
    """
    bit = F.xxhash64("doc_id", "sha").bitwiseAND(F.lit(SIEVE_BITS - 1))
    word, flag = F.shiftright("_bit", 6), F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = lists.select(bit.alias("_bit")).select(word.alias("_word"), flag.alias("_flag"))
    words = words.groupBy("_word").agg(F.bit_or("_flag").alias("_flags"))
    keyed = docs.withColumn("_bit", bit).withColumn("_word", word)
    return keyed.join(F.broadcast(words), "_word").where(F.col("_flags").bitwiseAND(flag) != 0).select(*docs.columns)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_bytes: bool = True
) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    ``kept`` (the remaining bytes; null where nothing was removed) if ``with_bytes``."""
    if not 16 <= gram < length:
        raise ValueError("a gram has 16 bytes or more and is shorter than the strings")
    docs = columns(docs, "doc_id", "text")
    rows = stored(anchors(docs, length, gram), "anchors")
    spots = rows.select("row", F.explode(F.arrays_zip("place", "begin", "size", "gram", "context")).alias("a"))
    spots = spots.select("row", "a.*")
    spot = F.col("row") + F.col("place")
    kinds = spots.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("first"))
    grams = kinds.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"))
    # Written, so that the join has a plain shuffle on both sides, which Spark splits at a hot gram.
    grams = stored(grams.where("total > 1"), "repeated-grams")
    kinds = kinds.join(grams, "gram")
    useful = spots.join(kinds, ["gram", "context"]).select(
        "row", "begin", "size", "gram",
        (F.col("n") > 1).alias("full"),
        ((F.col("m") > 1) & (spot == F.col("first"))).alias("ship"),
        (F.col("m") > hot).alias("hot"),
    )
    # A list per row is bounded by the row's own text.
    lists = useful.where("full or ship").groupBy("row").agg(
        F.collect_list(F.struct("begin", "size", "gram", "full", "ship", "hot")).alias("spots")
    )
    # Rows with equal id and content have equal results: the first stands for all of them.
    one = rows.groupBy("doc_id", "sha").agg(F.min("row").alias("row"))
    lists = stored(lists.join(one, "row"), "repeat-lists")
    with_sha = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = _maybe_listed(with_sha, lists).alias("d").join(
        lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.sha") == F.col("l.sha"))
    ).select("l.row", "d.doc_id", "d.sha", "d.text", "l.spots")
    found = stored(found, "repeat-candidates")
    shipped = lambda hot_ones: F.size(F.filter("spots", lambda s: s["ship"] & (s["hot"] == hot_ones)))
    sums = found.agg(F.sum(shipped(False)).alias("cold"), F.sum(shipped(True)).alias("hot")).first()
    cold = max(1, math.ceil((sums["cold"] or 0) * (2 * length - gram) / SHARD_BYTES))
    strings = max(1, math.ceil((sums["hot"] or 0) * (length - gram + 1) * 24 / (8 * SHARD_BYTES)))
    sent = found.select("row", "text", "spots")
    spans = (
        sent.mapInArrow(lambda it: _context_rows(it, cold), "shard int, row bigint, start bigint, bytes binary")
        .groupBy("shard").applyInArrow(lambda g: _sorted_contexts(g, length), "row bigint, start bigint, end bigint")
        .groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    runs = (
        sent.mapInArrow(lambda it: _string_rows(it, strings, length), "shard int, hashes binary, places binary")
        .groupBy("shard").applyInArrow(_equal_strings, "row bigint, places array<int>")
        .groupBy("row").agg(F.flatten(F.collect_list("places")).alias("strings"))
    )
    cut = (
        found.join(spans, "row", "left").join(runs, "row", "left")
        .mapInArrow(
            lambda it: _cut(it, length, with_bytes),
            "doc_id bigint, sha string, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
        )
        .dropDuplicates(["doc_id", "sha"])
    )
    r, c = rows.select("doc_id", "sha", "n_bytes").alias("r"), cut.alias("c")
    out = r.join(c, F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.sha") == F.col("c.sha")), "left")
    zero = F.lit(0).cast("bigint")
    more = ["c.kept"] if with_bytes else []
    return out.select(
        "r.doc_id", "r.n_bytes",
        F.coalesce("c.n_removed", zero).alias("n_removed"),
        F.coalesce("c.n_spans", zero).alias("n_spans"),
        F.coalesce("c.kept_sha256", "r.sha").alias("kept_sha256"),
        *more,
    )
