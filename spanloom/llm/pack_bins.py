"""Best-fit packing of token pieces into sequences of fixed capacity.

Method: a piece above a third of the capacity shares its sequence with at most one other of
that kind, found by greedy matching (the longest with the longest that still fits); smaller pieces
then go, longest first, to the sequence with the smallest gap that takes them.

Lengths are whole numbers up to the capacity, so the whole decision needs only the count of pieces
per length: at most ``capacity`` numbers reach the driver, at any corpus size. The plan says which
ranks of which length go where; each piece finds its place by its rank among the pieces of its
length. A rank is the count of that length in earlier scan tasks plus a running number inside the
task, so no task ever holds all pieces of one length.

Tokens: ``tokenizers`` ids. Text is cut at blanks between two non-blanks, where the byte-level rule always starts a
new word, and each distinct chunk is encoded once per worker; a doubled blank stays inside its chunk.

Defined cases: a null or empty text has only the end id. Repeated rows and ids are packed as
pieces of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import columns, stored

CAPACITY = 2048
END_ID = 0
SLICE_BYTES = 4 << 20
ENCODE_BYTES = 8 << 20  # of text encoded together
MAX_CHUNKS = 600_000  # distinct chunks a worker remembers; then it keeps those in use
_JOINED = 4096  # chunks encoded as one text
_DOUBLED = r"[ ][\s\v\x1c-\x1f\x85\p{Z}]|[\s\v\x1c-\x1f\x85\p{Z}][ ]"  # a blank next to a blank of any kind
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ONE_BLANK = r"^ [^ ]+$"
# The marker that the vocabulary knows, and how it writes the byte of a blank.
END_TEXT = "<|endoftext|>"
_BLANK_BYTE = "\u0120"
PIECE_SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, cell int, spot bigint"
)


def _spots(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... of each run, end to end."""
    upto = np.cumsum(size, dtype=np.int32)
    n = int(upto[-1]) if len(upto) else 0
    return np.arange(n, dtype=np.int32) + np.repeat(at - (upto - size), size)


class Encoder:
    """Ids of texts, as flat arrays. Entry 0 is the end id; entry i + 1 is chunk i of ``names``, its ids lie in one pool."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin with a blank
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_BLANK_BYTE)]] = True
        self.names = pa.array([], pa.string())
        self.pool = np.array([END_ID], dtype=np.uint32)
        self.at, self.size = np.zeros(1, np.int32), np.ones(1, np.int32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _keep(self, entries: np.ndarray) -> None:
        """Forget all chunks but these."""
        size = self.size[entries]
        spots = _spots(self.at[entries], size)
        self.names = self.names.take(pa.array(entries - 1))
        self.pool = np.append(self.pool[:1], self.pool[spots])
        self.at = np.append(self.at[:1], 1 + np.cumsum(size, dtype=np.int32) - size)
        self.size = np.append(self.size[:1], size)

    def _ids_of_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _ids_of_joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with one blank each, at the front: end to end they are encoded at once, and the ids that begin
        with a blank show where each begins."""
        joined = ["".join(chunks[i : i + _JOINED]) for i in range(0, len(chunks), _JOINED)]
        flat, _ = self._ids_of_each(joined)
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(chunks):
            return self._ids_of_each(chunks)
        return flat, np.diff(first, append=len(flat)).astype(np.int32)

    def _learn(self, chunks: pa.Array) -> None:
        """Encode chunks (all different) that were not met before."""
        single = np.asarray(pc.match_substring_regex(chunks, _ONE_BLANK)) & ~np.asarray(pc.match_substring(chunks, END_TEXT))
        for part, encode in ((single, self._ids_of_joined), (~single, self._ids_of_each)):
            if part.any():
                names = chunks.filter(pa.array(part))
                flat, size = encode(names.to_pylist())
                self.names = pa.concat_arrays([self.names, names])
                self.at = np.append(self.at, len(self.pool) + np.cumsum(size, dtype=np.int32) - size)
                self.size = np.append(self.size, size)
                self.pool = np.append(self.pool, flat)

    def _entries(self, chunks: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(chunks, value_set=self.names), -1)) + 1

    def encode(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts cut into chunks (lists of one or more): all ids with the end id after each text, and the number
        of ids per text. The blank at the front of all chunks but the first of a text is left out."""
        flat = lists.flatten().dictionary_encode()
        starts = np.asarray(lists.offsets)[:-1].astype(np.int64) - int(lists.offsets[0].as_py())
        codes = np.asarray(flat.indices)
        used, spot = np.unique(codes[starts], return_inverse=True)
        later = pc.binary_join_element_wise(pa.scalar(" "), flat.dictionary, "")
        chunks = pa.concat_arrays([later, flat.dictionary.take(pa.array(used))])
        found = self._entries(chunks)
        new = chunks.filter(pa.array(found == 0)).unique()
        if len(new):
            if len(self.names) + len(new) > MAX_CHUNKS:
                self._keep(np.unique(found[found > 0]))
            self._learn(new)
            found = self._entries(chunks)
        entries = found[codes]
        entries[starts] = found[len(later) :][spot]
        ends = np.append(starts[1:], len(entries))
        entries = np.insert(entries, ends, 0)
        size = self.size[entries]
        ids = self.pool[_spots(self.at[entries], size)]
        upto = np.cumsum(size, dtype=np.int64)
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


def chunk_lists(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """Texts cut at each blank between two non-blanks: which texts, and their chunks."""
    odd = np.asarray(pc.match_substring_regex(texts, _DOUBLED))
    if not odd.all():
        yield np.flatnonzero(~odd), pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    if odd.any():
        cut = [_BETWEEN.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        yield np.flatnonzero(odd), pa.array(cut, pa.list_(pa.string()))


def slices(
    batch: pa.RecordBatch, column: str = "text", size_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size_bytes`` of text, at least one row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // size_bytes, prepend=0, append=-1))
    begin = 0
    for end in np.unique(np.append(cut, batch.num_rows)):
        if end > begin:
            yield batch.slice(begin, end - begin)
            begin = int(end)


def _pieces_of(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, capacity: int) -> Iterator[tuple]:
    at = 0
    for doc_id, n in zip(doc_ids, sizes.tolist(), strict=True):
        first = n % capacity or min(n, capacity)
        start = 0
        for piece in range(-(-n // capacity)):
            length = first if piece == 0 else capacity
            crc = zlib.crc32(ids[at + start : at + start + length].astype("<u4").tobytes())
            yield doc_id, piece, start, length, crc
            start += length
        at += n


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; ``cell`` is the scan task and ``spot`` the running number of the
    piece among those of its length in the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        cell = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, size_bytes=ENCODE_BYTES):
                texts = pc.fill_null(part.column("text"), "")
                doc_ids = np.array(part.column("doc_id").to_pylist(), dtype=object)
                rows: list[tuple] = []
                for which, lists in chunk_lists(texts):
                    ids, sizes = encoder.encode(lists)
                    rows.extend(_pieces_of(doc_ids[which], ids, sizes, capacity))
                spots = []
                for row in rows:
                    spots.append(seen.get(row[3], 0))
                    seen[row[3]] = spots[-1] + 1
                fields = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(f, k) for f, k in zip(fields, kinds, strict=True)]
                arrays += [pa.array([cell] * len(rows), pa.int32()), pa.array(spots, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "cell", "spot"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return columns(docs, "doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, how many, first sequence, offset): rank r of a length goes
    to sequence first + (r - first rank)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    n_bins = 0

    def put(length: int, n: int, first_bin: int, offset: int) -> None:
        placed.append((length, int(used[length]), n, first_bin, offset))
        used[length] += n
        left[length] -= n

    def open_gap(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first_bin, n))

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            partners = np.flatnonzero(left[third + 1 : min(a, capacity - a) + 1]) + third + 1
            if len(partners) and partners[-1] == a and left[a] == 1:
                partners = partners[:-1]
            b = int(partners[-1]) if len(partners) else 0
            n = int(left[a]) if not b else int(left[a]) // 2 if b == a else int(min(left[a], left[b]))
            put(a, n, n_bins, 0)
            if b:
                put(b, n, n_bins, a)
            open_gap(capacity - a - b, n_bins, n)
            n_bins += n
    for s in range(third, 0, -1):
        while left[s]:
            fits = [g for g in gaps if g >= s]
            if fits:
                gap = min(fits)
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                gap, first, n = capacity, n_bins, -(-int(left[s]) // (capacity // s))
                n_bins += n
            each = gap // s
            full = min(n, int(left[s]) // each)
            for k in range(each if full else 0):
                put(s, full, first, capacity - gap + k * s)
            open_gap(gap - each * s, first, full)
            first, n = first + full, n - full
            rest = min(int(left[s]), each - 1) if n else 0
            if rest:
                for k in range(rest):
                    put(s, 1, first, capacity - gap + k * s)
                open_gap(gap - rest * s, first, 1)
                first, n = first + 1, n - 1
            open_gap(gap, first, n)
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of ``token_pieces``."""
    pieces = stored(pieces, "pieces")
    counts = pieces.groupBy("cell", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(plan_bins(totals, capacity), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    ranked = pieces.join(base, ["cell", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("spot")).alias("rank")
    )
    starts = plan[:, 0] << 44 | plan[:, 1]  # one sorted key per (length, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank")).astype(np.int64)
            key = np.asarray(batch.column("length")).astype(np.int64) << 44 | rank
            row = plan[np.searchsorted(starts, key, side="right") - 1]
            arrays = batch.columns[:5] + [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            names = [*batch.schema.names[:5], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ranked.mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint",
    )
