"""Benchmark decontamination by q-gram lemma filtering.

A passage within k edits of a benchmark item of length L keeps at least L - q + 1 - k*q of its
q-grams, all on diagonals (place in the text minus place in the item) that lie within k of each
other. So shared q-grams are counted in diagonal bands of width 2k that overlap by half; bands
that reach the bound are verified by banded alignment, everything else is out for sure.

Documents are scanned once, in whole texts, without a shuffle. Items are a stated query set: they
are taken in blocks of at most ``BLOCK_BYTES`` bytes, so what a task receives is bounded, and each block
scans the documents. Only ids and places of matches leave a task.

Texts are compared in a plain form: A-Z lower-cased, runs of other ASCII than letters and digits as
one blank, everything else as it is. Items of fewer than ``SHORT`` plain bytes have no edits to give and too few
q-grams to filter by: they match where their words stand as they are, by a hash of the bytes between two word borders
and a comparison. A text longer than ``WINDOW`` is searched in parts that overlap by the longest item and its edits,
and the places that share q-grams with items are laid out for ``PIECE`` of them at a time.

Defined cases: a null text or item, and one without letters or digits, matches nothing; an item of one word matches
each document with that word, so what such an item is worth is for its table to say; repeated rows get their matches
each; two items with equal text both match. Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import columns
from spanloom.llm.pack_bins import slices

Q = 8
EDIT_RATE = 0.1  # edits per byte of the item
SHORT = 40  # plain bytes; shorter items match word by word
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20  # of text taken from a batch at once
WINDOW = 4 << 20  # bytes of a text searched at once, or four times the longest item
PIECE = 4 << 20  # pairs of a place in a text and a place in an item laid out at once
_TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)
MATCH_SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int"


def plain_form(text: str) -> tuple[bytes, np.ndarray]:
    """The plain bytes and the place of each in the text's own bytes."""
    raw = np.frombuffer(text.encode().translate(_PLAIN), dtype=np.uint8)
    blank = raw == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    if len(at) and raw[at[0]] == 32:
        at = at[1:]
    if len(at) and raw[at[-1]] == 32:
        at = at[:-1]
    return raw[at].tobytes(), at


def q_grams(data: np.ndarray) -> np.ndarray:
    """Each run of Q bytes as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), dtype="<u8", buffer=data.tobytes(), strides=(1,)).copy()


def budget_of(length: int, rate: float) -> int:
    """Edits allowed for an item, so that at least one shared q-gram is sure."""
    return max(0, min(int(rate * length), (length - Q) // Q))


@dataclass
class Index:
    """A block of items: the q-grams of the long ones, the hashes of the short ones by length."""

    ids: np.ndarray
    items: list[bytes]
    budgets: np.ndarray
    least: np.ndarray  # shared q-grams that a band needs
    grams: np.ndarray  # sorted
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length: sorted hashes, items
    reach: int  # bytes of the longest passage that can match

    @classmethod
    def build(cls, rows: list[tuple[int, str]], rate: float) -> Index:
        plain = [(i, plain_form(t)[0]) for i, t in rows]
        plain = [(i, t) for i, t in plain if t]
        grams = [q_grams(np.frombuffer(t, np.uint8)) if len(t) >= SHORT else np.zeros(0, np.uint64) for _, t in plain]
        sizes = [len(g) for g in grams]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(plain)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        budgets = np.array([budget_of(len(t), rate) if len(t) >= SHORT else 0 for _, t in plain], dtype=np.int64)
        least = np.array([len(t) - Q + 1 for _, t in plain], dtype=np.int64) - Q * budgets
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[_slot(flat)] = True
        ids = np.array([i for i, _ in plain], dtype=np.int64)
        lengths = np.array([len(t) for _, t in plain], dtype=np.int64)
        short = {}
        for length in np.unique(lengths[lengths < SHORT]).tolist():
            own = np.flatnonzero(lengths == length)
            joined = np.frombuffer(b"".join(plain[i][1] for i in own), np.uint8)
            hashes = _part_hashes(joined, np.arange(len(own)) * length, length)
            by_hash = np.argsort(hashes, kind="stable")
            short[length] = hashes[by_hash], own[by_hash]
        reach = int((lengths + budgets).max(initial=0)) + 1
        return cls(
            ids, [t for _, t in plain], budgets, least, flat[order], owner[order], place[order], table, short, reach
        )


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers before each place, and the inverse power of each place (modulo 2^64)."""
    powers = np.full(len(data), _BASE, np.uint64)
    powers[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)
    back[:1] = 1
    return sums, np.multiply.accumulate(back, out=back)


def _part_hashes(data: np.ndarray, starts: np.ndarray, length: int, sums: tuple | None = None) -> np.ndarray:
    """A hash of the ``length`` bytes from each start."""
    total, back = sums or _sums(data)
    return (total[starts + length] - total[starts]) * back[starts]


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _MIX) >> np.uint64(64 - _TABLE_BITS)


def align(item: bytes, region: bytes, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits between the item and a part of the region on the diagonals low..high, and the
    part's end. ``anchored``: the part begins with the region. A large number if there is none."""
    far = 1 << 20
    m, n = len(item), len(region)
    text = np.frombuffer(region, np.uint8)
    width = high - low + 1
    lane = np.arange(width)
    # row[d]: edits for the item's first i bytes ending at text place i + low + d
    at = low + lane
    row = np.where((at >= 0) & (at <= n), np.maximum(at, 0) if anchored else 0, far)
    for i in range(1, m + 1):
        at = i + low + lane
        inside = (at >= 1) & (at <= n)
        differ = text[np.clip(at - 1, 0, max(n - 1, 0))] != item[i - 1] if n else np.ones(width, bool)
        best = np.where(inside, row + differ, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where((at >= 0) & (at <= n), best, far)
        best = np.where(at == 0, i, best)
        row = np.minimum.accumulate(best - lane) + lane
        row = np.where((at >= 0) & (at <= n), row, far)
    end = int(np.argmin(row))
    return int(row[end]), m + low + end


def _locate(item: bytes, text: bytes, band: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best passage on the band's diagonals, if within k edits."""
    low, high = band * max(k, 1), (band + 2) * max(k, 1) - 1
    begin, stop = max(0, low), min(len(text), high + len(item) + k)
    exact = text.find(item, begin, stop)
    if exact >= 0:
        return exact, exact + len(item), 0
    edits, end = align(item, text[begin:stop], low - k - begin, high + k - begin)
    end += begin
    if edits > k:
        return None
    # The same alignment from its end backwards gives the start.
    back = text[max(0, end - len(item) - k) : end][::-1]
    _, size = align(item[::-1], back, -k, k, anchored=True)
    return end - size, end, edits


Match = tuple[int, int, int, int, int]  # text number, item number, start, end, edits


def _short_matches(index: Index, texts: list[bytes]) -> list[Match]:
    """Short items between two blanks or ends of the texts."""
    if not index.short:
        return []
    data = np.frombuffer(b" " + b" \n ".join(texts) + b" ", np.uint8)  # no item holds a line end
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 3) - sizes - 2
    words = np.flatnonzero(data == 32)[:-1] + 1
    sums = _sums(data)
    found = []
    for length, (hashes, owner) in index.short.items():
        at = words[words + length < len(data)]
        at = at[data[at + length] == 32]
        asked = _part_hashes(data, at, length, sums)
        first = np.searchsorted(hashes, asked, side="left")
        last = np.searchsorted(hashes, asked, side="right")
        for spot in np.flatnonzero(last > first).tolist():
            t = int(np.searchsorted(starts, at[spot], side="right")) - 1
            start = int(at[spot] - starts[t])
            part = texts[t][start : start + length]
            found += [(t, i, start, start + length, 0) for i in owner[first[spot] : last[spot]].tolist() if index.items[i] == part]
    return found


def _long_matches(index: Index, texts: list[bytes]) -> list[Match]:
    """Passages in bands with enough shared q-grams, verified."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    grams = q_grams(np.frombuffer(b"".join(texts), np.uint8))
    hit = np.flatnonzero(index.table[_slot(grams)])
    doc = np.searchsorted(starts, hit, side="right") - 1
    own = hit + Q <= starts[doc] + sizes[doc]  # not across two texts
    hit, doc = hit[own], doc[own]
    order = np.argsort(grams[hit], kind="stable")
    hit, doc = hit[order], doc[order]
    names, begin, uses = np.unique(grams[hit], return_index=True, return_counts=True)
    first = np.searchsorted(index.grams, names, side="left")
    n = np.searchsorted(index.grams, names, side="right") - first
    # Postings of the texts' grams; the items are taken in pieces by the pairs that they lead to.
    posting = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    begin, uses = np.repeat(begin, n), np.repeat(uses, n)
    owner = index.owner[posting]
    load = np.cumsum(np.bincount(owner, weights=uses, minlength=len(index.ids)))
    piece = ((load - 1) // PIECE)[owner]
    found: list[Match] = []
    for number in np.unique(piece):
        mine = np.flatnonzero(piece == number)
        m = uses[mine]
        spot = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[mine], m)
        item, place = np.repeat(owner[mine], m), np.repeat(index.place[posting[mine]], m)
        found += _verified(index, texts, doc[spot], item, place, hit[spot] - starts[doc[spot]] - place)
    return found


def _verified(index: Index, texts: list[bytes], doc, item, place, diagonal) -> list[Match]:
    """Passages in the bands of these shared q-grams; all those of an item are among them."""
    upper = diagonal // np.maximum(index.budgets[item], 1)
    doc, item, place = np.tile(doc, 2), np.tile(item, 2), np.tile(place, 2)
    band = np.concatenate([upper, upper - 1])
    # One number per (text, item, band); the bands are shifted to be positive.
    low = int(band.min())
    span = int(band.max()) - low + 1
    key = (doc * len(index.ids) + item) * span + (band - low)
    order = np.argsort(key, kind="stable")
    key, place, item, doc, band = key[order], place[order], item[order], doc[order], band[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(begin, len(key)))
    found: list[Match] = []
    enough = count >= index.least[item[begin]]
    for b, c in zip(begin[enough], count[enough], strict=True):
        i, t = int(item[b]), int(doc[b])
        if len(np.unique(place[b : b + c])) < index.least[i]:
            continue
        passage = _locate(index.items[i], texts[t], int(band[b]), int(index.budgets[i]))
        if passage:
            found.append((t, i, *passage))
    return found


def _parts(texts: list[bytes], size: int, overlap: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts or parts of long ones, about ``size`` bytes at a time: text number, begin, bytes."""
    held: list[tuple[int, int, bytes]] = []
    room = size
    for t, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - overlap), size - overlap):
            part = text[begin : begin + size]
            if held and len(part) > room:
                yield held
                held, room = [], size
            held.append((t, begin, part))
            room -= len(part)
    if held:
        yield held


def matches(index: Index, texts: list[bytes]) -> list[Match]:
    """(text number, item number, start, end, edits) in plain places; passages of one item that
    overlap are reported once, by the fewest edits, then the first."""
    if not len(index.ids):
        return []
    found: set[Match] = set()
    for held in _parts(texts, max(WINDOW, 4 * index.reach), index.reach):
        parts = [p for _, _, p in held]
        for k, i, start, end, edits in _long_matches(index, parts):
            t, begin, _ = held[k]
            found.add((t, i, start + begin, end + begin, edits))
        for k, i, start, end, edits in _short_matches(index, parts):
            t, begin, _ = held[k]
            start, end = start + begin, end + begin
            # The ends of a part are no word borders of its text.
            if (start == 0 or texts[t][start - 1] == 32) and (end == len(texts[t]) or texts[t][end] == 32):
                found.add((t, i, start, end, edits))
    kept: list[Match] = []
    taken: list[tuple[int, int]] = []
    of = None
    for x in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2], x[3])):
        if x[:2] != of:
            of, taken = x[:2], []
        at = bisect(taken, x[2:4])
        if (at == 0 or taken[at - 1][1] <= x[2]) and (at == len(taken) or taken[at][0] >= x[3]):
            taken.insert(at, x[2:4])
            kept.append(x)
    return kept


def _code_points(text: str, at: np.ndarray, start: int, end: int) -> tuple[int, int]:
    raw = text.encode()
    first, last = int(at[start]), int(at[end - 1]) + 1
    while last < len(raw) and raw[last] & 0xC0 == 0x80:
        last += 1
    return len(raw[:first].decode(errors="ignore")), len(raw[:last].decode(errors="ignore"))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``: as many as the total size asks for."""
    items = columns(items, "item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()]


def leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """A row per passage of a document that is an item up to ``rate`` edits per byte: doc_id,
    item_id, start and end (code points of the text, end exclusive), edits."""
    spark = docs.sparkSession
    docs = columns(docs, "doc_id", "text")
    out = None
    for block in item_blocks(items):
        index = spark.sparkContext.broadcast(Index.build(block, rate))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, size_bytes=SLICE_BYTES):
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    plain = [plain_form(t) for t in texts]
                    rows = []
                    for t, i, start, end, edits in matches(index.value, [p for p, _ in plain]):
                        spot = _code_points(texts[t], plain[t][1], start, end)
                        rows.append((part.column("doc_id")[t].as_py(), int(index.value.ids[i]), *spot, edits))
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                        fields = zip(zip(*rows, strict=True), kinds, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f, k) for f, k in fields],
                            names=["doc_id", "item_id", "start", "end", "edits"],
                        )

        found = docs.mapInArrow(search, MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCH_SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns as they came."""
    for block in item_blocks(items):
        index = docs.sparkSession.sparkContext.broadcast(Index.build(block, rate))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, size_bytes=SLICE_BYTES):
                    plain = [plain_form(t or "")[0] for t in part.column("text").to_pylist()]
                    hit = np.ones(part.num_rows, dtype=bool)
                    hit[[t for t, *_ in matches(index.value, plain)]] = False
                    yield part.filter(pa.array(hit))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
