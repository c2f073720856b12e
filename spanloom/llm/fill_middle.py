"""Fill-in-the-middle forms of documents: prefix, suffix and middle, cut between units.

Units are runs of ASCII letters and single other code points. A text is looked at in fixed blocks of bytes. A Fenwick
tree holds the units and the code points that start in each block; a descent by powers of two finds the block
of a cut, and only that block is searched for the place. So finding a cut takes a logarithm of the blocks and one
block, whatever the length of the text, and the flags of no more than one block are held at a time.

The draws of a document are the first groups of a hash of seed and id: cuts, share of plain texts and of
suffix-first texts. A text that holds one of the marks stays plain, so that ``restore`` is exact.

Defined cases: a null text is empty and plain; a null id draws like an empty one; rows of equal id draw the same numbers;
cuts may meet, which leaves an empty part. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import columns
from spanloom.llm.pack_bins import slices

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 4096  # bytes
FORMED = 90  # of 100 texts
SUFFIX_FIRST = 20  # of 100 formed texts
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point


class BlockTree:
    """Fenwick tree over the blocks of a text: units and code points that start in each."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        n = -(-len(data) // block)
        tree = [(0, 0)] * (n + 1)
        for i in range(n):
            begins, leads = self.flags(i)
            tree[i + 1] = (int(np.count_nonzero(begins)), int(np.count_nonzero(leads)))
        for i in range(1, n + 1):
            above = i + (i & -i)
            if above <= n:
                tree[above] = (tree[above][0] + tree[i][0], tree[above][1] + tree[i][1])
        self.tree = tree

    def flags(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the bytes of block i: whether a unit begins there, and whether a code point does."""
        low = i * self.block
        part = self.data[low : low + self.block]
        letter, leads = _LETTER[part], _LEADS[part]
        before = np.empty_like(letter)
        before[0] = low > 0 and _LETTER[self.data[low - 1]]
        before[1:] = letter[:-1]
        return leads & ~(letter & before), leads

    def totals(self) -> tuple[int, int]:
        units = points = 0
        i = len(self.tree) - 1
        while i:
            units, points = units + self.tree[i][0], points + self.tree[i][1]
            i -= i & -i
        return units, points

    def cut(self, unit: int) -> tuple[int, int]:
        """The byte and the code point where unit number ``unit`` (from 0) begins; one past the last: the end."""
        at, units, points = 0, 0, 0
        step = 1 << max(0, (len(self.tree) - 1).bit_length() - 1)
        while step:
            to = at + step
            if to < len(self.tree) and units + self.tree[to][0] <= unit:
                at, units, points = to, units + self.tree[to][0], points + self.tree[to][1]
            step >>= 1
        if at == len(self.tree) - 1:
            return len(self.data), points
        begins, leads = self.flags(at)
        place = int(np.flatnonzero(begins)[unit - units])
        return at * self.block + place, points + int(np.count_nonzero(leads[:place]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def form_of(doc_id: int | None, text: bytes, seed: int, formed: int, suffix_first: int, block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    tree = BlockTree(np.frombuffer(text, dtype=np.uint8), block)
    n, _ = tree.totals()
    h = draws(doc_id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h[2] % 100 >= formed or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = tree.cut(low), tree.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        form, parts = "spm", [marks[1], suffix, marks[0], prefix, marks[2], middle]
    else:
        form, parts = "psm", [marks[0], prefix, marks[1], suffix, marks[2], middle]
    return n, form, a_chars, b_chars - a_chars, b"".join(parts)


def transform(
    docs: DataFrame, seed: int = 1, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary())
                rows = [form_of(i, t.as_py(), seed, formed, suffix_first, block) for i, t in zip(ids, texts, strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                cells = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form)]
                cells += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    return columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def restore(formed: DataFrame) -> DataFrame:
    """Add ``restored``: the text, from form and output alone. The marks are in no formed text."""
    part = F.split("output", "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    text = F.col("output")
    for form, places in order.items():
        text = F.when(F.col("form") == form, F.concat(*[part[i] for i in places])).otherwise(text)
    return formed.withColumn("restored", text)
