"""SimHash near-duplicates by a self-join of binary tries over the fingerprints.

Equal texts give equal fingerprints, so copies collapse before anything is joined: the trie holds
distinct fingerprints only. Pairs of trie nodes are walked together from the top; a pair adds a
differing bit when it takes different branches, and it is dropped once the bits exceed the budget.

The walk is made cheap by the pigeonhole rule: of two halves of the bits (four quarters for budgets
above 3) at least one holds its share of the budget or less, so one trie starts with each part, and its first
levels have the smaller budget. No pair is lost. With halves and a budget of 3 the work grows a little
faster than the number of fingerprints; with quarters it has a part that grows with its square over 2**16. The top levels of the walk are a Spark shuffle: a fingerprint goes to its
own subtree and to those whose prefix differs within the budget; the prefix grows with the count of
fingerprints, so subtrees stay small. A subtree that stays large is cut into blocks and its pairs of
blocks become tasks of their own. Inside a task links are reduced to a forest, and components come
from distributed star joins; nothing is collected on the driver but counts.

Defined cases: a null or empty text, or one of blanks only, has fingerprint zero and is linked like
any other; a text of fewer words than a shingle has one shingle of all its words. Rows with equal or
null ids each get a row; a component of rows with null ids only has a null component_id. Further
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import columns, stored
from spanloom.llm.graph import components
from spanloom.llm.pack_bins import slices

SEED = 42
SLICE_BYTES = 1 << 20  # of text hashed at once
SUBTREE = 1024  # fingerprints that a subtree holds on average
BLOCK = 4096  # fingerprints of one node that a task takes
PAIRS = 1 << 20  # node pairs walked at once
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words, A-Z lower-cased; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hash64 = xxhash.xxh64_intdigest
    return [hash64(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)] or [
        hash64(joined, SEED)
    ]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text the bits that more than half of its hashes have; zero for a text without any.

    Eight counters ride in the bytes of one 64-bit number, over runs of at most 255 hashes."""
    prints = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return prints
    n = sizes[some].astype(np.int64)
    starts = np.cumsum(n) - n
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    run_no = np.arange(int(runs.sum())) - np.repeat(first_run, runs)
    run_starts = np.repeat(starts, runs) + 255 * run_no
    value = np.zeros(len(some), dtype=np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, run_starts)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(counts, first_run, axis=0)
        for lane in range(8):
            value |= (2 * sums[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + bit)
    prints[some] = value
    return prints


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size_bytes=SLICE_BYTES):
                hashes = [shingle_hashes(t, size) for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
                flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
                fp = majority_bits(flat, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _top(bits: np.ndarray, depth: int) -> np.ndarray:
    return bits >> np.uint64(64 - depth) if depth else np.zeros_like(bits)


def trie_pairs(
    a: np.ndarray, b: np.ndarray, same: bool, depth: int, max_bits: int, first_budget: int, first_bits: int = 32
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in a, j in b) of values with at most ``max_bits`` differing bits.

    a and b are sorted and share their first ``depth`` bits each (``same``: a is b, and each pair
    comes once). A trie node is a range of the sorted values."""
    if not len(a) or not len(b):
        return
    bits = int(np.bitwise_count(_top(a[:1], depth) ^ _top(b[:1], depth))[0])
    zero = np.zeros(1, np.int64)
    todo = [(depth, zero, zero + len(a), zero, zero + len(b), zero + bits)]
    while todo:
        level, a0, a1, b0, b1, d = todo.pop()
        small = (a1 - a0) * (b1 - b0) <= 16
        if level >= 64:
            small[:] = True
        if small.any():
            p0, p1, q0, q1 = a0[small], a1[small], b0[small], b1[small]
            wide = q1 - q0
            n = (p1 - p0) * wide
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(p0, n) + at // np.repeat(wide, n)
            j = np.repeat(q0, n) + at % np.repeat(wide, n)
            near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, d = (x[~small] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        shift = np.uint64(63 - level)
        cut_a = np.searchsorted(a, (a[a0] >> shift | np.uint64(1)) << shift)
        cut_b = np.searchsorted(b, (b[b0] >> shift | np.uint64(1)) << shift)
        cut_a, cut_b = np.clip(cut_a, a0, a1), np.clip(cut_b, b0, b1)
        parts = [
            (a0, cut_a, b0, cut_b, d),
            (cut_a, a1, cut_b, b1, d),
            (a0, cut_a, cut_b, b1, d + 1),
            (cut_a, a1, b0, cut_b, d + 1),
        ]
        a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        budget = first_budget if level < first_bits else max_bits
        keep = (a1 > a0) & (b1 > b0) & (d <= budget)
        if same:
            keep &= a0 <= b0  # the mirrored pair is walked instead
        a0, a1, b0, b1, d = (x[keep] for x in (a0, a1, b0, b1, d))
        for begin in range(0, len(a0), PAIRS):
            cut = slice(begin, begin + PAIRS)
            todo.append((level + 1, a0[cut], a1[cut], b0[cut], b1[cut], d[cut]))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest linked place of each of n places."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            # Each label is a root here, and only roots are hooked: members of earlier batches follow theirs.
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _rotated(fp: Column, bits: Column) -> Column:
    """The 64 bits turned left, so that the part that the trie starts with is in front."""
    turned = F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn)")
    return F.when(bits == 0, fp).otherwise(turned)


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """prints(fp), distinct -> (a, b): links that join all fingerprints within ``max_bits`` bits
    of each other into the same components."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits goes from 0 to 7, so that one part has at most one differing bit")
    parts = 2 if max_bits <= 3 else 4
    first_bits, budget = 64 // parts, max_bits // parts
    total = prints.count()
    depth = max(0, min(first_bits, math.ceil(math.log2(max(total, 1) / SUBTREE))))
    turn = F.explode(F.array(*[F.lit(first_bits * k) for k in range(parts)])).alias("turn")
    rows = prints.select("fp", turn).select(
        F.col("turn").alias("o"), _rotated(F.col("fp"), F.col("turn")).alias("r")
    )
    node = F.shiftrightunsigned("r", 64 - depth) if depth else F.lit(0).cast("bigint")
    rows = rows.withColumn("x", node)

    # Which nodes a node meets: itself, and those whose prefix differs within the budget.
    masks = [0]
    for _ in range(budget):
        masks = sorted({m | 1 << k for m in masks for k in range(depth)} | set(masks))
    meets = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask")
    nodes = stored(rows.groupBy("o", "x").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k")), "trie-nodes")
    partner = nodes.select("o", F.col("x").alias("y"), F.col("k").alias("ky"))
    met = nodes.select("o", "x", "k", meets).withColumn("y", F.col("x").bitwiseXOR(F.col("mask")))
    met = met.join(partner, ["o", "y"])
    # Blocks of the pair's lower and higher node; the node's own block count and its partner's.
    met = met.groupBy("o", "x").agg(F.max("k").alias("k"), F.collect_list(F.struct("y", "ky")).alias("met"))
    rows = rows.join(met, ["o", "x"])
    rows = rows.withColumn("i", F.pmod(F.xxhash64("r"), F.col("k")))
    rows = rows.select("o", "r", "x", "k", "i", F.explode("met").alias("m")).select(
        "o", "r", "x", "i", F.col("m.y").alias("y"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m.ky") - 1)).alias("j"),
    )
    low = F.col("x") < F.col("y")
    own = F.col("x") == F.col("y")
    rows = rows.select(
        "o", "r",
        F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"),
        F.when(own, F.least("i", "j")).when(low, F.col("i")).otherwise(F.col("j")).alias("u"),
        F.when(own, F.greatest("i", "j")).when(low, F.col("j")).otherwise(F.col("i")).alias("v"),
        # Side 1 is the second block; within one node the side is the row's own block.
        F.when(own, (F.col("i") > F.col("j")).cast("int")).otherwise((~low).cast("int")).alias("side"),
    )

    def walk(group: pa.Table) -> pa.Table:
        values = np.asarray(group["r"]).astype(np.int64).view(np.uint64)
        side = np.asarray(group["side"])
        same = group["lo"][0].as_py() == group["hi"][0].as_py() and group["u"][0].as_py() == group["v"][0].as_py()
        a, b = np.sort(values[side == 0]), np.sort(values[side == 1])
        if same:
            b = a
        found = trie_pairs(a, b, same, depth, max_bits, budget, first_bits)
        if not same:
            found = ((i, j + len(a)) for i, j in found)
        both = a if same else np.concatenate([a, b])
        label = _forest(len(both), found)
        at = np.flatnonzero(label != np.arange(len(both)))
        first = both[at], both[label[at]]
        turned = group["o"][0].as_py()
        if turned:
            back = np.uint64(64 - turned)
            first = tuple(x << back | x >> np.uint64(turned) for x in first)
        return pa.table({"a": first[0].view(np.int64), "b": first[1].view(np.int64)})

    return rows.groupBy("o", "lo", "hi", "u", "v").applyInArrow(walk, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) per row."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    copies = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(copies.select("fp"), max_bits))
    named = copies.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, size: int = 3, max_bits: int = 3) -> DataFrame:
    """Of each component of ``docs`` the row with the smallest doc_id (null last), the first of these if several have it.

    Rows are told apart by a number of their own, so rows of equal or null ids are documents of their own."""
    numbered = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = near_duplicates(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), size, max_bits)
    named = found.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "doc.doc_id"), "row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    return numbered.join(best.select("best.row"), "row", "left_semi").select("doc.*")
