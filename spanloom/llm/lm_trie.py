"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates bigrams with add-one unigrams:
``P(w | u) = weight(c(u)) * q(u, w) + (1 - weight(c(u))) * (c(w) + 1) / (N + V + 1)``, where q is the
quantised probability of w after u in the training text, and the weight of each size class of c(u)
is the one under which the training text, each place left out of its own counts, is likeliest.
For every context the probabilities add up to one up to the quantising step (1 / 2048 of a
power of two). Contexts never seen in training use the unigrams alone.

The trie is cut into shards. A shard holds its contexts and its (context, word) pairs as two rising
Elias-Fano sequences, a third one of pointers from contexts to their first pair, and a 16-bit code per pair. A
query finds its context, then searches the successor of its word inside that context's range. The
shards are rows of a table in the shared folder, read as views of Arrow buffers (a remote
store has no files to map); none is ever broadcast.

Work goes in blocks of about 4 MB of text. A block sends each distinct word once to a vocabulary
shard and each distinct pair once to a trie shard, and gets ids, counts and codes back. A word that
a third of all places hold is one entry per block, and the pairs of a frequent context are
spread over shards by their second word. The number of shards follows the counts. The driver sees
totals and 72 sums only.

Defined cases: a null or empty text has one token, the end. Repeated rows are counted and scored
each. Without training rows all probabilities are one (N = V = 0). Further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import columns, stored
from spanloom.llm.elias_fano import EliasFano
from spanloom.llm.pack_bins import slices

WORDS_A_SHARD = 400_000
PAIRS_A_SHARD = 2_000_000
STEPS = 2048  # steps of the quantised probabilities in a power of two
# Contexts are classed by count (powers of eight); candidates for the weight of the bigrams.
CLASSES = 8
WEIGHTS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.55, 0.75, 0.9])
START, END, FIRST_WORD = 0, 1, 2  # ids

BLOCK_SCHEMA = (
    "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<int>, codes binary, words binary, n_words int"
)
ANSWER_SCHEMA = "block bigint, kind int, shard int, a binary, b binary, n_types bigint, n_tokens bigint"


def _squeeze(values: np.ndarray, kind: str) -> bytes:
    """Bytes of equal weight next to each other, compressed."""
    data = np.ascontiguousarray(values, dtype=kind)
    planes = data.view(np.uint8).reshape(-1, data.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z lower-cased, and the number of words per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    some = np.asarray(pc.not_equal(flat, ""))
    upto = np.append(0, np.cumsum(some))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return flat.filter(pa.array(some)), np.diff(upto[offsets - offsets[0]])


def blocks_of(docs: DataFrame, held: Column) -> DataFrame:
    """Texts as word numbers: a row per block of documents, with the block's own word list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                words, sizes = text_words(part.column("text"))
                coded = words.dictionary_encode()
                names = [w.encode() for w in coded.dictionary.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.column("held").to_pylist()], pa.list_(pa.bool_())),
                        pa.array([sizes.tolist()], pa.list_(pa.int32())),
                        pa.array([_squeeze(np.asarray(coded.indices), "<u4")], pa.binary()),
                        pa.array([_pack_words(names)], pa.binary()),
                        pa.array([len(names)], pa.int32()),
                    ],
                    names=["block", "doc_ids", "held", "sizes", "codes", "words", "n_words"],
                )
                block += 1

    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _part_of(shards: np.ndarray, shard: int) -> slice:
    """Where a shard stands among rising shard numbers."""
    begin, end = np.searchsorted(shards, [shard, shard + 1])
    return slice(begin, end)


class _Block:
    """One block's row, taken apart."""

    def __init__(self, row: dict) -> None:
        self.block = row["block"]
        self.doc_ids = row["doc_ids"]
        self.held = np.array(row["held"], dtype=bool)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.codes = _unsqueeze(row["codes"], "<u4").astype(np.int64)
        self.words = _unpack_words(row["words"])

    def counts(self) -> np.ndarray:
        """Training places of each of the block's words."""
        training = np.repeat(~self.held, self.sizes)
        return np.bincount(self.codes[training], minlength=len(self.words))

    def shards(self, n: int) -> np.ndarray:
        return np.fromiter((zlib.crc32(w) % n for w in self.words), np.int64, len(self.words))

    def numbered(self, answers: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Global id and training count of each of the block's words."""
        ids = np.zeros(len(self.words), np.int64)
        counts = np.zeros(len(self.words), np.int64)
        shard = self.shards(n)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        for row in answers:
            if row["kind"] == 1:
                own = order[_part_of(shard, row["shard"])]
                ids[own] = _unsqueeze(row["a"], "<i8") + FIRST_WORD
                counts[own] = _unsqueeze(row["b"], "<i8")
        return ids, counts

    def sequences(self, values: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token, the value of the one before it and its own, the end token included."""
        ends = np.cumsum(self.sizes)
        flat = values[self.codes] if len(self.codes) else np.zeros(0, np.int64)
        own = np.insert(flat, ends, end)
        before = np.insert(flat, ends - self.sizes, start)
        return before, own


def _word_rows(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            counts, shard = block.counts(), block.shards(n_shards)
            order = np.argsort(shard, kind="stable")
            used, first = np.unique(shard[order], return_index=True)
            parts = np.split(order, first[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([block.block] * len(used), pa.int64()),
                    pa.array([_pack_words([block.words[i] for i in p]) for p in parts[: len(used)]], pa.binary()),
                    pa.array([_squeeze(counts[p], "<i8") for p in parts[: len(used)]], pa.binary()),
                ],
                names=["shard", "block", "words", "counts"],
            )


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ["block", "kind", "shard", "a", "b", "n_types", "n_tokens"]
    fields = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(f, k) for f, k in zip(fields, kinds, strict=True)], names=names)


def vocabulary(blocks: DataFrame, n_shards: int) -> DataFrame:
    """Answers of kind 1: ids and counts of each block's words; kind 0: totals of a shard."""

    def count(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        lists = [_unpack_words(x.as_py()) for x in group["words"]]
        sizes = [len(x) for x in lists]
        coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        counts = np.concatenate([_unsqueeze(x.as_py(), "<i8") for x in group["counts"]])
        totals = np.bincount(codes, weights=counts).astype(np.int64)
        rows: list[tuple] = [(-1, 0, shard, None, None, int((totals > 0).sum()), int(totals.sum()))]
        for block, part in zip(group["block"], np.split(codes, np.cumsum(sizes)[:-1]), strict=True):
            ids = _squeeze(part * n_shards + shard, "<i8")
            rows.append((block.as_py(), 1, shard, ids, _squeeze(totals[part], "<i8"), 0, 0))
        return _answers(rows)

    sent = blocks.mapInArrow(
        lambda it: _word_rows(it, n_shards), "shard int, block bigint, words binary, counts binary"
    )
    return sent.groupBy("shard").applyInArrow(count, ANSWER_SCHEMA)


class Trie:
    """One shard: contexts, pointers to their pairs, pairs, and a code per pair.

    Pair i of context k is stored as k * bound + word, which rises over the whole level."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, pairs: EliasFano, codes: np.ndarray, bound: int) -> None:
        self.contexts, self.pointers, self.pairs, self.codes, self.bound = contexts, pointers, pairs, codes, bound

    @classmethod
    def build(cls, keys: np.ndarray, codes: np.ndarray, bound: int) -> Trie:
        """keys: context * bound + word, rising."""
        contexts, first = np.unique(keys // bound, return_index=True)
        at = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(keys))))
        return cls(
            EliasFano.of(contexts, bound),
            EliasFano.of(np.append(first, len(keys)), len(keys) + 1),
            EliasFano.of(at * bound + keys % bound, max(1, len(contexts)) * bound),
            codes.astype("<u2"),
            bound,
        )

    def to_bytes(self) -> bytes:
        levels = self.contexts.to_bytes() + self.pointers.to_bytes() + self.pairs.to_bytes()
        return np.array([self.bound], "<i8").tobytes() + levels + self.codes.tobytes()

    @classmethod
    def view(cls, data: bytes | memoryview) -> Trie:
        bound = int(np.frombuffer(data, "<i8", 1)[0])
        contexts, at = EliasFano.from_buffer(data, 8)
        pointers, at = EliasFano.from_buffer(data, at)
        pairs, at = EliasFano.from_buffer(data, at)
        return cls(contexts, pointers, pairs, np.frombuffer(data, "<u2", pairs.n, at), bound)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each pair; 0 for a pair that is not there."""
        found = np.zeros(len(keys), dtype=np.int64)
        if not self.pairs.n:
            return found
        context, word = keys // self.bound, keys % self.bound
        names, where = np.unique(context, return_inverse=True)
        at = self.contexts.successor(names)
        known = at < self.contexts.n
        known[known] = self.contexts.values(at[known]) == names[known].astype(np.uint64)
        at = np.minimum(at, self.contexts.n - 1)
        begin = self.pointers.values(at).astype(np.int64)
        end = self.pointers.values(at + 1).astype(np.int64)
        ask = np.flatnonzero(known[where])
        k = where[ask]
        target = at[k] * self.bound + word[ask]
        spot = self.pairs.successor(target, begin[k], end[k])
        hit = spot < end[k]
        stored_values = self.pairs.values(np.minimum(spot, self.pairs.n - 1))
        hit &= stored_values == target.astype(np.uint64)
        found[ask[hit]] = self.codes[spot[hit]]
        return found


def quantise(share: np.ndarray) -> np.ndarray:
    """Code of a probability in (0, 1]: 1 for one, a step more per 1 / STEPS of a halving."""
    return np.clip(np.rint(-np.log2(share) * STEPS) + 1, 1, 65_535).astype(np.int64)


def unquantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** (-(np.maximum(code, 1) - 1) / STEPS), 0.0)


def _pairs_of(block: _Block, ids: np.ndarray, counts: np.ndarray, n_docs: int, total: int, bound: int, n_shards: int):
    """Distinct pairs in the order they are sent (shard, then key), their shards, and for each
    token the place of its pair."""
    before, own = block.sequences(ids, START, END)
    seen, _ = block.sequences(counts, n_docs, n_docs)
    keys, first, place = np.unique(before * bound + own, return_index=True, return_inverse=True)
    # A context with more than its share of all places is spread by the second word.
    salts = 1 + seen[first] * n_shards // max(total, 1)
    spread = _mix(keys % bound + 1) % salts.astype(np.uint64)
    shard = (_mix((keys // bound).astype(np.uint64) * np.uint64(1_000_003) + spread) % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    return keys[order], shard[order], seen[first][order], where[place]


def _pair_rows(block: _Block, ids: np.ndarray, counts: np.ndarray, facts: tuple) -> Iterator[tuple]:
    n_docs, total, bound, n_shards = facts
    keys, shard, context, place = _pairs_of(block, ids, counts, n_docs, total, bound, n_shards)
    training = np.repeat(~block.held, block.sizes + 1)
    n = np.bincount(place[training], minlength=len(keys))
    used, first = np.unique(shard, return_index=True)
    for s, at in zip(used, np.split(np.arange(len(keys)), first[1:]), strict=True):
        deltas = np.diff(keys[at], prepend=0)
        yield int(s), block.block, _squeeze(deltas, "<i8"), _squeeze(n[at], "<u4"), _squeeze(context[at], "<i8")


def _trie_answers(group: pa.Table, bound: int) -> pa.Table:
    shard = group["shard"][0].as_py()
    asked = [np.cumsum(_unsqueeze(x.as_py(), "<i8")) for x in group["keys"]]
    counts = [_unsqueeze(x.as_py(), "<u4") for x in group["counts"]]
    context = [_unsqueeze(x.as_py(), "<i8") for x in group["context"]]
    flat, n, seen = np.concatenate(asked), np.concatenate(counts), np.concatenate(context)
    keys, first, place = np.unique(flat, return_index=True, return_inverse=True)
    n = np.bincount(place, weights=n).astype(np.int64)
    seen = seen[first]
    known = n > 0
    trie = Trie.build(keys[known], quantise(n[known] / seen[known]), bound)
    data = trie.to_bytes()
    trie = Trie.view(data)
    rows: list[tuple] = [(-1, 3, shard, data, None, len(trie.codes), 0)]
    # One search for the shard; the blocks take their parts of it.
    found = np.split(trie.find(keys)[place], np.cumsum([len(own) for own in asked])[:-1])
    for block, own in zip(group["block"], found, strict=True):
        rows.append((block.as_py(), 2, shard, _squeeze(own, "<u2"), None, 0, 0))
    return _answers(rows)


def _class_of(counts: np.ndarray) -> np.ndarray:
    """Size class of a context's count: powers of eight."""
    octaves = np.frexp(np.maximum(counts, 1).astype(float))[1] - 1
    return np.minimum(octaves // 3, CLASSES - 1)


def _gains(ratio: np.ndarray, classes: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, class and weight: the sum of log10(1 - w + w * ratio)."""
    slot = docs * CLASSES + classes
    out = [
        np.bincount(slot, weights=np.log10(1 - w + w * ratio), minlength=n_docs * CLASSES) for w in WEIGHTS
    ]
    return np.stack(out, axis=1).reshape(n_docs, CLASSES * len(WEIGHTS))


def _scored(left: pa.Table, right: pa.Table, facts: tuple, n_types: int, word_shards: int) -> pa.Table:
    n_docs, total, bound, n_shards = facts
    answers = right.to_pylist()
    out: dict[str, list] = {k: [] for k in ("doc_id", "held", "n_tokens", "n_known", "base", "gains", "left_out")}
    for row in left.to_pylist():
        block = _Block(row)
        ids, counts = block.numbered(answers, word_shards)
        _, shard, _, place = _pairs_of(block, ids, counts, n_docs, total, bound, n_shards)
        codes = np.zeros(len(shard), np.int64)
        for a in answers:
            if a["kind"] == 2:
                codes[_part_of(shard, a["shard"])] = _unsqueeze(a["a"], "<u2")
        q = unquantise(codes)[place]
        seen, own = block.sequences(counts, n_docs, n_docs)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes + 1)
        n = len(block.sizes)
        one = (own + 1) / (total + n_types + 1)
        base = np.bincount(doc, weights=np.log10(one), minlength=n)
        known = np.bincount(doc, weights=own > 0, minlength=n).astype(np.int64)
        ask = np.flatnonzero(seen > 0)
        classes = _class_of(seen)
        gains = _gains((q / one)[ask], classes[ask], doc[ask], n)
        # The training text with each place left out of the counts.
        train = np.flatnonzero(np.repeat(~block.held, block.sizes + 1) & (seen > 1))
        pair = np.rint(q[train] * seen[train])
        rest = (np.maximum(pair - 1, 0) / (seen[train] - 1)) / (own[train] / max(total + n_types, 1))
        left_out = _gains(rest, classes[train], np.zeros(len(train), np.int64), 1)[0]
        out["doc_id"] += block.doc_ids
        out["held"] += block.held.tolist()
        out["n_tokens"] += (block.sizes + 1).tolist()
        out["n_known"] += known.tolist()
        out["base"] += base.tolist()
        out["gains"] += list(gains)
        out["left_out"] += [left_out] + [None] * (n - 1) if n else []
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


SCORED_SCHEMA = (
    "doc_id bigint, held boolean, n_tokens bigint, n_known bigint, base double, gains array<double>, "
    "left_out array<double>"
)


def score(docs: DataFrame, held: Column) -> tuple[DataFrame, DataFrame]:
    """Learn from the rows of docs(doc_id, text) that are not ``held`` and score all.

    Returns (scores, tries). scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    tries: shard, trie (its bytes), n_pairs.
    """
    blocks = stored(blocks_of(docs, held), "lm-blocks")
    learned = F.size(F.filter("held", lambda x: ~x))
    sums = blocks.agg(F.sum("n_words").alias("w"), F.sum(learned).alias("t")).first()
    n_docs = int(sums["t"] or 0)
    word_shards = max(1, math.ceil((sums["w"] or 0) / WORDS_A_SHARD))
    words = stored(vocabulary(blocks, word_shards), "lm-words")
    totals = words.where("kind = 0").agg(F.sum("n_types").alias("v"), F.sum("n_tokens").alias("n")).first()
    total = int(totals["n"] or 0) + n_docs
    n_types = int(totals["v"] or 0) + (1 if n_docs else 0)
    n_tokens = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x + 1)"))).first()[0] or 0
    pair_shards = max(1, math.ceil(n_tokens / PAIRS_A_SHARD))
    bound = _id_bound(words)
    facts = (n_docs, total, bound, pair_shards)

    def pair_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        rows = []
        for row in left.to_pylist():
            block = _Block(row)
            rows.extend(_pair_rows(block, *block.numbered(answers, word_shards), facts))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        fields = list(zip(*rows, strict=True)) or [[]] * 5
        names = ["shard", "block", "keys", "counts", "context"]
        return pa.table([pa.array(f, k) for f, k in zip(fields, kinds, strict=True)], names=names)

    own = words.where("kind = 1")
    sent = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        pair_rows, "shard int, block bigint, keys binary, counts binary, context binary"
    )
    found = stored(
        sent.groupBy("shard").applyInArrow(lambda g: _trie_answers(g, bound), ANSWER_SCHEMA), "lm-tries"
    )
    answers = own.unionByName(found.where("kind = 2"))
    scored = stored(
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            lambda a, b: _scored(a, b, facts, n_types, word_shards), SCORED_SCHEMA
        ),
        "lm-scored",
    )
    best = _best_weights(scored)
    chosen = sum((F.get("gains", F.lit(i)) for i in best), F.lit(0.0))
    scores = scored.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("base") + chosen).alias("score"),
    )
    tries = found.where("kind = 3").select("shard", F.col("a").alias("trie"), F.col("n_types").alias("n_pairs"))
    return scores, tries


def _id_bound(words: DataFrame) -> int:
    """One more than the largest word id; pairs of ids must fit 63 bits."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [int(_unsqueeze(x.as_py(), "<i8").max(initial=0)) for x in batch.column("a")]
            yield pa.RecordBatch.from_arrays([pa.array(top, pa.int64())], names=["top"])

    top = words.where("kind = 1").select("a").mapInArrow(largest, "top bigint").agg(F.max("top")).first()[0]
    bound = FIRST_WORD + (top or 0) + 1
    if bound**2 >= 2**63:
        raise ValueError("more than 3e9 word ids: pairs of ids do not fit 63 bits")
    return bound


def _best_weights(scored: DataFrame) -> list[int]:
    """Per class the place of the likeliest weight; 72 sums reach the driver."""
    sums = (
        scored.where("left_out is not null")
        .select(F.posexplode("left_out").alias("at", "x"))
        .groupBy("at").agg(F.sum("x").alias("x")).collect()
    )
    table = np.zeros(CLASSES * len(WEIGHTS))
    for r in sums:
        table[r["at"]] = r["x"]
    table = table.reshape(CLASSES, len(WEIGHTS))
    return [int(c * len(WEIGHTS) + np.argmax(table[c])) for c in range(CLASSES)]
