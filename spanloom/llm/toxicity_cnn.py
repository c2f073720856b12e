"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to buckets, buckets to small vectors; filters of several widths slide over the
whole text, each keeps its largest response, and a logistic layer scores them. Thresholds are
calibrated per language on rows kept out of the fit.

The fit learns from every labelled row, whole. Rows stay in shards on the executors; only word counts by bucket, the
mean model of a pass and bins of held-out scores reach the driver, bounded by the number of buckets and bins.
Scoring reads every whole text in its scan task; the model (buckets by size) is a few MB at any corpus size.
The score sees only the text; the language only picks a threshold for ``flagged``.

Defined cases: a null or empty text is scored as a text without words. Without labelled rows the
score is 0.0 everywhere. Repeated rows are scored one by one, further columns are not read, and
unknown or null languages use the threshold over all languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import columns
from spanloom.llm.pack_bins import slices
from spanloom.session import cut_lineage

BUCKET_BITS = 18
WIDTHS = (1, 2, 3)
STRIP = ".,;:!?\"'()[]{}<>*#$%&|…«»¿¡“”„’-_"
PAD = max(WIDTHS) - 1
SLICE_BYTES = 1 << 20  # of text scored at once

# Fixed values of the fit.
SHARD_ROWS, MAX_SHARDS = 4000, 64
BROADCAST_LABELS = 1 << 20  # more labels are joined by a shuffle
PART_BYTES = 16 << 20  # of stored bucket numbers (four bytes each) looked at at once
STEP_WORDS = 1 << 18  # of a step, unless a single text has more
FIXED_POINT = float(1 << 32)
LOSS = -(1 << 40)  # the row of a round that holds the loss
SCORE_BINS, SCORE_LIMIT = 1024, 64.0  # bins of a unit of the raw score, and beyond what score there is one bin


@dataclass
class Model:
    buckets: np.ndarray  # bucket -> row of the embedding; row 0: padding and unknown words
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, dims, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray  # of one number
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def params(self) -> list[np.ndarray]:
        """What is learned, the embedding first."""
        return [self.embedding, *[self.filters[w] for w in WIDTHS], self.bias, self.out, self.out_bias]


def word_buckets(words: list[str]) -> np.ndarray:
    """Hashed bucket of each word, in lower case and without marks around it."""
    mask = (1 << BUCKET_BITS) - 1
    cut = (zlib.crc32(w.strip(STRIP).lower().encode()) & mask for w in words)
    return np.fromiter(cut, np.int64, len(words))


def text_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of all texts, and the number of words per text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    sizes = np.diff(np.asarray(lists.offsets).astype(np.int64))
    values = word_buckets(flat.dictionary.to_pylist())
    codes = np.asarray(flat.indices).astype(np.int64)
    if not len(values):
        return np.zeros(0, np.int64), sizes
    ids = values[codes]
    empty = np.array([w.strip(STRIP) == "" for w in flat.dictionary.to_pylist()])[codes]
    if empty.any():
        owner = np.repeat(np.arange(len(sizes)), sizes)[~empty]
        ids, sizes = ids[~empty], np.bincount(owner, minlength=len(sizes))
    return ids, sizes


def _padded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with PAD zeros after each text, and where each text starts."""
    ends = np.cumsum(sizes)
    padded = np.insert(rows, np.repeat(ends, PAD), 0)
    return padded, ends - sizes + PAD * np.arange(len(sizes))


def _responses(model: Model, rows: np.ndarray) -> np.ndarray:
    """Response of every filter at every place. Each distinct word is multiplied once."""
    words, codes = np.unique(rows, return_inverse=True)
    vectors = model.embedding[words]
    n, each = len(rows), model.filters[WIDTHS[0]].shape[2]
    out = np.empty((n, each * len(WIDTHS)))
    for k, width in enumerate(WIDTHS):
        kernel = model.filters[width]
        sums = out[:, k * each : (k + 1) * each]
        sums[:] = (vectors @ kernel[0])[codes]
        for j in range(1, width):
            sums[: n - j] += (vectors @ kernel[j])[codes[j:]]
    return out


def raw_scores(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    rows, starts = _padded(model.buckets[ids], sizes)
    peaks = np.maximum.reduceat(_responses(model, rows), starts, axis=0)
    return np.maximum(peaks + model.bias, 0) @ model.out + model.out_bias


def scores(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.scale * raw_scores(model, ids, sizes) + model.shift)))


class _Adam:
    """Adam steps on a model's parameters; of the embedding only the rows that a step touched move."""

    def __init__(self, params: list[np.ndarray], lr: float) -> None:
        self.params, self.lr, self.step = params, lr, 0
        self.first = [np.zeros_like(p) for p in params]
        self.second = [np.zeros_like(p) for p in params]

    def update(self, touched: np.ndarray, grads: list[np.ndarray]) -> None:
        self.step += 1
        for i, g in enumerate(grads):
            at = touched if i == 0 else slice(None)
            m = self.first[i][at] * 0.9 + 0.1 * g
            v = self.second[i][at] * 0.999 + 0.001 * g * g
            self.first[i][at], self.second[i][at] = m, v
            self.params[i][at] -= self.lr * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def _bucket_counts(ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per label and bucket the number of texts that hold it."""
    n = 1 << BUCKET_BITS
    met = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + ids)
    return np.bincount(labels.astype(np.int64)[met // n] * n + met % n, minlength=2 * n).reshape(2, n)


def _start(seen: np.ndarray, totals: np.ndarray, dims: int, filters: int, min_docs: int, rng: np.random.Generator) -> Model:
    """The model before the first step. Buckets met in ``min_docs`` texts get a row each, with their shrunken log odds."""
    known = np.flatnonzero(seen.sum(0) >= min_docs)
    buckets = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
    buckets[known] = np.arange(1, len(known) + 1)
    share = (seen[:, known] + 1) / (totals[:, None] + 2)
    odds = np.log(share[1] / share[0]) * np.minimum(1, seen[:, known].sum(0) / 20)
    embedding = rng.normal(0, 0.05, (len(known) + 1, dims))
    embedding[1:, 0] += odds
    embedding[0] = 0
    kernels = {w: rng.normal(0, 0.1, (w, dims, filters)) for w in WIDTHS}
    for w in WIDTHS:
        kernels[w][:, 0, 0] += 1 / w
    n_out = filters * len(WIDTHS)
    out = rng.normal(0, 0.1, n_out)
    out[::filters] += 0.5
    rate = np.clip(totals[1] / max(totals.sum(), 1), 0.01, 0.99)
    return Model(buckets, embedding, kernels, np.full(n_out, -0.5), out, np.array([np.log(rate / (1 - rate))]))


def _learn(model: Model, adam: _Adam, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """One step on a few texts; returns the touched rows of the embedding."""
    kernels, filters = model.filters, model.filters[WIDTHS[0]].shape[2]
    rows, starts = _padded(model.buckets[ids], sizes)
    places = _responses(model, rows)
    ends = np.append(starts[1:], len(rows))
    top = np.array([s + places[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
    peak = np.take_along_axis(places, top, axis=0) + model.bias
    hidden = np.maximum(peak, 0)
    z = hidden @ model.out + model.out_bias[0]
    d = (1 / (1 + np.exp(-z)) - labels) / len(labels)
    d_peak = d[:, None] * model.out * (peak > 0)
    words, flows, d_kernels = [], [], []
    for k, w in enumerate(WIDTHS):
        cols = slice(k * filters, (k + 1) * filters)
        flow = d_peak[:, cols]
        grad = np.zeros_like(kernels[w])
        for j in range(w):
            word = rows[np.minimum(top[:, cols] + j, len(rows) - 1)]
            grad[j] = np.einsum("bfd,bf->df", model.embedding[word], flow)
            words.append(word.ravel())
            flows.append((flow[..., None] * kernels[w][j].T[None]).reshape(-1, kernels[w].shape[1]))
        d_kernels.append(grad + 1e-4 * kernels[w])
    touched, place = np.unique(np.concatenate(words), return_inverse=True)
    d_embedding = 1e-4 * model.embedding[touched]
    np.add.at(d_embedding, place, np.concatenate(flows))
    d_embedding[touched == 0] = 0
    adam.update(touched, [d_embedding, *d_kernels, d_peak.sum(0), hidden.T @ d + 1e-4 * model.out, np.array([d.sum()])])
    return touched


def _step_cuts(sizes: np.ndarray, batch: int) -> list[int]:
    """Where steps begin and end: at most ``batch`` texts and STEP_WORDS words, at least one text."""
    cuts, words = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if i > cuts[-1] and (i - cuts[-1] >= batch or words + n > STEP_WORDS):
            cuts.append(i)
            words = 0
        words += n
    return [*cuts, len(sizes)]


def _pass(model: Model, adam: _Adam, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, batch: int, rng) -> np.ndarray:
    """Steps over all the texts in a new order; returns a mark per row of the embedding that was touched."""
    marks = np.zeros(len(model.embedding), dtype=bool)
    ends = np.cumsum(sizes)
    order = rng.permutation(len(sizes))
    cuts = _step_cuts(sizes[order], batch)
    for low, high in zip(cuts, cuts[1:], strict=False):
        at = order[low:high]
        if len(at):
            own = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in at])
            marks[_learn(model, adam, own, sizes[at], labels[at])] = True
    return marks


def _part_scores(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Raw scores in parts of bounded words."""
    ends = np.cumsum(sizes)
    cuts = _step_cuts(sizes, len(sizes) + 1)
    parts = [raw_scores(model, ids[ends[low] - sizes[low] : ends[high - 1]], sizes[low:high]) for low, high in zip(cuts, cuts[1:], strict=False) if high > low]
    return np.concatenate(parts) if parts else np.zeros(0)


def _losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


def train(
    texts: list[np.ndarray],
    labels: np.ndarray,
    dims: int = 8,
    filters: int = 6,
    epochs: int = 8,
    batch: int = 64,
    lr: float = 0.02,
    min_docs: int = 6,
    seed: int = 0,
) -> Model:
    """Fit on four fifths of rows in memory; the last fifth picks the epoch and scales the score.

    ``fit`` does the same on a table of any size."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=float)
    held = np.arange(len(texts)) % 5 == 4

    def flat(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([texts[i] for i in at]) if len(at) else np.zeros(0, np.int64)
        return ids, np.array([len(texts[i]) for i in at], np.int64), labels[at]

    own, other = flat(np.flatnonzero(~held)), flat(np.flatnonzero(held))
    model = _start(_bucket_counts(*own), np.bincount(own[2].astype(int), minlength=2), dims, filters, min_docs, rng)
    adam = _Adam(model.params(), lr)
    best, kept = np.inf, [p.copy() for p in model.params()]
    for _ in range(epochs):
        _pass(model, adam, *own, batch, rng)
        now = _losses(_part_scores(model, *other[:2]), other[2]).mean() if held.any() else 0.0
        if now < best:
            best, kept = now, [p.copy() for p in model.params()]
    for p, k in zip(model.params(), kept, strict=True):
        p[...] = k
    _calibrate(model, _part_scores(model, *other[:2]), other[2], np.ones(len(other[2])))
    return model


def _calibrate(model: Model, z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> None:
    """Logistic scale and shift of the raw score on rows that the fit did not see: ``n`` rows at each z, ``hits`` of label 1."""
    if n.sum() < 20 or not 0 < hits.sum() < n.sum():
        return
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge towards (1, 0)
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = n * p * (1 - p)
        grad = np.array([((n * p - hits) * z).sum() + (a - 1), (n * p - hits).sum() + 0.1 * b])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    if a > 0:
        model.scale, model.shift = float(a), float(b)


def best_threshold(
    low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray, floor: float = 0.3, ceiling: float = 0.9
) -> float | None:
    """The threshold with the best F1 between bins of scores (falling; their least and largest score, rows and rows of
    label 1); None where no threshold is right half of the time."""
    right, told = np.cumsum(hits), np.cumsum(n)
    good = right / told >= 0.5
    if not good.any():
        return None
    f1 = np.where(good, 2 * right / (told + hits.sum()), -1)
    at = int(np.argmax(f1))
    below = high[at + 1] if at + 1 < len(low) else low[at]
    return float(np.clip((low[at] + below) / 2, floor, ceiling))


def _set_thresholds(model: Model, bins: dict[str, np.ndarray], least: int = 60) -> None:
    """A threshold per language; key None: over all. Languages of fewer than ``least`` rows, or where none is right half
    of the time, use the one over all."""

    def best(own: dict[str, np.ndarray]) -> float | None:
        chance = lambda z: 1 / (1 + np.exp(-(model.scale * z + model.shift)))
        return best_threshold(chance(own["low"]), chance(own["high"]), own["n"], own["hits"]) if len(own["n"]) else None

    shared = best({k: v[bins["lang"] == None] for k, v in bins.items()})  # noqa: E711
    model.thresholds = {None: 0.5 if shared is None else shared}
    for lang in sorted({x for x in bins["lang"] if x}):
        own = {k: v[bins["lang"] == lang] for k, v in bins.items()}
        if own["n"].sum() >= least and (t := best(own)) is not None:
            model.thresholds[lang] = t


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size_bytes=SLICE_BYTES):
            ids, sizes = text_buckets(part.column("text"))
            ends = np.cumsum(sizes)
            data = [ids[e - n : e].astype("<i4").tobytes() for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"), part.column("lang"), pa.array(data, pa.binary())],
                names=["doc_id", "toxic", "lang", "words"],
            )


def _flat(part: pa.RecordBatch, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets end to end, words per text and labels of the rows to keep."""
    own = part.filter(pa.array(keep))
    data = own.column("words").to_pylist()
    ids = np.frombuffer(b"".join(data), "<i4").astype(np.int64)
    return ids, np.array([len(x) // 4 for x in data], np.int64), np.asarray(own.column("toxic")).astype(float)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "words", PART_BYTES):
            yield part, np.asarray(part.column("held").to_numpy(zero_copy_only=False), dtype=bool)


def _vocabulary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The texts of each label that hold a bucket, and the texts of each label, over all rows of the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
        for part, held in _parts(batches):
            ids, sizes, y = _flat(part, ~held)
            if len(y):
                seen += _bucket_counts(ids, sizes, y)
                totals += np.bincount(y.astype(int), minlength=2)
        at = np.flatnonzero(seen.sum(0))
        cells = [np.append(at, -1), *[np.append(seen[y, at], totals[y]) for y in range(2)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["bucket", "n0", "n1"])

    counts = rows.mapInArrow(run, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket")
    counts = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen, totals = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
    bucket = counts["bucket"].to_numpy()
    for y in range(2):
        n = counts[f"n{y}"].to_numpy()
        seen[y, bucket[bucket >= 0]] = n[bucket >= 0]
        totals[y] = n[bucket < 0].sum()
    return seen, totals


def _round(rows: DataFrame, model: Model, batch: int, lr: float, seed: int, learn: bool) -> float:
    """The held-out loss of the model as it is, then a pass of steps in every shard and the mean of what they learned.

    A row of the embedding becomes the mean over the shards that touched it, the other parameters the mean over all.
    Sums are of whole numbers, so their order does not matter.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    dims = model.embedding.shape[1]
    names = ["pos", "n", *[f"d{i}" for i in range(dims)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        own = replace(given, embedding=given.embedding.copy(), filters={w: k.copy() for w, k in given.filters.items()},
                      bias=given.bias.copy(), out=given.out.copy(), out_bias=given.out_bias.copy())
        adam, marks = _Adam(own.params(), lr), np.zeros(len(own.embedding), dtype=bool)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        loss, n_held, n_fit = 0.0, 0, 0
        for part, held in _parts(batches):
            ids, sizes, y = _flat(part, held)
            loss += float(_losses(_part_scores(given, ids, sizes), y).sum())
            n_held += len(y)
            if learn:
                ids, sizes, y = _flat(part, ~held)
                marks |= _pass(own, adam, ids, sizes, y, batch, rng)
                n_fit += len(y)
        cells = [np.array([loss] + [0.0] * (dims - 1))[None]]
        pos, n = [[LOSS]], [[n_held]]
        if n_fit:
            at = np.flatnonzero(marks)
            rest = np.concatenate([p.ravel() for p in own.params()[1:]])
            rest = np.pad(rest, (0, -len(rest) % dims)).reshape(-1, dims)
            pos += [at, -1 - np.arange(len(rest))]
            n += [np.ones(len(at), np.int64), np.ones(len(rest), np.int64)]
            cells += [own.embedding[at], rest]
        values = np.rint(np.vstack(cells) * FIXED_POINT).astype(np.int64)
        columns = [np.concatenate(pos).astype(np.int64), np.concatenate(n).astype(np.int64), *values.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    made = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names)).groupBy("pos")
    made = made.agg(*[F.sum(c).alias(c) for c in names[1:]]).orderBy("pos").toArrow()
    shared.destroy()
    pos, n = made["pos"].to_numpy(), made["n"].to_numpy()
    total = np.stack([made[c].to_numpy() for c in names[2:]], axis=1) / FIXED_POINT
    told = pos == LOSS
    words, rest = pos >= 0, (pos < 0) & ~told
    model.embedding[pos[words]] = total[words] / n[words, None]
    flat = (total[rest] / n[rest, None])[::-1].ravel()
    for p in model.params()[1:] if len(flat) else []:
        p[...] = flat[: p.size].reshape(p.shape)
        flat = flat[p.size :]
    return float(total[told, 0].sum() / max(n[told].sum(), 1))


def _held_bins(rows: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Bins of the raw scores of all held-out rows, falling, over all rows (lang null) and per language: rows, rows of
    label 1, least, largest and summed raw score. Their number is bounded by the width of a bin, not by the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _parts(batches):
            ids, sizes, y = _flat(part, held)
            lang = part.filter(pa.array(held)).column("lang")
            yield pa.RecordBatch.from_arrays([lang, pa.array(_part_scores(shared.value, ids, sizes)), pa.array(y)], names=["lang", "z", "y"])

    scored = rows.mapInArrow(run, "lang string, z double, y double")
    names = F.array_distinct(F.array(F.lit(None).cast("string"), F.nullif("lang", F.lit(""))))
    scored = scored.select(F.explode(names).alias("lang"), "z", "y")
    bins = scored.groupBy("lang", F.floor(F.greatest(F.least("z", F.lit(SCORE_LIMIT)), F.lit(-SCORE_LIMIT)) * SCORE_BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.min("z").alias("low"), F.max("z").alias("high"),
        F.sum(F.rint(F.col("z") * FIXED_POINT).cast("bigint")).alias("sum"),
    )
    table = bins.orderBy(F.desc("bin"), "lang").toArrow()
    return {c: np.array(table[c].to_pylist(), dtype=object if c == "lang" else float) for c in ("lang", "n", "hits", "low", "high", "sum")}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    dims: int = 8,
    filters: int = 6,
    epochs: int = 8,
    batch: int = 64,
    lr: float = 0.02,
    min_docs: int = 6,
    seed: int = 0,
    shard_rows: int = SHARD_ROWS,
) -> Model | None:
    """Train on every labelled row; None without labels of both kinds.

    Rows are dealt by their id to shards of about ``shard_rows`` (at most MAX_SHARDS, then larger ones) and stored as bucket
    numbers. An epoch is a pass of steps in every shard, from the same model, and the mean of the models. A fifth of the rows
    is kept out: it picks the epoch, scales the score and sets the thresholds.
    """
    labels = columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    chosen = cut_lineage(labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = chosen.count()
    shards = max(1, min(MAX_SHARDS, -(-n // shard_rows)))
    if n <= BROADCAST_LABELS:
        chosen = F.broadcast(chosen)
    rows = columns(docs, "doc_id", "text", "lang").join(chosen, "doc_id")
    rows = rows.mapInArrow(_hashed, "doc_id bigint, toxic int, lang string, words binary")
    held = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)) == 4
    rows = rows.withColumn("held", held).repartition(shards, "doc_id")
    rows = cut_lineage(rows.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "words"))
    seen, totals = _vocabulary(rows)
    if not totals.all():
        return None
    model = _start(seen, totals, dims, filters, min_docs, np.random.default_rng(seed))
    best, kept = np.inf, []
    for epoch in range(epochs + 1):
        before = [p.copy() for p in model.params()]
        now = _round(rows, model, batch, lr, seed + epoch, learn=epoch < epochs)
        if not kept or (epoch and now < best):
            best, kept = now if epoch else np.inf, before
    for p, k in zip(model.params(), kept, strict=True):
        p[...] = k
    bins = _held_bins(rows, model)
    whole = bins["lang"] == None  # noqa: E711
    _calibrate(model, (bins["sum"] / FIXED_POINT / bins["n"])[whole], bins["hits"][whole], bins["n"][whole])
    _set_thresholds(model, bins)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, threshold (of the row's language), flagged; one row per row of ``docs``."""
    docs = columns(docs, "doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = model.thresholds if model else {}
        for batch in batches:
            for part in slices(batch, size_bytes=SLICE_BYTES):
                ids, sizes = text_buckets(part.column("text"))
                p = scores(model, ids, sizes) if model else np.zeros(len(sizes))
                t = [limits.get(x, limits.get(None, 0.5)) for x in part.column("lang").to_pylist()]
                arrays = [part.column("doc_id"), pa.array(p, pa.float64()), pa.array(t, pa.float64())]
                arrays.append(pa.array(p >= np.array(t)))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "threshold", "flagged"])

    return docs.mapInArrow(run, "doc_id bigint, score double, threshold double, flagged boolean")


def keep_mask(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows whose text is flagged; all columns as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size_bytes=SLICE_BYTES):
                ids, sizes = text_buckets(part.column("text"))
                p = scores(model, ids, sizes) if model else np.zeros(len(sizes))
                limits = model.thresholds if model else {}
                t = [limits.get(x, limits.get(None, 0.5)) for x in part.column("lang").to_pylist()]
                yield part.filter(pa.array(~(p >= np.array(t))))

    return docs.mapInArrow(run, docs.schema) if model else docs
