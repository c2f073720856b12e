"""Pieces against the tokenizer itself, packing against its rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import pack_bins
from tests.llm.fixtures import documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
MORE = [
    (900, "a  b   c \n d\n\n e"), (901, "x<|endoftext|>y z"), (902, " lead and trail "),
    (903, "nbsp  here 　x"), (904, "it's we'll\tTab\r\nline 1234 5,6!"), (905, " "), (906, "\u0085   a"),
]


def pieces_of(text, capacity):
    ids = [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        yield k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(spark, capacity):
    rows = texts() + MORE
    pieces = pack_bins.token_pieces(documents(spark, rows), PATH, capacity)
    got = pack_bins.pack(pieces, capacity).collect()
    want = Counter((d, *p) for d, t in rows for p in pieces_of(t, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spots in bins.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert pack_bins.pack(pack_bins.token_pieces(documents(spark, []), PATH)).count() == 0


def best_fit(lengths, capacity):
    """Number of sequences of best fit, longest first, one by one."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    lengths = [min(200, int(rng.expovariate(1 / 60)) + 1) for _ in range(400)] + [200] * 9 + [100] * 7
    plan = pack_bins.plan_bins(Counter(lengths), 200)
    content = defaultdict(int)
    seen = defaultdict(int)
    large = defaultdict(int)
    for length, rank, n, first, offset in plan:
        assert rank == seen[length]
        seen[length] += n
        for b in range(first, first + n):
            assert content[b] == offset
            content[b] += length
            large[b] += length * 3 > 200
    assert seen == Counter(lengths)
    assert max(content.values()) <= 200 and max(large.values()) <= 2
    assert len(content) <= best_fit(lengths, 200) + 2


def test_full_memory_of_chunks(monkeypatch):
    """With more distinct chunks than the encoder remembers, and with chunks it must tell apart one by one."""
    import pyarrow as pa

    monkeypatch.setattr(pack_bins, "MAX_CHUNKS", 60)
    monkeypatch.setattr(pack_bins, "_JOINED", 7)
    encoder, plain = pack_bins.Encoder(PATH), Tokenizer.from_file(PATH)
    rows = [t or "" for _, t in texts()[:60] + MORE] + ["don't  stop 've  it'll", " a", "a ", "\n \n x y", "<|endoftext|> a  <|endoftext|>"]
    for lo in range(0, len(rows), 9):
        part = rows[lo : lo + 9]
        seen = 0
        for which, lists in pack_bins.chunk_lists(pa.array(part, pa.string())):
            ids, sizes = encoder.encode(lists)
            cut = np.split(ids, np.cumsum(sizes)[:-1])
            for k, got in zip(which, cut, strict=True):
                assert got.tolist() == [*plain.encode(part[k], add_special_tokens=False).ids, 0]
                seen += 1
        assert seen == len(part)
    assert len(encoder.names) < 2000


def test_doubled_blanks_stay_in_their_chunk():
    import pyarrow as pa

    (_, even), (_, odd) = pack_bins.chunk_lists(pa.array(["a b c", "a  b c\n d e "]))
    assert even.to_pylist() == [["a", "b", "c"]] and odd.to_pylist() == [["a  b", "c\n d", "e "]]
