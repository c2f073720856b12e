"""Cuts by the block tree against all units of the text, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from spanloom.llm import fill_middle as fim
from tests.llm.fixtures import documents, texts

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def plain(doc_id, text, seed=1):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), out


AWKWARD = [
    (600, "<P>"), (601, "a <S> b"), (602, "<M"), (603, "<"), (604, "<S" * 40), (605, "P>" * 50), (606, "\n\n\r\t\0x"),
    (607, "\U0001f600" * 3000), (608, "letters" * 3000), (609, "é" + "abc" * 2000 + "é"), (610, "."), (-3, "minus one two"),
]


def test_against_all_units(spark):
    rows = texts() + AWKWARD
    got = fim.restore(fim.transform(documents(spark, rows))).collect()
    mine = sorted(repr((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got)
    assert mine == sorted(repr((str(d), *plain(d, t))) for d, t in rows)
    assert sorted((str(r.doc_id), r.restored) for r in got) == sorted((str(d), t or "") for d, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_text_over_a_slice(spark):
    rng = random.Random(8)
    long = "".join(rng.choice(["word", "Été", " ", "\n", "\U0001f600", "x" * 9000, "7"]) for _ in range(4000))
    assert len(long.encode()) > 4 << 20
    rows = [(i, long[i:]) for i in range(6)]
    got = fim.restore(fim.transform(documents(spark, rows))).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted(
        ((d, *plain(d, t)) for d, t in rows)
    )
    assert all(r.restored == long[r.doc_id :] for r in got)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_every_cut(block):
    text = "ab cé\U0001f600D  e9fgh\n" * 3
    units = UNIT.findall(text)
    tree = fim.BlockTree(np.frombuffer(text.encode(), np.uint8), block)
    assert tree.totals() == (len(units), len(text))
    for u in range(len(units) + 1):
        head = "".join(units[:u])
        assert tree.cut(u) == (len(head.encode()), len(head))


def test_rates_and_seed(spark):
    rows = [(i, "one two three") for i in range(300)]
    forms = lambda **how: [r.form for r in fim.transform(documents(spark, rows), **how).collect()]
    assert set(forms(formed=0)) == {"plain"}
    assert set(forms(formed=100, suffix_first=0)) == {"psm"} and set(forms(formed=100, suffix_first=100)) == {"spm"}
    assert forms(seed=1) != forms(seed=2)
    assert fim.transform(documents(spark, [])).count() == 0
