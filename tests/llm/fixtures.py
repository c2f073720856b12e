"""Small tables with the awkward cases: nulls, empty and long texts, copies, clashing columns."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta river stone cloud paper light green seven north small house winter".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    base = [sentence(rng, rng.randrange(5, 120)) for _ in range(40)]
    rows: list[tuple] = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(12)]  # exact copies
    rows += [(200 + i, base[i] + " tail") for i in range(12)]  # near copies
    rows += [(300 + i, sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 30)) for i in range(9)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, None), (404, "one"), (405, "Two WORDS")]
    rows += [(406, "Été 中文 \U0001f600 " * 30), (407, "ab " * 900), (408, sentence(rng, 3000))]
    rows += [(5, base[5]), (None, base[3]), (None, None)]  # repeated rows and null ids
    return rows


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, words string, row bigint, start bigint"


def documents(spark, rows: list[tuple] | None = None):
    """With columns whose names the operators use inside."""
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "src0", len(t or ""), "x", "y", 1, 2) for i, t in rows]
    return spark.createDataFrame(full, DOCS)
