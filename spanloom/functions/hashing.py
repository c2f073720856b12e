"""Stable hashes: the same row gets the same value on every run and every executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The document split hashes this many characters into this many buckets.
SPLIT_PREFIX = 200
SPLIT_BUCKETS = 1000


def hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def split_bucket(text: Column) -> Column:
    digest = F.sha2(F.substring(text, 1, SPLIT_PREFIX), 256)
    return hex_number(digest, 1, 8) % SPLIT_BUCKETS


def is_val(text: Column, fraction: float) -> Column:
    if fraction <= 0.0:
        return F.lit(False)
    return split_bucket(text) < int(fraction * SPLIT_BUCKETS)


def order_key(seed: int, *ids: str) -> Column:
    """Sorting by this key shuffles rows; another seed gives another order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]), 256)


def unit_uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 drawn from the given values."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (hex_number(digest, 1, 12).cast("double") + 0.5) / float(16**12)
