"""Joins of a large table with a lookup table of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Bytes of a value of fixed size, with its place in a row.
_FIXED_BYTES = 16


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a table take; one aggregate, nothing moves."""
    total = F.lit(_FIXED_BYTES)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0)) + _FIXED_BYTES
        elif kind.startswith("array"):
            total = total + F.greatest(F.size(name), F.lit(0)) * _FIXED_BYTES
        else:
            total = total + _FIXED_BYTES
    return df.agg(F.sum(total.cast("bigint"))).first()[0] or 0


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    *salt_by: str,
    max_broadcast_bytes: int = 64 << 20,
    salts: int = 32,
    how: str = "inner",
) -> DataFrame:
    """Join on ``key``, whose values may be very uneven in ``rows`` and are unique in ``lookup``.

    A lookup of checked size is broadcast. A larger one is copied ``salts`` times and joined
    on the key and a salt from ``salt_by``, so a hot key is shared by many tasks.
    """
    if table_bytes(lookup) <= max_broadcast_bytes:
        return rows.join(F.broadcast(lookup), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return salted.join(lookup.withColumn("_salt", copies), [key, "_salt"], how).drop("_salt")
