"""Seeded order and uniform numbers that depend on the key alone, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """In [0, 1), with 32 bits."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
