"""Seeded hash draws.

Draws come from MD5 of the seed and the row's keys, so a sample depends on the
data only, never on partitioning, retries or task order, and any SQL engine can
replay it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 12
HASH_SPAN = 16**_HEX


def hash_key(seed, *cols) -> Column:
    """Hex digest of ``seed|col|col...`` used as a random sort key."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(seed, *cols) -> Column:
    """Uniform integer in [0, 16**12) as a long."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, _HEX), 16, 10).cast("long")


def hash_index(size, seed, *cols) -> Column:
    """Uniform index in [0, size)."""
    return hash_int(seed, *cols) % size


def hash_sign(seed, *cols) -> Column:
    """+1 or -1 with equal chance."""
    return F.when(hash_int(seed, *cols) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
