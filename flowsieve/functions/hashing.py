"""Seeded, engine-independent random order: md5 over ``seed:id``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_md5(seed: object, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def order_key(seed: object, row_id: Column) -> Column:
    """The first 60 bits of the md5, as bigint. It sorts like the md5 text."""
    return F.conv(F.substring(seeded_md5(seed, row_id), 1, HASH_BITS // 4), 16, 10).cast("bigint")
