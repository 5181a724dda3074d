"""Reproducible draws: every random choice is a hash of a text key, never ``rand()``.

The value depends only on the key, so a retried task or another partitioning draws the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def order_hash(*parts) -> Column:
    """32 hex digits that put rows in a shuffled but repeatable order."""

    return F.md5(_text(*parts))


def hash_key(*parts) -> Column:
    """Integer in [0, 2^32)."""

    return F.conv(F.substring(F.md5(_text(*parts)), 1, 8), 16, 10).cast("bigint")


def fn_hash_uniform(*parts) -> Column:
    """Double in [0, 1)."""

    return hash_key(*parts) / F.lit(4294967296.0)
