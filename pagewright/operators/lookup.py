"""Joins with a table that has one row per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` (distinct in ``key``) on ``key``.

    Any share of ``left`` may carry one key.  Adaptive execution splits such a
    key, but only when both sides were shuffled for the join itself; a side
    grouped by the key would be joined in place, its partition unsplittable.
    The hash as a second join key makes that side move once more: it is the
    small side.  Where it is small enough Spark broadcasts it instead.
    """
    on = f"__hash_{key}"
    joined = left.withColumn(on, F.xxhash64(key)).join(right.withColumn(on, F.xxhash64(key)), [on, key], how)
    return joined.drop(on)
