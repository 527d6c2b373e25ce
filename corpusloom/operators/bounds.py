"""Size checks that decide between a broadcast and a shuffle.

A side is broadcast only after its rows were counted and found under a fixed limit. Above the
limit the same DataFrame goes back unhinted: Spark then shuffles both sides and adaptive
execution splits skewed partitions, so results never depend on the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000


def count_up_to(df: DataFrame, limit: int) -> int:
    """Row count, but never more work or a larger answer than ``limit + 1`` rows."""
    return df.limit(limit + 1).count()


def hint_small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df

