"""Ordering operators: rank is always a 0-based column, row order carries no meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores are compared at this precision: a distributed sum of doubles depends on the order of
# its terms, and equal documents have to tie for the id to decide.
ORDER_DIGITS = 9


def order_units(score: Column) -> Column:
    """A score in whole units of the last compared digit; ``PartialTopK`` does the same arithmetic, bit for bit."""
    return F.floor(score * float(10**ORDER_DIGITS) + 0.5)


def by_score(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return order_units(score).desc()


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group, with their 0-based rank.

    ``row_number() <= constant``, written exactly so, becomes a WindowGroupLimit. It cuts every
    input partition to ``k`` rows per group before the shuffle: a group holding a third of all rows
    still reaches its task as at most ``k`` rows per input partition.
    """
    window = W.partitionBy(*by).orderBy(*order)
    first = df.withColumn("_number", F.row_number().over(window)).where(F.col("_number") <= k)
    return first.withColumn(rank, F.col("_number") - 1).drop("_number")


def _split_points(df: DataFrame, key: str, buckets: int, sample: int) -> list:
    """Key values cutting the table into about equal ranges.

    They come from the rows with the smallest key hashes: a fixed-size, repeatable sample. They
    steer balance only, never the result.
    """
    rows = df.select(key).orderBy(F.xxhash64(key), key).limit(sample).collect()
    values = sorted(row[0] for row in rows if row[0] is not None)
    step = max(1, len(values) // buckets)
    return sorted(set(values[step::step]))


def spread_row_number(
    df: DataFrame,
    by: str,
    key: str,
    position: str = "position",
    size: str = "group_size",
    buckets: int | None = None,
    sample: int = 2000,
) -> DataFrame:
    """0-based position in ``by`` ordered by ``key``, and the group size, without a one-task group.

    A plain window sorts each group in one task. Here the key range is cut into buckets, rows are
    numbered inside (group, bucket), and the per-bucket counts, a table of at most groups x buckets
    rows, supply the offsets.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _split_points(df, key, buckets, sample)
    bucket = F.lit(0)
    if points:
        bounds = F.array(*[F.lit(point) for point in points])
        bucket = F.size(F.filter(bounds, lambda bound: bound <= F.col(key)))
    marked = df.withColumn("_bucket", bucket)

    counts = marked.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        by,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(by)).alias(size),
    )
    inside = W.partitionBy(by, "_bucket").orderBy(key)
    return (
        marked.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [by, "_bucket"])
        .withColumn(position, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )
