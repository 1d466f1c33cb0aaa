"""Exact order statistics that do not pull a group of rows into one task.

Rows are first reduced to (keys, value, count). That shuffle spreads a hot key
over its values, and what is left per key is one row per distinct value, which
for whole-pound prices is bounded by the price range and not by the row count.
A running count over the sorted values then locates any rank; the window sorts
and spills, it never holds a group in a hash map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Width of the value ranges that split the ungrouped case over many tasks.
RANGE_WIDTH = 1000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) with NULL values left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def with_running_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``upto`` (rows at or below the value) and ``total`` (rows of the key)."""
    if keys:
        spread = Window.partitionBy(*keys)
        upward = spread.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("upto", F.sum("n").over(upward)).withColumn(
            "total", F.sum("n").over(spread)
        )
    return _ungrouped_running_counts(counts, value)


def _ungrouped_running_counts(counts: DataFrame, value: str) -> DataFrame:
    """Running counts without a key, split into value ranges.

    Only one row per range meets in a single task, to add up the range offsets.
    """
    # A NULL value can only come with a count of zero; any range may hold it.
    ranged = counts.withColumn("_range", F.coalesce(F.floor(F.col(value) / RANGE_WIDTH), F.lit(0)))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_size"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(every).alias("total"),
    )
    inside = (
        Window.partitionBy("_range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.join(offsets, "_range")
        .withColumn("upto", F.col("_offset") + F.sum("n").over(inside))
        .drop("_range", "_offset")
    )


def at_rank(value: Column, rank: Column) -> Column:
    """Aggregate: the value at a 0-based rank, given running counts."""
    return F.min(F.when(F.col("upto") > rank, value))


def fraction_rank(q: float) -> Column:
    """0-based rank floor(total * q)."""
    return F.floor(F.col("total") * F.lit(q))


def median_expr(value: str) -> Column:
    """Aggregate: mean of the middle two values, given running counts."""
    low = at_rank(F.col(value), F.floor((F.col("total") - 1) / 2))
    high = at_rank(F.col(value), F.floor(F.col("total") / 2))
    return (low + high) / 2.0


def mean_expr(value: str) -> Column:
    """Aggregate: mean over (value, n) rows."""
    return F.sum(F.col(value).cast("double") * F.col("n")) / F.sum("n")


def stats_of_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: count, mean, median, upper median, minimum and maximum of (value, n) rows."""
    return with_running_counts(counts, keys, value).groupBy(*keys).agg(
        F.sum("n").alias("count"),
        mean_expr(value).alias("avg"),
        median_expr(value).alias("median"),
        at_rank(F.col(value), fraction_rank(0.5)).alias("upper_median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def price_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return stats_of_counts(value_counts(df, keys, value), keys, value)


def quantile_points(df: DataFrame, value: str, quantiles: Sequence[float]) -> DataFrame:
    """One row with the element at rank floor(n * q) for each quantile."""
    ranked = with_running_counts(value_counts(df, [], value), [], value)
    return ranked.agg(*[
        at_rank(F.col(value), fraction_rank(q)).alias(f"q{round(q * 100)}") for q in quantiles
    ])
