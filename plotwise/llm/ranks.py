"""Gapless ranks within a group without one task holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_rank(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each value of ``by``.

    Rows are dealt into slices by a hash of ``order``; slices are counted, the counts
    summed up in the order of the slices, and rows numbered inside their slice. There
    are as many slices as shuffle partitions, so a group that holds most rows is still
    spread over all tasks. Rows equal in ``order`` are numbered in no particular order.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = sliced.groupBy(by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("_by"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(by, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, (ranked[by] == offsets["_by"]) & (ranked["_slice"] == offsets["_of"]))
    return joined.select(*[c for c in df.columns if c != name], (F.col("_offset") + F.col("_rank")).cast("long").alias(name))
