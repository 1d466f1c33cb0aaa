"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a table of short rows is sent to every executor.
FEW = 200_000


def if_few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df``, which should be materialised, to be broadcast if it has few rows.

    Larger tables are left to Spark, which shuffles both sides of a join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
