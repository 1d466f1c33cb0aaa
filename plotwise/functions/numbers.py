"""Rounding and finite-number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole(value: Column) -> Column:
    """Round half to even and return a BIGINT."""
    return F.bround(value, 0).cast("bigint")


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def percent_change(new: Column, old: Column) -> Column:
    """(new - old) / old * 100; NULL when ``old`` is zero or NULL."""
    base = F.nullif(old.cast("double"), F.lit(0.0))
    return (new.cast("double") - base) / base * 100.0


def finite(value: Column) -> Column:
    """Cast to double; text that is no number, NaN and infinities become NULL."""
    number = value.try_cast("double")
    return F.when(
        ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number
    )


def clamp_to(value: Column, sql_type: str) -> Column:
    """Clip to the range of a small integer type, round half to even, cast."""
    low, high = {"byte": (-128, 127), "short": (-32768, 32767)}[sql_type]
    clipped = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), F.bround(clipped, 0).cast(sql_type))
