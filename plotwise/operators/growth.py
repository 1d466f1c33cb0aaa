"""Capital growth per postcode: medians, CAGR, volatility, drawdown, forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.numbers import half_even, whole
from plotwise.operators import order_stats

DEFAULT_PERIODS = (1, 3, 5, 10)
FORECAST_HORIZONS = (1, 3, 5)
MAX_PERIODS, MAX_PERIOD_YEARS = 10, 30
BASE_YEAR = 2000.0  # keeps the regression sums small


def parse_periods(periods: str) -> list[int]:
    """``"1,3,5"`` to a list: whole years from 1 to 30, at most ten of them; anything else is an error."""
    years = [int(part) for part in periods.split(",")]
    if len(years) > MAX_PERIODS or not all(1 <= y <= MAX_PERIOD_YEARS for y in years):
        raise ValueError(f"expected up to {MAX_PERIODS} periods of 1 to {MAX_PERIOD_YEARS} years, got {periods!r}")
    return years


def annual_medians(base: DataFrame, key: str = "postcode") -> DataFrame:
    """Median price and sale count per key and year."""
    rows = base.where(
        F.col("price_numeric").isNotNull() & F.col("date_sold_iso").isNotNull()
        & F.col(key).isNotNull()
    )
    stats = order_stats.price_stats(rows, [key, "year"], "price_numeric")
    return stats.select(
        key, "year", whole(F.col("median")).alias("median_price"),
        F.col("count").alias("sale_count"),
    )


def _cagr(start: Column, end: Column, years: Column) -> Column:
    rate = F.pow(end.cast("double") / start, F.lit(1.0) / years) - 1
    return F.when((start > 0) & (years > 0), half_even(rate * 100, 2))


def _history(medians: DataFrame, key: str, price: str) -> DataFrame:
    """One row per key with its yearly points, at most one per calendar year."""
    return medians.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("year", F.col(price).alias("price")))).alias("points")
    )


def _start_point(period: Column) -> Column:
    """First point not older than ``period`` years before the last point."""
    last_year = F.element_at("points", -1)["year"]
    return F.get(F.filter("points", lambda p: p["year"] >= last_year - period), 0)


def cagr_periods(medians: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS,
                 key: str = "postcode") -> DataFrame:
    """CAGR over each period, from the first year inside it to the last year."""
    wanted = F.explode(F.array(*[F.lit(int(p)) for p in periods])).alias("period_years")
    rows = _history(medians, key, "median_price").select(key, "points", wanted)
    start = _start_point(F.col("period_years"))
    end = F.element_at("points", -1)
    return rows.select(
        key, "period_years", start.alias("s"), end.alias("e")
    ).select(
        key, "period_years",
        _cagr(F.col("s.price"), F.col("e.price"), F.col("e.year") - F.col("s.year")).alias("cagr_pct"),
        F.col("s.price").alias("start_price"),
        F.col("e.price").alias("end_price"),
    )


def growth_leaderboard(base: DataFrame, limit: int = 20, period: int = 5,
                       key: str = "postcode") -> DataFrame:
    """Keys with the highest CAGR of yearly mean prices over the period."""
    rows = base.where(
        F.col(key).isNotNull() & F.col("price_numeric").isNotNull()
        & F.col("date_sold_iso").isNotNull()
    )
    yearly = rows.groupBy(key, "year").agg(
        F.avg("price_numeric").alias("mean_price"), F.count("*").alias("n")
    )
    per_key = yearly.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("year", F.col("mean_price").alias("price")))
        ).alias("points"),
        F.sum("n").alias("sale_count"),
    )
    first, last = F.get("points", 0), F.element_at("points", -1)
    start = _start_point(F.lit(period))
    scored = per_key.select(
        key, "sale_count",
        (last["year"] - first["year"]).alias("data_years"),
        _cagr(start["price"], last["price"], last["year"] - start["year"]).alias("cagr_pct"),
        whole(last["price"]).alias("latest_avg"),
    )
    return (
        scored.where((F.col("data_years") >= min(period, 2)) & F.col("cagr_pct").isNotNull())
        .orderBy(F.desc("cagr_pct"), key).limit(limit)
    )


def volatility(medians: DataFrame, key: str = "postcode") -> DataFrame:
    """Sample deviation of year-on-year returns, with three or more medians."""
    by_year = Window.partitionBy(key).orderBy("year")
    previous = F.lag("median_price").over(by_year)
    returns = medians.withColumn(
        "ret", F.when(previous > 0, (F.col("median_price") - previous) / previous * 100)
    )
    return returns.groupBy(key).agg(
        F.count("*").alias("n"), F.count("ret").alias("n_returns"),
        F.stddev_samp("ret").alias("sd"),
    ).select(
        key,
        F.when((F.col("n") >= 3) & (F.col("n_returns") >= 2), half_even(F.col("sd"), 2))
        .alias("volatility_pct"),
    )


def max_drawdown(medians: DataFrame, key: str = "postcode") -> DataFrame:
    """Largest fall below the running peak in percent; NULL when there is none."""
    so_far = (
        Window.partitionBy(key).orderBy("year")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    peak = F.max("median_price").over(so_far)
    falls = medians.withColumn(
        "fall", F.when(peak > 0, (peak - F.col("median_price")) / peak * 100)
    )
    worst = F.max("fall")
    return falls.groupBy(key).agg(
        F.when((F.count("*") >= 2) & (worst > 0), half_even(worst, 2)).alias("max_drawdown_pct")
    )


def data_span(medians: DataFrame, key: str = "postcode") -> DataFrame:
    return medians.groupBy(key).agg((F.max("year") - F.min("year")).alias("data_years"))


def forecast(medians: DataFrame, key: str = "postcode",
             horizons: Sequence[int] = FORECAST_HORIZONS,
             sample_band: bool = False) -> DataFrame:
    """Least-squares line through the medians, carried forward with a residual band.

    The residual deviation follows from the sums of squares of the same pass,
    sd² = (Syy - slope · Sxy) / n, so one aggregation fits the line and the band.
    The band is the population deviation over three or more points; with
    ``sample_band`` it is the sample deviation over two or more.
    """
    x = F.col("year").cast("double") - F.lit(BASE_YEAR)
    y = F.col("median_price").cast("double")
    fit = medians.groupBy(key).agg(
        F.count("*").alias("n"),
        F.max("year").alias("latest_year"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("squares"),
    ).where((F.col("n") >= (2 if sample_band else 3)) & F.col("slope").isNotNull())
    freedom = F.col("n") - 1 if sample_band else F.col("n")
    year = F.col("latest_year") + F.col("horizon")
    ahead = (
        fit.withColumn("sd", F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / freedom))
        .withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
        .withColumn("expected", F.col("slope") * (year - BASE_YEAR) + F.col("intercept"))
    )

    def floored(value: Column) -> Column:
        # Settle float noise first, so that an exact half rounds as a half.
        return whole(F.round(F.greatest(value, F.lit(0.0)), 6))

    return ahead.select(
        key, year.alias("year"),
        floored(F.col("expected")).alias("predicted_price"),
        floored(F.col("expected") - F.col("sd")).alias("lower_bound"),
        floored(F.col("expected") + F.col("sd")).alias("upper_bound"),
    )
