"""Comparisons between areas and the numbers behind the map and trend views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.operators import market, order_stats

DAYS_PER_YEAR = 365.25
QUARTILES = (0.25, 0.5, 0.75)


def trend_line(points: DataFrame, x: str = "bedrooms", y: str = "price") -> DataFrame:
    """Least-squares line and its ends at the extreme x; NULL when x does not vary."""
    fit = points.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    )
    return fit.select(
        "x_min", "x_max",
        (F.col("slope") * F.col("x_min") + F.col("intercept")).alias("y_at_min"),
        (F.col("slope") * F.col("x_max") + F.col("intercept")).alias("y_at_max"),
    )


def map_points(properties: DataFrame, latest: DataFrame, limit: int | None = None) -> DataFrame:
    """Located properties with their latest price."""
    located = properties.where(
        F.col("postcode").isNotNull() & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    )
    prices = latest.select(F.col("property_id").alias("id"), "latest_price")
    points = located.join(prices, "id", "left").select(
        "id", "address", "postcode", "latitude", "longitude", "latest_price",
        "property_type", "bedrooms",
    )
    return points.orderBy("id").limit(limit) if limit else points


def quartile_cuts(points: DataFrame, value: str = "latest_price") -> DataFrame:
    return order_stats.quantile_points(points, value, QUARTILES)


def quartile_bands(points: DataFrame, value: str = "latest_price") -> DataFrame:
    """Band 1 (cheapest) to 4 per point, NULL without a price."""
    cuts = market.single_row(quartile_cuts(points, value))
    price = F.col(value)
    band = (
        F.when(price <= F.col("_c.q25"), 1).when(price <= F.col("_c.q50"), 2)
        .when(price <= F.col("_c.q75"), 3).when(price.isNotNull(), 4)
    )
    return points.withColumn("_c", cuts).withColumn("band", band).drop("_c")


def map_centre(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))


def area_comparison(base: DataFrame, key: str = "postcode") -> DataFrame:
    """Priced and dated sales, types and streets per area; the base carries ``street``."""
    priced = F.col("price_numeric").isNotNull()
    return base.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(priced).alias("properties"),
        F.count_if(F.col("date_sold_iso").isNotNull()).alias("total_sales"),
        F.countDistinct(F.when(priced, F.col("type_key"))).alias("property_types"),
        F.countDistinct(F.when(priced, F.col("street"))).alias("streets"),
    )


def aligned_series(rows: DataFrame, key: str, area: str, areas: Sequence[str], value: str,
                   fill: int | None = None) -> DataFrame:
    """One row per key, one column per chosen area; gaps NULL or ``fill``.

    The areas are named by the caller, so the pivot needs no extra pass.
    """
    wide = (
        rows.where(F.col(area).isin(*areas)).groupBy(key).pivot(area, list(areas))
        .agg(F.first(value))
    )
    return wide.fillna(fill, subset=list(areas)) if fill is not None else wide


def property_appreciation(sales: DataFrame) -> DataFrame:
    """Total and annualised change from the first to the last priced sale."""
    rows = sales.where(
        F.col("date_sold_iso").isNotNull() & F.col("price_numeric").isNotNull()
        & (F.col("price_numeric") != 0)
    )
    order = F.struct("date_sold_iso", "id")
    ends = rows.groupBy("property_id").agg(
        F.min_by("price_numeric", order).alias("first_price"),
        F.max_by("price_numeric", order).alias("last_price"),
        F.min("date_sold_iso").alias("first_date"),
        F.max("date_sold_iso").alias("last_date"),
        F.count("*").alias("n"),
    ).where(F.col("n") >= 2)
    ratio = F.col("last_price") / F.col("first_price")
    years: Column = F.datediff(
        F.col("last_date").cast("date"), F.col("first_date").cast("date")
    ) / DAYS_PER_YEAR
    return ends.select(
        "property_id", "first_price", "last_price", "first_date", "last_date",
        ((ratio - 1) * 100).alias("total_change_pct"),
        F.when(years > 0, (F.pow(ratio, 1 / years) - 1) * 100).alias("annualised_pct"),
    )
