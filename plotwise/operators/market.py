"""Market-wide and per-postcode aggregates.

Every operator takes the sale-property base of ``sales.sales_with_property`` and
a list of grouping keys: no key is the whole market, ``["postcode_clean"]`` is
every postcode at once, and one postcode is a filter in front of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import text
from plotwise.functions.numbers import whole
from plotwise.operators import order_stats
from plotwise.operators.sales import display_type


def priced() -> Column:
    return F.col("price_numeric").isNotNull()


def dated() -> Column:
    return F.col("date_sold_iso").isNotNull()


def single_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns)).scalar()


def presented(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Sort a market-wide result; a result per key stays unsorted, since a global
    sort would shuffle it once more only to be filtered down to one key."""
    return df if keys else df.orderBy(*order)


def overview_totals(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: postcodes, properties, sales, date range, mean price."""
    held = properties.agg(
        F.countDistinct("postcode").alias("total_postcodes"),
        F.count("*").alias("total_properties"),
    )
    sold = sales.agg(
        F.count("*").alias("total_sales"),
        F.min("date_sold_iso").alias("earliest"),
        F.max("date_sold_iso").alias("latest"),
        whole(F.avg("price_numeric")).alias("avg_price"),
    )
    return sold.withColumn("_held", single_row(held)).select(
        "_held.total_postcodes", "_held.total_properties",
        "total_sales", "earliest", "latest", "avg_price",
    )


def overall_upper_median(sales: DataFrame) -> DataFrame:
    """One row: the price at 0-based rank n // 2."""
    stats = order_stats.price_stats(sales, [], "price_numeric")
    return stats.select(F.col("upper_median").cast("bigint").alias("median_price"))


def price_bands(sales: DataFrame) -> DataFrame:
    """Sales per fixed price band, empty bands shown with zero."""
    return bands_of_counts(order_stats.value_counts(sales, [], "price_numeric"))


def bands_of_counts(counts: DataFrame) -> DataFrame:
    """Sales per price band of (price_numeric, n) rows."""
    labels = [name for name, _, _ in text.PRICE_BANDS]
    bands = counts.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate(labels)], "band int, range string"
    )
    counted = (
        counts.groupBy(text.price_band(F.col("price_numeric")).alias("range"))
        .agg(F.sum("n").alias("n"))
    )
    return (
        bands.join(counted, "range", "left")
        .select("band", "range", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
        .orderBy("band")
    )


def top_postcodes(base: DataFrame, limit: int = 10) -> DataFrame:
    """Postcodes with the most sales."""
    return (
        base.where(F.col("postcode").isNotNull()).groupBy("postcode")
        .agg(F.count("*").alias("count"), whole(F.avg("price_numeric")).alias("avg_price"))
        .orderBy(F.desc("count"), "postcode").limit(limit)
    )


def _mean_and_count(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.where(priced()).groupBy(*keys).agg(
        F.count("*").alias("count"), whole(F.avg("price_numeric")).alias("avg_price")
    )


def type_breakdown(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    counted = _mean_and_count(base, [*keys, "type_key"]).withColumnRenamed("type_key", "property_type")
    return presented(counted, keys, F.desc("count"), "property_type")


def bedroom_distribution(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    known = base.where(F.col("bedrooms").isNotNull())
    return presented(_mean_and_count(known, [*keys, "bedrooms"]), keys, "bedrooms")


def sales_volume(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sales per year; unpriced sales count too."""
    counted = base.where(dated()).groupBy(*keys, "year").agg(F.count("*").alias("count"))
    return presented(counted, keys, "year")


def monthly_trend(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, true median, extremes and count of prices per month."""
    rows = base.where(priced() & dated())
    stats = order_stats.price_stats(rows, [*keys, "month"], "price_numeric")
    trend = stats.select(
        *keys, "month",
        whole(F.col("avg")).alias("avg_price"),
        whole(F.col("median")).alias("median_price"),
        F.col("min").alias("min_price"),
        F.col("max").alias("max_price"),
        "count",
    )
    return presented(trend, keys, "month")


def recent_sales(base: DataFrame, limit: int = 50) -> DataFrame:
    """Newest priced sales, highest id first within a day."""
    return (
        base.where(priced() & dated())
        .select(
            "sale_id", "property_id", "address", "postcode",
            F.col("price_numeric").alias("price"),
            F.col("date_sold_iso").alias("date_sold"),
            display_type().alias("property_type"),
            "bedrooms",
        )
        .orderBy(F.desc("date_sold"), F.desc("sale_id")).limit(limit)
    )


def with_street(properties: DataFrame) -> DataFrame:
    """Add the street of the address, once per property rather than per sale."""
    return properties.withColumn("street", text.street_of(F.col("address")))


def street_comparison(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean price and count per street; the base must carry ``street``."""
    return presented(_mean_and_count(base, [*keys, "street"]), keys, F.desc("avg_price"), "street")


def postcode_comparison(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    known = base.where(F.col("postcode").isNotNull())
    return presented(_mean_and_count(known, [*keys, "postcode"]), keys, F.desc("avg_price"), "postcode")


SUMMARY_FACETS = ("month", "type_key", "street", "postcode", "bedrooms", "year")


def summary_grouping_sets(base: DataFrame, key: str = "postcode_clean") -> DataFrame:
    """Count and mean price per postcode and facet, all six facets in one pass.

    One scan and one shuffle through GROUPING SETS; ``facet`` names the column
    that ``value`` comes from. The year facet also counts unpriced sales. Months
    also have extremes and a true median, which is found from price counts, so that
    no group of prices is held in memory.
    """
    slim = base.select(
        key, "price_numeric", *[F.col(c).cast("string").alias(c) for c in SUMMARY_FACETS]
    )
    sets = slim.groupingSets(
        [[key, facet] for facet in SUMMARY_FACETS], key, *SUMMARY_FACETS
    ).agg(
        F.count("*").alias("rows"),
        F.count("price_numeric").alias("priced_rows"),
        whole(F.avg("price_numeric")).alias("avg_price"),
        F.min("price_numeric").alias("low"), F.max("price_numeric").alias("high"),
        *[F.grouping(facet).alias(f"_g_{facet}") for facet in SUMMARY_FACETS],
    )
    facet_name = F.coalesce(*[
        F.when(F.col(f"_g_{facet}") == 0, F.lit(facet)) for facet in SUMMARY_FACETS
    ])
    facet_value = F.coalesce(*SUMMARY_FACETS)
    is_year, is_month = F.col("facet") == "year", F.col("facet") == "month"
    medians = order_stats.price_stats(base.where(priced() & F.col("month").isNotNull()), [key, "month"], "price_numeric").select(
        F.col(key).alias("_key"), F.col("month").alias("_month"), whole(F.col("median")).alias("median"))
    return (
        sets.select(
            key, facet_name.alias("facet"), facet_value.alias("value"),
            "rows", "priced_rows", "avg_price", "low", "high",
        )
        .where(F.col("value").isNotNull())
        .withColumn("count", F.when(is_year, F.col("rows")).otherwise(F.col("priced_rows")))
        .where(F.col("count") > 0)
        .join(medians, is_month & F.col(key).eqNullSafe(F.col("_key")) & (F.col("value") == F.col("_month")), "left")
        .select(key, "facet", "value", "count",
                F.when(~is_year, F.col("avg_price")).alias("avg_price"), F.col("median").alias("median_price"),
                F.when(is_month, F.col("low")).alias("min_price"), F.when(is_month, F.col("high")).alias("max_price"))
    )


def stats_by_postcode(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Per postcode: properties, sales, mean beds over the joined rows, type list.

    Sales are counted per property first, so the join carries one row per
    property and the mean is weighted back to the joined rows.
    """
    per_property = sales.groupBy("property_id").agg(F.count("*").alias("sale_count"))
    joined = properties.where(F.col("postcode").isNotNull()).join(
        per_property, properties["id"] == per_property["property_id"], "left"
    )
    rows = F.greatest(F.coalesce("sale_count", F.lit(0)), F.lit(1))
    numbers = joined.groupBy("postcode").agg(
        F.count("*").alias("properties"),
        F.coalesce(F.sum("sale_count"), F.lit(0)).alias("total_sales"),
        F.bround(
            F.sum(F.col("bedrooms") * rows) / F.sum(F.when(F.col("bedrooms").isNotNull(), rows)), 1
        ).alias("avg_beds"),
    )
    types = (
        properties.where(F.col("postcode").isNotNull() & F.col("property_type").isNotNull())
        .select("postcode", "property_type").distinct()
        .groupBy("postcode")
        .agg(F.array_join(F.array_sort(F.collect_list("property_type")), ",").alias("types"))
    )
    return numbers.join(types, "postcode", "left").orderBy(F.desc("properties"), "postcode")
