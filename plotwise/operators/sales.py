"""The sale-property base and the latest-sale operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions import text

PROPERTY_COLUMNS = (
    "address", "postcode", "postcode_clean", "property_type", "bedrooms", "bathrooms",
    "listing_status",
)


def sales_with_property(sales: DataFrame, properties: DataFrame,
                        *extra_columns: str, how: str = "inner") -> DataFrame:
    """Every sale next to its property (equi-join on the property id, inner unless told).

    The sale's own type is kept as ``sale_type``; ``type_key`` is the normalised
    type of either. Unused columns are pruned down to the scans.
    """
    kept = [c for c in (*PROPERTY_COLUMNS, *extra_columns) if c in properties.columns]
    left = sales.select(
        F.col("id").alias("sale_id"), "property_id", "price_numeric", "date_sold_iso",
        "tenure", F.col("property_type").alias("sale_type"),
        text.month_of(F.col("date_sold_iso")).alias("month"),
        text.year_of(F.col("date_sold_iso")).alias("year"),
    )
    right = properties.select(F.col("id").alias("property_id"), *dict.fromkeys(kept))
    return left.join(right, "property_id", how).withColumn(
        "type_key", text.property_type_key(F.col("sale_type"), F.col("property_type"))
    )


def display_type() -> Column:
    """Trimmed type in its own case, for row listings."""
    return text.first_text(F.col("sale_type"), F.col("property_type"), F.lit("Unknown"))


def latest_sale(sales: DataFrame, priced: bool = True) -> DataFrame:
    """One row per property: its newest dated sale, the highest id on a tie.

    An aggregate rather than a ranking window, so each map task keeps one row
    per property before anything is shuffled.
    """
    usable = F.col("date_sold_iso").isNotNull()
    if priced:
        usable = usable & F.col("price_numeric").isNotNull()
    payload = F.struct("id", "price_numeric", "date_sold_iso", "property_type", "tenure")
    newest = F.max_by(payload, F.struct("date_sold_iso", "id"))
    return (
        sales.where(usable).groupBy("property_id").agg(newest.alias("s"))
        .select(
            "property_id",
            F.col("s.id").alias("sale_id"),
            F.col("s.price_numeric").alias("latest_price"),
            F.col("s.date_sold_iso").alias("latest_date"),
            F.col("s.property_type").alias("sale_type"),
            F.col("s.tenure").alias("tenure"),
        )
    )


def last_entered_sale(sales: DataFrame, properties: DataFrame) -> DataFrame:
    """Each property with the sale entered last (highest id)."""
    last = sales.groupBy("property_id").agg(
        F.max_by(F.struct("date_sold", "price", "tenure"), "id").alias("s")
    )
    return properties.join(last, properties["id"] == last["property_id"]).select(
        "address", "postcode", "bedrooms", "s.date_sold", "s.price", "s.tenure"
    )


def latest_two_sales(sales: DataFrame) -> DataFrame:
    """Previous and latest priced sale of every property that has two or more.

    Undated sales sort before dated ones, the higher id is the later on a tie.
    The rank filter is a group limit: every map task keeps two rows per property
    before the shuffle, and the pairing reuses the partitioning of the window.
    """
    newest_first = Window.partitionBy("property_id").orderBy(
        F.desc(F.coalesce("date_sold_iso", F.lit(""))), F.desc("id")
    )
    payload = F.struct(
        F.col("id").alias("sale_id"), "price_numeric", "date_sold_iso", "tenure",
        "property_type",
    )
    last_two = (
        sales.where(F.col("price_numeric").isNotNull() & (F.col("price_numeric") != 0))
        .withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= 2)
    )
    return (
        last_two.groupBy("property_id").agg(
            F.max(F.when(F.col("_rank") == 2, payload)).alias("previous"),
            F.max(F.when(F.col("_rank") == 1, payload)).alias("latest"),
        )
        .where(F.col("previous").isNotNull())
    )


def repeat_sold_properties(sales: DataFrame, at_least: int = 2) -> DataFrame:
    """Properties with ``at_least`` sales."""
    return (
        sales.groupBy("property_id").agg(F.count("*").alias("sale_count"))
        .where(F.col("sale_count") >= at_least)
    )


def priced_property_count(sales: DataFrame) -> DataFrame:
    """Number of distinct properties with a priced sale."""
    return sales.where(F.col("price_numeric").isNotNull()).agg(
        F.countDistinct("property_id").alias("dataset_size")
    )


def properties_with_sales(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Property and sale history in long form: a left join, one row per sale.

    Kept flat so that a property with a very long history is still many rows in
    many tasks; order by ``date_sold_iso`` when presenting one property.
    """
    history = sales.select(
        F.col("id").alias("sale_id"), F.col("property_id").alias("id"), "date_sold_iso",
        "price_numeric", "tenure", F.col("property_type").alias("sale_type"),
    )
    return properties.join(history, "id", "left")


def with_sales_of(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Properties that have at least one sale (left semi)."""
    return properties.join(sales, properties["id"] == sales["property_id"], "left_semi")


def without_sales(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Properties that have no sale at all (left anti)."""
    return properties.join(sales, properties["id"] == sales["property_id"], "left_anti")


SALE_FIELDS = ("date_sold_iso", "sale_id", "price_numeric", "tenure", "sale_type")


def nested_sales(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per property with ``sales``, its history as an array of SALE_FIELDS by date and id.

    Sales without a date come first; a property without sales has an empty array. Stored,
    the array is read field by field: a question about prices reads no tenures.
    """
    history = sales.select(F.col("property_id").alias("id"), F.struct(
        "date_sold_iso", F.col("id").alias("sale_id"), "price_numeric", "tenure", F.col("property_type").alias("sale_type")).alias("s"))
    lists = history.groupBy("id").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(
        F.coalesce(a["date_sold_iso"], F.lit("")) < F.coalesce(b["date_sold_iso"], F.lit("")), -1).when(
        F.coalesce(a["date_sold_iso"], F.lit("")) > F.coalesce(b["date_sold_iso"], F.lit("")), 1).when(
        a["sale_id"] < b["sale_id"], -1).when(a["sale_id"] > b["sale_id"], 1).otherwise(0)).alias("sales"))
    joined = properties.join(lists, "id", "left")
    return joined.withColumn("sales", F.coalesce("sales", F.filter(F.array(F.lit(None).cast(lists.schema["sales"].dataType.elementType)), lambda s: F.lit(False))))


def history_figures(nested: DataFrame) -> DataFrame:
    """Figures of each property's history, from the prices and dates of the array alone."""
    priced = F.filter("sales", lambda s: s["price_numeric"].isNotNull())
    prices = F.transform(priced, lambda s: s["price_numeric"])
    last = F.element_at(F.filter(priced, lambda s: s["date_sold_iso"].isNotNull()), -1)
    rises = F.zip_with(F.slice(prices, 2, F.greatest(F.size(prices) - 1, F.lit(0))), F.slice(prices, 1, F.greatest(F.size(prices) - 1, F.lit(0))), lambda b, a: b - a)
    return nested.select(
        "id", F.size("sales").alias("n_sales"), F.size(prices).alias("n_priced"),
        F.aggregate(prices, F.lit(0).cast("long"), lambda total, p: total + p).alias("total"),
        F.when(F.size(F.filter(priced, lambda s: s["date_sold_iso"].isNotNull())) > 0, last["price_numeric"]).alias("last_price"),
        F.array_max(rises).alias("largest_rise"))


def flat_sales(nested: DataFrame) -> DataFrame:
    """The array back as one row per sale; properties without sales have none."""
    return nested.select(F.col("id").alias("property_id"), F.inline("sales"))
