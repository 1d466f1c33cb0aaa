"""Comparable properties: same outcode and type, similar size, closest price.

All targets at once without a pairwise self-join. Properties fall into serving
groups (outcode, type, bedroom count they may serve). Inside a group only the
``k + 1`` smallest ids per price can ever be picked, and only the ``k + 1`` prices
on each side of the target, so the search runs over distinct prices with a bounded
window frame, and each target then reads the short list of its own price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions import text

ANY_TYPE = ""
ANY_BEDS = -1


def _candidates(properties: DataFrame, latest: DataFrame) -> DataFrame:
    prices = latest.select(F.col("property_id").alias("id"), F.col("latest_price").alias("price"))
    return properties.join(prices, "id").select(
        "id",
        text.outcode(F.col("postcode")).alias("outcode"),
        F.upper(F.trim(F.coalesce("property_type", F.lit(ANY_TYPE)))).alias("type"),
        "bedrooms", "price",
    ).where(F.col("outcode").isNotNull())


def _short_lists(candidates: DataFrame, k: int) -> DataFrame:
    """(outcode, type_key, beds_key, price) with the ids that can be picked there."""
    beds = F.when(
        F.col("bedrooms").isNull(), F.array(F.lit(ANY_BEDS))
    ).otherwise(F.array(F.col("bedrooms") - 1, F.col("bedrooms"), F.col("bedrooms") + 1, F.lit(ANY_BEDS)))
    types = F.array_distinct(F.array(F.col("type"), F.lit(ANY_TYPE)))
    served = (
        candidates.withColumn("type_key", F.explode(types)).withColumn("beds_key", F.explode(beds))
    )
    # Only groups that some target asks for.
    asked = candidates.select(
        "outcode", F.col("type").alias("type_key"),
        F.coalesce("bedrooms", F.lit(ANY_BEDS)).alias("beds_key"),
    ).distinct()
    group = ["outcode", "type_key", "beds_key"]
    by_id = Window.partitionBy(*group, "price").orderBy("id")
    return (
        served.join(asked, group, "left_semi")
        .withColumn("_rank", F.row_number().over(by_id)).where(F.col("_rank") <= k + 1)
        .groupBy(*group, "price").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


def similar_properties(properties: DataFrame, latest: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` closest-priced comparables of every property that has a latest price.

    Same outcode, same type (any, when the target has none), bedrooms within one
    (any, when unknown); ordered by price difference, then id.
    """
    candidates = _candidates(properties, latest)
    group = ["outcode", "type_key", "beds_key"]
    around = Window.partitionBy(*group).orderBy("price").rowsBetween(-(k + 1), k + 1)
    lists = _short_lists(candidates, k).withColumn(
        "near", F.collect_list(F.struct("price", "ids")).over(around)
    ).select(*group, "price", "near")

    targets = candidates.select(
        F.col("id").alias("property_id"), "outcode", F.col("type").alias("type_key"),
        F.coalesce("bedrooms", F.lit(ANY_BEDS)).alias("beds_key"), "price",
    )

    def gaps(point: Column) -> Column:
        gap = F.abs(point["price"] - F.col("price"))
        return F.transform(point["ids"], lambda i: F.struct(gap.alias("gap"), i.alias("id")))

    picked = F.array_sort(F.flatten(F.transform("near", gaps)))
    others = F.filter(picked, lambda c: c["id"] != F.col("property_id"))
    return (
        targets.join(lists, [*group, "price"])
        .select("property_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "c"))
        .select(
            "property_id", (F.col("pos") + 1).alias("rank"),
            F.col("c.id").alias("similar_id"), F.col("c.gap").alias("price_gap"),
        )
    )
