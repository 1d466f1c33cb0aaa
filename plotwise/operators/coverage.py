"""Which postcodes and properties hold which data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import text
from plotwise.operators import market

# Report line and the property column whose presence it counts.
PROPERTY_FEATURES: tuple[tuple[str, str], ...] = (
    ("Bedrooms / Bathrooms / Type", "bedrooms"),
    ("Extra Features", "extra_features"),
    ("Geocoded (lat/lng)", "latitude"),
    ("EPC Rating", "epc_rating"),
    ("Flood Risk", "flood_risk_level"),
    ("Transport Distances", "dist_nearest_rail_km"),
    ("Listing Status", "listing_status"),
    ("IMD Deprivation", "imd_decile"),
    ("Broadband Speed", "broadband_median_speed"),
    ("Schools & Ofsted", "dist_nearest_primary_km"),
    ("Healthcare (GP/Hospital)", "dist_nearest_gp_km"),
    ("Supermarkets", "dist_nearest_supermarket_km"),
    ("Green Spaces", "dist_nearest_green_space_km"),
    ("Pubs", "dist_nearest_pub_km"),
    ("Gyms", "dist_nearest_gym_km"),
)


def coverage_report(properties: DataFrame, sales: DataFrame, crime: DataFrame,
                    planning: DataFrame) -> DataFrame:
    """Filled and total rows and distinct postcodes per feature group.

    Property features come from two aggregates: rows are reduced to one row per
    postcode with a count per column, and those rows are added up. That replaces a
    distinct count per column. Columns the table lacks count as empty.
    """
    names = [name for name, _ in PROPERTY_FEATURES]

    def present(column: str) -> Column:
        return F.col(column) if column in properties.columns else F.lit(None)

    per_postcode = properties.groupBy("postcode").agg(
        F.count("*").alias("_rows"), *[F.count(present(c)).alias(n) for n, c in PROPERTY_FEATURES]
    )
    known = F.col("postcode").isNotNull()
    totals = per_postcode.agg(
        F.sum("_rows").alias("total"),
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]),
            F.array(*[F.struct(
                F.sum(F.col(f"`{n}`")).alias("filled"),
                F.count_if(known & (F.col(f"`{n}`") > 0)).alias("postcodes"),
            ) for n in names]),
        ).alias("features"),
    )
    lines = totals.select("total", F.explode("features").alias("feature", "v")).select(
        "feature", "v.filled", "total", "v.postcodes"
    )
    sold = sales.agg(
        F.lit("Sales (parsed price + date)").alias("feature"),
        F.count("price_numeric").alias("filled"), F.count("*").alias("total"),
        F.lit(None).cast("bigint").alias("postcodes"),
    )
    all_postcodes = market.single_row(
        per_postcode.agg(F.count_if(known).alias("n"))
    )["n"]

    def by_postcode(df: DataFrame, label: str) -> DataFrame:
        held = df.select("postcode").distinct().agg(F.count("postcode").alias("n"))
        return held.select(
            F.lit(label).alias("feature"), F.col("n").alias("filled"),
            F.greatest(all_postcodes, F.lit(1)).alias("total"), F.col("n").alias("postcodes"),
        )

    return (
        lines.unionByName(sold)
        .unionByName(by_postcode(crime, "Crime Data"))
        .unionByName(by_postcode(planning, "Planning Applications"))
    )


def postcode_list(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Properties, sales and last update per postcode.

    Sales are counted per property before the join.
    """
    per_property = sales.groupBy(F.col("property_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        properties.where(F.col("postcode").isNotNull()).join(per_property, "id", "left")
        .groupBy("postcode").agg(
            F.count("*").alias("property_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("sale_count"),
            F.max("updated_at").alias("last_updated"),
        )
        .orderBy(F.desc("property_count"), "postcode")
    )


def outcode_rollup(postcodes: DataFrame) -> DataFrame:
    """Postcode list added up per outcode."""
    return postcodes.groupBy(text.outcode(F.col("postcode")).alias("outcode")).agg(
        F.count("*").alias("scraped_postcodes"),
        F.sum("property_count").alias("property_count"),
        F.sum("sale_count").alias("sale_count"),
        F.max("last_updated").alias("last_updated"),
    )


def outcode_coverage(directory: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Directory totals next to what is held, outcodes of either side kept."""
    totals = directory.groupBy("outcode").agg(F.count("*").alias("total_postcodes"))
    counts = ("total_postcodes", "scraped_postcodes", "property_count", "sale_count")
    return (
        totals.join(outcode_rollup(postcodes), "outcode", "full")
        .select("outcode", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "last_updated")
        .orderBy("outcode")
    )


def outcode_completeness(coverage: DataFrame) -> DataFrame:
    """State and percentage per outcode, complete ones first."""
    total, held = F.col("total_postcodes"), F.col("scraped_postcodes")
    state = (
        F.when((total > 0) & (held >= total), "done")
        .when((total > 0) & (held > 0), "partial").otherwise("pending")
    )
    rank = F.when(F.col("state") == "done", 0).when(F.col("state") == "partial", 1).otherwise(2)
    pct = F.when(total > 0, F.floor(held / total * 100 + 0.5)).otherwise(0)
    return (
        coverage.withColumn("state", state).withColumn("pct", pct.cast("int"))
        .orderBy(rank, "outcode")
    )


def completeness_totals(completeness: DataFrame) -> DataFrame:
    return completeness.agg(
        F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state") == "partial").alias("partial"),
        F.sum("property_count").alias("properties"), F.sum("sale_count").alias("sales"),
    )


def postcodes_without(properties: DataFrame, column: str) -> DataFrame:
    """Postcodes none of whose properties has the column filled."""
    return (
        properties.where(F.col("postcode").isNotNull()).groupBy("postcode")
        .agg(F.count(column).alias("n")).where(F.col("n") == 0).select("postcode")
    )


def postcodes_not_in(properties: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct property postcodes that a cache table does not hold."""
    have = cached.select(text.postcode_key(F.col("postcode")).alias("_key")).distinct()
    return (
        properties.where(F.col("postcode").isNotNull()).select("postcode").distinct()
        .withColumn("_key", text.postcode_key(F.col("postcode")))
        .join(have, "_key", "left_anti").select("postcode")
    )
