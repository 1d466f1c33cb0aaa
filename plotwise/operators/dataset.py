"""Feature registry and assembly of the modelling datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotwise.functions import text
from plotwise.functions.features import (
    BOOLEAN_FEATURES, CATEGORICAL_FEATURES, FEATURE_COLUMNS, NUMERIC_FEATURES, parse_features,
)
from plotwise.functions.numbers import clamp_to, finite, half_even, percent_change
from plotwise.operators.area_records import CRIME_COLUMNS, with_crime
from plotwise.operators.sales import latest_sale, latest_two_sales

# Registry entries as (category, name, label, kind).
PROPERTY_FEATURES: tuple[tuple[str, str, str, str], ...] = (
    ("Property Basics", "bedrooms", "Bedrooms", "numeric"),
    ("Property Basics", "bathrooms", "Bathrooms", "numeric"),
    ("Property Basics", "property_type", "Property Type", "categorical"),
    ("EPC", "epc_rating", "EPC Rating", "categorical"),
    ("EPC", "epc_score", "EPC Score", "numeric"),
    ("EPC", "estimated_energy_cost", "Energy Cost (£/yr)", "numeric"),
    ("EPC", "epc_environment_impact", "Environment Impact", "numeric"),
    ("Location", "latitude", "Latitude", "numeric"),
    ("Location", "longitude", "Longitude", "numeric"),
    ("Location", "flood_risk_level", "Flood Risk Level", "categorical"),
    ("Transport", "dist_nearest_rail_km", "Dist. to Nearest Rail (km)", "numeric"),
    ("Transport", "dist_nearest_tube_km", "Dist. to Nearest Tube (km)", "numeric"),
    ("Transport", "dist_nearest_bus_km", "Dist. to Nearest Bus (km)", "numeric"),
    ("Transport", "dist_nearest_airport_km", "Dist. to Nearest Airport (km)", "numeric"),
    ("Transport", "dist_nearest_port_km", "Dist. to Nearest Port (km)", "numeric"),
    ("Transport", "bus_stops_within_500m", "Bus Stops within 500m", "numeric"),
    ("Transport", "nearest_rail_station", "Nearest Rail Station", "categorical"),
    ("Transport", "nearest_tube_station", "Nearest Tube Station", "categorical"),
    ("Transport", "nearest_airport", "Nearest Airport", "categorical"),
    ("Transport", "nearest_port", "Nearest Port", "categorical"),
    ("Deprivation", "imd_decile", "IMD Overall Decile", "numeric"),
    ("Deprivation", "imd_income_decile", "Income Decile", "numeric"),
    ("Deprivation", "imd_employment_decile", "Employment Decile", "numeric"),
    ("Deprivation", "imd_education_decile", "Education Decile", "numeric"),
    ("Deprivation", "imd_health_decile", "Health Decile", "numeric"),
    ("Deprivation", "imd_crime_decile", "Crime Decile", "numeric"),
    ("Deprivation", "imd_housing_decile", "Housing Decile", "numeric"),
    ("Deprivation", "imd_environment_decile", "Environment Decile", "numeric"),
    ("Broadband", "broadband_median_speed", "Median Download (Mbit/s)", "numeric"),
    ("Broadband", "broadband_superfast_pct", "Superfast Availability (%)", "numeric"),
    ("Broadband", "broadband_ultrafast_pct", "Ultrafast Availability (%)", "numeric"),
    ("Broadband", "broadband_full_fibre_pct", "Full Fibre Availability (%)", "numeric"),
    ("Schools", "dist_nearest_primary_km", "Dist. to Nearest Primary (km)", "numeric"),
    ("Schools", "dist_nearest_secondary_km", "Dist. to Nearest Secondary (km)", "numeric"),
    ("Schools", "nearest_primary_school", "Nearest Primary School", "categorical"),
    ("Schools", "nearest_secondary_school", "Nearest Secondary School", "categorical"),
    ("Schools", "nearest_primary_ofsted", "Nearest Primary Ofsted", "categorical"),
    ("Schools", "nearest_secondary_ofsted", "Nearest Secondary Ofsted", "categorical"),
    ("Schools", "dist_nearest_outstanding_primary_km", "Dist. to Outstanding Primary (km)", "numeric"),
    ("Schools", "dist_nearest_outstanding_secondary_km", "Dist. to Outstanding Secondary (km)", "numeric"),
    ("Schools", "primary_schools_within_2km", "Primary Schools within 2km", "numeric"),
    ("Schools", "secondary_schools_within_3km", "Secondary Schools within 3km", "numeric"),
    ("Healthcare", "dist_nearest_gp_km", "Dist. to Nearest GP (km)", "numeric"),
    ("Healthcare", "nearest_gp_name", "Nearest GP Practice", "categorical"),
    ("Healthcare", "dist_nearest_hospital_km", "Dist. to Nearest Hospital (km)", "numeric"),
    ("Healthcare", "nearest_hospital_name", "Nearest Hospital", "categorical"),
    ("Healthcare", "gp_practices_within_2km", "GP Practices within 2km", "numeric"),
    ("Amenities", "dist_nearest_supermarket_km", "Dist. to Nearest Supermarket (km)", "numeric"),
    ("Amenities", "nearest_supermarket_name", "Nearest Supermarket", "categorical"),
    ("Amenities", "nearest_supermarket_brand", "Nearest Supermarket Brand", "categorical"),
    ("Amenities", "dist_nearest_premium_supermarket_km", "Dist. to Premium Supermarket (km)", "numeric"),
    ("Amenities", "dist_nearest_budget_supermarket_km", "Dist. to Budget Supermarket (km)", "numeric"),
    ("Amenities", "supermarkets_within_2km", "Supermarkets within 2km", "numeric"),
    ("Pubs", "dist_nearest_pub_km", "Dist. to Nearest Pub (km)", "numeric"),
    ("Pubs", "nearest_pub_name", "Nearest Pub", "categorical"),
    ("Pubs", "pubs_within_1km", "Pubs within 1km", "numeric"),
    ("Gyms", "dist_nearest_gym_km", "Dist. to Nearest Gym (km)", "numeric"),
    ("Gyms", "nearest_gym_name", "Nearest Gym", "categorical"),
    ("Gyms", "gyms_within_2km", "Gyms within 2km", "numeric"),
    ("Green Spaces", "dist_nearest_park_km", "Dist. to Nearest Park (km)", "numeric"),
    ("Green Spaces", "nearest_park_name", "Nearest Park", "categorical"),
    ("Green Spaces", "dist_nearest_green_space_km", "Dist. to Nearest Green Space (km)", "numeric"),
    ("Green Spaces", "nearest_green_space_name", "Nearest Green Space", "categorical"),
    ("Green Spaces", "green_spaces_within_1km", "Green Spaces within 1km", "numeric"),
)
SALE_FEATURES: tuple[tuple[str, str, str, str], ...] = (
    ("Sale Context", "sale_year", "Sale Year", "numeric"),
    ("Sale Context", "sale_month", "Sale Month", "numeric"),
    ("Sale Context", "sale_quarter", "Sale Quarter", "numeric"),
    ("Sale Context", "tenure", "Tenure", "categorical"),
)
TARGETS = (
    ("price_numeric", "Sale Price (£)"),
    ("price_per_sqft", "Price per Sq Ft (£)"),
    ("price_change_pct", "Price Change (%)"),
)
METADATA = ("property_id", "sale_id", "address", "date_sold_iso")

# Storage class of numeric columns in an exported dataset.
DOUBLE_COLUMNS = {
    "price_numeric", "price_per_sqft", "price_change_pct", "latitude", "longitude",
    "estimated_energy_cost", "service_charge", "ground_rent",
}
BYTE_COLUMNS = {
    "bedrooms", "bathrooms", "imd_decile", "imd_income_decile", "imd_employment_decile",
    "imd_education_decile", "imd_health_decile", "imd_crime_decile", "imd_housing_decile",
    "imd_environment_decile", "receptions", "sale_month", "sale_quarter", *BOOLEAN_FEATURES,
}
SHORT_COLUMNS = {
    "sale_year", "lease_years", "epc_score", "epc_environment_impact", "bus_stops_within_500m",
    "primary_schools_within_2km", "secondary_schools_within_3km", "gp_practices_within_2km",
    "supermarkets_within_2km", "green_spaces_within_1km", "pubs_within_1km", "gyms_within_2km",
}


def registry_rows() -> list[tuple[str, str, str, str]]:
    """(name, category, label, dtype) of every feature, in display order."""
    def title(name: str) -> str:
        return name.replace("_", " ").title()

    rows = [(name, category, label, kind) for category, name, label, kind in PROPERTY_FEATURES]
    rows.append(("total_crime", "Crime", "Total Crime Count", "numeric"))
    # Crime labels keep the wording of the category, hyphens as blanks.
    rows += [(c, "Crime", title(c), "numeric") for c in CRIME_COLUMNS]
    kinds = {c: "boolean" for c in BOOLEAN_FEATURES}
    kinds.update({c: "numeric" for c in NUMERIC_FEATURES}, **{c: "categorical" for c in CATEGORICAL_FEATURES})
    rows += [(c, "Parsed Features", title(c), kinds[c]) for c in FEATURE_COLUMNS if c != "epc_rating"]
    rows += [(name, category, label, kind) for category, name, label, kind in SALE_FEATURES]
    return rows


def feature_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), "name string, category string, label string, dtype string")


def feature_kinds() -> dict[str, str]:
    return {name: kind for name, _, _, kind in registry_rows()}


def _feature_value(name: str, kind: str) -> Column:
    """Modelling value: numbers and flags as double or NULL, categories as text."""
    if kind == "categorical":
        return F.col(name).alias(name)
    if kind == "boolean":
        return F.col(name).cast("double").alias(name)
    return finite(F.col(name)).alias(name)


def _property_side(properties: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Wanted property columns with parsed features, one row per property.

    Parsing happens here, before the sales join repeats the property.
    """
    parsed = tuple(c for c in FEATURE_COLUMNS if c in wanted)
    stored = [c for c in wanted if c in properties.columns and c not in parsed]
    slim = [c for c in dict.fromkeys(["id", "address", "postcode", *stored])]
    if parsed:
        return parse_features(properties, wanted=parsed, keep=tuple(slim)).withColumnRenamed("id", "property_id")
    return properties.select(*slim).withColumnRenamed("id", "property_id")


def _assembled(sale_rows: DataFrame, properties: DataFrame, crime: DataFrame | None,
               features: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Sale rows next to their features. ``sale_rows`` has property_id, sale_id,
    date_sold_iso, tenure and the ``carried`` target columns."""
    kinds = feature_kinds()
    crime_names = ("total_crime", *CRIME_COLUMNS)
    side = _property_side(properties, [f for f in features if f not in crime_names])
    rows = sale_rows.withColumns(text.sale_date_parts(F.col("date_sold_iso"))).join(side, "property_id")
    if crime is not None and any(f in crime_names for f in features):
        rows = with_crime(rows, crime)
    present = [f for f in features if f in rows.columns]
    return rows.select(*METADATA, *carried, *[_feature_value(f, kinds.get(f, "numeric")) for f in present])


def price_dataset(sales: DataFrame, properties: DataFrame, crime: DataFrame | None,
                  features: Sequence[str], target: str = "price_numeric") -> DataFrame:
    """Every priced sale with the chosen features.

    ``price_per_sqft`` keeps only sales whose property states a floor area.
    """
    wanted = list(features)
    if target == "price_per_sqft" and "sq_ft" not in wanted:
        wanted.append("sq_ft")
    rows = sales.where(F.col("price_numeric").isNotNull()).select(
        "property_id", F.col("id").alias("sale_id"), "date_sold_iso", "tenure",
        F.col("price_numeric").cast("double").alias("price_numeric"),
    )
    data = _assembled(rows, properties, crime, wanted, ["price_numeric"])
    if target == "price_per_sqft":
        data = data.where(F.col("sq_ft") > 0).withColumn(
            "price_per_sqft", F.col("price_numeric") / F.col("sq_ft")
        )
    return data


def price_change_dataset(sales: DataFrame, properties: DataFrame, crime: DataFrame | None,
                         features: Sequence[str]) -> DataFrame:
    """Change from the previous to the latest priced sale, per property."""
    pairs = latest_two_sales(sales).select(
        "property_id", "latest.sale_id", "latest.date_sold_iso", "latest.tenure",
        F.col("latest.price_numeric").cast("double").alias("price_numeric"),
        half_even(percent_change(F.col("latest.price_numeric"), F.col("previous.price_numeric")), 2)
        .alias("price_change_pct"),
    )
    return _assembled(pairs, properties, crime, features, ["price_numeric", "price_change_pct"])


def scoring_dataset(sales: DataFrame, properties: DataFrame, crime: DataFrame | None,
                    features: Sequence[str], prediction_date: str | None = None) -> DataFrame:
    """One row per property for prediction, in the setting of its latest sale.

    A prediction date replaces the sale year, month and quarter, not the crime
    window. Properties without a sale get an undated row.
    """
    latest = latest_sale(sales, priced=False).select(
        "property_id", "sale_id", F.col("latest_date").alias("date_sold_iso"), "tenure"
    )
    last_priced = latest_sale(sales).select("property_id", F.col("latest_price").alias("last_sale_price"))
    rows = (
        properties.select(F.col("id").alias("property_id")).join(latest, "property_id", "left")
        .join(last_priced, "property_id", "left")
    )
    data = _assembled(rows, properties, crime, features, ["last_sale_price"])
    if prediction_date:
        parts = text.sale_date_parts(F.lit(prediction_date))
        data = data.withColumns({
            name: value.cast("double") for name, value in parts.items() if name in data.columns
        })
    return data


def downcast(data: DataFrame) -> DataFrame:
    """Small storage types for export; values are clipped and rounded, not wrapped."""
    columns = []
    for name, kind in data.dtypes:
        value = F.col(name)
        if kind != "double" or name in DOUBLE_COLUMNS:
            columns.append(value)
        elif name in BYTE_COLUMNS:
            columns.append(clamp_to(value, "byte").alias(name))
        elif name in SHORT_COLUMNS:
            columns.append(clamp_to(value, "short").alias(name))
        else:
            columns.append(value.cast("float").alias(name))
    return data.select(*columns)
