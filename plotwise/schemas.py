"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from plotwise.operators.dataset import PROPERTY_FEATURES

_INTEGER_FACTS = {
    "epc_score", "estimated_energy_cost", "epc_environment_impact", "bus_stops_within_500m",
    "primary_schools_within_2km", "secondary_schools_within_3km", "gp_practices_within_2km",
    "supermarkets_within_2km", "pubs_within_1km", "gyms_within_2km", "green_spaces_within_1km",
}


def _fact_type(name: str, kind: str):
    if kind == "categorical":
        return StringType()
    return IntegerType() if name in _INTEGER_FACTS or name.startswith("imd_") else DoubleType()


def property_schema() -> StructType:
    """Properties: identity, listing state, and one column per enrichment fact."""
    basics = (
        "id bigint, address string, postcode string, postcode_clean string, property_type string,"
        " bedrooms int, bathrooms int, extra_features string, floorplan_urls string, url string,"
        " listing_status string, listing_price bigint, listing_price_display string,"
        " listing_date string, listing_url string, listing_checked_at timestamp,"
        " created_at timestamp, updated_at timestamp"
    )
    schema = StructType.fromDDL(basics)
    known = set(schema.fieldNames())
    for _, name, _, kind in PROPERTY_FEATURES:
        if name not in known:
            schema.add(name, _fact_type(name, kind))
    return schema


def sale_schema() -> StructType:
    return StructType.fromDDL(
        "id bigint, property_id bigint, date_sold string, price string, price_numeric bigint,"
        " date_sold_iso string, price_change_pct string, property_type string, tenure string"
    )


def record_schema() -> StructType:
    """Scraped records as they arrive."""
    return StructType.fromDDL(
        "seq bigint, ingested_at timestamp, address string, postcode string, property_type string,"
        " bedrooms int, bathrooms int, extra_features array<string>, floorplan_urls array<string>,"
        " url string, sales array<struct<date_sold string, price string, price_change_pct string,"
        " property_type string, tenure string>>, asking_price bigint, asking_price_display string,"
        " listing_id string"
    )


def planning_schema() -> StructType:
    return StructType.fromDDL(
        "postcode string, reference string, description string, status string,"
        " decision_date string, application_type string, is_major boolean, fetched_at timestamp"
    )


def crime_schema() -> StructType:
    return StructType.fromDDL(
        "postcode string, month string, category string, count bigint, fetched_at timestamp"
    )


def poi_schema() -> StructType:
    return StructType.fromDDL(
        "id bigint, kind string, subtype string, name string, brand string, rating string,"
        " lat double, lon double"
    )
