"""Filters as composable column predicates; an option left out adds none."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import text

FOR_SALE = "for_sale"
FRESH_DAYS = 30
LISTING_FRESH_HOURS = 24

# Columns whose NULL marks a property that an enrichment has not reached yet.
ENRICHMENT_MARKERS = {
    "transport": "dist_nearest_rail_km",
    "schools": "dist_nearest_primary_km",
    "healthcare": "dist_nearest_gp_km",
    "supermarkets": "dist_nearest_supermarket_km",
    "green_spaces": "dist_nearest_green_space_km",
    "pubs": "dist_nearest_pub_km",
    "gyms": "dist_nearest_gym_km",
    "imd": "imd_decile",
    "broadband": "broadband_median_speed",
}


def conjunction(parts: Iterable[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def postcode_prefix(prefix: str, column: str = "postcode_clean") -> Column:
    key = prefix.upper().replace("-", "").replace(" ", "")
    return F.col(column).startswith(key)


def type_contains(fragment: str) -> Column:
    return F.contains(F.lower("property_type"), F.lit(fragment.lower()))


def between(column: str, low=None, high=None) -> Column:
    parts = []
    if low is not None:
        parts.append(F.col(column) >= low)
    if high is not None:
        parts.append(F.col(column) <= high)
    return conjunction(parts)


def listing_state(only_listed: bool | None) -> Column:
    """True: for sale; False: anything else, unknown included; None: all."""
    if only_listed is None:
        return F.lit(True)
    if only_listed:
        return F.col("listing_status") == FOR_SALE
    return F.col("listing_status").isNull() | (F.col("listing_status") != FOR_SALE)


@dataclass(frozen=True)
class InsightsFilter:
    """Options of the investment dashboard; every one is optional."""

    property_type: str | None = None
    min_bedrooms: int | None = None
    max_bedrooms: int | None = None
    min_bathrooms: int | None = None
    max_bathrooms: int | None = None
    min_price: int | None = None
    max_price: int | None = None
    postcode_prefix: str | None = None
    tenure: str | None = None
    epc_rating: str | None = None
    has_garden: bool | None = None
    has_parking: bool | None = None
    chain_free: bool | None = None
    has_listing: bool | None = None

    def _shared(self, price_column: str) -> list[Column]:
        parts = [
            between("bedrooms", self.min_bedrooms, self.max_bedrooms),
            between("bathrooms", self.min_bathrooms, self.max_bathrooms),
            between(price_column, self.min_price, self.max_price),
        ]
        if self.postcode_prefix:
            # Matched on the displayed postcode, blanks included.
            parts.append(F.upper("postcode").startswith(self.postcode_prefix.upper().strip()))
        return parts

    def on_sales(self) -> Column:
        """Predicate over the sale-property base."""
        parts = self._shared("price_numeric")
        if self.property_type:
            wanted = self.property_type.strip().upper()
            parts.append(F.upper(text.first_text(F.col("sale_type"), F.col("property_type"))) == wanted)
        if self.tenure:
            parts.append(F.upper("tenure") == self.tenure.upper().strip())
        parts.append(listing_state(self.has_listing))
        return conjunction(parts)

    def on_listings(self) -> Column:
        """Predicate over properties, with the asking price in place of the sale price."""
        parts = self._shared("listing_price")
        parts.append(F.col("listing_status") == FOR_SALE)
        if self.property_type:
            parts.append(F.upper("property_type") == self.property_type.strip().upper())
        return conjunction(parts)

    def feature_names(self) -> tuple[str, ...]:
        """Parsed columns the options ask about."""
        asked = {"epc_rating": self.epc_rating, "garden": self.has_garden,
                 "parking": self.has_parking, "chain_free": self.chain_free}
        return tuple(name for name, option in asked.items() if option is not None)

    def on_features(self, prefix: str = "") -> Column:
        """Predicate over the parsed feature columns, named with ``prefix``."""
        parts = []
        if self.epc_rating:
            parts.append(F.col(prefix + "epc_rating") == self.epc_rating.upper())
        if self.has_garden is not None:
            parts.append(F.col(prefix + "garden").isNotNull() == F.lit(self.has_garden))
        if self.has_parking is not None:
            parts.append(F.col(prefix + "parking").isNotNull() == F.lit(self.has_parking))
        if self.chain_free is not None:
            known = F.coalesce(F.col(prefix + "chain_free"), F.lit(False))
            parts.append(known == F.lit(self.chain_free))
        return conjunction(parts)


def list_properties(properties: DataFrame, postcode: str | None = None,
                    property_type: str | None = None, min_bedrooms: int | None = None,
                    max_bedrooms: int | None = None, listing_only: bool | None = None,
                    skip: int = 0, limit: int = 0) -> DataFrame:
    """Properties newest first; ``limit`` 0 returns all of them."""
    parts = [between("bedrooms", min_bedrooms, max_bedrooms), listing_state(listing_only)]
    if postcode:
        parts.append(postcode_prefix(postcode))
    if property_type:
        parts.append(type_contains(property_type))
    rows = properties.where(conjunction(parts)).orderBy(F.desc("created_at"), "id")
    if skip:
        rows = rows.offset(skip)
    return rows.limit(limit) if limit else rows


def suggest_postcodes(properties: DataFrame, partial: str) -> DataFrame:
    """Known postcodes that start with the typed text, sorted."""
    return (
        properties.where(F.col("postcode").isNotNull() & postcode_prefix(partial))
        .select("postcode").distinct().orderBy("postcode")
    )


def freshness(properties: DataFrame, now: datetime, mode: str = "house_prices",
              days: int = FRESH_DAYS) -> DataFrame:
    """Per postcode: rows relevant to the mode, last update, and whether it is fresh."""
    relevant = listing_state(mode == "for_sale")
    cutoff = F.lit(now) - F.expr(f"interval {int(days)} days")
    return (
        properties.where(relevant & F.col("postcode").isNotNull()).groupBy("postcode")
        .agg(F.count("*").alias("property_count"), F.max("updated_at").alias("last_updated"))
        .withColumn("is_fresh", F.coalesce(F.col("last_updated") >= cutoff, F.lit(False)))
    )


def postcode_status(properties: DataFrame) -> DataFrame:
    """Per postcode key: how many properties and when one was last touched."""
    return properties.where(F.col("postcode_clean").isNotNull()).groupBy("postcode_clean").agg(
        F.count("*").alias("property_count"),
        F.max(F.coalesce("updated_at", "created_at")).alias("last_updated"),
    ).withColumn("has_data", F.lit(True))


def needs_enrichment(properties: DataFrame, kinds: Iterable[str] = ENRICHMENT_MARKERS) -> DataFrame:
    """Properties that at least one of the active enrichments has not reached."""
    return properties.where(reduce(or_, [F.col(ENRICHMENT_MARKERS[k]).isNull() for k in kinds]))


def listing_is_fresh(now: datetime, hours: int = LISTING_FRESH_HOURS) -> Column:
    cutoff = F.lit(now) - F.expr(f"interval {int(hours)} hours")
    return F.coalesce(F.col("listing_checked_at") > cutoff, F.lit(False))


def expired(fetched_at: str, now: datetime, days: int) -> Column:
    """Rows older than their time to live."""
    return F.col(fetched_at) < F.lit(now) - F.expr(f"interval {int(days)} days")


def selected_columns(df: DataFrame, wanted: Iterable[str], always: Iterable[str] = ()) -> DataFrame:
    """Only the wanted columns that exist; the scan reads nothing else."""
    names = [c for c in dict.fromkeys([*always, *wanted]) if c in df.columns]
    return df.select(*names)


def normalise_work_list(df: DataFrame, column: str = "postcode", order: str = "position") -> DataFrame:
    """First occurrence of every postcode, in the order of the list."""
    key = F.upper(text.strip(F.col(column)))
    return (
        df.select(key.alias(column), F.col(order)).groupBy(column)
        .agg(F.min(order).alias(order)).orderBy(order)
    )
