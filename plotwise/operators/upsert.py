"""Table maintenance: upserts, first-wins inserts, fills, replacements, expiry.

Plain parquet has no MERGE. Each operator returns the next version of a table;
``sinks.write_version`` stores it beside the current one, which is only read.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions import text
from plotwise.operators.predicates import FOR_SALE, expired

# Columns of a property that a scraped record can set.
RECORD_COLUMNS = (
    "postcode", "property_type", "bedrooms", "bathrooms", "extra_features", "floorplan_urls", "url",
    "listing_status", "listing_price", "listing_price_display", "listing_url", "listing_checked_at",
)
FAILED_MONTHS_LIMIT = 0.5
EXPECTED_CRIME_MONTHS = 60


def record_changes(records: DataFrame) -> DataFrame:
    """Scraped records as column changes: NULL means "leave as it is".

    Types are upper-cased and empty text changes nothing, while a count of zero
    does. An asking price turns the property into a listing.
    """
    listed = F.col("asking_price").isNotNull()
    return records.select(
        "address", F.col("seq").cast("bigint").alias("seq"),
        text.blank_to_null(F.col("postcode")).alias("postcode"),
        text.blank_to_null(F.upper("property_type")).alias("property_type"),
        "bedrooms", "bathrooms",
        F.to_json("extra_features").alias("extra_features"),
        F.to_json("floorplan_urls").alias("floorplan_urls"),
        text.blank_to_null(F.col("url")).alias("url"),
        F.when(listed, F.lit(FOR_SALE)).alias("listing_status"),
        F.when(listed, F.col("asking_price")).alias("listing_price"),
        F.when(listed, F.col("asking_price_display")).alias("listing_price_display"),
        F.when(listed, F.col("url")).alias("listing_url"),
        F.when(listed, F.col("ingested_at")).alias("listing_checked_at"),
        "ingested_at",
    )


def _last_known(column: str) -> Column:
    """Value with the highest sequence among those that are not NULL."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def upsert_properties(properties: DataFrame, changes: DataFrame) -> DataFrame:
    """Next version of the property table, one row per address.

    Stored rows and changes meet in one aggregation by address: the latest known
    value per column wins, so an address with many changes is folded on the map
    side first. Stored rows carry sequence -1. New addresses get an id derived
    from the address, so that a repeated run gives the same id.
    """
    own = [c for c in RECORD_COLUMNS if c in properties.columns]
    other = [c for c in properties.columns if c not in (*own, "id", "address", "created_at", "updated_at")]
    stored = properties.withColumn("seq", F.lit(-1).cast("bigint"))
    # Records without an address have no property to go to.
    arriving = changes.where(text.blank_to_null(text.strip(F.col("address"))).isNotNull()).select("address", "seq", *own, F.col("ingested_at").alias("updated_at"))
    both = stored.unionByName(arriving, allowMissingColumns=True)
    merged = both.groupBy("address").agg(
        F.max("id").alias("id"),
        F.min(F.coalesce("created_at", "updated_at")).alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        *[_last_known(c) for c in own],
        *[F.max_by(c, F.when(F.col("seq") == -1, 1)).alias(c) for c in other if c != "postcode_clean"],
    )
    if "postcode_clean" in properties.columns:
        merged = merged.withColumn("postcode_clean", text.postcode_key(F.col("postcode")))
    merged = merged.withColumn("id", F.coalesce("id", address_id(F.col("address"))))
    return merged.select(*properties.columns)


def address_id(address: Column) -> Column:
    """Id of a new property: a non-negative hash of its unique address."""
    return F.xxhash64(address).bitwiseAND(F.lit(2**63 - 1))


def sale_rows(records: DataFrame) -> DataFrame:
    """Sales of scraped records in stored form, with normalised date and price."""
    rows = records.select("address", F.col("seq").cast("bigint").alias("seq"),
                          F.posexplode("sales").alias("position", "s"))
    date_sold = text.date_without_leading_zeros(F.col("s.date_sold"))
    price = text.price_normalised(F.col("s.price"))
    return rows.select(
        "address", "seq", "position", date_sold.alias("date_sold"), price.alias("price"),
        text.price_to_int(price).alias("price_numeric"),
        text.date_to_iso(date_sold).alias("date_sold_iso"),
        F.col("s.price_change_pct").alias("price_change_pct"),
        F.col("s.property_type").alias("property_type"),
        F.upper("s.tenure").alias("tenure"),
    )


def new_sales(sales: DataFrame, arriving: DataFrame,
              key: Sequence[str] = ("property_id", "date_sold", "price")) -> DataFrame:
    """Arriving sales that are not stored yet, the first of each key.

    First-wins is an aggregate on (seq, position), folded before the shuffle;
    stored keys then drop out by an anti join.
    """
    columns = [c for c in arriving.columns if c not in (*key, "seq", "position")]
    payload = F.struct(*columns)
    first = arriving.groupBy(*key).agg(
        F.min_by(payload, F.struct("seq", "position")).alias("_first")
    ).select(*key, "_first.*")
    return first.join(sales.select(*key), list(key), "left_anti")


def insert_sales(sales: DataFrame, arriving: DataFrame,
                 key: Sequence[str] = ("property_id", "date_sold", "price")) -> DataFrame:
    """Next version of the sales table."""
    fresh = new_sales(sales, arriving, key).withColumn(
        "id", F.xxhash64(*key).bitwiseAND(F.lit(2**63 - 1))
    )
    return sales.unionByName(fresh, allowMissingColumns=True).select(*sales.columns)


def backfill(sales: DataFrame) -> DataFrame:
    """Parse price and date text where the parsed value is still missing."""
    return sales.withColumns({
        "price_numeric": F.coalesce("price_numeric", text.price_to_int(F.col("price"))),
        "date_sold_iso": F.coalesce("date_sold_iso", text.date_to_iso(F.col("date_sold"))),
    })


def backfill_postcode_key(properties: DataFrame) -> DataFrame:
    return properties.withColumn(
        "postcode_clean", F.coalesce("postcode_clean", text.postcode_key(F.col("postcode")))
    )


def upsert_planning(stored: DataFrame, arriving: DataFrame, now: datetime,
                    days: int = 30) -> DataFrame:
    """Latest application per (postcode, reference).

    A postcode whose newest stored row is past its time to live is dropped whole
    before the new rows come in.
    """
    newest = stored.groupBy("postcode").agg(F.max("fetched_at").alias("_newest"))
    stale = newest.where(expired("_newest", now, days)).select("postcode")
    kept = stored.join(stale, "postcode", "left_anti")
    columns = [c for c in stored.columns if c not in ("postcode", "reference")]
    both = kept.withColumn("_new", F.lit(0)).unionByName(arriving.select(*stored.columns).withColumn("_new", F.lit(1)))
    # Fetched at the same time, the arriving row wins; among equals the largest.
    latest = F.max_by(F.struct(*columns), F.struct("fetched_at", "_new", F.struct(*columns)))
    return (
        both.groupBy("postcode", "reference").agg(latest.alias("r"))
        .select("postcode", "reference", "r.*").select(*stored.columns)
    )


def replace_crime(stored: DataFrame, arriving: DataFrame, failures: DataFrame,
                  expected_months: int = EXPECTED_CRIME_MONTHS,
                  limit: float = FAILED_MONTHS_LIMIT) -> DataFrame:
    """Replace the crime rows of each arriving postcode as a whole.

    ``failures`` holds (postcode, month) of months that could not be fetched; a
    postcode with too many of them keeps what is stored.
    """
    unreliable = (
        failures.select("postcode", "month").distinct().groupBy("postcode")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= F.lit(expected_months * limit)).select("postcode")
    )
    usable = arriving.join(unreliable, "postcode", "left_anti")
    replaced = usable.select("postcode").distinct()
    return stored.join(replaced, "postcode", "left_anti").unionByName(usable.select(*stored.columns))


def due_for_refresh(df: DataFrame, now: datetime, days: int, stamp: str = "ingested_at") -> DataFrame:
    """Rows whose time to live is over, or that were never stamped."""
    return df.where(F.col(stamp).isNull() | expired(stamp, now, days))


def latest_version(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Newest row per key, as an aggregate."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(
        *df.columns
    )


def not_done(work: DataFrame, done: DataFrame, key: str = "postcode") -> DataFrame:
    """Work items that no earlier run has completed."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def first_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """First row per key in input order, as a ranking with a group limit."""
    window = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") == 1).drop("_r")


def with_property_id(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """Sale rows of scraped records under the id of their property."""
    ids = properties.select("address", F.col("id").alias("property_id"))
    return rows.join(ids, "address").drop("address")
