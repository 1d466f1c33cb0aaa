"""Crime, planning, flood and listing records per postcode."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions import text
from plotwise.operators.predicates import listing_is_fresh

# Crime categories that become columns.
CRIME_CATEGORIES = (
    "anti-social-behaviour", "burglary", "criminal-damage-and-arson", "drugs", "other-crime",
    "other-theft", "possession-of-weapons", "public-order", "robbery", "shoplifting",
    "theft-from-the-person", "vehicle-crime", "violence-and-sexual-offences",
)
CRIME_COLUMNS = tuple(c.replace("-", "_") for c in CRIME_CATEGORIES)
CRIME_MONTH_PATTERN = r"^\d{4}-\d{2}$"
CRIME_WINDOW_MONTHS = 12

# Reference codes and words that classify planning applications.
PLANNING_CODES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("full", ("/FUL", "/FULL")),
    ("outline", ("/OUT", "/OUTLINE")),
    ("householder", ("/HH", "/HSE", "HOUSEHOLDER")),
    ("listed_building", ("/LBC", "/LISTED")),
    ("tree", ("/TPO", "/TREE")),
    ("advertisement", ("/ADV", "/ADVERT")),
    ("change_of_use", ("/COU",)),
)
MAJOR_KEYWORDS = (
    "demolition", "new build", "erection of", "residential development", "mixed use",
    "commercial", "industrial", "warehouse", "hotel", "student accommodation", "care home",
    "school", "hospital", "solar farm", "wind turbine", "infrastructure",
)
DWELLINGS_PATTERN = r"(\d+)\s*(dwelling|flat|apartment|house|unit)"
MAJOR_DWELLINGS = 10


def _any_of(value: Column, words: Sequence[str]) -> Column:
    found = F.contains(value, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(value, F.lit(word))
    return found


# --- crime -------------------------------------------------------------------

def crime_counts(records: DataFrame) -> DataFrame:
    """Valid records counted per (postcode, month, category)."""
    valid = (F.col("category") != "") & F.col("month").rlike(CRIME_MONTH_PATTERN)
    return records.where(valid).groupBy(
        text.strip(F.upper("postcode")).alias("postcode"), "month", "category"
    ).agg(F.count("*").alias("count"))


def crime_summary(counts: DataFrame) -> DataFrame:
    """Per postcode: total per category, per month and overall, in one pass.

    ``facet`` is ``category``, ``month`` or ``total``; the total row also carries
    the number of months with data.
    """
    sets = counts.groupingSets(
        [["postcode", "category"], ["postcode", "month"], ["postcode"]],
        "postcode", "category", "month",
    ).agg(
        F.sum("count").alias("count"), F.grouping("category").alias("_c"), F.grouping("month").alias("_m"),
    )
    facet = F.when(F.col("_c") == 0, "category").when(F.col("_m") == 0, "month").otherwise("total")
    rows = sets.select("postcode", facet.alias("facet"), F.coalesce("category", "month").alias("value"), "count")
    # The month rows of a postcode are its months with data.
    months = F.count_if(F.col("facet") == "month").over(Window.partitionBy("postcode"))
    return rows.withColumn("_months", months).select(
        "postcode", "facet", "value", "count",
        F.when(F.col("facet") == "total", F.col("_months")).alias("months_covered"),
    )


def _crime_by_month(counts: DataFrame) -> DataFrame:
    """One row per (postcode key, month) with a column per category."""
    columns = [
        F.sum(F.when(F.col("category") == category, F.col("count")).otherwise(0)).alias(column)
        for category, column in zip(CRIME_CATEGORIES, CRIME_COLUMNS)
    ]
    return counts.groupBy(
        text.postcode_key(F.col("postcode")).alias("_pc"), text.month_index(F.col("month")).alias("_m")
    ).agg(F.sum("count").alias("total_crime"), *columns)


def crime_window(counts: DataFrame, months: int = CRIME_WINDOW_MONTHS) -> DataFrame:
    """Trailing sums for every (postcode, month) whose window holds any data.

    Each month of data is listed in the months whose window it falls in, after it
    has been reduced to one row per postcode and month.
    """
    monthly = _crime_by_month(counts)
    served = monthly.withColumn(
        "_m", F.explode(F.sequence(F.col("_m"), F.col("_m") + F.lit(months - 1)))
    )
    names = ("total_crime", *CRIME_COLUMNS)
    return served.groupBy("_pc", "_m").agg(*[F.sum(n).alias(n) for n in names])


def with_crime(rows: DataFrame, counts: DataFrame, postcode: str = "postcode",
               iso_date: str = "date_sold_iso") -> DataFrame:
    """Add the crime columns of the twelve months up to each row's month.

    NULL when no month of the window has data. Rows are reduced to their distinct
    (postcode, month) keys on the right side only, so nothing is multiplied.
    """
    keyed = rows.withColumn("_pc", text.postcode_key(F.col(postcode))).withColumn(
        "_m", text.month_index(text.month_of(F.col(iso_date)))
    )
    return keyed.join(crime_window(counts), ["_pc", "_m"], "left").drop("_pc", "_m")


# --- planning ----------------------------------------------------------------

def planning_type(reference: Column) -> Column:
    code = F.upper(reference)
    label = F.when(F.coalesce(reference, F.lit("")) == "", F.lit("unknown"))
    for name, codes in PLANNING_CODES:
        label = label.when(_any_of(code, codes), F.lit(name))
    return label.otherwise("other")


def planning_status(end_date: Column, decision_date: Column) -> Column:
    decided = F.coalesce(text.blank_to_null(end_date), text.blank_to_null(decision_date))
    return F.when(decided.isNotNull(), F.lit("decided")).otherwise(F.lit("pending"))


def is_major_development(description: Column) -> Column:
    """The first counted dwelling phrase reaches ten, or a keyword appears."""
    low = F.lower(F.coalesce(description, F.lit("")))
    dwellings = text.blank_to_null(F.regexp_extract(low, DWELLINGS_PATTERN, 1)).try_cast("bigint")
    return F.coalesce(dwellings >= MAJOR_DWELLINGS, F.lit(False)) | _any_of(low, MAJOR_KEYWORDS)


def planning_records(entities: DataFrame) -> DataFrame:
    """Landed planning entities as application rows."""
    reference = F.coalesce(text.blank_to_null(F.col("reference")), F.col("entity").cast("string"))
    return entities.select(
        text.strip(F.upper("postcode")).alias("postcode"),
        reference.alias("reference"),
        F.coalesce("description", F.lit("")).alias("description"),
        planning_status(F.col("end_date"), F.col("decision_date")).alias("status"),
        text.blank_to_null(F.col("decision_date")).alias("decision_date"),
        planning_type(reference).alias("application_type"),
        is_major_development(F.col("description")).alias("is_major"),
        "fetched_at",
    )


def planning_totals(applications: DataFrame) -> DataFrame:
    return applications.groupBy("postcode").agg(
        F.count("*").alias("total_count"), F.count_if("is_major").alias("major_count")
    )


# --- flood -------------------------------------------------------------------

def flood_risk(postcodes: DataFrame, areas: DataFrame, warnings: DataFrame) -> DataFrame:
    """Flood zone and risk level per postcode."""
    zone = (
        F.when(_any_of(F.col("notation"), ("Zone3", "zone3")), 3)
        .when(_any_of(F.col("notation"), ("Zone2", "zone2")), 2).otherwise(1)
    )
    zones = areas.groupBy("postcode").agg(F.greatest(F.max(zone), F.lit(2)).alias("zone"))
    alerts = warnings.groupBy("postcode").agg(
        F.bool_or(F.col("severity").isin("Severe", "1")).alias("severe"), F.count("*").alias("n")
    )
    base = F.when(F.col("flood_zone") == 1, "very_low").when(F.col("flood_zone") == 2, "low").otherwise("medium")
    return (
        postcodes.join(zones, "postcode", "left").join(alerts, "postcode", "left")
        .withColumn("flood_zone", F.coalesce("zone", F.lit(1)))
        .withColumn("base", base)
        .select(
            "postcode", "flood_zone",
            F.when(F.coalesce("severe", F.lit(False)), "high")
            .when((F.coalesce("n", F.lit(0)) > 0) & F.col("base").isin("very_low", "low"), "medium")
            .otherwise(F.col("base")).alias("risk_level"),
            F.coalesce("n", F.lit(0)).alias("active_warnings"),
        )
    )


# --- listings ----------------------------------------------------------------

LISTING_PRICE_PATTERN = (
    r"((?:Guide [Pp]rice |Offers? (?:Over|in the region of|in excess of) )?£[\d,]+)"
)


def listing_status(channel: Column, published: Column, archived: Column) -> Column:
    live = F.coalesce(published, F.lit(False)) & ~F.coalesce(archived, F.lit(True))
    return F.when(live & (F.coalesce(channel, F.lit("")) == "RES_BUY"), F.lit("for_sale")).otherwise(
        F.lit("not_listed")
    )


def listing_date(reason: Column, advertised_from: Column) -> Column:
    found = text.blank_to_null(F.regexp_extract(reason, r"(\d{2}/\d{2}/\d{4})", 1))
    return F.coalesce(found, advertised_from)


def asking_price_text(description: Column, title: Column) -> Column:
    """``Guide price £450,000`` from the description, else from the title."""
    described = F.regexp_extract(description, "for " + LISTING_PRICE_PATTERN, 1)
    titled = F.regexp_extract(title, LISTING_PRICE_PATTERN, 1)
    return F.coalesce(text.blank_to_null(text.strip(described)), text.blank_to_null(text.strip(titled)))


def listing_records(pages: DataFrame) -> DataFrame:
    """Listing status rows; details are cleared when a property is not listed."""
    status = listing_status(F.col("channel"), F.col("published"), F.col("archived"))
    display = asking_price_text(F.col("description"), F.col("title"))
    amount = F.regexp_replace(F.regexp_extract(display, r"£([\d,]+)", 1), ",", "")
    listed = F.col("listing_status") == "for_sale"
    rows = pages.select("property_id", status.alias("listing_status"), display.alias("d"),
                        amount.try_cast("bigint").alias("a"),
                        listing_date(F.col("update_reason"), F.col("advertised_from")).alias("w"),
                        F.col("listing_id").cast("string").alias("l"))
    return rows.select(
        "property_id", "listing_status",
        F.when(listed, F.col("a")).alias("listing_price"),
        F.when(listed, F.col("d")).alias("listing_price_display"),
        F.when(listed, F.col("w")).alias("listing_date"),
        F.when(listed, F.concat(F.lit("/properties/"), F.col("l"))).alias("listing_url"),
    )


def listing_totals(properties: DataFrame, now: datetime) -> DataFrame:
    """Per postcode: listed, not listed, and whether every check is recent."""
    listed = F.col("listing_status").isNotNull() & (F.col("listing_status") != "not_listed")
    return properties.where(F.col("postcode").isNotNull()).groupBy("postcode").agg(
        F.count_if(listed).alias("properties_matched"),
        F.count_if(~listed).alias("properties_not_listed"),
        F.bool_and(listing_is_fresh(now)).alias("all_fresh"),
    )
