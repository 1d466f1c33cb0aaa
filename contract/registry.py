"""The registered queries: library operators applied to the driver's tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import plotwise
from plotwise import schemas
from contract.views import VIEWS, table, view
from plotwise.functions import text
from plotwise.functions.features import FEATURE_COLUMNS, parse_features
from plotwise.operators import (
    area_records, compare, coverage as coverage_ops, dataset, growth, insights, lookups, market, model,
    one_pass, predicates, similar, spatial, text_reports, upsert, stumps,
)
from plotwise.operators.predicates import InsightsFilter
from plotwise.operators.sales import (
    flat_sales, history_figures, last_entered_sale as last_entered, latest_sale, latest_two_sales, priced_property_count, properties_with_sales as properties_and_sales,
    nested_sales, repeat_sold_properties, sales_with_property, with_sales_of, without_sales,
)
from plotwise.plans import market_questions
from plotwise.session import staging_path
from plotwise.sources import html_pages, readers, sinks
from plotwise.streaming import jobs

# Send library functions to the workers by value: the caller's working directory need
# not be on their path. A cluster ships the package with --py-files instead.
cloudpickle.register_pickle_by_value(plotwise)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def base_of(spark: SparkSession, sf: str) -> DataFrame:
    return sales_with_property(view(spark, sf, "sale"), view(spark, sf, "property"))


def street_base_of(spark: SparkSession, sf: str) -> DataFrame:
    properties = market.with_street(view(spark, sf, "property"))
    return sales_with_property(view(spark, sf, "sale"), properties, "street")


# --- market overview ---------------------------------------------------------

@query
def overview_totals(spark, sf):
    return market.overview_totals(view(spark, sf, "property"), view(spark, sf, "sale"))


@query
def upper_median(spark, sf):
    return market.overall_upper_median(view(spark, sf, "sale"))


@query
def price_bands(spark, sf):
    return market.price_bands(view(spark, sf, "sale")).drop("band")


@query
def top_postcodes(spark, sf):
    return market.top_postcodes(base_of(spark, sf))


@query
def type_breakdown(spark, sf):
    return market.type_breakdown(base_of(spark, sf))


@query
def type_breakdown_by_postcode(spark, sf):
    return market.type_breakdown(base_of(spark, sf), ["postcode_clean"])


@query
def bedroom_dist(spark, sf):
    return market.bedroom_distribution(base_of(spark, sf))


@query
def bedroom_dist_by_postcode(spark, sf):
    return market.bedroom_distribution(base_of(spark, sf), ["postcode_clean"])


@query
def sales_volume(spark, sf):
    return market.sales_volume(base_of(spark, sf))


@query
def sales_volume_by_postcode(spark, sf):
    return market.sales_volume(base_of(spark, sf), ["postcode_clean"])


@query
def monthly_trend(spark, sf):
    return market.monthly_trend(base_of(spark, sf))


@query
def monthly_trend_by_postcode(spark, sf):
    return market.monthly_trend(base_of(spark, sf), ["postcode_clean"])


@query
def recent_sales(spark, sf):
    return market.recent_sales(base_of(spark, sf))


@query
def street_comparison(spark, sf):
    return market.street_comparison(street_base_of(spark, sf), ["postcode_clean"])


@query
def postcode_comparison(spark, sf):
    return market.postcode_comparison(base_of(spark, sf))


@query
def summary_grouping_sets(spark, sf):
    return market.summary_grouping_sets(street_base_of(spark, sf))


@query
def stats_by_postcode(spark, sf):
    return market.stats_by_postcode(view(spark, sf, "property"), view(spark, sf, "sale"))


# --- capital growth ----------------------------------------------------------

def medians_of(spark, sf):
    return growth.annual_medians(base_of(spark, sf))


@query
def annual_medians(spark, sf):
    return medians_of(spark, sf)


@query
def cagr_periods(spark, sf):
    return growth.cagr_periods(medians_of(spark, sf))


@query
def growth_leaderboard(spark, sf):
    return growth.growth_leaderboard(base_of(spark, sf))


@query
def volatility(spark, sf):
    return growth.volatility(medians_of(spark, sf))


@query
def max_drawdown(spark, sf):
    return growth.max_drawdown(medians_of(spark, sf))


@query
def data_span(spark, sf):
    return growth.data_span(medians_of(spark, sf))


@query
def forecast(spark, sf):
    return growth.forecast(medians_of(spark, sf))


@query
def forecast_sample_band(spark, sf):
    return growth.forecast(medians_of(spark, sf), sample_band=True)


# --- investment dashboard ----------------------------------------------------

FILTERED = InsightsFilter(min_bedrooms=2, max_bedrooms=4, min_price=50000, tenure="freehold",
                          has_listing=False)


@query
def price_histogram(spark, sf):
    return insights.price_histogram(base_of(spark, sf))


@query
def price_histogram_filtered(spark, sf):
    base = insights.filtered_base(view(spark, sf, "sale"), view(spark, sf, "property"), FILTERED)
    return insights.price_histogram(base)


@query
def insights_time_series(spark, sf):
    return insights.time_series(base_of(spark, sf))


@query
def scatter_sample(spark, sf):
    return insights.scatter(base_of(spark, sf))


@query
def postcode_heatmap(spark, sf):
    return insights.postcode_heatmap(base_of(spark, sf))


@query
def kpis(spark, sf):
    return insights.kpis(base_of(spark, sf))


@query
def kpis_filtered(spark, sf):
    base = insights.filtered_base(view(spark, sf, "sale"), view(spark, sf, "property"), FILTERED)
    return insights.kpis(base)


@query
def investment_deals(spark, sf):
    return insights.investment_deals(base_of(spark, sf))


@query
def deals_by_price(spark, sf):
    return insights.sort_deals(insights.investment_deals(base_of(spark, sf)), "price", True)


@query
def current_listings(spark, sf):
    return insights.current_listings(
        view(spark, sf, "property"), InsightsFilter(min_price=100000, max_bedrooms=4)
    )


# --- comparisons -------------------------------------------------------------

@query
def latest_sale_per_property(spark, sf):
    return latest_sale(view(spark, sf, "sale"))


@query
def trend_line(spark, sf):
    line = compare.trend_line(insights.scatter(base_of(spark, sf)))
    return line.selectExpr("x_min", "x_max", "round(y_at_min, 4) AS y_at_min",
                           "round(y_at_max, 4) AS y_at_max")


def points_of(spark, sf):
    return compare.map_points(view(spark, sf, "property"), latest_sale(view(spark, sf, "sale")))


@query
def map_points(spark, sf):
    return compare.map_points(
        view(spark, sf, "property"), latest_sale(view(spark, sf, "sale"))
    )


@query
def quartile_bands(spark, sf):
    return compare.quartile_bands(points_of(spark, sf)).select("id", "latest_price", "band")


@query
def map_centre(spark, sf):
    return compare.map_centre(points_of(spark, sf)).selectExpr(
        "round(lat, 6) AS lat", "round(lon, 6) AS lon"
    )


@query
def area_comparison(spark, sf):
    return compare.area_comparison(street_base_of(spark, sf))


AREAS = ("AF0 1AB", "AM1 2AB", "EU3 5AB", "AS2 3AB")


@query
def compare_pivot(spark, sf):
    trend = market.monthly_trend(base_of(spark, sf), ["postcode"])
    return compare.aligned_series(trend, "month", "postcode", AREAS, "median_price")


@query
def compare_types(spark, sf):
    types = market.type_breakdown(base_of(spark, sf), ["postcode"])
    return compare.aligned_series(types, "property_type", "postcode", AREAS, "count", fill=0)


@query
def property_appreciation(spark, sf):
    return compare.property_appreciation(view(spark, sf, "sale")).selectExpr(
        "property_id", "first_price", "last_price", "first_date", "last_date",
        "round(total_change_pct, 4) AS total_change_pct",
        "round(annualised_pct, 4) AS annualised_pct",
    )


# --- listing features and phrases --------------------------------------------

def parsed_of(spark, sf):
    return parse_features(view(spark, sf, "property"), keep=("id",))


def lines_of(spark, sf):
    """Lines of prose stand for listing phrases."""
    lines = table(spark, sf, "documents").select(F.split("text", "\n").alias("lines"))
    return text_reports.phrases_of(lines, "lines")


@query
def feature_flags(spark, sf):
    return parsed_of(spark, sf)


@query
def fill_rates(spark, sf):
    return text_reports.fill_rates(parsed_of(spark, sf))


@query
def fill_totals(spark, sf):
    groups = {c: "v2" for c in FEATURE_COLUMNS[41:64]} | {c: "v3" for c in FEATURE_COLUMNS[64:]}
    return text_reports.fill_totals(text_reports.fill_rates(parsed_of(spark, sf)), groups)


@query
def value_distribution(spark, sf):
    return text_reports.value_distribution(parsed_of(spark, sf))


@query
def uncaught_phrases(spark, sf):
    return text_reports.uncaught_phrases(lines_of(spark, sf))


@query
def caught_totals(spark, sf):
    return text_reports.caught_totals(lines_of(spark, sf))


@query
def category_totals(spark, sf):
    return text_reports.category_totals(lines_of(spark, sf))


@query
def category_top_phrases(spark, sf):
    return text_reports.category_top_phrases(lines_of(spark, sf))


@query
def kpis_with_features(spark, sf):
    options = InsightsFilter(has_parking=True, chain_free=False)
    base = insights.filtered_base(view(spark, sf, "sale"), view(spark, sf, "property"), options)
    return insights.kpis(base)


# --- cleaning ----------------------------------------------------------------

@query
def clean_sales(spark, sf):
    return view(spark, sf, "raw_sale").select(
        "id", text.price_to_int(F.col("price")).alias("price_numeric"),
        text.price_normalised(F.col("price")).alias("price"),
        text.date_without_leading_zeros(F.col("date_sold")).alias("date_sold"),
        text.date_to_iso(F.col("date_sold")).alias("date_sold_iso"),
    )


@query
def postcode_forms(spark, sf):
    code = F.col("postcode")
    return view(spark, sf, "property").select(
        "id", text.postcode_key(code).alias("key"), text.postcode_in(F.col("address")).alias("found"),
        text.outcode(code).alias("outcode"), text.outcode_by_pattern(code).alias("outcode_pattern"),
        text.outcode_by_separator(code).alias("outcode_separator"),
        text.postcode_spaced(text.postcode_key(code)).alias("spaced"),
    )


@query
def streets(spark, sf):
    return view(spark, sf, "property").select("id", text.street_of(F.col("address")).alias("street"))


@query
def backfill_sales(spark, sf):
    sales = view(spark, sf, "raw_sale").join(
        view(spark, sf, "sale").select("id", "price_numeric", "date_sold_iso"), "id"
    )
    return upsert.backfill(sales).select("id", "price_numeric", "date_sold_iso")


# --- points of interest ------------------------------------------------------

def poi_of(spark, sf):
    return view(spark, sf, "poi").unionByName(spatial.fixed_points(spark), allowMissingColumns=True)


def ids_at(spark, sf, facts):
    at = view(spark, sf, "property").select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return at.join(facts, ["lat", "lon"])


@query
def nearest_poi(spark, sf):
    points = spatial.distinct_points(view(spark, sf, "property"))
    rows = spatial.nearest(points, spatial.with_targets(poi_of(spark, sf)), tuple(spatial.TARGETS))
    return ids_at(spark, sf, rows).select("id", "target", "poi_id", F.round("arc_km", 2).alias("km"))


@query
def within_radius(spark, sf):
    points = spatial.distinct_points(view(spark, sf, "property"))
    radii = {"bus": 15.0, "primary": 10.0, "secondary": 15.0, "gp": 10.0, "supermarket": 20.0,
             "green_space": 25.0, "pub": 25.0, "gym": 20.0}
    rows = spatial.within_radius(points, spatial.with_targets(poi_of(spark, sf)), radii)
    return ids_at(spark, sf, rows).select("id", "target", "n")


@query
def proximity(spark, sf):
    enriched = spatial.enrich_proximity(view(spark, sf, "property"), poi_of(spark, sf))
    columns = [c for t in spatial.TARGETS.values()
               for c in (t.distance, t.name, t.detail, t.within[0] if t.within else None) if c]
    return enriched.select("id", *columns)


# --- lookups and matches -----------------------------------------------------

@query
def imd_lookup(spark, sf):
    return lookups.with_imd(
        view(spark, sf, "property"), view(spark, sf, "postcode_lookup"), view(spark, sf, "imd")
    ).select("id", *lookups.IMD_COLUMNS)


@query
def broadband_lookup(spark, sf):
    return lookups.with_broadband(view(spark, sf, "property"), view(spark, sf, "broadband")).select(
        "id", *lookups.BROADBAND_COLUMNS
    )


@query
def geocode(spark, sf):
    known = F.col("property_type") != "BUILDING"
    located = view(spark, sf, "property").withColumns({
        "latitude": F.when(known, F.col("latitude")), "longitude": F.when(known, F.col("longitude")),
    })
    return lookups.geocode(located, view(spark, sf, "postcode_lookup")).select("id", "latitude", "longitude")


@query
def epc_match(spark, sf):
    return lookups.match_epc(view(spark, sf, "property"), view(spark, sf, "epc_cert"))


@query
def epc_match_by_containment(spark, sf):
    return lookups.match_epc_by_containment(view(spark, sf, "property"), view(spark, sf, "epc_cert"))


@query
def similar_properties(spark, sf):
    return similar.similar_properties(view(spark, sf, "property"), latest_sale(view(spark, sf, "sale")))


# --- crime, planning, flood, listings ----------------------------------------

def crime_of(spark, sf):
    return area_records.crime_counts(view(spark, sf, "crime_record"))


@query
def crime_counts(spark, sf):
    return crime_of(spark, sf)


@query
def crime_summary(spark, sf):
    return area_records.crime_summary(crime_of(spark, sf))


@query
def crime_window(spark, sf):
    rows = area_records.with_crime(base_of(spark, sf), crime_of(spark, sf))
    return rows.select("sale_id", "total_crime", *area_records.CRIME_COLUMNS)


def planning_of(spark, sf):
    return area_records.planning_records(view(spark, sf, "planning_entity"))


@query
def planning_records(spark, sf):
    return planning_of(spark, sf)


@query
def planning_totals(spark, sf):
    return area_records.planning_totals(planning_of(spark, sf))


@query
def flood_risk(spark, sf):
    warnings = view(spark, sf, "flood_warning")
    postcodes = view(spark, sf, "planning_entity").select("postcode").distinct()
    return area_records.flood_risk(postcodes, view(spark, sf, "flood_area"), warnings)


@query
def listing_records(spark, sf):
    return area_records.listing_records(view(spark, sf, "listing_page"))


NOW = datetime(2024, 1, 20, 12)


@query
def listing_totals(spark, sf):
    return area_records.listing_totals(view(spark, sf, "property"), NOW)


# --- coverage and freshness --------------------------------------------------

@query
def coverage(spark, sf):
    return coverage_ops.coverage_report(
        view(spark, sf, "property"), view(spark, sf, "sale"), crime_of(spark, sf), planning_of(spark, sf)
    )


@query
def postcode_list(spark, sf):
    return coverage_ops.postcode_list(view(spark, sf, "property"), view(spark, sf, "sale"))


@query
def outcode_completeness(spark, sf):
    held = coverage_ops.postcode_list(view(spark, sf, "property"), view(spark, sf, "sale"))
    directory = view(spark, sf, "crime_record").select("postcode").distinct().withColumn(
        "outcode", text.outcode(F.col("postcode"))
    )
    return coverage_ops.outcode_completeness(coverage_ops.outcode_coverage(directory, held))


@query
def completeness_totals(spark, sf):
    return coverage_ops.completeness_totals(outcode_completeness(spark, sf))


@query
def work_list(spark, sf):
    """Distinct postcodes of the listings in the order they first appear."""
    wanted = view(spark, sf, "property").where("listing_status = 'for_sale'").select(
        F.lower("postcode").alias("postcode"), F.col("id").alias("position")
    )
    return predicates.normalise_work_list(wanted)


@query
def freshness(spark, sf):
    return predicates.freshness(view(spark, sf, "property"), datetime(2024, 7, 1))


@query
def postcode_status(spark, sf):
    return predicates.postcode_status(view(spark, sf, "property"))


@query
def needs_enrichment(spark, sf):
    enriched = lookups.with_imd(
        view(spark, sf, "property").withColumn("broadband_median_speed", F.lit(None).cast("double")),
        view(spark, sf, "postcode_lookup").where("lsoa <> 'EAF0'"), view(spark, sf, "imd"),
    )
    return predicates.needs_enrichment(enriched, ["imd"]).select("id")


@query
def postcode_suggestions(spark, sf):
    return predicates.suggest_postcodes(view(spark, sf, "property"), "af1")


@query
def property_list(spark, sf):
    rows = predicates.list_properties(
        view(spark, sf, "property"), "AF", "ture", 2, 5, listing_only=False, skip=5, limit=40
    )
    return rows.select("id", "address", "property_type", "bedrooms", "created_at")


@query
def properties_without_sales(spark, sf):
    return without_sales(view(spark, sf, "property"), view(spark, sf, "raw_sale").where(
        "o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")).select("id")


@query
def postcodes_without_crime(spark, sf):
    return coverage_ops.postcodes_not_in(view(spark, sf, "property"), crime_of(spark, sf))


@query
def properties_with_sales(spark, sf):
    return properties_and_sales(view(spark, sf, "property"), view(spark, sf, "sale")).select(
        "id", "address", "sale_id", "date_sold_iso", "price_numeric", "tenure", "sale_type"
    )


@query
def properties_nested(spark, sf):
    """One row per property with its ordered sales, from a stored nested table."""
    path = staging_path(spark, "nested-sales")
    nested_sales(view(spark, sf, "property").select("id", "address"), view(spark, sf, "sale")).write.parquet(path)
    nested = spark.read.parquet(path)
    entry = F.array_join(F.transform("sales", lambda s: F.concat_ws(
        ":", F.coalesce(s["date_sold_iso"], F.lit("?")), s["sale_id"].cast("string"), F.coalesce(s["price_numeric"].cast("string"), F.lit("?")))), ";")
    return nested.select("id", "address", entry.alias("history")).join(history_figures(nested), "id")


@query
def properties_nested_flat(spark, sf):
    """The nested sales taken apart again."""
    return flat_sales(nested_sales(view(spark, sf, "property").select("id"), view(spark, sf, "sale")))


@query
def properties_with_any_sale(spark, sf):
    return with_sales_of(view(spark, sf, "property"), view(spark, sf, "sale")).select("id", "address")


@query
def due_properties(spark, sf):
    return upsert.due_for_refresh(view(spark, sf, "property"), datetime(2024, 3, 1), 90, "updated_at").select("id", "updated_at")


@query
def merged_files(spark, sf):
    """Properties written in four layouts: numbers of other width, missing and additional columns."""
    homes = view(spark, sf, "property")
    layouts = (
        ("CAST(id AS INT) AS id", "CAST(bedrooms AS SMALLINT) AS bedrooms", "CAST(bathrooms * 1000 AS INT) AS price", "address"),
        ("id", "bedrooms", "bathrooms * 1000 + CAST(0.5 AS DOUBLE) AS price"),
        ("address", "id", "CAST(bathrooms AS DECIMAL(5, 1)) AS rate", "CAST(created_at AS DATE) AS seen"),
        ("CAST(id AS INT) AS id", "CAST(bedrooms AS TINYINT) AS bedrooms", "CAST(bathrooms AS DECIMAL(9, 3)) AS rate", "created_at AS seen"),
    )
    path = staging_path(spark, "layouts")
    for k, columns in enumerate(layouts):
        homes.where(F.pmod("id", F.lit(4)) == k).selectExpr(*columns).write.parquet(f"{path}/{k}")
    return sinks.merge_parquet(spark, path).select("id", "address", "bedrooms", "price", F.col("rate").cast("double").alias("rate"), "seen")


@query
def cache_refresh(spark, sf):
    """Areas cached by outcode: those of A first, the others later, then those of A again when they are too old."""
    homes, path = view(spark, sf, "property"), staging_path(spark, "cache")
    areas, age = homes.select("outcode").distinct(), timedelta(days=30)

    def fetch(version):
        return lambda due: homes.join(due, "outcode").groupBy("outcode").agg(F.count("*").alias("properties")).withColumn("version", F.lit(version))

    first = sinks.refresh_cache(spark, path, "outcode", datetime.now(), age, fetch(1), areas.where("outcode LIKE 'A%'"))
    written = first.select(F.max("_metadata.file_modification_time")).first()[0] or datetime.now()
    time.sleep(1.5)
    sinks.refresh_cache(spark, path, "outcode", written, age, fetch(2), areas)
    return sinks.refresh_cache(spark, path, "outcode", written + age + timedelta(seconds=0.5), age, fetch(3), areas).select("outcode", "properties", "version")


def scraped_sales(spark, sf):
    none = F.lit(None).cast("string")
    parsed = view(spark, sf, "sale").select("id", "price_numeric", "date_sold_iso", "tenure", "property_type")
    raw = view(spark, sf, "raw_sale").select("id", "property_id", "date_sold", "price")
    return raw.join(parsed, "id").withColumn("price_change_pct", none)


@query
def last_entered_sale(spark, sf):
    return last_entered(scraped_sales(spark, sf), view(spark, sf, "property"))


@query
def sales_export(spark, sf):
    properties = view(spark, sf, "property").withColumns({
        "url": F.lit(None).cast("string"), "floorplan_urls": F.lit(None).cast("string"),
    })
    return sinks.sales_export(properties, scraped_sales(spark, sf))


@query
def dataset_size(spark, sf):
    return priced_property_count(view(spark, sf, "sale"))


@query
def repeat_sales(spark, sf):
    return repeat_sold_properties(view(spark, sf, "sale"))


# --- table maintenance -------------------------------------------------------

def records_of(spark, sf):
    none = F.lit(None).cast("array<string>")
    return view(spark, sf, "record").withColumns({"extra_features": none, "floorplan_urls": none})


UPSERTED = ("address", "postcode", "postcode_clean", "property_type", "bedrooms", "bathrooms", "url",
            "listing_status", "listing_price", "listing_checked_at", "extra_features")


@query
def upsert_properties(spark, sf):
    stored = view(spark, sf, "property").withColumn("url", F.lit(None).cast("string"))
    merged = upsert.upsert_properties(stored, upsert.record_changes(records_of(spark, sf)))
    return merged.select(*UPSERTED)


@query
def dedup_sales(spark, sf):
    raw = view(spark, sf, "raw_sale")
    arriving = raw.select(
        "property_id", text.date_without_leading_zeros(F.col("date_sold")).alias("date_sold"),
        text.price_normalised(F.col("price")).alias("price"), F.col("id").alias("seq"),
        F.lit(0).alias("position"), F.col("id").alias("sale_id"),
    )
    repeated = arriving.unionByName(arriving.withColumn("seq", F.col("seq") + 1000000000))
    stored = arriving.join(raw.where("o_orderstatus = 'F'").select(F.col("id").alias("sale_id")), "sale_id")
    return upsert.new_sales(stored, repeated)


@query
def upsert_planning(spark, sf):
    rows = planning_of(spark, sf)
    arriving = rows.where("is_major").withColumns({
        "status": F.lit("refreshed"), "fetched_at": F.col("fetched_at") + F.expr("interval 90 days"),
    })
    return upsert.upsert_planning(rows, arriving, datetime(2024, 3, 15)).select(
        "postcode", "reference", "status", "is_major", "fetched_at"
    )


@query
def replace_crime(spark, sf):
    counts = crime_of(spark, sf)
    arriving = counts.where("category = 'burglary'").withColumn("count", F.col("count") * 2)
    failures = counts.where("category = 'drugs' AND postcode LIKE 'A%'").select("postcode", "month")
    return upsert.replace_crime(counts, arriving, failures, expected_months=100)


# --- modelling ---------------------------------------------------------------

ML_FEATURES = ("bedrooms", "bathrooms", "property_type", "latitude", "longitude", "tenure", "sale_year",
               "sale_month", "sale_quarter", "parking", "garden", "double_glazed", "chain_free", "sq_ft",
               "lease_years", "total_crime", "burglary")


@query
def ml_dataset(spark, sf):
    return dataset.price_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), crime_of(spark, sf), ML_FEATURES
    )


@query
def ml_price_per_sqft(spark, sf):
    data = dataset.price_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), None, ("bedrooms",), "price_per_sqft"
    )
    return data.select("sale_id", "sq_ft", F.round("price_per_sqft", 4).alias("price_per_sqft"))


@query
def ml_price_change(spark, sf):
    data = dataset.price_change_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), None, ("bedrooms", "tenure", "sale_year")
    )
    return data.drop("address")


@query
def ml_scoring_rows(spark, sf):
    return dataset.scoring_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), None,
        ("bedrooms", "tenure", "sale_year", "sale_month", "sale_quarter"), "2025-08-15"
    )


@query
def ml_downcast(spark, sf):
    data = dataset.price_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), None,
        ("bedrooms", "sale_year", "double_glazed", "lease_years", "latitude"),
    )
    return dataset.downcast(data).drop("address", "property_id")


MODEL_FEATURES = ("bedrooms", "bathrooms", "property_type", "latitude", "longitude", "tenure",
                  "sale_year", "parking")


FITTED: dict[tuple[str, str], model.PriceModel] = {}


def scored_of(spark, sf):
    """The model of a table, fitted once in a session, and its scored test rows."""
    data = dataset.price_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), None, MODEL_FEATURES
    )
    rows, held_out = model.split(data, "temporal", "2000-01-01")
    key = (spark.sparkContext.applicationId, sf)
    if key not in FITTED:
        FITTED[key] = model.train(rows, "price_numeric", MODEL_FEATURES, log_transform=True)
    return FITTED[key], model.with_residual(model.score(FITTED[key], held_out), "price_numeric")


STUMP_FEATURES = ("bathrooms", "bedrooms", "sale_month", "sale_year")
STUMP_ROUNDS = 6


STUMP_MODELS: dict[tuple[str, str], stumps.StumpModel] = {}


def stump_model(spark, sf):
    """A model that SQL can state, fitted once in a session, and its scored test rows."""
    data = dataset.price_dataset(view(spark, sf, "sale"), view(spark, sf, "property"), None, STUMP_FEATURES)
    rows, held_out = model.split(data, "temporal", "2000-01-01")
    key = (spark.sparkContext.applicationId, sf)
    if key not in STUMP_MODELS:
        STUMP_MODELS[key] = stumps.fit(rows, "price_numeric", STUMP_FEATURES, STUMP_ROUNDS)
    fitted = STUMP_MODELS[key]
    return fitted, model.with_residual(stumps.score(fitted, held_out), "price_numeric")


@query
def ml_stumps(spark, sf):
    return stumps.stump_table(spark, stump_model(spark, sf)[0]).withColumn("gain", F.round(F.col("gain") / 1e6, 3))


@query
def ml_metrics(spark, sf):
    return model.metrics(stump_model(spark, sf)[1])


@query
def ml_predictions(spark, sf):
    rows = dataset.scoring_dataset(view(spark, sf, "sale"), view(spark, sf, "property"), None, STUMP_FEATURES, "2002-01-15")
    return model.predictions(stumps.score(stump_model(spark, sf)[0], rows))


@query
def ml_importance(spark, sf):
    return stumps.importance_table(spark, stump_model(spark, sf)[0])


@query
def ml_worst_predictions(spark, sf):
    return model.worst_predictions(stump_model(spark, sf)[1]).select("property_id", "sale_id", "predicted", "actual", "residual")


@query
def ml_residuals(spark, sf):
    return stump_model(spark, sf)[1].select("property_id", "sale_id", "date_sold_iso", "predicted", "actual", "residual")


@query
def ml_residual_histogram(spark, sf):
    return model.residual_histogram(stump_model(spark, sf)[1])


@query
def ml_category_means(spark, sf):
    """Mean price of each sale's type over the sales of other folds."""
    rows = dataset.price_dataset(view(spark, sf, "sale"), view(spark, sf, "property"), None, ("property_type",))
    means = model.means_of_other_folds(rows, "property_type", "price_numeric", 100000.0, F.pmod("sale_id", F.lit(5)))
    return means.select("sale_id", "property_type", F.round("property_type__mean", 4).alias("mean"))


def naive_residuals(spark, sf):
    """Residuals of the previous sale as a forecast of the latest one."""
    pairs = latest_two_sales(view(spark, sf, "sale"))
    rows = pairs.select(
        "property_id", F.col("latest.sale_id").alias("sale_id"),
        F.col("latest.price_numeric").alias("price_numeric"),
        F.col("previous.price_numeric").cast("double").alias("predicted"),
    )
    return model.with_residual(rows, "price_numeric")


@query
def naive_forecast_histogram(spark, sf):
    return model.residual_histogram(naive_residuals(spark, sf))


@query
def naive_forecast_metrics(spark, sf):
    return model.metrics(naive_residuals(spark, sf))


@query
def naive_forecast_worst(spark, sf):
    return model.worst_predictions(naive_residuals(spark, sf))


# The whole output of gradient-boosted trees, which SQL cannot state; tests hold it against its scored rows.

@query
def fitted_metrics(spark, sf):
    return model.metrics(scored_of(spark, sf)[1])


@query
def fitted_predictions(spark, sf):
    rows = dataset.scoring_dataset(
        view(spark, sf, "sale"), view(spark, sf, "property"), None, MODEL_FEATURES, "2002-01-15"
    )
    return model.predictions(model.score(scored_of(spark, sf)[0], rows))


@query
def fitted_importance(spark, sf):
    return model.importance_table(spark, scored_of(spark, sf)[0])


@query
def fitted_worst_predictions(spark, sf):
    return model.worst_predictions(scored_of(spark, sf)[1])


@query
def fitted_residual_histogram(spark, sf):
    return model.residual_histogram(scored_of(spark, sf)[1])


# --- streams -----------------------------------------------------------------

def table_stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of files."""
    return jobs.stream_files(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def event_stream(spark, sf):
    return table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_period_totals(spark, sf):
    totals = jobs.period_totals(event_stream(spark, sf), "ts", "value", "1 day", "2 hours", "event_type")
    rows = jobs.collect_updates(totals, ["period_start", "event_type"], "periods")
    return rows.withColumn("avg_price", F.round("avg_price", 6))


@query
def stream_freshness(spark, sf):
    live = jobs.freshness_view(event_stream(spark, sf), "user_id", "ts")
    return jobs.collect_updates(live, ["user_id"], "freshness")


@query
def stream_dedup(spark, sf):
    once = jobs.deduplicate(event_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    rows = jobs.collect_updates(once.select("event_id", "user_id", "event_type"), ["user_id", "event_type"],
                                "dedup", mode="append")
    return rows.select("user_id", "event_type")


ORDERS_IN_TURNS = (0.25, 0.5, 0.75)


def ingested(spark, sf):
    """Tables of properties and sales after orders have arrived, in four turns, as a stream of scraped records."""
    folder = staging_path(spark, "ingest")
    stored = view(spark, sf, "property").withColumn("url", F.lit(None).cast("string"))
    store = jobs.ingest_store(spark, f"{folder}/tables", stored.schema, schemas.sale_schema())
    store.load(property=stored)
    bring_in = jobs.ingest_batch(store, "orders")

    def records_arrive(batch, batch_id):
        none = F.lit(None).cast("array<string>")
        session = batch.sparkSession
        places = {t: table(session, sf, t) for t in ("customer", "nation", "region")}
        records = session.sql(VIEWS["record"], orders=batch, **places).withColumns({"extra_features": none, "floorplan_urls": none})
        bring_in(records.withColumn("sales", F.array(F.struct(
            F.col("date_sold"), F.col("price"), F.lit("").alias("price_change_pct"), F.col("sale_type").alias("property_type"), F.col("tenure")))), batch_id)

    orders = table(spark, sf, "orders")
    bounds = orders.agg(F.percentile_approx("o_orderkey", list(ORDERS_IN_TURNS))).first()[0] or []
    turn = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda bound: bound < F.col("o_orderkey")))
    for part in jobs.in_turns(orders.withColumn("turn", turn), "turn"):
        part.write.mode("append").parquet(f"{folder}/landing")
        jobs.run_available(jobs.stream_files(spark, f"{folder}/landing", part.schema), records_arrive, f"{folder}/checkpoint")
    return store.snapshot()


@query
def stream_ingest(spark, sf):
    return ingested(spark, sf).read(jobs.PROPERTY).select(*UPSERTED)


@query
def stream_ingest_sales(spark, sf):
    tables = ingested(spark, sf)
    places = tables.read(jobs.PROPERTY).select(F.col("id").alias("property_id"), "address")
    return tables.read(jobs.SALE).join(places, "property_id").select("address", "date_sold", "price", "price_numeric", "date_sold_iso", "property_type", "tenure")


# Events land in turns of five days; one in twenty arrives two turns late. A watermark two
# days behind the newest event drops most of these.
TURN = "CAST(floor(unix_seconds(ts) / 432000) AS INT) + CASE WHEN event_id % 20 = 0 THEN 2 ELSE 0 END"
DELAY = "2 days"


def event_turns(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.in_turns(events.withColumn("turn", F.expr(TURN)), "turn")


@query
def stream_periods_late(spark, sf):
    totals = jobs.replay(
        event_turns(spark, sf), lambda s: jobs.period_totals(s, "ts", "value", "1 day", DELAY, "event_type"), ["period_start", "event_type"], "late-periods")
    return totals.withColumn("avg_price", F.round("avg_price", 6))


@query
def stream_dedup_late(spark, sf):
    def once(stream):
        days = stream.select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
        return jobs.deduplicate(days, ["user_id", "event_type", "day"], "day", DELAY)
    return jobs.replay(event_turns(spark, sf), once, ["user_id", "event_type", "day"], "late-dedup", "append")


@query
def stream_freshness_late(spark, sf):
    return jobs.replay(event_turns(spark, sf), lambda s: jobs.freshness_view(s, "user_id", "ts"), ["user_id"], "late-freshness")


def interrupted(do, calls):
    """``do``, but lost after as many calls."""
    left = [calls]

    def attempt(items):
        left[0] -= 1
        if left[0] < 0:
            raise InterruptedError
        return do(items)
    return attempt


@query
def resumed_work(spark, sf):
    """Properties counted by postcode in four batches, of which the first run finishes two."""
    homes = view(spark, sf, "property")
    results = spark.createDataFrame([], "postcode string, properties bigint").schema
    store = jobs.work_store(spark, staging_path(spark, "work"), results)

    def count(items):
        return homes.join(items, "postcode").groupBy("postcode").agg(F.count("*").alias("properties"))

    work = homes.select("postcode")
    try:
        jobs.run_work(work, store, interrupted(count, 2), 4)
    except InterruptedError:
        pass
    jobs.run_work(work, store, count, 4)
    done = store.snapshot().read("done").groupBy("postcode").agg(F.count("*").alias("times"))
    return store.snapshot().read("result").join(done, "postcode", "left")


# --- landed files ------------------------------------------------------------
# Views are written in the form in which files land, and read by the readers.

def landed(df, keys, name, fields):
    """One JSON record for each key, with a list of records in the order of ``at``."""
    spark = df.sparkSession
    path = staging_path(spark, f"landed-{name}")
    records = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("r")))).alias("l"))
    records.select(*keys, F.col("l.r").alias(name)).write.json(path)
    return path


@query
def landed_crime(spark, sf):
    path = staging_path(spark, "landed-crime")
    view(spark, sf, "crime_record").select("postcode", "category", "month").write.json(path)
    return readers.read_crime(spark, path).groupBy("postcode", "category", "month").agg(F.count("*").alias("count"))


GRID_PLACE = {"Easting": "100000 + id * 7919 % 500000", "Northing": "id * 104729 % 1000000"}


@query
def landed_schools(spark, sf):
    path = staging_path(spark, "schools")
    view(spark, sf, "property").selectExpr(
        "address AS EstablishmentName", "CASE WHEN id % 5 = 0 THEN 'Closed' ELSE 'Open' END AS `EstablishmentStatus (name)`",
        "CASE WHEN id % 2 = 0 THEN ' Primary' ELSE 'Secondary' END AS `PhaseOfEducation (name)`", "'Good' AS `OfstedRating (name)`",
        *[f"CASE WHEN id % 7 <> 0 THEN CAST({v} AS STRING) ELSE 'none' END AS {k}" for k, v in GRID_PLACE.items()],
    ).write.csv(path, header=True)
    return readers.read_schools(spark, path).select("kind", "subtype", "name", "rating", "lat", "lon")


@query
def green_space_sites(spark, sf):
    """Sites of four boundary vertices each, moved from the grid to degrees."""
    corners = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((-30, -20), (30, -20), (30, 20), (-30, 20))]))
    vertices = view(spark, sf, "property").selectExpr("id AS site_id", "CASE WHEN id % 3 > 0 THEN address END AS name", "CASE WHEN id % 2 = 0 THEN 'Play Space' END AS function",
                                                      *[f"{v} AS {k}" for k, v in GRID_PLACE.items()]).withColumn("c", corners)
    sites = readers.green_spaces(vertices.select("site_id", "name", "function", (F.col("Easting") + F.col("c.dx")).alias("x"), (F.col("Northing") + F.col("c.dy")).alias("y")))
    return sites.select("kind", "subtype", "name", "lat", "lon")


@query
def outcode_rollup(spark, sf):
    return coverage_ops.outcode_rollup(coverage_ops.postcode_list(view(spark, sf, "property"), view(spark, sf, "sale")))


@query
def landed_epc(spark, sf):
    certs = view(spark, sf, "epc_cert").withColumn("at", F.col("seq"))
    fields = [
        F.col("address"), F.col("epc_rating").alias("current-energy-rating"), F.col("epc_score").cast("string").alias("current-energy-efficiency"),
        F.when(F.col("environment_impact") > 0, F.col("environment_impact").cast("string")).otherwise("n/a").alias("environment-impact-current"),
        F.concat(F.col("estimated_energy_cost").cast("string"), F.lit(".7")).alias("heating-cost-current"),
        F.lit("bad").alias("hot-water-cost-current"), F.lit("100").alias("lighting-cost-current"),
    ]
    return readers.read_epc(spark, landed(certs, ["postcode"], "rows", fields))


@query
def landed_planning(spark, sf):
    rows = view(spark, sf, "planning_entity").withColumn("at", F.col("entity"))
    fields = [F.col("entity"), F.col("reference"), F.col("description"), F.col("end_date").alias("end-date"), F.col("decision_date").alias("decision-date")]
    return readers.read_planning(spark, landed(rows, ["postcode", "fetched_at"], "entities", fields))


@query
def landed_flood_areas(spark, sf):
    return readers.read_flood_areas(spark, landed(view(spark, sf, "flood_area").withColumn("at", F.col("notation")), ["postcode"], "items", [F.col("notation")]))


@query
def landed_flood_warnings(spark, sf):
    rows = view(spark, sf, "flood_warning").withColumn("at", F.col("position"))
    fields = [F.nullif(F.col("severity"), F.lit("3")).alias("severityLevel"), F.col("position").cast("string").alias("eaAreaName")]
    return readers.read_flood_warnings(spark, landed(rows, ["postcode"], "items", fields))


def landed_csv(df, name):
    path = staging_path(df.sparkSession, f"landed-{name}")
    df.write.csv(path, header=True)
    return path


@query
def landed_postcodes(spark, sf):
    """Ended postcodes and unreadable coordinates among the rows."""
    rows = view(spark, sf, "property").select(
        F.col("postcode").alias("pcds"), F.col("outcode").alias("lsoa11"),
        F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("latitude").cast("string")).alias("lat"), F.col("longitude").cast("string").alias("long"),
        F.when(F.col("id") % 5 == 0, "201001").alias("doterm"))
    return readers.read_postcode_lookup(spark, landed_csv(rows, "postcodes"))


@query
def landed_stops(spark, sf):
    """Stops of all kinds, of other kinds and without coordinates."""
    rows = view(spark, sf, "poi").select(
        F.col("id").alias("ATCOCode"), F.col("name").alias("CommonName"),
        F.when(F.col("id") % 9 == 0, "").otherwise(F.col("lat").cast("string")).alias("Latitude"), F.col("lon").alias("Longitude"),
        F.element_at(F.array(*map(F.lit, ("RSE", "TMU", "BCT", "FER", "xyz"))), (F.col("id") % 5 + 1).cast("int")).alias("StopType"))
    return readers.read_stops(spark, landed_csv(rows, "stops")).select("kind", "subtype", "name", "lat", "lon")


@query
def landed_imd(spark, sf):
    """Deciles under headers with extra wording, one missing, one unreadable."""
    rows = view(spark, sf, "imd").select(
        F.col("lsoa").alias("LSOA code (2011)"),
        F.col("imd_decile").alias("Index of Multiple Deprivation (IMD) Decile (where 1 is most deprived 10% of LSOAs)"),
        F.when(F.col("imd_income_decile") == 9, "n/a").otherwise(F.col("imd_income_decile").cast("string")).alias("Income Decile (where 1 is most deprived 10% of LSOAs)"))
    return readers.read_imd(spark, landed_csv(rows, "imd")).select("lsoa", "imd_decile", "imd_income_decile", "imd_crime_decile")


@query
def landed_broadband(spark, sf):
    """Connections by speed band; the shares are taken of all of them."""
    n = lambda k: (F.col("id") % k).cast("string")
    rows = view(spark, sf, "property").select(
        F.concat(F.col("postcode"), F.lit(" ")).alias("postcode"), F.when(F.col("id") % 8 == 0, "").otherwise((F.col("id") % 999 + 0.25).cast("string")).alias("Median download speed (Mbit/s)"),
        n(3).alias("Number of connections < 2 Mbit/s (number of lines)"), n(11).alias("Number of connections 10<30 Mbit/s"),
        n(13).alias("Number of connections 30<300 Mbit/s"), n(5).alias("Number of connections >= 300 Mbit/s"),
        n(17).alias("Number of connections >= 30 Mbit/s"), (F.col("id") % 90 + 0.45).cast("string").alias("FTTP %"))
    return readers.read_broadband(spark, landed_csv(rows, "broadband"))


@query
def csv_export_written(spark, sf):
    """The CSV export, written and read back; all columns are text."""
    path = staging_path(spark, "csv-export")
    sales = view(spark, sf, "sale").join(view(spark, sf, "raw_sale").select("id", "date_sold", "price"), "id")
    sinks.write_csv(sinks.csv_export(view(spark, sf, "property"), sales), path)
    return spark.read.csv(path, header=True, escape='"')


# --- pages -------------------------------------------------------------------

@query
def page_extract(spark, sf):
    """Everything a property page holds; lists as text."""
    # One small file of customers makes a page for each of them, so these lie in one partition.
    pages = html_pages.extract_pages(view(spark, sf, "property_page"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sale = lambda s: F.concat_ws("|", s["date_sold"], s["price"], s["price_change_pct"], s["property_type"], s["tenure"])
    return pages.select(
        "page_id", "url", "address", "postcode", "property_type", "bedrooms", "bathrooms",
        F.array_join("extra_features", "|").alias("extra_features"), F.array_join("floorplan_urls", "|").alias("floorplan_urls"),
        F.array_join(F.transform("sales", sale), ";").alias("sales"),
    )


@query
def page_addresses(spark, sf):
    return html_pages.extract_pages(table(spark, sf, "pages")).select("page_id", "url", "address", "postcode")


@query
def area_postcodes(spark, sf):
    directory = view(spark, sf, "property").select("postcode", "outcode").distinct()
    return readers.postcodes_for(directory, "am1")


# --- bundles -----------------------------------------------------------------

#: Key columns of the frames of a bundle in long form; a frame without any is one row.
BUNDLE_KEYS = {
    "price_histogram": ["bucket"], "time_series": ["month"], "postcode_heatmap": ["postcode"],
    "price_distribution": ["range"], "top_postcodes": ["postcode"], "property_types": ["property_type"],
    "bedroom_distribution": ["bedrooms"], "yearly_trends": ["year"], "price_trends": ["month"],
    "annual_medians": ["postcode", "year"], "metrics": ["postcode", "period_years"], "volatility": ["postcode"],
    "max_drawdown": ["postcode"], "forecast": ["postcode", "year"], "data_years": ["postcode"],
}


@query
def overview_bundle(spark, sf):
    frames = market_questions.overview_figures(view(spark, sf, "property"), view(spark, sf, "sale"))
    return one_pass.long_form(frames, BUNDLE_KEYS)


@query
def insights_bundle(spark, sf):
    frames = market_questions.insights_figures(view(spark, sf, "property"), view(spark, sf, "sale"))
    line = frames["trend_line"].selectExpr("x_min", "x_max", "round(y_at_min, 4) AS y_at_min", "round(y_at_max, 4) AS y_at_max")
    return one_pass.long_form({**frames, "trend_line": line}, BUNDLE_KEYS)


@query
def growth_bundle(spark, sf):
    """Growth figures of every postcode; the yearly medians are written once, from one scan."""
    frames = market_questions.postcode_growth(view(spark, sf, "property"), view(spark, sf, "sale"))
    return one_pass.long_form(frames, BUNDLE_KEYS)
