"""Investment dashboard: histogram, series, heatmap, indicators, deals, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.features import parse_features
from plotwise.functions.numbers import half_even, whole
from plotwise.functions.text import price_display
from plotwise.operators import market, order_stats
from plotwise.operators.predicates import InsightsFilter
from plotwise.operators.sales import display_type, sales_with_property

BUCKETS = 20
DEAL_ROWS = 50
# A deal is more than 5 % below its postcode; risk steps at 15 and 25 %.
DEAL_FLOOR_PCT, LOW_RISK_PCT, MEDIUM_RISK_PCT = 5, 15, 25


def filtered_base(sales: DataFrame, properties: DataFrame, options: InsightsFilter,
                  features: DataFrame | None = None) -> DataFrame:
    """Sale-property base under the dashboard options.

    Feature options are predicates on parsed columns: only the columns asked about
    are parsed, unless a stored feature table is given, and the matching property
    ids reduce the base by a semi join, in the same plan.
    """
    base = sales_with_property(sales, properties).where(options.on_sales())
    names = options.feature_names()
    if not names:
        return base
    if features is None:
        features = parse_features(properties, wanted=names, keep=("id",))
    wanted = features.where(options.on_features()).select(F.col("id").alias("property_id"))
    return base.join(wanted, "property_id", "left_semi")


def price_histogram(base: DataFrame, value: str = "price_numeric", buckets: int = BUCKETS) -> DataFrame:
    """Equal-width histogram; the last bucket is closed, empty inner ones are hidden.

    Prices are counted once; the extremes are read from those counts as a scalar
    subquery, so the base is scanned a single time.
    """
    return histogram_of_counts(order_stats.value_counts(base, [], value), value, buckets)


def histogram_of_counts(counts: DataFrame, value: str = "price_numeric", buckets: int = BUCKETS) -> DataFrame:
    """The histogram of (value, n) rows."""
    # The row count keeps this branch on the same aggregate, so its shuffle is shared.
    extremes = counts.agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.sum("n").alias("rows")
    )
    width = F.ceil(F.greatest(F.col("_x.high") - F.col("_x.low"), F.lit(1)) / F.lit(buckets))
    slot = F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.lit(buckets - 1))
    placed = (
        counts.withColumn("_x", market.single_row(extremes))
        .withColumn("low", F.col("_x.low")).withColumn("width", width)
        .groupBy(slot.cast("int").alias("bucket")).agg(F.sum("n").alias("count"))
    )
    frame = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    floor_price = F.col("_x.low") + F.col("bucket") * width
    shown = (F.col("count") > 0) | F.col("bucket").isin(0, buckets - 1)
    return (
        frame.join(placed, "bucket", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("_x", market.single_row(extremes))
        .where((F.col("_x.rows") > 0) & shown)
        .select(
            "bucket", floor_price.cast("bigint").alias("min_price"),
            (floor_price + width).cast("bigint").alias("max_price"), "count",
        )
        .withColumn(
            "range_label",
            F.concat_ws("-", price_display(F.col("min_price")), price_display(F.col("max_price"))),
        )
        .orderBy("bucket")
    )


def time_series(base: DataFrame) -> DataFrame:
    """Monthly median and mean price with the number of sales."""
    return market.monthly_trend(base).select(
        "month", "median_price", "avg_price", F.col("count").alias("sales_count")
    )


def scatter(base: DataFrame, limit: int | None = None) -> DataFrame:
    """Bedrooms against price of every sale; with a limit, the first rows by sale id."""
    points = (
        base.where(market.priced() & F.col("bedrooms").isNotNull())
        .select(
            "sale_id", "bedrooms", F.col("price_numeric").alias("price"),
            F.coalesce("postcode", F.lit("Unknown")).alias("postcode"),
            display_type().alias("property_type"),
        )
    )
    return points if limit is None else points.orderBy("sale_id").limit(limit)


def postcode_heatmap(base: DataFrame) -> DataFrame:
    """Mean price, sales and yearly growth per postcode.

    One shuffle on (postcode, year); the postcode level is added up from it.
    """
    yearly = (
        base.where(market.priced() & F.col("postcode").isNotNull())
        .groupBy("postcode", "year")
        .agg(F.sum(F.col("price_numeric").cast("double")).alias("s"), F.count("*").alias("n"))
    )
    return heatmap_of_years(yearly)


def heatmap_of_years(yearly: DataFrame) -> DataFrame:
    """The heatmap of (postcode, year, s, n) rows: sum and number of prices."""
    per_postcode = yearly.withColumn("mean", F.col("s") / F.col("n")).groupBy("postcode").agg(
        whole(F.sum("s") / F.sum("n")).alias("avg_price"),
        F.sum("n").alias("count"),
        F.min("year").alias("y0"), F.max("year").alias("y1"),
        F.min_by("mean", "year").alias("m0"), F.max_by("mean", "year").alias("m1"),
    )
    span = F.col("y1") - F.col("y0")
    growth = (F.col("m1") - F.col("m0")) / F.col("m0") / span * 100
    return per_postcode.select(
        "postcode", "avg_price", "count",
        F.when((span > 0) & (F.col("m0") > 0), half_even(growth, 1)).alias("growth_pct"),
    ).orderBy(F.desc("count"), "postcode")


def _price_cells(base: DataFrame) -> DataFrame:
    """(month, price) with all rows and priced rows: what every indicator of price
    and time is added up from. Undated and unpriced sales keep their own cells."""
    return base.groupBy("month", "price_numeric").agg(
        F.count("*").alias("rows"), F.count("price_numeric").alias("n")
    )


def _overall(cells: DataFrame) -> DataFrame:
    """Total sales, spread and median over all cells."""
    by_price = cells.groupBy("price_numeric").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    # Squares are taken around a price in the middle: sums of plain squares cancel.
    centre = by_price.agg(F.avg("price_numeric").alias("centre"))
    ranked = order_stats.with_running_counts(by_price, [], "price_numeric").withColumn("_centre", centre.scalar())
    price = F.col("price_numeric").cast("double") - F.col("_centre")
    sums = ranked.agg(
        F.max("_centre").alias("centre"),
        F.sum("rows").alias("total_sales"), F.sum("n").alias("n"),
        order_stats.mean_expr("price_numeric").alias("mean"),
        F.sum(price * price * F.col("n")).alias("squares"),
        order_stats.median_expr("price_numeric").alias("median"),
    )
    off = F.col("mean") - F.col("centre")
    variance = (F.col("squares") - F.col("n") * off * off) / (F.col("n") - 1)
    return sums.withColumn("sd", F.when(F.col("n") >= 2, F.sqrt(F.greatest(variance, F.lit(0.0)))))


def _over_time(cells: DataFrame) -> DataFrame:
    """First and last monthly median, number of months, last two yearly counts.

    Months add up to years and years to one row, so a task meets at most one row
    per calendar year at the end.
    """
    ranked = order_stats.with_running_counts(cells, ["month"], "price_numeric")
    months = ranked.groupBy("month").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        whole(order_stats.median_expr("price_numeric")).alias("median"),
    )
    priced_month = F.when(F.col("n") > 0, F.col("month"))
    years = months.groupBy(F.substring("month", 1, 4).alias("year")).agg(
        F.sum("rows").alias("rows"), F.count(priced_month).alias("months"),
        F.min(F.when(F.col("n") > 0, F.struct("month", "median"))).alias("first"),
        F.max(F.when(F.col("n") > 0, F.struct("month", "median"))).alias("last"),
    )
    dated = F.col("year").isNotNull()
    row = years.agg(
        F.sum(F.when(dated, F.col("months"))).alias("months"),
        F.min(F.when(dated, F.col("first"))).alias("first"),
        F.max(F.when(dated, F.col("last"))).alias("last"),
        F.array_sort(F.collect_list(F.when(dated, F.struct("year", "rows")))).alias("years"),
    )
    return row.select(
        "months", F.col("first.median").alias("first_price"), F.col("last.median").alias("last_price"),
        F.get("years", F.size("years") - 1)["rows"].alias("last_count"),
        F.get("years", F.size("years") - 2)["rows"].alias("previous_count"),
    )


def _per_property(base: DataFrame) -> DataFrame:
    """Distinct properties and the sums behind the price per bedroom."""
    price, beds = F.col("price_numeric"), F.col("bedrooms")
    usable = price.isNotNull() & (beds > 0)
    held = base.groupBy("property_id").agg(
        F.sum(F.when(usable, price)).alias("bed_price"), F.sum(F.when(usable, beds)).alias("beds")
    )
    return _over_properties(held)


def _over_properties(held: DataFrame) -> DataFrame:
    return held.agg(
        F.count("*").alias("properties"), F.sum("bed_price").alias("bed_price"), F.sum("beds").alias("beds")
    )


def kpis(base: DataFrame, listing_only: DataFrame | None = None) -> DataFrame:
    """One row of indicators over the filtered base.

    The base is read twice: once reduced to properties and once to (month, price)
    cells, whose shuffle the overall and the time figures share. ``listing_only``
    adds the listed properties without sales to the total.
    """
    return kpis_of_cells(_price_cells(base), _per_property(base), listing_only)


def kpis_of_cells(cells: DataFrame, held: DataFrame, listing_only: DataFrame | None = None) -> DataFrame:
    """The indicators from (month, price_numeric, rows, n) cells and one row of
    properties, bed_price and beds."""
    row = (
        held
        .withColumn("_o", market.single_row(_overall(cells)))
        .withColumn("_t", market.single_row(_over_time(cells)))
    )
    extra: Column = F.lit(0)
    if listing_only is not None:
        row = row.withColumn("_listed", market.single_row(listing_only.agg(F.count("*").alias("n"))))
        extra = F.coalesce("_listed.n", F.lit(0))
    first, last = F.col("_t.first_price"), F.col("_t.last_price")
    appreciation = (last - first) / first / (F.col("_t.months") / 12.0) * 100
    before, now = F.col("_t.previous_count"), F.col("_t.last_count")
    velocity = F.when(before > 0, half_even((now - before) / before * 100, 1))
    spread = half_even(F.col("_o.sd") / F.col("_o.mean") * 100, 1)
    return row.select(
        F.when((F.col("_t.months") >= 2) & (first > 0) & (last != 0), half_even(appreciation, 1))
        .alias("appreciation_rate"),
        F.when(F.col("beds") > 0, whole(F.col("bed_price") / F.col("beds"))).alias("price_per_bedroom"),
        velocity.alias("market_velocity_pct"),
        F.when(velocity > 0, F.lit("accelerating"))
        .when(velocity.isNotNull(), F.lit("decelerating")).alias("market_velocity_direction"),
        F.when(F.col("_o.mean") > 0, spread).alias("price_volatility_pct"),
        F.coalesce("_o.total_sales", F.lit(0)).alias("total_sales"),
        (F.col("properties") + extra).alias("total_properties"),
        whole(F.col("_o.median")).alias("median_price"),
    )


def investment_deals(base: DataFrame, limit: int = DEAL_ROWS) -> DataFrame:
    """Latest sales well below the mean of their postcode, best first.

    The latest sale is a per-property aggregate over the joined base, so the base
    is not joined to itself; the postcode means are one row per postcode.
    """
    rows = base.where(market.priced() & F.col("postcode").isNotNull())
    payload = F.struct(
        "address", "postcode", display_type().alias("property_type"), "bedrooms",
        F.col("price_numeric").alias("price"), F.col("date_sold_iso").alias("date_sold"),
    )
    latest = (
        rows.where(market.dated()).groupBy("property_id")
        .agg(F.max_by(payload, F.struct("date_sold_iso", "sale_id")).alias("s"))
        .select("property_id", "s.*")
    )
    means = (
        rows.groupBy("postcode")
        .agg(F.avg("price_numeric").alias("mean"), F.count("*").alias("n"))
        .where((F.col("n") >= 2) & (F.col("mean") > 0)).drop("n")
    )
    discount = (F.col("mean") - F.col("price")) / F.col("mean") * 100
    risk = (
        F.when(F.col("discount") <= LOW_RISK_PCT, F.lit("Low"))
        .when(F.col("discount") <= MEDIUM_RISK_PCT, F.lit("Medium")).otherwise(F.lit("High"))
    )
    return (
        latest.join(means, "postcode").withColumn("discount", discount)
        .where(F.col("discount") > DEAL_FLOOR_PCT)
        .select(
            "property_id", "address", "postcode", "property_type", "bedrooms", "price",
            "date_sold", whole(F.col("mean")).alias("postcode_avg"),
            half_even(F.col("discount"), 1).alias("value_score"), risk.alias("risk_level"),
        )
        .orderBy(F.desc("value_score"), "property_id").limit(limit)
    )


def sort_deals(deals: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Deals by any column, unknown values last either way."""
    key = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return deals.orderBy(key, "property_id")


def current_listings(properties: DataFrame, options: InsightsFilter = InsightsFilter()) -> DataFrame:
    return properties.where(options.on_listings()).select(
        F.col("id").alias("property_id"), "address", "postcode",
        F.trim(F.coalesce("property_type", F.lit("Unknown"))).alias("property_type"),
        "bedrooms", "bathrooms", "listing_price", "listing_price_display", "listing_url",
        "listing_checked_at",
    )
