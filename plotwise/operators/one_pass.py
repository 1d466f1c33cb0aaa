"""Many figures of a bundle from one pass over its base.

Every row of the base is repeated once for each section of a bundle, with the keys of that
section alone, and reduced to cells before anything is shuffled. The measures are counts
and sums, so the reduction stays a hash aggregate. All frames of the bundle are then
worked out from the cells, which are few next to the base.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.numbers import whole
from plotwise.operators import insights, market, order_stats

Sections = Mapping[str, Sequence[str]]

DASHBOARD: Sections = {
    "price": ("month", "price_numeric"), "area": ("postcode", "year"),
    "bedrooms": ("bedrooms",), "property": ("property_id",),
}
OVERVIEW: Sections = {
    "price": ("held", "month", "price_numeric"), "area": ("held", "postcode"), "type": ("held", "type_key"),
    "bedrooms": ("held", "bedrooms"), "year": ("held", "year"),
}


def cells(base: DataFrame, sections: Sections, **more: Column) -> DataFrame:
    """section, the keys of all sections (NULL outside their own), rows, n and s.

    ``rows`` counts all rows of a cell, ``n`` those with a price, ``s`` adds these up;
    ``more`` are further aggregates.
    """
    keys = dict.fromkeys(key for held in sections.values() for key in held)
    of_key = {key: [name for name, held in sections.items() if key in held] for key in keys}
    spread = base.withColumn("section", F.explode(F.array(*[F.lit(name) for name in sections])))
    return spread.groupBy(
        "section", *[F.when(F.col("section").isin(names), F.col(key)).alias(key) for key, names in of_key.items()]
    ).agg(
        F.count("*").alias("rows"), F.count("price_numeric").alias("n"), F.sum("price_numeric").alias("s"),
        *[column.alias(name) for name, column in more.items()],
    )


def dashboard_cells(base: DataFrame) -> DataFrame:
    usable = market.priced() & (F.col("bedrooms") > 0)
    return cells(
        base, DASHBOARD, bed_price=F.sum(F.when(usable, F.col("price_numeric"))), beds=F.sum(F.when(usable, F.col("bedrooms"))),
    )


def of_section(held: DataFrame, name: str) -> DataFrame:
    return held.where(F.col("section") == name)


def line_of_sums(points: DataFrame, x: str = "bedrooms") -> DataFrame:
    """Least-squares line over rows of x, n and s (number and sum of the y there) and its
    ends at the extreme x; NULL when x does not vary."""
    value = F.col(x).cast("double")
    sums = points.agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.sum("n").alias("n"), F.sum("s").alias("y"),
        F.sum(value * F.col("n")).alias("x"), F.sum(value * value * F.col("n")).alias("xx"), F.sum(value * F.col("s")).alias("xy"),
    )
    spread = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(spread, F.lit(0.0))
    fit = sums.withColumn("slope", slope).withColumn("intercept", (F.col("y") - F.col("slope") * F.col("x")) / F.col("n"))
    return fit.select("x_min", "x_max", *[
        (F.col("slope") * F.col(end) + F.col("intercept")).alias(name) for end, name in (("x_min", "y_at_min"), ("x_max", "y_at_max"))
    ])


def dashboard(held: DataFrame, listing_only: DataFrame | None = None) -> dict[str, DataFrame]:
    """The figures of the investment dashboard from ``dashboard_cells``."""
    prices, areas = of_section(held, "price"), of_section(held, "area")
    priced = prices.where("n > 0")
    months = order_stats.stats_of_counts(priced.where("month IS NOT NULL").select("month", "price_numeric", "n"), ["month"], "price_numeric")
    properties = insights._over_properties(of_section(held, "property").select("property_id", "bed_price", "beds"))
    return {
        "price_histogram": insights.histogram_of_counts(priced.groupBy("price_numeric").agg(F.sum("n").alias("n"))),
        "time_series": months.select(
            "month", whole(F.col("median")).alias("median_price"), whole(F.col("avg")).alias("avg_price"), F.col("count").alias("sales_count")),
        "trend_line": line_of_sums(of_section(held, "bedrooms").where("n > 0 AND bedrooms IS NOT NULL")),
        "postcode_heatmap": insights.heatmap_of_years(areas.where("n > 0 AND postcode IS NOT NULL").select("postcode", "year", "s", "n")),
        "kpis": insights.kpis_of_cells(prices.select("month", "price_numeric", "rows", "n"), properties, listing_only),
    }


def overview_cells(sales_and_property: DataFrame) -> DataFrame:
    """Cells of all sales; ``held`` tells those whose property is known."""
    return cells(sales_and_property, OVERVIEW)


def overview(held: DataFrame) -> dict[str, DataFrame]:
    """The figures of the market overview from ``overview_cells``."""
    known = held.where("held")
    counts = of_section(held, "price").where("n > 0").groupBy("price_numeric").agg(F.sum("n").alias("n"))
    median = order_stats.stats_of_counts(counts, [], "price_numeric").select(F.col("upper_median").cast("bigint").alias("median_price"))
    trend = order_stats.stats_of_counts(
        of_section(known, "price").where("n > 0 AND month IS NOT NULL").select("month", "price_numeric", "n"), ["month"], "price_numeric")
    mean = whole(F.col("s") / F.col("n")).alias("avg_price")
    areas = of_section(known, "area").where("postcode IS NOT NULL").select("postcode", F.col("rows").alias("count"), mean)
    return {
        "median_price": median,
        "price_distribution": market.bands_of_counts(counts).drop("band"),
        "top_postcodes": areas.orderBy(F.desc("count"), "postcode").limit(10),
        "property_types": of_section(known, "type").where("n > 0").select(F.col("type_key").alias("property_type"), F.col("n").alias("count"), mean),
        "bedroom_distribution": of_section(known, "bedrooms").where("n > 0 AND bedrooms IS NOT NULL").select("bedrooms", F.col("n").alias("count"), mean),
        "yearly_trends": of_section(known, "year").where("year IS NOT NULL").select("year", F.col("rows").alias("count")),
        "price_trends": trend.select(
            "month", whole(F.col("avg")).alias("avg_price"), whole(F.col("median")).alias("median_price"),
            F.col("min").alias("min_price"), F.col("max").alias("max_price"), "count"),
    }


def long_form(frames: Mapping[str, DataFrame], keys: Sections) -> DataFrame:
    """section, key, measure and value (numbers) or label (text) of all frames; ``keys``
    names the key columns of a frame, the others are one row. Keys are joined by ``|``."""
    parts = []
    for name, frame in frames.items():
        figures = [
            F.struct(
                F.lit(field.name).alias("measure"),
                (F.lit(None) if field.dataType.simpleString() == "string" else F.col(field.name)).cast("double").alias("value"),
                (F.col(field.name) if field.dataType.simpleString() == "string" else F.lit(None)).cast("string").alias("label"))
            for field in frame.schema.fields if field.name not in keys.get(name, ())
        ]
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys.get(name, ())])
        parts.append(frame.select(F.lit(name).alias("section"), key.alias("key"), F.inline(F.array(*figures))))
    whole_bundle = parts[0]
    for part in parts[1:]:
        whole_bundle = whole_bundle.unionByName(part)
    return whole_bundle
