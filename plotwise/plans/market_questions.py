"""The answers a user asks for as one unit, as named DataFrames.

Nothing runs until a frame is used. Bundles that read the same filtered base many
times write it once to the shared folder first (``materialise_base``), so the join
is not repeated and the loss of an executor does not bring it back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plotwise.operators import compare, growth, insights, market, one_pass
from plotwise.operators.predicates import InsightsFilter
from plotwise.operators.sales import sales_with_property, without_sales
from plotwise.session import materialise


def market_overview(properties: DataFrame, sales: DataFrame) -> dict[str, DataFrame]:
    """Database-wide figures."""
    base = sales_with_property(sales, properties)
    return {
        "totals": market.overview_totals(properties, sales),
        "median_price": market.overall_upper_median(sales),
        "price_distribution": market.price_bands(sales),
        "top_postcodes": market.top_postcodes(base),
        "property_types": market.type_breakdown(base),
        "bedroom_distribution": market.bedroom_distribution(base),
        "yearly_trends": market.sales_volume(base),
        "price_trends": market.monthly_trend(base),
        "recent_sales": market.recent_sales(base),
    }


def overview_figures(properties: DataFrame, sales: DataFrame) -> dict[str, DataFrame]:
    """The figures of ``market_overview`` that are sums over sales, from one scan of the base."""
    known = sales_with_property(sales, properties.withColumn("held", F.lit(True)), "held", how="left")
    base = known.withColumn("held", F.coalesce("held", F.lit(False)))
    return one_pass.overview(materialise(one_pass.overview_cells(base), "overview-cells"))


def insights_figures(properties: DataFrame, sales: DataFrame,
                     options: InsightsFilter = InsightsFilter(), features: DataFrame | None = None) -> dict[str, DataFrame]:
    """The figures of ``housing_insights`` from one scan of the filtered base.

    Listed properties without a sale count in the total, which takes the keys of the sales
    once more.
    """
    base = insights.filtered_base(sales, properties, options, features)
    unsold = without_sales(properties.where(options.on_listings()), sales)
    return one_pass.dashboard(materialise(one_pass.dashboard_cells(base), "insights-cells"), unsold)


def postcode_analytics(properties: DataFrame, sales: DataFrame) -> dict[str, DataFrame]:
    """The per-postcode figures for every postcode; filter on ``postcode_clean`` for one."""
    base = sales_with_property(sales, market.with_street(properties), "street")
    key = ["postcode_clean"]
    return {
        "price_trends": market.monthly_trend(base, key),
        "property_types": market.type_breakdown(base, key),
        "street_comparison": market.street_comparison(base, key),
        "postcode_comparison": market.postcode_comparison(base, key),
        "bedroom_distribution": market.bedroom_distribution(base, key),
        "sales_volume": market.sales_volume(base, key),
    }


def housing_insights(properties: DataFrame, sales: DataFrame,
                     options: InsightsFilter = InsightsFilter(), features: DataFrame | None = None,
                     materialise_base: bool = True) -> dict[str, DataFrame]:
    """The investment dashboard under one set of options."""
    base = insights.filtered_base(sales, properties, options, features)
    if materialise_base:
        base = materialise(base, "insights-base")
    listings = insights.current_listings(properties, options)
    unsold = without_sales(properties.where(options.on_listings()), sales)
    scatter = insights.scatter(base)
    return {
        "price_histogram": insights.price_histogram(base),
        "time_series": insights.time_series(base),
        "scatter_data": scatter,
        "trend_line": compare.trend_line(scatter),
        "postcode_heatmap": insights.postcode_heatmap(base),
        "kpis": insights.kpis(base, unsold),
        "investment_deals": insights.investment_deals(base),
        "current_listings": listings,
    }


def postcode_growth(properties: DataFrame, sales: DataFrame,
                    periods: Sequence[int] = growth.DEFAULT_PERIODS,
                    materialise_medians: bool = True) -> dict[str, DataFrame]:
    """Growth figures of every postcode from one table of yearly medians."""
    medians = growth.annual_medians(sales_with_property(sales, properties))
    if materialise_medians:
        medians = materialise(medians, "annual-medians")
    return {
        "annual_medians": medians,
        "metrics": growth.cagr_periods(medians, periods),
        "volatility": growth.volatility(medians),
        "max_drawdown": growth.max_drawdown(medians),
        "forecast": growth.forecast(medians),
        "data_years": growth.data_span(medians),
    }
