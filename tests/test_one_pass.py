from contract.views import view
from plotwise.operators import compare, insights, market, one_pass
from plotwise.operators.predicates import InsightsFilter
from plotwise.operators.sales import sales_with_property, without_sales
from plotwise.plans import market_questions

SF = "/root/testdata/sf0.001"
SALE = "id long, property_id long, price_numeric long, date_sold_iso string, tenure string, property_type string"
PROPERTY = ("id long, address string, postcode string, postcode_clean string, property_type string, bedrooms int, bathrooms int, "
            "listing_status string, listing_price long, listing_checked_at timestamp")


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def same_as_parts(properties, sales):
    base = sales_with_property(sales, properties)
    figures = market_questions.overview_figures(properties, sales)
    whole = market_questions.market_overview(properties, sales)
    for name, frame in figures.items():
        expected = whole[name].drop("band") if name == "price_distribution" else whole[name]
        assert sorted(frame.columns) == sorted(expected.columns), name
        assert rows(frame.select(*expected.columns)) == rows(expected), name
    unsold = without_sales(properties.where(InsightsFilter().on_listings()), sales)
    figures = market_questions.insights_figures(properties, sales)
    expected = {
        "price_histogram": insights.price_histogram(base), "time_series": insights.time_series(base),
        "trend_line": compare.trend_line(insights.scatter(base)), "postcode_heatmap": insights.postcode_heatmap(base),
        "kpis": insights.kpis(base, unsold),
    }
    for name, frame in figures.items():
        assert rows(frame.select(*expected[name].columns)) == rows(expected[name]), name


def test_same_as_the_parts(spark):
    same_as_parts(view(spark, SF, "property"), view(spark, SF, "sale"))


def test_rows_without_price_date_place_or_property(spark):
    properties = spark.createDataFrame([
        (1, "a", "SW1 1AA", "SW11AA", "Flat", 2, 1, None, None, None), (2, "b", None, None, None, None, 1, "for_sale", 5, None),
        (3, "c", "SW1 1AB", "SW11AB", "House", 3, 1, "for_sale", 7, None),
    ], PROPERTY)
    sales = spark.createDataFrame([
        (1, 1, 100000, "2020-01-05", None, None), (2, 1, None, "2020-02-05", None, None), (3, 1, 250000, None, None, " Terraced"),
        (4, 2, 90000, "2021-03-01", None, ""), (5, 99, 400000, "2021-04-01", None, None), (6, None, 1, None, None, None),
        (7, 1, 100000, "2022-01-05", None, None), (7, 1, 100000, "2022-01-05", None, None),
    ], SALE)
    same_as_parts(properties, sales)
    same_as_parts(properties, sales.limit(0))


def test_the_base_is_scanned_once(spark):
    properties, sales = view(spark, SF, "property"), view(spark, SF, "sale")
    base = sales_with_property(sales, properties)
    plan = one_pass.dashboard_cells(base)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("orders.parquet") == 1 and plan.count("customer.parquet") == 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    for name, frame in {**market_questions.overview_figures(properties, sales), **market_questions.insights_figures(properties, sales)}.items():
        if name != "kpis":
            assert not any(SF in file for file in frame.inputFiles()), name


def test_long_form(spark):
    frames = {"a": spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "k int, t string, v double"),
              "b": spark.createDataFrame([(7,)], "n long")}
    got = {(r["section"], r["key"], r["measure"], r["value"], r["label"]) for r in one_pass.long_form(frames, {"a": ["k"]}).collect()}
    assert got == {("a", "1", "t", None, "x"), ("a", "1", "v", 2.5, None), ("a", "2", "t", None, None), ("a", "2", "v", None, None),
                   ("b", "", "n", 7.0, None)}
