import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plotwise.operators import (
    area_records, compare, coverage, growth, insights, lookups, market, order_stats, predicates, sales,
    similar, upsert,
)
from plotwise.operators.predicates import InsightsFilter
from plotwise.plans import market_questions

PROPERTY = ("id bigint, address string, postcode string, postcode_clean string, property_type string, bedrooms int,"
            " bathrooms int, listing_status string, listing_price bigint, listing_price_display string,"
            " listing_url string, listing_checked_at timestamp, created_at timestamp, updated_at timestamp,"
            " latitude double, longitude double, extra_features string")
SALE = ("id bigint, property_id bigint, date_sold string, price string, price_numeric bigint, date_sold_iso string,"
        " price_change_pct string, property_type string, tenure string")


def prop(i, postcode="SW20 8NE", kind="FLAT", beds=2, status=None, price=None, **more):
    row = dict(id=i, address=f"{i} High Street, {postcode}", postcode=postcode,
               postcode_clean=postcode.replace(" ", "") if postcode else None, property_type=kind, bedrooms=beds,
               bathrooms=1, listing_status=status, listing_price=price, listing_price_display=None,
               listing_url=None, listing_checked_at=None, created_at=datetime(2024, 1, 1),
               updated_at=datetime(2024, 1, 1), latitude=51.4, longitude=-0.2, extra_features=None)
    row.update(more)
    return tuple(row.values())


def sale(i, pid, price, date, kind=None, tenure=None):
    return (i, pid, None, None, price, date, None, kind, tenure)


@pytest.fixture
def tables(spark):
    def make(properties, sold):
        return spark.createDataFrame(properties, PROPERTY), spark.createDataFrame(sold, SALE)
    return make


def test_single_sale_overview(tables):
    p, s = tables([prop(1)], [sale(1, 1, 450000, "2023-11-04")])
    out = market_questions.market_overview(p, s)
    assert out["totals"].first() == (1, 1, 1, "2023-11-04", "2023-11-04", 450000)
    assert out["median_price"].first() == (450000,)
    assert [r["count"] for r in out["price_distribution"].collect()] == [0, 0, 1, 0, 0]


def test_insights_medians_and_counts(tables):
    p, s = tables([prop(1), prop(2, "SW20 9AA"), prop(3, status="for_sale", price=400000)],
                  [sale(1, 1, 450000, "2023-11-04"), sale(2, 2, 300000, "2023-11-05"), sale(3, 2, None, "2022-01-01")])
    out = market_questions.housing_insights(p, s)
    row = out["kpis"].first()
    assert (row["median_price"], row["total_sales"], row["total_properties"]) == (375000, 3, 3)
    assert out["current_listings"].count() == 1
    only = market_questions.housing_insights(p, s, InsightsFilter(postcode_prefix="sw20 9"))["kpis"].first()
    assert (only["total_sales"], only["median_price"]) == (2, 300000)


def test_empty_base_gives_no_figures(tables):
    p, s = tables([prop(1)], [])
    base = sales.sales_with_property(s, p)
    row = insights.kpis(base).first()
    assert row["total_sales"] == 0 and row["median_price"] is None
    assert insights.price_histogram(base).count() == 0


def test_histogram_of_one_price(tables):
    p, s = tables([prop(1)], [sale(1, 1, 100, "2023-01-01"), sale(2, 1, 100, "2023-01-02")])
    rows = insights.price_histogram(sales.sales_with_property(s, p)).collect()
    assert [(r["bucket"], r["min_price"], r["max_price"], r["count"]) for r in rows] == [
        (0, 100, 101, 2), (19, 119, 120, 0)]


def test_growth_of_one_postcode(tables):
    p, s = tables([prop(1)], [sale(i, 1, v, f"{2020 + i}-06-01") for i, v in enumerate([300000, 330000, 360000, 400000])])
    out = market_questions.postcode_growth(p, s)
    assert out["annual_medians"].count() == 4
    cagr = {r["period_years"]: r["cagr_pct"] for r in out["metrics"].collect()}
    assert cagr[3] == round(((400000 / 300000) ** (1 / 3) - 1) * 100, 2) == cagr[10]
    assert cagr[1] == round((400000 / 360000 - 1) * 100, 2)
    assert out["data_years"].first()["data_years"] == 3
    assert out["max_drawdown"].first()["max_drawdown_pct"] is None
    returns = [10.0, 100 / 11, 100 / 9]
    assert out["volatility"].first()["volatility_pct"] == round(statistics.stdev(returns), 2)
    assert [r["year"] for r in out["forecast"].orderBy("year").collect()] == [2024, 2026, 2028]


def test_growth_needs_history(tables):
    p, s = tables([prop(1)], [sale(1, 1, 100, "2020-01-01")])
    out = market_questions.postcode_growth(p, s)
    assert out["volatility"].first()["volatility_pct"] is None
    assert out["forecast"].count() == 0
    assert out["metrics"].first()["cagr_pct"] is None


def test_leaderboard_order(tables):
    p, s = tables([prop(1, "E1 6AA"), prop(2, "E2 7BB")], [
        sale(1, 1, 200000, "2020-01-01"), sale(2, 1, 300000, "2023-01-01"),
        sale(3, 2, 200000, "2020-01-01"), sale(4, 2, 220000, "2023-01-01")])
    rows = growth.growth_leaderboard(sales.sales_with_property(s, p)).collect()
    assert [r["postcode"] for r in rows] == ["E1 6AA", "E2 7BB"]
    assert rows[0]["sale_count"] == 2


def test_periods_text():
    assert growth.parse_periods("1, 3,10") == [1, 3, 10]
    for wrong in ("1,x", "40", "0", ",".join(map(str, range(1, 12)))):
        with pytest.raises(ValueError):
            growth.parse_periods(wrong)


def test_order_statistics_match_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(0, 5000)) for _ in range(801)] + [("c", 7), ("c", 9), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {r["k"]: (r["median"], r["upper_median"], r["count"]) for r in order_stats.price_stats(df, ["k"], "v").collect()}
    for key in "abc":
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == (statistics.median(values), values[len(values) // 2], len(values))
    every = sorted(v for _, v in rows if v is not None)
    row = order_stats.price_stats(df, [], "v").first()
    assert (row["median"], row["min"], row["max"]) == (statistics.median(every), every[0], every[-1])
    cuts = order_stats.quantile_points(df, "v", (0.25, 0.75)).first()
    assert cuts == (every[int(len(every) * 0.25)], every[int(len(every) * 0.75)])


def test_latest_sale_ties_and_gaps(tables):
    _, s = tables([prop(1)], [
        sale(1, 1, 100, "2020-01-01"), sale(2, 1, 200, "2020-01-01"), sale(3, 1, None, "2021-01-01"), sale(4, 1, 50, None)])
    assert sales.latest_sale(s).first()["latest_price"] == 200
    assert sales.latest_sale(s, priced=False).first()["sale_id"] == 3
    pair = sales.latest_two_sales(s).first()
    assert (pair["previous"]["sale_id"], pair["latest"]["sale_id"]) == (1, 2)


def test_list_and_suggest(tables):
    p, _ = tables([prop(1), prop(2, "E1 6AA", status="for_sale"), prop(3, None)], [])
    assert [r["id"] for r in predicates.list_properties(p, "SW20").collect()] == [1]
    assert [r["id"] for r in predicates.list_properties(p, listing_only=True).collect()] == [2]
    assert [r["id"] for r in predicates.list_properties(p, listing_only=False).collect()] == [1, 3]
    assert [r["postcode"] for r in predicates.suggest_postcodes(p, "e1-6").collect()] == ["E1 6AA"]


def test_freshness(tables):
    now = datetime(2024, 2, 1)
    p, _ = tables([prop(1, "A1 1AA", updated_at=now - timedelta(days=29)), prop(2, "B1 1AA", updated_at=now - timedelta(days=31)),
                   prop(3, "C1 1AA", updated_at=None)], [])
    assert {r["postcode"]: r["is_fresh"] for r in predicates.freshness(p, now).collect()} == {
        "A1 1AA": True, "B1 1AA": False, "C1 1AA": False}


@pytest.mark.parametrize("k", [1, 3])
def test_similar_equals_every_pair(tables, k):
    rng = random.Random(k)
    rows, sold = [], []
    for i in range(1, 90):
        rows.append(prop(i, rng.choice(["SW20 8NE", "SW2 1AA"]), rng.choice(["FLAT", "flat ", None]),
                         rng.choice([1, 2, 3, None])))
        if i % 9:
            sold.append(sale(i, i, rng.choice([100, 100, 100, 150, rng.randrange(50, 300)]), "2020-01-01"))
    p, s = tables(rows, sold)
    got = {}
    for r in similar.similar_properties(p, sales.latest_sale(s), k).orderBy("property_id", "rank").collect():
        got.setdefault(r["property_id"], []).append(r["similar_id"])
    prices = {x[1]: x[4] for x in sold}
    facts = {r[0]: (r[2].split()[0], (r[4] or "").strip().upper(), r[5]) for r in rows}
    for i, price in prices.items():
        out, kind, beds = facts[i]
        ranked = sorted(
            (abs(prices[j] - price), j) for j in prices if j != i and facts[j][0] == out
            and (not kind or facts[j][1] == kind)
            and (beds is None or (facts[j][2] is not None and abs(facts[j][2] - beds) <= 1)))
        assert got.get(i, []) == [j for _, j in ranked[:k]]


def test_epc_matching(spark, tables):
    p, _ = tables([prop(1, address="10 High Street, SW20 8NE"), prop(2, address="11 High Street, SW20 8NE"),
                   prop(3, address="12 Low Road, SW20 8NE"), prop(4, "E1 6AA", address="10 High Street, SW20 8NE, X")], [])
    certs = spark.createDataFrame([
        (1, "sw208ne", "10 HIGH STREET, LONDON", "D", 50, 40, 900), (2, "SW20 8NE", "10 High Street, SW20 8NE", "C", 72, 65, 1200),
        (3, "SW20 8NE", "11, HIGH  Court", "", 1, 1, 1), (4, "SW20 8NE", "11 HIGH STREET", "B", 80, 70, 800),
        (5, "SW20 8NE", "12 LOW ROAD, SW20 8NE", None, 1, 1, 1), (6, "SW20 8NE", "12 LOW ROAD", "A", 1, 1, 1),
    ], "seq bigint, postcode string, address string, epc_rating string, epc_score int, environment_impact int, estimated_energy_cost int")
    got = {r["property_id"]: (r["epc_rating"], r["epc_score"]) for r in lookups.match_epc(p, certs).collect()}
    assert got == {1: ("C", 72)}  # 2: first start match has no rating; 3: the exact one has none
    loose = {r["seq"]: r["property_id"] for r in lookups.match_epc_by_containment(p, certs).collect()}
    assert loose == {1: 1, 2: 1, 4: 2, 5: 3, 6: 3}


def test_containment_of_short_and_long_text(spark, tables):
    p, _ = tables([prop(1, address="FLAT 1 THE LONG BUILDING, NORTH WING, LONDON"), prop(2, address="ab")], [])
    certs = spark.createDataFrame([(1, "SW20 8NE", "north wing"), (2, "SW20 8NE", "x ab y"), (3, "SW20 8NE", "nowhere"),
                                   (4, "SW20 8NE", "the long building, north wing")], "seq bigint, postcode string, address string")
    assert {r["seq"]: r["property_id"] for r in lookups.match_epc_by_containment(p, certs).collect()} == {1: 1, 2: 2, 4: 1}


def test_lookups_fill_only_gaps(spark, tables):
    p, _ = tables([prop(1, latitude=None, longitude=None), prop(2, latitude=1.0, longitude=2.0), prop(3, "ZZ1 1ZZ", latitude=None)], [])
    places = spark.createDataFrame([("SW208NE", "E01", 51.5, -0.25), ("SW208NE", "E01", 51.5, -0.25)], "postcode string, lsoa string, lat double, lng double")
    got = {r["id"]: (r["latitude"], r["longitude"]) for r in lookups.geocode(p, places).collect()}
    assert got == {1: (51.5, -0.25), 2: (1.0, 2.0), 3: (None, -0.2)}
    imd = spark.createDataFrame([("E01", *range(1, 9))], "lsoa string, " + ", ".join(f"{c} int" for c in lookups.IMD_COLUMNS))
    deciles = {r["id"]: r["imd_decile"] for r in lookups.with_imd(p.withColumn("imd_decile", F.when(F.col("id") == 2, 9)), places, imd).collect()}
    assert deciles == {1: 1, 2: 9, 3: None}


def test_crime_window_edges(spark):
    counts = area_records.crime_counts(spark.createDataFrame(
        [("sw20 8ne", "2022-01", "burglary")] * 2 + [("SW20 8NE ", "2022-06", "drugs"), ("SW20 8NE", "bad", "drugs"), ("SW20 8NE", "2022-06", "")],
        "postcode string, month string, category string"))
    rows = spark.createDataFrame([(1, "SW208NE", "2022-12-31"), (2, "SW20 8NE", "2023-01-01"), (3, "SW20 8NE", "2023-06-01"),
                                  (4, "E1 6AA", "2022-12-31"), (5, "SW20 8NE", None)], "id int, postcode string, date_sold_iso string")
    got = {r["id"]: (r["total_crime"], r["burglary"], r["drugs"], r["robbery"]) for r in area_records.with_crime(rows, counts).collect()}
    assert got == {1: (3, 2, 1, 0), 2: (1, 0, 1, 0), 3: (None,) * 4, 4: (None,) * 4, 5: (None,) * 4}
    total = area_records.crime_summary(counts).where("facet = 'total'").first()
    assert (total["count"], total["months_covered"]) == (3, 2)


def test_planning_classes(one):
    assert one(area_records.is_major_development, "Erection of 15 dwellings with parking", "Single storey rear extension",
               "Conversion to 9 flats", "10 units", "2 flats and 30 houses", None) == [True, False, False, True, False, False]
    assert one(area_records.planning_type, "24/1/FUL", "24/1/hse", "24/1/COU", "x", "", None) == [
        "full", "householder", "change_of_use", "other", "unknown", "unknown"]


def test_flood_levels(spark):
    codes = spark.createDataFrame([(c,) for c in "ABCDEF"], "postcode string")
    areas = spark.createDataFrame([("B", "area"), ("C", "xZone3"), ("D", "zone2"), ("E", "area")], "postcode string, notation string")
    alerts = spark.createDataFrame([("D", "3"), ("E", "Severe"), ("F", "2")], "postcode string, severity string")
    got = {r["postcode"]: (r["flood_zone"], r["risk_level"]) for r in area_records.flood_risk(codes, areas, alerts).collect()}
    assert got == {"A": (1, "very_low"), "B": (2, "low"), "C": (3, "medium"), "D": (2, "medium"), "E": (2, "high"), "F": (1, "medium")}


def test_listing_rules(one):
    live = area_records.listing_status
    assert one(lambda v: live(v, F.lit(True), F.lit(False)), "RES_BUY", "RES_LET", None) == ["for_sale", "not_listed", "not_listed"]
    assert one(lambda v: area_records.listing_date(v, F.lit("2025-01-01")), "Added on 03/02/2026", "Reduced") == ["03/02/2026", "2025-01-01"]
    assert one(lambda v: area_records.asking_price_text(v, F.lit("flat, £325,000 in X")), "house for Guide price £450,000. Call", "no price") == [
        "Guide price £450,000", "£325,000"]


def test_coverage_of_missing_columns(spark, tables):
    p, s = tables([prop(1), prop(2, None, beds=None)], [sale(1, 1, None, None)])
    none = spark.createDataFrame([], "postcode string")
    rows = {r["feature"]: (r["filled"], r["total"], r["postcodes"]) for r in coverage.coverage_report(p, s, none, none).collect()}
    assert rows["Bedrooms / Bathrooms / Type"] == (1, 2, 1)
    assert rows["EPC Rating"] == (0, 2, 0) and rows["Crime Data"] == (0, 1, 0)
    assert rows["Sales (parsed price + date)"] == (0, 1, None)


def test_outcode_coverage(spark, tables):
    p, s = tables([prop(1), prop(2, "SW20 9AA"), prop(3, "E1 6AA")], [sale(1, 1, 5, "2020-01-01")])
    directory = spark.createDataFrame([("SW20 8NE", "SW20"), ("SW20 9AA", "SW20"), ("N1 1AA", "N1")], "postcode string, outcode string")
    rows = coverage.outcode_completeness(coverage.outcode_coverage(directory, coverage.postcode_list(p, s))).collect()
    assert [(r["outcode"], r["state"], r["pct"], r["property_count"]) for r in rows] == [
        ("SW20", "done", 100, 2), ("E1", "pending", 0, 1), ("N1", "pending", 0, 0)]


def test_compare_views(tables):
    p, s = tables([prop(1), prop(2, "E1 6AA")], [sale(1, 1, 100, "2020-01-01"), sale(2, 1, 200, "2022-01-01"), sale(3, 2, 300, "2020-01-05")])
    change = compare.property_appreciation(s).first()
    assert change["total_change_pct"] == 100.0 and abs(change["annualised_pct"] - 41.4) < 0.1
    trend = market.monthly_trend(sales.sales_with_property(s, p), ["postcode"])
    wide = compare.aligned_series(trend, "month", "postcode", ["SW20 8NE", "E1 6AA"], "avg_price").orderBy("month").collect()
    assert [tuple(r) for r in wide] == [("2020-01", 100, 300), ("2022-01", 200, None)]


# --- table maintenance -------------------------------------------------------

RECORD = ("seq bigint, ingested_at timestamp, address string, postcode string, property_type string, bedrooms int,"
          " bathrooms int, extra_features array<string>, floorplan_urls array<string>, url string,"
          " sales array<struct<date_sold string, price string, price_change_pct string, property_type string, tenure string>>,"
          " asking_price bigint, asking_price_display string, listing_id string")


def record(seq, address, sold=(), **more):
    row = dict(seq=seq, ingested_at=datetime(2024, 5, 1), address=address, postcode="SW20 8NE", property_type="flat", bedrooms=2,
               bathrooms=1, extra_features=["Garage"], floorplan_urls=[], url="/u", sales=list(sold), asking_price=None,
               asking_price_display="", listing_id="")
    row.update(more)
    return tuple(row.values())


def test_property_upsert(spark, tables):
    p, _ = tables([prop(7, address="A")], [])
    p = p.withColumns({"floorplan_urls": F.lit(None).cast("string"), "url": F.lit("/old")})
    changes = upsert.record_changes(spark.createDataFrame([
        record(1, "A", bedrooms=0, postcode="", property_type="", bathrooms=None, extra_features=None),
        record(2, "B", asking_price=400000, asking_price_display="Guide"), record(3, "B", bedrooms=5, url=""),
    ], RECORD))
    rows = {r["address"]: r for r in upsert.upsert_properties(p, changes).collect()}
    a, b = rows["A"], rows["B"]
    assert (a["id"], a["bedrooms"], a["bathrooms"], a["postcode"], a["property_type"], a["url"]) == (7, 0, 1, "SW20 8NE", "FLAT", "/u")
    assert (b["listing_status"], b["listing_price"], b["bedrooms"], b["url"], b["property_type"]) == ("for_sale", 400000, 5, "/u", "FLAT")
    assert a["latitude"] == 51.4 and b["latitude"] is None and b["postcode_clean"] == "SW208NE"
    again = upsert.upsert_properties(spark.createDataFrame(list(rows.values()), p.schema), changes)
    assert {r["address"]: r["id"] for r in again.collect()} == {"A": 7, "B": b["id"]}


def test_sale_insert_is_idempotent(spark):
    rows = upsert.sale_rows(spark.createDataFrame([
        record(1, "A", [("04 Nov 2023", "450000", "", "flat", "leasehold"), ("4 Nov 2023", "£450,000", "9%", "x", "y")]),
        record(2, "A", [("4 Nov 2023", "£450,000", "", "z", ""), ("5 Nov 2023", "POA", "", "", "")]),
    ], RECORD)).withColumn("property_id", F.lit(7).cast("bigint")).drop("address")
    empty = spark.createDataFrame([], SALE)
    first = upsert.insert_sales(empty, rows)
    got = sorted((r["date_sold"], r["price"], r["price_numeric"], r["tenure"]) for r in first.collect())
    assert got == [("4 Nov 2023", "£450,000", 450000, "LEASEHOLD"), ("5 Nov 2023", "POA", None, "")]
    assert upsert.insert_sales(first, rows).count() == 2


def test_planning_and_crime_replacement(spark):
    cols = "postcode string, reference string, status string, fetched_at timestamp"
    stored = spark.createDataFrame([("A", "1", "old", datetime(2024, 1, 1)), ("A", "2", "old", datetime(2024, 3, 1)), ("B", "1", "old", datetime(2024, 1, 1))], cols)
    fresh = spark.createDataFrame([("A", "1", "new", datetime(2024, 3, 2)), ("B", "9", "new", datetime(2024, 3, 2))], cols)
    got = sorted(tuple(r)[:3] for r in upsert.upsert_planning(stored, fresh, datetime(2024, 3, 10)).collect())
    assert got == [("A", "1", "new"), ("A", "2", "old"), ("B", "9", "new")]
    crime = "postcode string, month string, category string, count bigint"
    held = spark.createDataFrame([("A", "2023-01", "x", 1), ("B", "2023-01", "x", 1)], crime)
    arriving = spark.createDataFrame([("A", "2023-02", "x", 5), ("B", "2023-02", "x", 5)], crime)
    failed = spark.createDataFrame([("B", f"2020-{m:02d}") for m in range(1, 7)], "postcode string, month string")
    got = sorted(tuple(r) for r in upsert.replace_crime(held, arriving, failed, expected_months=12).collect())
    assert got == [("A", "2023-02", "x", 5), ("B", "2023-01", "x", 1)]


def test_work_lists(spark):
    work = spark.createDataFrame([("sw20 8ne ", 2), ("E1 6AA", 1), ("SW20 8NE", 0)], "postcode string, position int")
    ordered = predicates.normalise_work_list(work)
    assert [r["postcode"] for r in ordered.collect()] == ["SW20 8NE", "E1 6AA"]
    done = spark.createDataFrame([("E1 6AA",)], "postcode string")
    assert [r["postcode"] for r in upsert.not_done(ordered, done).collect()] == ["SW20 8NE"]


def test_only_places_that_may_open_an_address_travel(spark):
    rng = random.Random(5)
    names = [f"{rng.randrange(1, 400)}{rng.choice(['', 'a', ' '])} {rng.choice(['High Street', 'Mill', 'Church Road, Flat 2'])}" for _ in range(150)]
    props = [(i, f"P{i % 3}", n) for i, n in enumerate(names)]
    certs = [(i, f"P{i % 4}", rng.choice(["", "Flat 1, "]) + rng.choice(names) + rng.choice(["", ", Annexe"])) for i in range(300)]
    p = spark.createDataFrame([*props, (900, "P0", None), (901, None, "Mill")], "id bigint, postcode string, address string")
    c = spark.createDataFrame([*certs, (900, "P0", None), (901, None, "Mill")], "seq bigint, postcode string, address string")

    def start(address):
        m = re.match(r"^(\d+)\s*(\S+)", address)
        return m and m.groups()

    wanted = {}
    for seq, at, cert in certs:
        a = cert.strip().upper()
        near = [i for i, pc, n in props if pc == at and ((b := n.strip().upper()) in a or a in b or (start(a) and start(a) == start(b)))]
        if near:
            wanted[seq] = min(near)
    assert {r["seq"]: r["property_id"] for r in lookups.match_epc_by_containment(p, c).collect()} == wanted
    texts = lookups._texts(p, "id", "p_id")
    places = texts.select("_pc", "_text", F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("_at")).withColumn(
        "_opening", F.substring("_text", F.col("_at"), F.lit(lookups.OPENING)))
    kept = places.where(lookups._may_open(lookups._opening_map(texts), "_pc", "_opening")).collect()
    opens = {(r["_pc"], r["_text"][: lookups.OPENING]) for r in texts.collect()}
    assert {(r["_pc"], r["_opening"]) for r in kept if r["_at"] == 1} == opens
    assert len(kept) < places.count() / 5
