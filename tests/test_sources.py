import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plotwise.operators import lookups
from plotwise.sources import html_pages, readers, sinks


def write(path, text):
    path.write_text(text, encoding="latin-1")
    return str(path)


def test_stops(spark, tmp_path):
    path = write(tmp_path / "s.csv", "ATCOCode,CommonName,Latitude,Longitude,StopType\n1,A,51.5,-0.1,RSE\n2,B,,-0.1,BCT\n3,C,51,0,FER\n4,D,51,0,TMU\n")
    rows = readers.read_stops(spark, path).orderBy("name").collect()
    assert [(r["kind"], r["name"], r["lat"]) for r in rows] == [("rail", "A", 51.5), ("tube", "D", 51.0)]


def test_schools(spark, tmp_path):
    path = write(tmp_path / "g.csv",
                 "URN,EstablishmentName,EstablishmentStatus (code),EstablishmentStatus (name),PhaseOfEducation (code),"
                 "PhaseOfEducation (name),OfstedRating (name),Easting,Northing\n"
                 "1,Oak,1,Open,2, Primary ,Outstanding,530000,180000\n2,Elm,2,Closed,2,Primary,Good,530000,180000\n"
                 "3,Ash,1,\"Open, but proposed to close\",4,Secondary,,x,1\n4,Fir,1,Open,4,Secondary,Good,900000,1\n")
    rows = readers.read_schools(spark, path).collect()
    assert [(r["name"], r["subtype"], r["rating"]) for r in rows] == [("Oak", "primary", "Outstanding")]
    assert rows[0]["lat"] == pytest.approx(51.504, abs=0.01)
    with pytest.raises(ValueError):
        readers.read_schools(spark, write(tmp_path / "bad.csv", "a,b\n1,2\n"))


def test_postcode_lookup_and_imd(spark, tmp_path):
    path = write(tmp_path / "n.csv", "pcds,lsoa11,lat,long,doterm\nSW20 8NE,E01,51.4,-0.2,\nSW1A 1AA,E02,51.5,-0.1,201001\nE1 6AA,E03,x,0,\n")
    rows = {r["postcode"]: (r["lsoa"], r["lat"]) for r in readers.read_postcode_lookup(spark, path).collect()}
    assert rows == {"SW208NE": ("E01", 51.4), "E16AA": ("E03", None)}
    imd = write(tmp_path / "i.csv", '"LSOA code (2011)","Index of Multiple Deprivation (IMD) Decile (where 1 is most deprived)","Income Decile (1)"\nE01,3,4\n')
    row = readers.read_imd(spark, imd).first()
    assert (row["lsoa"], row["imd_decile"], row["imd_income_decile"], row["imd_crime_decile"]) == ("E01", 3, 4, None)


def test_broadband(spark, tmp_path):
    head = ("postcode,Median download speed (Mbit/s),Number of connections < 2 Mbit/s (number of lines),Number of connections 10<30 Mbit/s,"
            "Number of connections 30<300 Mbit/s,Number of connections >= 300 Mbit/s,Number of connections >= 30 Mbit/s,FTTP %\n")
    folder = tmp_path / "b"
    folder.mkdir()
    write(folder / "one.csv", head + "sw20 8ne,63.44,1,2,3,4,7,12.34\n")
    write(folder / "two.csv", head + "E1 6AA,,0,0,0,0,0,\n")
    rows = {r["postcode"]: tuple(r)[1:] for r in readers.read_broadband(spark, str(folder)).collect()}
    assert rows == {"SW208NE": (63.4, 70.0, 40.0, 12.3), "E16AA": (None, None, None, None)}


def test_health_facilities(spark, tmp_path):
    line = lambda name, code, status: f"X,{name},2,3,4,5,6,7,8,{code},10,11,{status}\n"
    gp = write(tmp_path / "gp.csv", line("Dr A", "SW20 8NE", "ACTIVE") + line("Dr B", "SW20 8NE", "INACTIVE") + line("Dr C", "", "A"))
    hospital = write(tmp_path / "h.csv", line("St X", "E1 6AA", "") + line("St Y", "ZZ9 9ZZ", "nan"))
    rows = readers.read_health_facilities(spark, gp, hospital)
    assert sorted(r["name"] for r in rows.collect()) == ["Dr A", "St X", "St Y"]
    places = spark.createDataFrame([("SW208NE", 51.4, -0.2), ("E1 6AA", 51.5, 0.0)], "postcode string, lat double, lng double")
    poi = readers.health_poi(lookups.geocode_facilities(rows, places))
    assert sorted((r["kind"], r["name"], r["lat"]) for r in poi.collect()) == [("gp", "Dr A", 51.4), ("hospital", "St X", 51.5)]


def test_supermarkets_and_map_elements(spark, tmp_path):
    path = write(tmp_path / "r.csv", "id,retailer,store_name,long_wgs,lat_wgs\n1,Tesco Express,Tesco Raynes Park,-0.2,51.4\n2,Boots,Boots,-0.2,51.4\n3,Aldi,,x,51\n")
    assert [(r["name"], r["brand"]) for r in readers.read_supermarkets(spark, path).collect()] == [("Tesco Raynes Park", "Tesco Express")]
    data = {"elements": [{"lat": 51.4, "lon": -0.2, "tags": {"name": "The Fox"}}, {"center": {"lat": 51.5, "lon": -0.1}}, {"tags": {"name": "No place"}}]}
    pubs = readers.read_pubs(spark, write(tmp_path / "p.json", json.dumps(data))).orderBy("lat").collect()
    assert [(r["name"], r["lat"]) for r in pubs] == [("The Fox", 51.4), ("Unknown Pub", 51.5)]


def test_green_spaces(spark):
    vertices = spark.createDataFrame([("a", None, "Public Park Or Garden", 530000.0, 180000.0), ("a", None, "Public Park Or Garden", 530100.0, 180100.0),
                                      ("b", "Rec", None, 1e9, 1.0)], "site_id string, name string, function string, x double, y double")
    rows = readers.green_spaces(vertices).collect()
    assert [(r["name"], r["subtype"]) for r in rows] == [("Public Park Or Garden", "Public Park Or Garden")]


def test_postcode_directory(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([("SE1 7GA", "SE1"), ("SE17 1AA", "SE17"), ("SE17 2GG", "SE17"), ("SW1A 1AA", "SW1A")],
                          "postcode string, outcode string").write.partitionBy("outcode").parquet(path)
    directory = readers.read_postcode_directory(spark, path)
    found = lambda typed: [r["postcode"] for r in readers.postcodes_for(directory, typed).collect()]
    assert found("SE") == ["SE1 7GA", "SE17 1AA", "SE17 2GG"]
    assert found("se17g") == ["SE1 7GA"] and found("SE17 1") == ["SE17 1AA"] and found("SE1") == ["SE1 7GA"]
    with pytest.raises(ValueError):
        readers.postcodes_for(directory, "123")


def test_landed_records(spark, tmp_path):
    epc = {"postcode": "SW20 8NE", "rows": [{"address": "1 High st", "current-energy-rating": "C", "current-energy-efficiency": "72",
           "environment-impact-current": "x", "heating-cost-current": "500.7", "hot-water-cost-current": "bad", "lighting-cost-current": "60"}, {"address": "2"}]}
    rows = readers.read_epc(spark, write(tmp_path / "e.json", json.dumps(epc))).orderBy("seq").collect()
    assert tuple(rows[0])[2:] == ("1 HIGH ST", "C", 72, None, 560) and rows[1]["estimated_energy_cost"] is None
    plan = {"postcode": "SW20 8NE", "fetched_at": "2024-01-01T00:00:00Z", "entities": [
        {"entity": "9", "reference": "", "description": "12 flats", "end-date": "", "decision-date": "2024-01-01"}]}
    row = readers.read_planning(spark, write(tmp_path / "p.json", json.dumps(plan))).first()
    assert (row["reference"], row["status"], row["is_major"], row["application_type"]) == ("9", "decided", True, "other")
    flood = {"postcode": "A", "items": [{"severityLevel": "3", "eaAreaName": "x"}] * 12}
    assert readers.read_flood_warnings(spark, write(tmp_path / "f.json", json.dumps(flood))).count() == 12
    crime = '{"postcode":"A","category":"burglary","month":"2023-01"}\n{"postcode":"A","category":"","month":"2023-01"}\n{"postcode":"A","category":"x","month":"2023"}\n'
    assert readers.read_crime(spark, write(tmp_path / "c.json", crime)).count() == 1


def test_for_sale_records(spark, tmp_path):
    lines = [
        {"id": "7", "displayAddress": "1 High St, SW20 8NE", "bedrooms": 2, "propertySubType": "Flat", "price": {"amount": 400000, "displayPrices": [{"displayPrice": "Guide £400,000"}]}},
        {"id": "8", "address": "2 High St", "searchPostcode": "SW20", "propertyType": "house", "price": {"amount": 300000}},
        {"id": "9", "displayAddress": ""}]
    rows = readers.read_for_sale(spark, write(tmp_path / "s.json", "\n".join(map(json.dumps, lines)))).orderBy("listing_id").collect()
    assert [(r["postcode"], r["property_type"], r["asking_price"], r["asking_price_display"], r["bedrooms"]) for r in rows] == [
        ("SW20 8NE", "Flat", 400000, "Guide £400,000", 2), ("SW20", "house", 300000, "£300,000", 0)]


def test_listing_records(spark, tmp_path):
    lines = [
        {"address": "1 High St", "searchPostcode": "sw208ne", "detailUrl": "/x", "transactions": [{"dateSold": "4 Nov 2023", "price": 450000}, {"tenure": "Freehold"}]},
        {"address": "2 High St, E1 6AA", "transactions": [], "latestTransaction": {"dateSold": "1 Jan 2020", "displayPrice": "£1", "tenure": "Leasehold"}},
        {"address": "3 High St"}, {"address": ""}]
    rows = readers.read_listings(spark, write(tmp_path / "l.json", "\n".join(map(json.dumps, lines)))).orderBy("address").collect()
    assert [(r["postcode"], [(s["date_sold"], s["price"]) for s in r["sales"]]) for r in rows] == [
        ("SW20 8NE", [("4 Nov 2023", "£450,000")]), ("E1 6AA", [("1 Jan 2020", "£1")]), (None, [])]


PAGE = """<html><body><h1> 10 <b>High</b> Street, SW20 8NE</h1>
<table><tr><th>Date</th><th>Change</th><th>Price</th><th>Property</th><th>Tenure</th></tr>
<tr><td>4 Nov 2023</td><td>+5%</td><td>&pound;450,000</td><td>Flat</td><td>Leasehold</td></tr>
<tr><td>1 Jan 2010</td><td></td><td>£200,000</td><td>Freehold</td></tr><tr><td>x</td></tr></table>
<table><tr><td>a</td><td>b</td><td>c</td></tr></table>
<div><h2>Key Features</h2><p>text</p><ul><li>Garage</li><li> </li><li>Garden <i>room</i></li></ul></div><ul><li>menu</li></ul>
<dl><dt>Bedrooms</dt><dd>3 beds</dd><dt>Bathrooms</dt><dd>two</dd><dt>Type</dt><dd>Terraced</dd></dl>
<img src="/fp.png" alt="Floorplan"><a href="/floorplan.JPG">see</a><a href="/p"><img src="/in.png">Floorplan</a><img src="/fp.png" class="big floorplan">
<script>var h = "<h1>no</h1>";</script></body></html>"""


def test_pages_are_the_same_however_they_are_spread(spark):
    rows = [(i, "u", PAGE if i % 3 else None) for i in range(40)] + [(None, "v", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    spread = html_pages.extract_pages(df, 4)
    assert sorted(map(str, spread.collect())) == sorted(map(str, html_pages.extract_pages(df).collect()))
    empty = spark.createDataFrame([], df.schema)
    assert html_pages.extract_pages(empty, 4).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "v", "<p>nothing</p>"), (3, "w", None)], "page_id bigint, url string, html string")
    rows = html_pages.extract_pages(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["postcode"] == "SW20 8NE" and r["address"] == "10HighStreet, SW20 8NE"
    assert (r["bedrooms"], r["bathrooms"], r["property_type"]) == (3, 0, "Terraced")
    assert r["extra_features"] == ["Garage", "Gardenroom"]
    assert r["floorplan_urls"] == ["/fp.png", "/floorplan.JPG", "/in.png"]
    assert [(s["date_sold"], s["price"], s["property_type"], s["tenure"]) for s in r["sales"]] == [
        ("4 Nov 2023", "£450,000", "Flat", "Leasehold"), ("1 Jan 2010", "£200,000", "", "Freehold")]
    sales = html_pages.page_sales(html_pages.extract_pages(df)).orderBy("date_sold_iso").collect()
    assert [(s["price_numeric"], s["date_sold_iso"]) for s in sales] == [(200000, "2010-01-01"), (450000, "2023-11-04")]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, "1 High St", "SW20 8NE", "FLAT", 2, 1, '["Garage"]', None, "/u"), (2, "2 Low St", None, "FLAT", 2, 1, None, None, "/u")],
                              "id bigint, address string, postcode string, property_type string, bedrooms int, bathrooms int, extra_features string, floorplan_urls string, url string")
    s = spark.createDataFrame([(1, 1, "4 Nov 2023", "£1", 1, "2023-11-04", "", "", "F"), (2, 2, "x", "y", None, None, "", "house", "")],
                              "id bigint, property_id bigint, date_sold string, price string, price_numeric bigint, date_sold_iso string, price_change_pct string, property_type string, tenure string")
    out = str(tmp_path / "export")
    sinks.write_sales_export(sinks.sales_export(p, s), out)
    back = spark.read.parquet(out)
    assert [(r["outcode"], r["property_type"]) for r in back.collect()] == [("SW20", "FLAT")]
    assert set(back.columns) == {*sinks.EXPORT_COLUMNS, "outcode"}
    assert sinks.merge_parquet(spark, out).count() == 1
    sinks.write_enriched(p, str(tmp_path / "rich"))
    assert spark.read.parquet(str(tmp_path / "rich")).where("parking = 'Garage'").count() == 1
    sinks.write_csv(sinks.csv_export(p, s), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    now = datetime(2024, 1, 10)
    assert sinks.cache_is_stale(spark, str(tmp_path / "none"), now, 5)
    sinks.write_cache(p, str(tmp_path / "cache"), datetime(2024, 1, 1))
    assert sinks.cache_is_stale(spark, str(tmp_path / "cache"), now, 5) and not sinks.cache_is_stale(spark, str(tmp_path / "cache"), now, 30)
    path = sinks.write_version(p, str(tmp_path / "t"), 3, F.pmod(F.col("id"), F.lit(2)))
    assert path.endswith("version=3") and spark.read.parquet(path).count() == 2


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    from plotwise.operators.sales import sales_with_property
    p = spark.range(1000).selectExpr("id", "'a' AS address", "'SW20 8NE' AS postcode", "'SW208NE' AS postcode_clean",
                                     "'FLAT' AS property_type", "2 AS bedrooms", "1 AS bathrooms", "'x' AS listing_status")
    s = spark.range(3000).selectExpr("id", "id % 1000 AS property_id", "id AS price_numeric", "'2020-01-01' AS date_sold_iso",
                                     "'F' AS tenure", "'FLAT' AS property_type")
    try:
        sinks.save_bucketed(p, s, "bucketed_property", "bucketed_sale", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        base = sales_with_property(spark.table("bucketed_sale"), spark.table("bucketed_property"))
        assert base.count() == 3000
        assert "Exchange hashpartitioning(property_id" not in base._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_property")
        spark.sql("DROP TABLE IF EXISTS bucketed_sale")
