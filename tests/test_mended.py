"""Cases that once went wrong."""

import json

import pytest
from pyspark.sql import functions as F

from plotwise.functions import text
from plotwise.operators import area_records, lookups
from plotwise.sources import readers


def test_the_eleventh_flood_warning_counts(spark):
    warnings = spark.createDataFrame([("A1 1AA", i, "3") for i in range(10)] + [("A1 1AA", 10, "Severe")], "postcode string, position int, severity string")
    areas = spark.createDataFrame([], "postcode string, notation string")
    row = area_records.flood_risk(spark.createDataFrame([("A1 1AA",)], "postcode string"), areas, warnings).first()
    assert (row["risk_level"], row["active_warnings"]) == ("high", 11)


def test_a_lookup_takes_one_whole_row(spark):
    facts = spark.createDataFrame([("K", 9, 1), ("K", 1, 9)], "k string, a int, b int")
    assert [tuple(r) for r in lookups._one_per_key(facts, "k", ["a", "b"]).collect()] == [("K", 1, 9)]


def test_a_house_number_is_never_cut(spark):
    df = spark.createDataFrame([("123",), ("12 3",), ("12HIGH ST",), ("7 LANE",)], "a string")
    got = [r[0] for r in df.select(lookups._number_and_word(F.col("a"))).collect()]
    assert got == [None, "12 3", "12 HIGH", "7 LANE"]


def test_a_blank_type_falls_through(spark):
    df = spark.createDataFrame([("", "Flat"), ("  ", " house "), (None, ""), ("Terraced ", "x")], "s string, p string")
    assert [r[0] for r in df.select(text.property_type_key(F.col("s"), F.col("p"))).collect()] == ["FLAT", "HOUSE", "UNKNOWN", "TERRACED"]


def test_map_elements_in_an_indented_document(spark, tmp_path):
    path = tmp_path / "pubs.json"
    path.write_text(json.dumps({"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "Fox"}}, {"center": {"lat": 3.0, "lon": 4.0}}]}, indent=2))
    assert [r["name"] for r in readers.read_pubs(spark, str(path)).orderBy("lat").collect()] == ["Fox", "Unknown Pub"]


def test_broken_records_are_an_error(spark, tmp_path):
    path = tmp_path / "crime.json"
    path.write_text('{"postcode": "A1",\n "category": "drugs", "month": "2024-01"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_crime(spark, str(path)).collect()
