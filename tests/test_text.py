import pytest
from pyspark.sql import functions as F

from plotwise.functions import numbers, text


def test_price_to_int(one):
    assert one(text.price_to_int, "£450,000", "Â£1,200,000", "450000", "Guide price £5", "", "POA", None) == [
        450000, 1200000, 450000, 5, None, None, None]


def test_price_forms(one):
    assert one(text.price_normalised, "450000", "Â£1,200", "POA") == ["£450,000", "£1,200", "POA"]
    assert one(text.price_display_or_blank, 450000, None, type_="bigint") == ["£450,000", ""]


def test_date_to_iso(one):
    assert one(text.date_to_iso, "4 Nov 2023", "04 November 2023", "  15 Mar 2021 ", "31 Feb 2020",
               "1 Foo 2020", "2023-11-04", "", None) == [
        "2023-11-04", "2023-11-04", "2021-03-15", None, None, None, None, None]


def test_dates_without_leading_zeros(one):
    assert one(text.date_without_leading_zeros, "04 Nov 2023", "10 Nov 2023", "1 Jan 2005") == [
        "4 Nov 2023", "10 Nov 2023", "1 Jan 2005"]


def test_postcodes(one):
    assert one(text.postcode_key, "sw20 8ne", "SW20-8NE", None) == ["SW208NE", "SW208NE", None]
    assert one(text.postcode_in, "10 High St, London sw20 8ne", "E1W1AT flat", "no code") == [
        "SW20 8NE", "E1W1AT", None]
    assert one(text.postcode_spaced, "SW208NE", "E1") == ["SW20 8NE", "E1"]
    assert one(text.outcode, "SW20 8NE", "E16AA", "E1") == ["SW20", "E1", "E1"]
    assert one(text.outcode_by_pattern, "SW20 8NE", "e1w 1at", "SW208NE") == ["SW20", "E1W", None]
    assert one(text.outcode_by_separator, "sw20 8ne", "SW20-8NE", "SW208NE", "E1") == ["SW20", "SW20", "SW20", "E1"]
    assert one(text.export_outcode, "sw20 8ne", "12345 99") == ["SW20", "1234"]


@pytest.mark.parametrize("address, street", [
    ("Flat 5, 14, Coombe Lane, London SW20 8ND", "Coombe Lane"),
    ("1, Woodlands, Raynes Park, London SW20 9JF", "Woodlands"),
    ("12a High Street, Wimbledon Park, SW19 8AA", "High Street"),
    ("Flat 3, Raynes Park, London SW20 9JF", "Raynes Park"),
    ("12, London, SW20 8ND", "Unknown"),
    ("", "Unknown"),
])
def test_street(one, address, street):
    assert one(text.street_of, address) == [street]


def test_bands(one):
    assert one(text.price_band, 0, 199999, 200000, 999999, 1000000, None, type_="bigint") == [
        "Under £200k", "Under £200k", "£200k-£400k", "£600k-£1M", "Over £1M", None]


def test_type_and_labels(one):
    assert one(lambda v: text.property_type_key(v, F.lit(None)), " flat ", None) == ["FLAT", "UNKNOWN"]
    assert one(text.category_column, "anti-social-behaviour") == ["anti_social_behaviour"]
    assert one(text.category_label, "anti-social-behaviour") == ["Anti Social Behaviour"]


def test_number_words(one):
    assert one(text.number_word, "Two", "10", "ten", "many") == [2, 10, 10, None]


def test_json_list(one):
    assert one(text.json_text_list, '[" a ", "", null, "b"]', "[]", "bad", '{"a": 1}', "", None) == [
        ["a", "b"], [], [], [], [], []]


def test_sale_date_parts(one):
    assert one(lambda v: F.struct(*text.sale_date_parts(v).values()), "2023-11-04", None) == [
        (2023, 11, 4), (None, None, None)]


def test_numbers(one):
    assert one(numbers.whole, 0.5, 1.5, 2.5, type_="double") == [0, 2, 2]
    assert one(numbers.finite, "1.5", "x", "NaN", "Infinity") == [1.5, None, None, None]
    assert one(lambda v: numbers.clamp_to(v, "byte"), 300.0, -2.5, None, type_="double") == [127, -2, None]
    assert one(lambda v: numbers.percent_change(v, F.lit(200)), 300, type_="bigint") == [50.0]


