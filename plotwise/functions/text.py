"""Cleaning expressions for prices, dates, postcodes and addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POUND = "£"

# Months, number words, price bands, address vocabulary, patterns.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun",
          "jul", "aug", "sep", "oct", "nov", "dec")
NUMBER_WORDS = ("one", "two", "three", "four", "five",
                "six", "seven", "eight", "nine", "ten")
PRICE_BANDS = (
    ("Under £200k", 0, 200000),
    ("£200k-£400k", 200000, 400000),
    ("£400k-£600k", 400000, 600000),
    ("£600k-£1M", 600000, 1000000),
    ("Over £1M", 1000000, None),
)
POSTCODE_IN_TEXT = r"(?i)[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}"
POSTCODE_IN_ADDRESS = r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
OUTCODE_BEFORE_SPACE = r"(?i)^([A-Z]{1,2}\d[A-Z\d]?)\s"
STREET_WORDS = (
    "Road", "Street", "Avenue", "Lane", "Drive", "Close", "Way", "Gardens",
    "Crescent", "Place", "Terrace", "Court", "Hill", "Park", "Grove", "Square",
    "Walk", "Rise", "Row", "Mews", "Yard", "Passage", "Parade", "Green",
    "Circus", "Gate", "View", "Wharf", "Linkway", "Westway",
)
CITY_WORDS = ("london", "england", "uk", "united kingdom")
NEIGHBOURHOODS = (
    "raynes park", "wimbledon chase", "west wimbledon", "east wimbledon",
    "wimbledon park", "colliers wood", "south wimbledon", "morden park",
)
NUMBER_ONLY_PART = r"(?i)^(flat|unit|apt|apartment)?\s*\d+[a-zA-Z]?$"
LEADING_HOUSE_NUMBERS = r"^(\d+[a-zA-Z]?[\s-]*)+"


def strip(value: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def price_to_int(value: Column) -> Column:
    """First run of digits once pound signs, their mojibake and commas are gone."""
    digits = F.regexp_extract(F.translate(value, POUND + "Â,", ""), r"(\d+)", 1)
    return blank_to_null(digits).try_cast("bigint")


def price_normalised(value: Column) -> Column:
    """Price text in one form, ``£450,000``; text without digits is left alone."""
    return F.coalesce(price_display(price_to_int(value)), value)


def price_display(amount: Column) -> Column:
    return F.concat(F.lit(POUND), F.format_number(amount, 0))


def price_display_or_blank(amount: Column) -> Column:
    return F.coalesce(price_display(amount), F.lit(""))


def date_to_iso(value: Column) -> Column:
    """``4 Nov 2023`` to ``2023-11-04``; NULL when it is no calendar date."""
    pattern = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    text = strip(value)
    day = F.lpad(F.regexp_extract(text, pattern, 1), 2, "0")
    name = F.substring(F.lower(F.regexp_extract(text, pattern, 2)), 1, 3)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    year = F.regexp_extract(text, pattern, 3)
    iso = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), day)
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def date_without_leading_zeros(value: Column) -> Column:
    return F.regexp_replace(value, r"\b0(\d)", "$1")


def month_of(iso_date: Column) -> Column:
    return F.substring(iso_date, 1, 7)


def year_of(iso_date: Column) -> Column:
    return F.substring(iso_date, 1, 4).try_cast("int")


def month_index(year_month: Column) -> Column:
    """Months since year zero, so that windows over months are plain integers."""
    year = F.substring(year_month, 1, 4).try_cast("int")
    month = F.substring(year_month, 6, 2).try_cast("int")
    return year * 12 + month - 1


def sale_date_parts(iso_date: Column) -> dict[str, Column]:
    """Year, month and quarter of an ISO date, NULL when it does not parse."""
    month = F.substring(iso_date, 6, 2).try_cast("int")
    return {
        "sale_year": F.substring(iso_date, 1, 4).try_cast("int"),
        "sale_month": month,
        "sale_quarter": F.floor((month - 1) / 3).cast("int") + 1,
    }


def postcode_key(value: Column) -> Column:
    """Upper case without blanks and dashes: the join key for every postcode."""
    return F.regexp_replace(F.upper(value), r"[\s\-]", "")


def postcode_in(address: Column) -> Column:
    """First postcode found in an address, NULL when there is none."""
    found = F.regexp_extract(address, POSTCODE_IN_TEXT, 0)
    return blank_to_null(F.upper(strip(found)))


def postcode_spaced(value: Column) -> Column:
    """``SW208NE`` to ``SW20 8NE``; anything shorter than five stays as it is."""
    key = postcode_key(value)
    return F.when(
        F.length(key) >= 5,
        F.concat_ws(" ", key.substr(F.lit(1), F.length(key) - 3), F.right(key, F.lit(3))),
    ).otherwise(key)


def outcode(value: Column) -> Column:
    """Postcode without its three-character inward part."""
    key = postcode_key(value)
    return F.when(
        F.length(key) >= 5, key.substr(F.lit(1), F.length(key) - 3)
    ).otherwise(key)


def outcode_by_pattern(value: Column) -> Column:
    """Outward part of a spaced postcode, NULL when it does not look like one."""
    return blank_to_null(F.upper(F.regexp_extract(strip(value), OUTCODE_BEFORE_SPACE, 1)))


def outcode_by_separator(value: Column) -> Column:
    """Text before the first blank, else before the first dash, else ``outcode``."""
    text = strip(F.upper(value))
    return (
        F.when(F.contains(text, F.lit(" ")), F.split_part(text, F.lit(" "), F.lit(1)))
        .when(F.contains(text, F.lit("-")), F.split_part(text, F.lit("-"), F.lit(1)))
        .otherwise(outcode(text))
    )


def export_outcode(postcode: Column) -> Column:
    """Folder key of the sales export: outcode, else four characters of the postcode."""
    return F.coalesce(
        blank_to_null(F.regexp_extract(F.upper(postcode), OUTCODE_BEFORE_SPACE, 1)),
        F.substring(F.replace(postcode, F.lit(" "), F.lit("")), 1, 4),
    )


def street_of(address: Column) -> Column:
    """Street name in an address.

    Takes the first part with a street word that is no neighbourhood, then the
    first part that is no neighbourhood, then any part, each without its house
    number; ``Unknown`` when nothing is left.
    """
    street_word = r"(?i)\b(" + "|".join(STREET_WORDS) + r")\b"
    without_postcode = F.regexp_replace(address, POSTCODE_IN_ADDRESS, "")
    parts = F.transform(F.split(without_postcode, ","), strip)
    parts = F.filter(
        parts,
        lambda p: (p != "") & ~F.lower(p).isin(*CITY_WORDS) & ~p.rlike(NUMBER_ONLY_PART),
    )

    def named(part: Column) -> Column:
        return strip(F.regexp_replace(part, LEADING_HOUSE_NUMBERS, ""))

    by_word = F.filter(
        F.transform(
            F.filter(parts, lambda p: p.rlike(street_word) & ~F.lower(p).isin(*NEIGHBOURHOODS)),
            named,
        ),
        lambda s: s != "",
    )
    names = F.filter(F.transform(parts, named), lambda s: s != "")
    outside = F.filter(names, lambda s: ~F.lower(s).isin(*NEIGHBOURHOODS))
    return F.coalesce(F.get(by_word, 0), F.get(outside, 0), F.get(names, 0), F.lit("Unknown"))


def price_band(price: Column) -> Column:
    """Label of the fixed price band a price falls in."""
    label = F.when(price < PRICE_BANDS[0][2], F.lit(PRICE_BANDS[0][0]))
    for name, low, high in PRICE_BANDS[1:]:
        inside = price >= low
        if high is not None:
            inside = inside & (price < high)
        label = label.when(inside, F.lit(name))
    return F.when(price >= 0, label)


def property_type_key(*candidates: Column) -> Column:
    """First known type, trimmed and upper-cased, ``UNKNOWN`` when none is known."""
    return F.upper(first_text(*candidates, F.lit("Unknown")))


def first_text(*candidates: Column) -> Column:
    """First value that is neither NULL nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(strip(c)) for c in candidates])


def number_word(value: Column) -> Column:
    """Digits or an English number word (one to ten) as an integer."""
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    position = F.array_position(words, F.lower(value)).cast("int")
    return F.coalesce(F.nullif(position, F.lit(0)), value.try_cast("int"))


def json_text_list(value: Column) -> Column:
    """JSON text to a clean string array; anything but a list gives an empty one."""
    items = F.from_json(value, "array<string>")
    cleaned = F.filter(
        F.transform(items, strip), lambda item: item.isNotNull() & (item != "")
    )
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def category_column(category: Column) -> Column:
    return F.replace(category, F.lit("-"), F.lit("_"))


def category_label(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("-"), F.lit(" ")))
