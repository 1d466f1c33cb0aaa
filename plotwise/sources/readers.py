"""Readers for the landed files. Each returns a DataFrame in the library's shape.

Column names are resolved on ``df.columns`` only: no row is read for that. Bad
numbers become NULL instead of failing the scan, and no schema is inferred.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotwise.functions import geo, text
from plotwise.functions.numbers import finite, half_even
from plotwise.operators import area_records

# Stop types, brands and report columns of the open-data files.
STOP_KINDS = {"RSE": "rail", "TMU": "tube", "BCT": "bus"}
SHOP_BRANDS = (
    "tesco", "tesco express", "tesco extra", "tesco metro", "sainsburys", "sainsbury's",
    "sainsbury's local", "asda", "morrisons", "waitrose", "m&s food", "m&s simply food",
    "marks & spencer", "aldi", "lidl", "co-op", "cooperative", "the co-operative", "iceland",
    "farmfoods", "spar", "nisa", "costcutter", "budgens", "londis",
)
IMD_HEADERS = (
    ("Index of Multiple Deprivation (IMD) Decile", "imd_decile"),
    ("Income Decile", "imd_income_decile"),
    ("Employment Decile", "imd_employment_decile"),
    ("Education, Skills and Training Decile", "imd_education_decile"),
    ("Health Deprivation and Disability Decile", "imd_health_decile"),
    ("Crime Decile", "imd_crime_decile"),
    ("Barriers to Housing and Services Decile", "imd_housing_decile"),
    ("Living Environment Decile", "imd_environment_decile"),
)
SPEED_BANDS = ("< 2", "2<5", "5<10", "10<30", "30<300")
HEALTH_NAME, HEALTH_POSTCODE, HEALTH_STATUS = 1, 9, 12

POI_COLUMNS = ("kind", "subtype", "name", "brand", "rating", "lat", "lon")


def read_csv(spark: SparkSession, path: str, header: bool = True, encoding: str = "ISO-8859-1") -> DataFrame:
    """Text columns only; headers with dots are quoted on use."""
    return spark.read.csv(path, header=header, encoding=encoding, multiLine=False, escape='"')


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def find_column(columns: Iterable[str], *tests: Callable[[str], bool]) -> str | None:
    """First column that passes the first test any column passes."""
    names = list(columns)
    for test in tests:
        for name in names:
            if test(name.strip().lower()):
                return name
    return None


def one_of(*names: str) -> Callable[[str], bool]:
    return lambda column: column in names


def compact(column: str) -> str:
    return re.sub(r"[ ()]", "", column)


def poi_rows(df: DataFrame, kind: Column | str, **columns: Column) -> DataFrame:
    """Rows in the shape of the poi table; a content hash serves as stable id."""
    label = F.lit(kind) if isinstance(kind, str) else kind
    shaped = df.select(label.alias("kind"), *[
        columns.get(c, F.lit(None).cast("string")).alias(c) for c in POI_COLUMNS[1:]
    ])
    return shaped.withColumn("id", F.xxhash64(*POI_COLUMNS).bitwiseAND(F.lit(2**63 - 1)))


# --- postcode directory ------------------------------------------------------

def read_postcode_directory(spark: SparkSession, path: str) -> DataFrame:
    """Postcodes stored in one folder per outcode."""
    return spark.read.parquet(path).select("postcode", "outcode")


def postcodes_for(directory: DataFrame, typed: str) -> DataFrame:
    """Postcodes under a typed area or outcode prefix.

    Letters alone cover every outcode that starts with them. Otherwise the longest
    outcode reading that has matches is taken, then the shorter one. All filters
    are on the partition column or can be pushed to the scan.
    """
    key = re.sub(r"[\s-]", "", typed.upper())
    if not re.match(r"[A-Z]{1,2}", key):
        raise ValueError(f"not a postcode prefix: {typed!r}")
    if re.fullmatch(r"[A-Z]{1,2}", key):
        return directory.where(F.col("outcode").startswith(key)).select("postcode").orderBy("postcode")
    longest = re.match(r"[A-Z]{1,2}\d[A-Z\d]?", key)
    if not longest:
        raise ValueError(f"not a postcode prefix: {typed!r}")
    shorter = re.match(r"[A-Z]{1,2}\d", key).group(0)
    readings = list(dict.fromkeys([longest.group(0), shorter]))
    starts = F.replace(F.col("postcode"), F.lit(" "), F.lit("")).startswith(key)
    matches = directory.where(F.col("outcode").isin(*readings) & starts)
    best = matches.agg(F.max(F.length("outcode")).alias("n")).scalar()
    return matches.where(F.length("outcode") == best).select("postcode").orderBy("postcode")


# --- points of interest ------------------------------------------------------

def read_stops(spark: SparkSession, path: str) -> DataFrame:
    """Rail, tube and bus stops with coordinates."""
    df = read_csv(spark, path)
    kind = F.when(F.col("StopType") == "RSE", "rail").when(F.col("StopType") == "TMU", "tube").otherwise("bus")
    placed = df.where(F.col("StopType").isin(*STOP_KINDS)).withColumns({
        "lat": finite(F.col("Latitude")), "lon": finite(F.col("Longitude")),
    }).dropna(subset=["lat", "lon"])
    return poi_rows(placed, kind, subtype=F.col("StopType"), name=F.col("CommonName"),
                    lat=F.col("lat"), lon=F.col("lon"))


def school_columns(columns: Iterable[str]) -> dict[str, str | None]:
    """Which header holds what, names preferred over codes."""
    names = list(columns)

    def has(*parts: str) -> Callable[[str], bool]:
        return lambda c: all(p in compact(c) for p in parts)

    def opening(prefix: str, short: str, named: bool) -> Callable[[str], bool]:
        return lambda c: (compact(c).startswith(prefix) or compact(c) == short) and (
            not named or "name" in compact(c))

    return {
        "name": find_column(names, lambda c: compact(c) in ("establishmentname", "schoolname", "name")),
        "phase": find_column(names, opening("phaseofeducation", "phase", True),
                             opening("phaseofeducation", "phase", False)),
        "status": find_column(names, opening("establishmentstatus", "status", True),
                              opening("establishmentstatus", "status", False)),
        "ofsted": find_column(names, has("ofsted", "rating", "name"), has("ofsted", "rating")),
        "easting": find_column(names, one_of("easting")),
        "northing": find_column(names, one_of("northing")),
    }


def read_schools(spark: SparkSession, path: str) -> DataFrame:
    """Open schools with phase and rating, moved from the national grid to degrees."""
    df = read_csv(spark, path)
    found = school_columns(df.columns)
    for needed in ("name", "easting", "northing"):
        if not found[needed]:
            raise ValueError(f"school file has no {needed} column: {df.columns[:30]}")
    if found["status"]:
        df = df.where(F.contains(F.lower(_col(found["status"])), F.lit("open")))
    phase = F.lower(text.strip(_col(found["phase"]))) if found["phase"] else F.lit("unknown")
    rating = text.strip(_col(found["ofsted"])) if found["ofsted"] else F.lit("")
    grid = df.select(
        _col(found["name"]).alias("name"), phase.alias("phase"), rating.alias("ofsted"),
        finite(_col(found["easting"])).alias("easting"),
        finite(_col(found["northing"])).alias("northing"),
    ).dropna(subset=["easting", "northing"])
    placed = geo.reproject(grid)
    return poi_rows(placed, "school", subtype=F.col("phase"), name=F.col("name"),
                    rating=F.col("ofsted"), lat=F.col("lat"), lon=F.col("lon"))


def read_health_facilities(spark: SparkSession, gp_path: str, hospital_path: str) -> DataFrame:
    """Active practices and hospitals (name, postcode, kind) from headerless files.

    Coordinates come from ``lookups.geocode_facilities``.
    """
    def facilities(path: str, kind: str, active: tuple[str, ...]) -> DataFrame:
        df = read_csv(spark, path, header=False)
        names = df.columns
        if len(names) <= HEALTH_POSTCODE:
            return spark.createDataFrame([], "name string, postcode string, kind string")
        status = F.lit("ACTIVE")
        if len(names) > HEALTH_STATUS:
            status = F.coalesce(F.upper(text.strip(F.col(names[HEALTH_STATUS]))), F.lit("ACTIVE"))
        return df.select(
            text.blank_to_null(text.strip(F.col(names[HEALTH_NAME]))).alias("name"),
            text.blank_to_null(text.strip(F.col(names[HEALTH_POSTCODE]))).alias("postcode"),
            F.lit(kind).alias("kind"), status.alias("_status"),
        ).where(F.col("_status").isin(*active)).drop("_status").dropna(subset=["name", "postcode"])

    return facilities(gp_path, "gp", ("A", "ACTIVE")).unionByName(
        facilities(hospital_path, "hospital", ("A", "ACTIVE", "NAN"))
    )


def health_poi(located: DataFrame) -> DataFrame:
    return poi_rows(located, F.col("kind"), name=F.col("name"), lat=F.col("lat"), lon=F.col("lon"))


def read_supermarkets(spark: SparkSession, path: str) -> DataFrame:
    """Shops of known brands; name and brand stand in for each other."""
    df = read_csv(spark, path)
    brand = find_column(df.columns, lambda c: c in ("retailer", "fascia"))
    name = find_column(df.columns, one_of("store_name", "name"))
    lat = find_column(df.columns, one_of("lat_wgs", "latitude", "lat"))
    lon = find_column(df.columns, one_of("long_wgs", "longitude", "lon", "lng"))
    if not lat or not lon:
        raise ValueError(f"shop file has no coordinates: {df.columns[:20]}")
    brand_text = text.strip(_col(brand or name)) if brand or name else F.lit("Unknown")
    name_text = text.strip(_col(name)) if name and brand else brand_text
    rows = df.select(
        name_text.alias("name"), brand_text.alias("brand"),
        finite(_col(lat)).alias("lat"), finite(_col(lon)).alias("lon"),
    ).dropna(subset=["lat", "lon"])
    low = F.lower("brand")
    known = F.exists(F.array(*[F.lit(b) for b in SHOP_BRANDS]), lambda b: F.contains(low, b))
    return poi_rows(rows.where(known), "supermarket", name=F.col("name"), brand=F.col("brand"),
                    lat=F.col("lat"), lon=F.col("lon"))


OSM_SCHEMA = (
    "elements array<struct<lat double, lon double, center struct<lat double, lon double>,"
    " tags struct<name string>>>"
)


def read_map_elements(spark: SparkSession, path: str, kind: str, unnamed: str) -> DataFrame:
    """Pubs or gyms from map extracts: own position, else that of the centre.

    A file is one JSON document, on one line or many; a broken one is an error.
    """
    elements = spark.read.schema(OSM_SCHEMA).json(path, multiLine=True, mode="FAILFAST").select(F.explode("elements").alias("e"))
    lat = F.coalesce(F.nullif("e.lat", F.lit(0.0)), "e.center.lat")
    lon = F.coalesce(F.nullif("e.lon", F.lit(0.0)), "e.center.lon")
    rows = elements.select(
        F.coalesce("e.tags.name", F.lit(unnamed)).alias("name"), lat.alias("lat"), lon.alias("lon")
    ).dropna(subset=["lat", "lon"])
    return poi_rows(rows, kind, name=F.col("name"), lat=F.col("lat"), lon=F.col("lon"))


def read_pubs(spark: SparkSession, path: str) -> DataFrame:
    return read_map_elements(spark, path, "pub", "Unknown Pub")


def read_gyms(spark: SparkSession, path: str) -> DataFrame:
    return read_map_elements(spark, path, "gym", "Unknown Gym")


def green_spaces(vertices: DataFrame) -> DataFrame:
    """Sites placed at the mean of their boundary vertices.

    ``vertices`` has (site_id, name, function, x, y) in grid metres.
    """
    sites = vertices.groupBy("site_id").agg(
        F.max("name").alias("name"), F.max("function").alias("function"),
        F.avg("x").alias("easting"), F.avg("y").alias("northing"),
    )
    placed = geo.reproject(sites)
    name = F.coalesce(text.blank_to_null(F.col("name")), text.blank_to_null(F.col("function")), F.lit("Unknown"))
    function = F.coalesce(text.blank_to_null(F.col("function")), F.lit("Unknown"))
    return poi_rows(placed, "green_space", subtype=function, name=name, lat=F.col("lat"), lon=F.col("lon"))


# --- dimensions --------------------------------------------------------------

def read_postcode_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Active postcodes with area code and coordinates."""
    df = read_csv(spark, path)
    pick = {
        "postcode": find_column(df.columns, one_of("pcds", "pcd", "pcd2", "pcds2")) or df.columns[0],
        "lsoa": find_column(df.columns, one_of("lsoa11", "lsoa11cd", "lsoa21cd", "lsoa21")),
        "lat": find_column(df.columns, one_of("lat")),
        "lng": find_column(df.columns, one_of("long")),
    }
    ended = find_column(df.columns, one_of("doterm"))
    if ended:
        df = df.where(_col(ended).isNull())
    missing = F.lit(None)
    return df.select(
        text.postcode_key(_col(pick["postcode"])).alias("postcode"),
        (_col(pick["lsoa"]) if pick["lsoa"] else missing.cast("string")).alias("lsoa"),
        (finite(_col(pick["lat"])) if pick["lat"] else missing.cast("double")).alias("lat"),
        (finite(_col(pick["lng"])) if pick["lng"] else missing.cast("double")).alias("lng"),
    ).where(F.col("postcode").isNotNull() & (F.col("postcode") != ""))


def read_imd(spark: SparkSession, path: str) -> DataFrame:
    """Area code and eight deprivation deciles; headers may carry extra wording."""
    df = read_csv(spark, path)
    area = find_column(
        df.columns, lambda c: "lsoa" in c and any(part in c for part in ("code", "11", "21"))
    ) or df.columns[0]
    columns = [text.strip(_col(area)).alias("lsoa")]
    for header, name in IMD_HEADERS:
        wanted = header.lower()
        match = find_column(
            df.columns, lambda c, w=wanted: c == w, lambda c, w=wanted: w in c and "decile" in c
        )
        value = finite(_col(match)).cast("int") if match else F.lit(None).cast("int")
        columns.append(value.alias(name))
    return df.select(*columns).where(F.col("lsoa") != "")


def read_broadband(spark: SparkSession, path: str) -> DataFrame:
    """Speed metrics per postcode from any number of area files."""
    df = read_csv(spark, path, encoding="UTF-8")
    names = df.columns
    counted = [c for c in names if c.strip().lower().startswith("number of connections")]
    ultra = find_column(counted, lambda c: ">= 300" in c)
    superfast = find_column([c for c in counted if c != ultra], lambda c: ">= 30" in c)
    bands = [c for c in counted if c not in (ultra, superfast) and any(b in c.lower() for b in SPEED_BANDS)]
    fibre = find_column(
        names, lambda c: "fttp" in c or ("full fibre" in c and any(p in c for p in ("%", "pct", "proportion")))
    )
    median = find_column(names, lambda c: all(p in c for p in ("median", "download", "speed")))
    postcode = find_column(names, one_of("postcode", "pcds", "pcd")) or names[0]

    def number(column: str) -> Column:
        return F.coalesce(finite(_col(column)), F.lit(0.0))

    total = sum((number(c) for c in [*bands, *([ultra] if ultra else [])]), F.lit(0.0))
    share = lambda c: half_even(number(c) / F.nullif(total, F.lit(0.0)) * 100, 1)
    none = F.lit(None).cast("double")
    return df.select(
        text.postcode_key(_col(postcode)).alias("postcode"),
        (half_even(finite(_col(median)), 1) if median else none).alias("broadband_median_speed"),
        (share(superfast) if superfast and bands else none).alias("broadband_superfast_pct"),
        (share(ultra) if ultra and bands else none).alias("broadband_ultrafast_pct"),
        (half_even(finite(_col(fibre)), 1) if fibre else none).alias("broadband_full_fibre_pct"),
    ).where(F.col("postcode").isNotNull())


# --- landed records ----------------------------------------------------------

EPC_SCHEMA = (
    "postcode string, rows array<struct<address string, `current-energy-rating` string,"
    " `current-energy-efficiency` string, `environment-impact-current` string,"
    " `heating-cost-current` string, `hot-water-cost-current` string,"
    " `lighting-cost-current` string>>"
)


def epc_cost(*costs: Column) -> Column:
    """Sum of the whole pounds of each cost; zero counts as unknown."""
    parts = [F.coalesce(c.try_cast("double").cast("int"), F.lit(0)) for c in costs]
    return F.nullif(sum(parts[1:], parts[0]), F.lit(0))


def read_epc(spark: SparkSession, path: str) -> DataFrame:
    """Certificates per postcode in the order of the file."""
    rows = spark.read.schema(EPC_SCHEMA).json(path, mode="FAILFAST").select("postcode", F.posexplode("rows").alias("seq", "r"))
    value = lambda name: F.col("r").getField(name)
    return rows.select(
        "postcode", F.col("seq").cast("bigint").alias("seq"), F.upper(value("address")).alias("address"),
        value("current-energy-rating").alias("epc_rating"),
        value("current-energy-efficiency").try_cast("double").cast("int").alias("epc_score"),
        value("environment-impact-current").try_cast("double").cast("int").alias("environment_impact"),
        epc_cost(*[value(f"{k}-cost-current") for k in ("heating", "hot-water", "lighting")])
        .alias("estimated_energy_cost"),
    )


def read_crime(spark: SparkSession, path: str) -> DataFrame:
    """Street-crime records (postcode, category, month) with usable fields."""
    df = spark.read.schema("postcode string, category string, month string").json(path, mode="FAILFAST")
    return df.where((F.col("category") != "") & F.col("month").rlike(area_records.CRIME_MONTH_PATTERN))


PLANNING_SCHEMA = (
    "postcode string, fetched_at timestamp, entities array<struct<entity string, reference string,"
    " description string, `end-date` string, `decision-date` string>>"
)


def read_planning(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PLANNING_SCHEMA).json(path, mode="FAILFAST").select(
        "postcode", "fetched_at", F.explode("entities").alias("e")
    )
    return area_records.planning_records(rows.select(
        "postcode", "fetched_at", "e.entity", "e.reference", "e.description",
        F.col("e").getField("end-date").alias("end_date"),
        F.col("e").getField("decision-date").alias("decision_date"),
    ))


def read_flood_areas(spark: SparkSession, path: str) -> DataFrame:
    schema = "postcode string, items array<struct<notation string>>"
    return spark.read.schema(schema).json(path, mode="FAILFAST").select(
        "postcode", F.explode("items.notation").alias("notation")
    ).withColumn("notation", F.coalesce("notation", F.lit("")))


def read_flood_warnings(spark: SparkSession, path: str) -> DataFrame:
    schema = ("postcode string, items array<struct<severityLevel string, message string,"
              " description string, eaAreaName string>>")
    rows = spark.read.schema(schema).json(path, mode="FAILFAST").select("postcode", F.posexplode("items").alias("position", "w"))
    return rows.select(
        "postcode", "position",
        F.coalesce("w.severityLevel", F.lit("Unknown")).alias("severity"),
        F.coalesce("w.message", F.lit("")).alias("message"),
        F.coalesce("w.description", "w.eaAreaName", F.lit("")).alias("area"),
    )


FOR_SALE_SCHEMA = (
    "id string, displayAddress string, address string, bedrooms int, bathrooms int,"
    " propertySubType string, displayPropertyType string, propertyType string,"
    " price struct<amount bigint, displayPrice string, displayPrices array<struct<displayPrice string>>>,"
    " searchPostcode string"
)


def _first_text(*columns: str) -> Column:
    return F.coalesce(*[text.blank_to_null(F.col(c)) for c in columns])


def for_sale_records(listings: DataFrame, site: str = "") -> DataFrame:
    """Search results as scraped records; rows without an address drop out.

    ``site`` is put in front of the page paths.
    """
    amount = F.nullif("price.amount", F.lit(0))
    shown = F.coalesce(
        text.blank_to_null(F.get(F.col("price.displayPrices"), 0).getField("displayPrice")),
        F.when(F.size("price.displayPrices") > 0, F.lit(None)).otherwise(text.blank_to_null(F.col("price.displayPrice"))),
        text.price_display(amount), F.lit(""),
    )
    address = _first_text("displayAddress", "address")
    ident = F.coalesce("id", F.lit(""))
    return listings.select(
        address.alias("address"),
        F.coalesce(text.postcode_in(address), F.col("searchPostcode")).alias("postcode"),
        F.coalesce(_first_text("propertySubType", "displayPropertyType", "propertyType"), F.lit("")).alias("property_type"),
        F.coalesce("bedrooms", F.lit(0)).alias("bedrooms"), F.coalesce("bathrooms", F.lit(0)).alias("bathrooms"),
        F.when(ident != "", F.concat(F.lit(site + "/properties/"), ident)).otherwise("").alias("url"),
        amount.alias("asking_price"), shown.alias("asking_price_display"), ident.alias("listing_id"),
    ).where(F.col("address").isNotNull())


def read_for_sale(spark: SparkSession, path: str, site: str = "") -> DataFrame:
    return for_sale_records(spark.read.schema(FOR_SALE_SCHEMA).json(path, mode="FAILFAST"), site)


SALE_JSON = ("struct<dateSold string, price string, displayPrice string, priceChangePercentage string,"
             " priceChange string, propertyType string, tenure string>")
LISTING_SCHEMA = (
    "address string, detailUrl string, propertyType string, bedrooms int, bathrooms int,"
    f" transactions array<{SALE_JSON}>, latestTransaction {SALE_JSON}, searchPostcode string"
)


def _sale_of(t: Column, brief: bool = False) -> Column:
    """Stored form of a transaction; the brief form knows date, price and tenure."""
    raw = F.coalesce(t["price"], t["displayPrice"])
    number = raw.try_cast("double")
    price = F.coalesce(text.price_display(number), raw, F.lit(""))
    change = F.coalesce(t["priceChangePercentage"], t["priceChange"], F.lit(""))
    return F.struct(
        F.coalesce(t["dateSold"], F.lit("")).alias("date_sold"), price.alias("price"),
        (F.lit("") if brief else change).alias("price_change_pct"),
        (F.lit("") if brief else F.coalesce(t["propertyType"], F.lit(""))).alias("property_type"),
        F.coalesce(t["tenure"], F.lit("")).alias("tenure"),
    )


def listing_to_property(listings: DataFrame, site: str = "") -> DataFrame:
    """Sold-price listings as scraped records with their sales.

    The latest transaction stands in when the list gives no usable sale.
    """
    def usable(s: Column) -> Column:
        return (s["date_sold"] != "") | (s["price"] != "")

    sales = F.filter(F.transform("transactions", lambda t: _sale_of(t)), usable)
    latest = F.filter(F.array(_sale_of(F.col("latestTransaction"), brief=True)), usable)
    fallback = F.when(F.col("latestTransaction").isNotNull(), latest)
    url = F.coalesce("detailUrl", F.lit(""))
    return listings.where(F.coalesce("address", F.lit("")) != "").select(
        "address",
        F.coalesce(text.postcode_in(F.col("address")), text.postcode_spaced(F.col("searchPostcode"))).alias("postcode"),
        F.coalesce("propertyType", F.lit("")).alias("property_type"),
        F.coalesce("bedrooms", F.lit(0)).alias("bedrooms"), F.coalesce("bathrooms", F.lit(0)).alias("bathrooms"),
        F.when((url != "") & ~url.startswith("http"), F.concat(F.lit(site), url)).otherwise(url).alias("url"),
        F.when(F.size(sales) > 0, sales).otherwise(F.coalesce(fallback, F.slice(latest, 1, 0))).alias("sales"),
    )


def read_listings(spark: SparkSession, path: str, site: str = "") -> DataFrame:
    return listing_to_property(spark.read.schema(LISTING_SCHEMA).json(path, mode="FAILFAST"), site)
