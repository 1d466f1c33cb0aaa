"""Joins that attach dimension data to properties by postcode, and EPC matching.

No side is forced to be broadcast: sizes are checked by adaptive execution, which
broadcasts a dimension only below its threshold and sort-merges, with skew
splitting, above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import text

IMD_COLUMNS = (
    "imd_decile", "imd_income_decile", "imd_employment_decile", "imd_education_decile",
    "imd_health_decile", "imd_crime_decile", "imd_housing_decile", "imd_environment_decile",
)
BROADBAND_COLUMNS = (
    "broadband_median_speed", "broadband_superfast_pct", "broadband_ultrafast_pct",
    "broadband_full_fibre_pct",
)


def fill_missing(df: DataFrame, facts: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that fills only NULL targets; ``facts`` has one row per key."""
    renamed = facts.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(renamed, list(on), "left")
    kept = [c for c in df.columns if c not in columns]
    filled = [
        (F.coalesce(F.col(c), F.col(f"_new_{c}")) if c in df.columns else F.col(f"_new_{c}")).alias(c)
        for c in columns
    ]
    return joined.select(*kept, *filled)


def _one_per_key(dim: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One whole row per key, so that a lookup neither multiplies rows nor mixes two."""
    first = F.min(F.struct(*columns)).alias("_row")
    return dim.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "_row.*")


def with_imd(properties: DataFrame, postcode_lookup: DataFrame, imd: DataFrame) -> DataFrame:
    """Postcode to area code to deprivation deciles.

    The two dimensions are joined with each other first: they are small next to
    the properties, which are then shuffled at most once.
    """
    areas = postcode_lookup.select(text.postcode_key(F.col("postcode")).alias("_key"), "lsoa")
    deciles = areas.join(imd.select("lsoa", *IMD_COLUMNS), "lsoa")
    facts = _one_per_key(deciles, "_key", IMD_COLUMNS)
    keyed = properties.withColumn("_key", text.postcode_key(F.col("postcode")))
    return fill_missing(keyed, facts, ["_key"], IMD_COLUMNS).drop("_key")


def with_broadband(properties: DataFrame, broadband: DataFrame) -> DataFrame:
    facts = _one_per_key(
        broadband.withColumn("_key", text.postcode_key(F.col("postcode"))), "_key", BROADBAND_COLUMNS
    )
    keyed = properties.withColumn("_key", text.postcode_key(F.col("postcode")))
    return fill_missing(keyed, facts, ["_key"], BROADBAND_COLUMNS).drop("_key")


def geocode(properties: DataFrame, postcode_lookup: DataFrame) -> DataFrame:
    """Fill missing coordinates from the postcode lookup; known ones stay."""
    coordinates = postcode_lookup.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        text.postcode_key(F.col("postcode")).alias("_key"),
        F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lng")).alias("_at"),
    )
    facts = coordinates.groupBy("_key").agg(F.min("_at").alias("_at"))
    missing = F.col("latitude").isNull()
    joined = properties.withColumn("_key", text.postcode_key(F.col("postcode"))).join(facts, "_key", "left")
    return joined.select(*[
        F.when(missing, F.coalesce("_at.lat", "latitude")).otherwise(F.col("latitude")).alias(c)
        if c == "latitude" else
        F.when(missing, F.coalesce("_at.lng", "longitude")).otherwise(F.col("longitude")).alias(c)
        if c == "longitude" else F.col(c)
        for c in properties.columns
    ])


def geocode_facilities(facilities: DataFrame, postcode_lookup: DataFrame) -> DataFrame:
    """Facilities with coordinates; those whose postcode is unknown drop out."""
    points = postcode_lookup.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        text.postcode_key(F.col("postcode")).alias("_key"),
        F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lon")).alias("_at"),
    ).groupBy("_key").agg(F.min("_at").alias("_at"))
    keyed = facilities.withColumn("_key", text.postcode_key(F.col("postcode")))
    return keyed.join(points, "_key").select(
        *facilities.columns, F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon")
    )


# --- energy certificates -----------------------------------------------------

def _plain_address(address: Column) -> Column:
    """Upper case, commas as blanks, single blanks."""
    spaced = F.regexp_replace(F.upper(text.strip(address)), ",+", " ")
    return text.strip(F.regexp_replace(spaced, r"\s+", " "))


def _address_start(address: Column) -> Column:
    """First two words, or the whole address when it has fewer.

    Sharing the first three words implies sharing two, so this one key stands for
    every way two addresses can match loosely.
    """
    words = F.split(_plain_address(address), " ")
    return F.array_join(F.slice(words, 1, 2), " ")


def match_epc(properties: DataFrame, certificates: DataFrame) -> DataFrame:
    """The certificate of each property, from its postcode.

    An exact address wins; without one, the first certificate that starts with the
    same two words. A certificate without a rating updates nothing, also when it
    is the exact one. Certificates are reduced to one per key before the joins.
    """
    cert = F.struct(
        F.col("epc_rating"), F.col("epc_score"), F.col("environment_impact"),
        F.col("estimated_energy_cost"), F.col("seq"),
    )
    certs = certificates.select(
        text.postcode_key(F.col("postcode")).alias("_pc"),
        F.upper(text.strip(F.col("address"))).alias("_exact"),
        _address_start(F.col("address")).alias("_start"), "seq", cert.alias("cert"),
    )
    by_exact = certs.groupBy("_pc", "_exact").agg(F.min_by("cert", "seq").alias("_by_exact"))
    by_start = certs.groupBy("_pc", "_start").agg(F.min_by("cert", "seq").alias("_by_start"))
    keyed = properties.select(
        F.col("id").alias("property_id"),
        text.postcode_key(F.col("postcode")).alias("_pc"),
        F.upper(text.strip(F.col("address"))).alias("_exact"),
        _address_start(F.col("address")).alias("_start"),
    )
    found = (
        keyed.join(by_exact, ["_pc", "_exact"], "left").join(by_start, ["_pc", "_start"], "left")
        .withColumn("c", F.coalesce("_by_exact", "_by_start"))
    )
    return found.where(F.nullif(F.col("c.epc_rating"), F.lit("")).isNotNull()).select(
        "property_id", "c.epc_rating", "c.epc_score",
        F.col("c.environment_impact").alias("epc_environment_impact"), "c.estimated_energy_cost",
    )


def _texts(df: DataFrame, ident: str, name: str) -> DataFrame:
    """(postcode key, address text, id) of the rows that have an address."""
    value = F.upper(text.strip(F.col("address")))
    return df.select(
        F.col(ident).alias(name), text.postcode_key(F.col("postcode")).alias("_pc"), value.alias("_text")
    ).where(F.length("_text") > 0)


OPENING = 12
#: Numbers of 64 bits in the map of openings: a fixed size whatever the tables hold.
MAP_WORDS = 2**20


def _opening_bits(postcode: str, opening: str) -> tuple[Column, Column]:
    """The two bits of the map that an opening in a postcode sets."""
    hashed = F.xxhash64(postcode, opening)
    bits = F.lit(64 * MAP_WORDS)
    return F.pmod(hashed, bits), F.pmod(F.shiftrightunsigned(hashed, 32), bits)


def _opening_map(texts: DataFrame) -> Column:
    """Bits of the openings of ``texts``, as one array that every task looks up.

    It only thins out places before they travel: a bit may also be set by another opening.
    """
    keys = texts.select("_pc", F.substring("_text", 1, OPENING).alias("_opening"))
    bits = keys.select(F.explode(F.array(*_opening_bits("_pc", "_opening"))).alias("_bit"))
    words = bits.groupBy(F.shiftright("_bit", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")).alias("_word"))
    whole = texts.sparkSession.range(MAP_WORDS).join(words, "id", "left").select("id", F.coalesce("_word", F.lit(0).cast("bigint")).alias("_word"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "_word")))
    return whole.agg(F.transform(ordered, lambda w: w["_word"])).scalar()


def _may_open(known: Column, postcode: str, opening: str) -> Column:
    """Whether the map has an opening; never false for one that was put in."""
    first, second = (
        F.getbit(F.get(known, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1
        for bit in _opening_bits(postcode, opening))
    return first & second


def _parts(df: DataFrame, name: str, others: DataFrame) -> DataFrame:
    """Substrings that can be a whole address of the other side in the postcode.

    A place in a text counts only where it shows the opening characters of such an
    address; there the substrings of the lengths of those addresses are listed.
    Shorter addresses are their own opening, so nothing is missed. Most places show
    none and are dropped where they arise, by the map of openings.
    """
    openings = others.groupBy("_pc", F.substring("_text", 1, OPENING).alias("_opening")).agg(
        F.collect_set(F.length("_text")).alias("_lengths")
    )
    sizes = openings.groupBy("_pc").agg(F.collect_set(F.length("_opening")).alias("_sizes"))
    fitting = F.filter("_sizes", lambda n: n <= F.length("_text"))
    starts = F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1))
    places = (
        df.join(sizes, "_pc").withColumn("_n", F.explode(fitting)).withColumn("_at", starts)
        .withColumn("_opening", F.col("_text").substr(F.col("_at"), F.col("_n")))
        .where(_may_open(_opening_map(others), "_pc", "_opening"))
        .join(openings, ["_pc", "_opening"])
    )
    within = F.filter("_lengths", lambda n: F.col("_at") + n - 1 <= F.length("_text"))
    return places.withColumn("_m", F.explode(within)).select(
        name, "_pc", F.col("_text").substr(F.col("_at"), F.col("_m")).alias("_part")
    )


def _number_and_word(address: Column) -> Column:
    """House number and the word after it, NULL without them; the number is never cut."""
    pattern = r"^(\d++)\s*(\S+)"
    number, word = F.regexp_extract(address, pattern, 1), F.regexp_extract(address, pattern, 2)
    return F.when(word != "", F.concat_ws(" ", number, word))


def match_epc_by_containment(properties: DataFrame, certificates: DataFrame) -> DataFrame:
    """For each certificate the first property (lowest id) of its postcode whose
    address contains it, is contained in it, or shares house number and next word.

    Containment is an equi-join: the containing address is listed under each of its
    substrings that can be a whole address of the other side. Properties are
    reduced to the lowest id per key before every join, so a certificate meets one
    row per key however many properties share it, and no pairs are compared.
    """
    certs, props = _texts(certificates, "seq", "seq"), _texts(properties, "id", "p_id")

    def lowest(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy("_pc", key).agg(F.min("p_id").alias("p_id"))

    whole = certs.withColumnRenamed("_text", "_part")
    in_property = whole.join(lowest(_parts(props, "p_id", certs), "_part"), ["_pc", "_part"])
    wholes = lowest(props, "_text").withColumnRenamed("_text", "_part")
    in_certificate = _parts(certs, "seq", props).join(wholes, ["_pc", "_part"])
    start = certs.withColumn("_part", _number_and_word(F.col("_text")))
    starts = lowest(props.withColumn("_part", _number_and_word(F.col("_text"))), "_part")
    same_start = start.join(starts, ["_pc", "_part"])
    found = in_property.select("seq", "p_id").unionByName(
        in_certificate.select("seq", "p_id")
    ).unionByName(same_start.select("seq", "p_id"))
    return found.groupBy("seq").agg(F.min("p_id").alias("property_id"))
