"""Nearest and within-radius joins between points and points of interest (pois).

Both run as equi-joins on grid cells and never compare every pair. Points are
reduced to distinct coordinates first: properties located by postcode share one.
All targets go through the same joins, told apart by a column.

Within a radius: a poi is listed in every cell its radius can reach (an exact
bounding box on the sphere), a point sits in one cell, the distance decides.

Nearest: a first join finds, for each point and target, some poi close by, at the
finest of a few grid levels whose cell holds one. Its distance bounds the answer.
A second join looks at the few cells, of about that size, that the bounding circle
touches. Cells divide the full circle evenly, so they wrap at the antimeridian.

Crowded cells are spread over slices by a hash of the point, with the other side
repeated per slice, so one cell is many tasks. Pairs are folded into one row per
point on the map side of the aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import geo

SALTS = 4
# Grid levels: level k has 2^k cells around the globe, from 2.4 km to all of it.
LEVELS = (14, 12, 10, 8, 6, 4, 2, 0)
# Coarse cells hold most points and few representatives: many slices cost little.
COARSE_LEVEL, COARSE_SLICES = 8, 64

# Airports and ports.
AIRPORTS = (
    ("Heathrow", 51.4700, -0.4543), ("Gatwick", 51.1537, -0.1821),
    ("Stansted", 51.8860, 0.2389), ("Luton", 51.8747, -0.3683),
    ("London City", 51.5053, 0.0553), ("Manchester", 53.3588, -2.2727),
    ("Birmingham", 52.4539, -1.7480), ("Edinburgh", 55.9508, -3.3726),
    ("Glasgow", 55.8642, -4.4316), ("Bristol", 51.3827, -2.7190),
    ("Liverpool John Lennon", 53.3336, -2.8497), ("Newcastle", 55.0374, -1.6917),
    ("Leeds Bradford", 53.8659, -1.6606), ("East Midlands", 52.8311, -1.3280),
    ("Belfast City", 54.6181, -5.8725), ("Belfast International", 54.6575, -6.2158),
    ("Aberdeen", 57.2019, -2.1978), ("Southampton", 50.9503, -1.3568),
    ("Cardiff", 51.3967, -3.3433), ("Exeter", 50.7344, -3.4139),
    ("Bournemouth", 50.7800, -1.8425), ("Doncaster Sheffield", 53.4805, -1.0105),
    ("Inverness", 57.5425, -4.0494), ("Norwich", 52.6758, 1.2828),
    ("Southend", 51.5714, 0.6956),
)
PORTS = (
    ("Dover", 51.1279, 1.3134), ("Southampton", 50.8998, -1.3969),
    ("Portsmouth", 50.8376, -1.0911), ("Harwich", 51.9456, 1.2862),
    ("Liverpool", 53.4488, -3.0183), ("Hull", 53.7392, -0.2894),
    ("Holyhead", 53.3094, -4.6318), ("Fishguard", 52.0066, -4.9920),
    ("Newhaven", 50.7866, 0.0603), ("Poole", 50.7059, -1.9819),
    ("Plymouth", 50.3612, -4.1372), ("Tilbury", 51.4569, 0.3576),
    ("Felixstowe", 51.9555, 1.3511), ("Aberdeen", 57.1446, -2.0789),
    ("Cairnryan", 54.9722, -5.0185), ("Pembroke Dock", 51.6928, -4.9426),
    ("Folkestone", 51.0957, 1.1765), ("Newcastle", 55.0108, -1.4420),
    ("Fleetwood", 53.9260, -3.0060), ("Weymouth", 50.6106, -2.4549),
)
PREMIUM_BRANDS = ("waitrose", "m&s food", "m&s simply food", "marks & spencer")
BUDGET_BRANDS = ("aldi", "lidl")
PARK_FUNCTION = "public park or garden"


@dataclass(frozen=True)
class Target:
    """What one nearest-neighbour target fills in on a property."""

    distance: str
    name: str | None = None
    detail: str | None = None
    within: tuple[str, float] | None = None
    great_circle: bool = False


# Output columns, count radii in km, distance kind per target.
TARGETS: dict[str, Target] = {
    "rail": Target("dist_nearest_rail_km", "nearest_rail_station", great_circle=True),
    "tube": Target("dist_nearest_tube_km", "nearest_tube_station", great_circle=True),
    "bus": Target("dist_nearest_bus_km", within=("bus_stops_within_500m", 0.5), great_circle=True),
    "airport": Target("dist_nearest_airport_km", "nearest_airport", great_circle=True),
    "port": Target("dist_nearest_port_km", "nearest_port", great_circle=True),
    "primary": Target("dist_nearest_primary_km", "nearest_primary_school",
                      "nearest_primary_ofsted", ("primary_schools_within_2km", 2.0)),
    "secondary": Target("dist_nearest_secondary_km", "nearest_secondary_school",
                        "nearest_secondary_ofsted", ("secondary_schools_within_3km", 3.0)),
    "outstanding_primary": Target("dist_nearest_outstanding_primary_km"),
    "outstanding_secondary": Target("dist_nearest_outstanding_secondary_km"),
    "gp": Target("dist_nearest_gp_km", "nearest_gp_name", within=("gp_practices_within_2km", 2.0)),
    "hospital": Target("dist_nearest_hospital_km", "nearest_hospital_name"),
    "supermarket": Target("dist_nearest_supermarket_km", "nearest_supermarket_name",
                          "nearest_supermarket_brand", ("supermarkets_within_2km", 2.0)),
    "premium_supermarket": Target("dist_nearest_premium_supermarket_km"),
    "budget_supermarket": Target("dist_nearest_budget_supermarket_km"),
    "green_space": Target("dist_nearest_green_space_km", "nearest_green_space_name",
                          within=("green_spaces_within_1km", 1.0)),
    "park": Target("dist_nearest_park_km", "nearest_park_name"),
    "pub": Target("dist_nearest_pub_km", "nearest_pub_name", within=("pubs_within_1km", 1.0)),
    "gym": Target("dist_nearest_gym_km", "nearest_gym_name", within=("gyms_within_2km", 2.0)),
}


def fixed_points(spark) -> DataFrame:
    """Airports and ports in the shape of the poi table, with negative ids."""
    rows = [(-(i + 1), kind, name, lat, lon)
            for i, (kind, name, lat, lon) in enumerate(
                [("airport", *a) for a in AIRPORTS] + [("port", *p) for p in PORTS])]
    return spark.createDataFrame(rows, "id bigint, kind string, name string, lat double, lon double")


def _any_brand(brands: Sequence[str]) -> Column:
    low = F.lower("brand")
    return F.exists(F.array(*[F.lit(b) for b in brands]), lambda b: F.contains(low, b))


def with_targets(poi: DataFrame) -> DataFrame:
    """One row per (point of interest, target it counts for).

    A school may serve four targets and a shop two; one explode covers all.
    """
    phase, rating = F.lower(F.coalesce("subtype", F.lit(""))), F.lower(F.coalesce("rating", F.lit("")))
    school = F.col("kind") == "school"
    primary = school & F.contains(phase, F.lit("primary"))
    secondary = school & F.contains(phase, F.lit("secondary"))
    outstanding = F.contains(rating, F.lit("outstanding"))
    shop = F.col("kind") == "supermarket"
    green = F.col("kind") == "green_space"
    tags = F.array_compact(F.array(
        F.when(~school, F.col("kind")),
        F.when(primary, F.lit("primary")), F.when(secondary, F.lit("secondary")),
        F.when(primary & outstanding, F.lit("outstanding_primary")),
        F.when(secondary & outstanding, F.lit("outstanding_secondary")),
        F.when(shop & _any_brand(PREMIUM_BRANDS), F.lit("premium_supermarket")),
        F.when(shop & _any_brand(BUDGET_BRANDS), F.lit("budget_supermarket")),
        F.when(green & (phase == PARK_FUNCTION), F.lit("park")),
    ))
    detail = F.when(school, F.nullif("rating", F.lit(""))).when(shop, F.col("brand"))
    return poi.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.explode(tags).alias("target"), F.col("id").alias("poi_id"), "name",
        detail.alias("detail"), F.col("lat").alias("plat"), F.col("lon").alias("plon"),
    )


def distinct_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Distinct known coordinates as (lat, lon)."""
    return (
        df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    )


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("int")


def _span(centre: Column, reach: Column, size: Column) -> Column:
    """All cells between centre - reach and centre + reach, one row each."""
    slack = reach * (1 + 1e-9) + 1e-9
    return F.explode(F.sequence(_cell(centre - slack, size), _cell(centre + slack, size)))


def _sliced(df: DataFrame, slices: Column) -> DataFrame:
    """Repeat every row once per slice."""
    return df.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))


def _own_slice(slices: Column) -> Column:
    return F.pmod(F.xxhash64("lat", "lon"), slices).cast("int")


def _distance(great_circle: Column) -> Column:
    ends = (F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return F.when(great_circle, geo.haversine_km(*ends)).otherwise(geo.chord_km(*ends))


def _arc_km() -> Column:
    return geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))


def _level_cells() -> Column:
    """Number of cells around the globe at the row's level."""
    return F.pow(F.lit(2.0), F.col("level"))


def _level_size() -> Column:
    return F.lit(360.0) / _level_cells()


def _wrapped(cx: Column) -> Column:
    return F.pmod(cx, _level_cells().cast("int"))


def _radius_level(radius_km: float) -> int:
    """Finest level whose cells are at least as large as the radius."""
    return max(int(math.floor(math.log2(360.0 / min(geo.latitude_reach(radius_km), 360.0)))), 0)


def _on_levels(df: DataFrame, lat: str, lon: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Each row once per grid level, with its cell counted from the south-west."""
    return (
        df.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
        .withColumn("cy", _cell(F.col(lat) + 90, _level_size()))
        .withColumn("cx", _wrapped(_cell(F.col(lon) + 180, _level_size())))
    )


def _bounds(points: DataFrame, pois: DataFrame) -> DataFrame:
    """(lat, lon, target, bound_km): distance to some poi of the target nearby."""
    slices = F.when(F.col("level") <= COARSE_LEVEL, COARSE_SLICES).otherwise(SALTS)
    occupied = (
        _on_levels(pois, "plat", "plon").groupBy("level", "cy", "cx", "target")
        .agg(F.min_by(F.struct("plat", "plon"), "poi_id").alias("p"))
        .select("level", "cy", "cx", "target", "p.plat", "p.plon")
    )
    seen = _on_levels(points, "lat", "lon").withColumn("slice", _own_slice(slices))
    return (
        seen.join(_sliced(occupied, slices), ["level", "slice", "cy", "cx"])
        .groupBy("lat", "lon", "target").agg(F.min(_arc_km()).alias("bound_km"))
    )


def _bound_level() -> Column:
    """Finest level whose cells are at least as large as the bound."""
    degrees = F.degrees(F.col("bound_km") / F.lit(geo.EARTH_RADIUS_KM))
    level = F.lit(LEVELS[-1])
    for k in sorted(LEVELS):
        level = F.when(degrees <= 360.0 / 2**k, F.lit(k)).otherwise(level)
    return level


def nearest(points: DataFrame, targets: DataFrame, wanted: Sequence[str],
            salts: int = SALTS) -> DataFrame:
    """Nearest poi of every wanted target for every point, smallest id on a tie.

    ``points`` are distinct (lat, lon); ``targets`` come from ``with_targets``.
    Returns (lat, lon, target, poi_id, name, detail, plat, plon, arc_km). Targets
    that have no poi at all give no row.
    """
    pois = _unique_places(targets.where(F.col("target").isin(*wanted)))
    bounded = _bounds(points, pois).withColumn("level", _bound_level())
    degrees = F.degrees(F.col("bound_km") / F.lit(geo.EARTH_RADIUS_KM))
    wide = geo.longitude_reach(F.col("lat"), F.col("bound_km"))
    searched = (
        bounded.withColumn("cy", _span(F.col("lat") + 90, degrees, _level_size()))
        .withColumn("cx", _span(F.col("lon") + 180, wide, _level_size()))
        .withColumn("cx", _wrapped(F.col("cx")))
        .withColumn("slice", _own_slice(F.lit(salts)))
    )
    pairs = searched.join(
        _sliced(_on_levels(pois, "plat", "plon"), F.lit(salts)),
        ["target", "level", "cy", "cx", "slice"],
    )
    payload = F.struct("poi_id", "name", "detail", "plat", "plon")
    rank = F.struct(_arc_km().alias("arc_km"), F.col("poi_id"))
    best = pairs.groupBy("lat", "lon", "target").agg(
        F.min_by(payload, rank).alias("best"), F.min(_arc_km()).alias("arc_km")
    )
    return best.select("lat", "lon", "target", "best.*", "arc_km")


def _unique_places(targets: DataFrame) -> DataFrame:
    """One poi per target and place: on equal distance the smallest id wins anyway."""
    return targets.groupBy("target", "plat", "plon").agg(
        F.min("poi_id").alias("poi_id"),
        F.min_by("name", "poi_id").alias("name"),
        F.min_by("detail", "poi_id").alias("detail"),
    )


def within_radius(points: DataFrame, targets: DataFrame, radii_km: Mapping[str, float],
                  salts: int = SALTS) -> DataFrame:
    """Number of pois of each target within its radius, for points that have any.

    Places are counted before the join, so pois that share a place are one row.
    Cells are once to twice as large as the radius.
    """
    places = targets.groupBy("target", "plat", "plon").agg(F.count("*").alias("here"))
    radius_of, level_of = F.lit(None).cast("double"), F.lit(None).cast("int")
    for target, radius in radii_km.items():
        here = F.col("target") == target
        radius_of = F.when(here, F.lit(float(radius))).otherwise(radius_of)
        level_of = F.when(here, F.lit(_radius_level(radius))).otherwise(level_of)
    reach = F.degrees(F.col("radius") / F.lit(geo.EARTH_RADIUS_KM))
    wide = geo.longitude_reach(F.col("plat"), F.col("radius"))
    reached = (
        places.where(F.col("target").isin(*radii_km))
        .withColumn("radius", radius_of).withColumn("level", level_of)
        .withColumn("cy", _span(F.col("plat") + 90, reach, _level_size()))
        .withColumn("cx", _span(F.col("plon") + 180, wide, _level_size()))
        .withColumn("cx", _wrapped(F.col("cx"))).distinct()
    )
    # A point takes part once per grid level, so that all targets share one join.
    levels = sorted({_radius_level(r) for r in radii_km.values()})
    placed = _on_levels(points, "lat", "lon", levels).withColumn("slice", _own_slice(F.lit(salts)))
    pairs = placed.join(_sliced(reached, F.lit(salts)), ["level", "cy", "cx", "slice"])
    # Counts compare the straight line with the radius, for every family.
    near = geo.chord_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= F.col("radius")
    return pairs.where(near).groupBy("lat", "lon", "target").agg(F.sum("here").alias("n"))


def _wide_nearest(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    circle = [t for t in wanted if TARGETS[t].great_circle]
    measured = rows.withColumn("km", F.bround(_distance(F.col("target").isin(*circle)), 2))
    columns = []
    for tag in wanted:
        target, here = TARGETS[tag], F.col("target") == tag
        columns.append(F.max(F.when(here, F.col("km"))).alias(target.distance))
        if target.name:
            columns.append(F.max(F.when(here, F.col("name"))).alias(target.name))
        if target.detail:
            columns.append(F.max(F.when(here, F.col("detail"))).alias(target.detail))
    return measured.groupBy("lat", "lon").agg(*columns)


def proximity(points: DataFrame, poi: DataFrame, wanted: Sequence[str] = tuple(TARGETS)) -> DataFrame:
    """All distance, name and count columns per distinct point."""
    targets = with_targets(poi)
    wide = _wide_nearest(nearest(points, targets, wanted), wanted)
    radii = {t: TARGETS[t].within[1] for t in wanted if TARGETS[t].within}
    out = points.join(wide, ["lat", "lon"], "left")
    if not radii:
        return out
    counts = within_radius(points, targets, radii).groupBy("lat", "lon").agg(*[
        F.sum(F.when(F.col("target") == t, F.col("n"))).cast("int").alias(TARGETS[t].within[0])
        for t in radii
    ])
    zero_for = {TARGETS[t].within[0]: 0 for t in radii}
    return out.join(counts, ["lat", "lon"], "left").fillna(zero_for)


def enrich_proximity(properties: DataFrame, poi: DataFrame,
                     wanted: Sequence[str] = tuple(TARGETS)) -> DataFrame:
    """Properties with the proximity columns; unlocated ones keep NULLs."""
    facts = proximity(distinct_points(properties), poi, wanted)
    facts = facts.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    fresh = [c for c in properties.columns if c not in facts.columns or c in ("latitude", "longitude")]
    return properties.select(*fresh).join(facts, ["latitude", "longitude"], "left")
