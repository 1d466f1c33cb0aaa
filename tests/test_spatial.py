import math
import random

import pytest
from pyspark.sql import functions as F

from plotwise.functions import geo
from plotwise.operators import spatial

POI = "id bigint, kind string, subtype string, name string, brand string, rating string, lat double, lon double"


def arc(a, b):
    p, q = [tuple(map(math.radians, x)) for x in (a, b)]
    h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def test_distances(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(53.4808), F.lit(-2.2426)).alias("d"),
        geo.haversine_km(F.lit(51.0), F.lit(0.0), F.lit(51.0), F.lit(0.0)).alias("z"),
        geo.chord_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("c"),
    ).first()
    assert 255 < row["d"] < 270 and row["z"] == 0 and row["c"] == pytest.approx(2 * 6371.0)


def test_grid_projection(spark):
    df = spark.createDataFrame([(651409.903, 313177.270), (-1.0, 5.0), (None, 1.0)], "easting double, northing double")
    rows = geo.reproject(df).collect()
    assert len(rows) == 1
    # Worked example of the published guide, shifted to WGS84.
    assert rows[0]["lat"] == pytest.approx(52.6580, abs=2e-3)
    assert rows[0]["lon"] == pytest.approx(1.7160, abs=2e-3)


def test_targets(spark):
    poi = spark.createDataFrame([
        (1, "school", "primary and secondary", "S", None, "Outstanding", 1.0, 1.0),
        (2, "supermarket", None, "W", "Little Waitrose", None, 1.0, 1.0), (3, "green_space", "Public Park Or Garden", "P", None, None, 1.0, 1.0),
        (4, "pub", None, "X", None, None, None, 1.0), (5, "school", "nursery", "N", None, "Good", 1.0, 1.0)], POI)
    got = sorted((r["poi_id"], r["target"]) for r in spatial.with_targets(poi).collect())
    assert got == [(1, "outstanding_primary"), (1, "outstanding_secondary"), (1, "primary"), (1, "secondary"),
                   (2, "premium_supermarket"), (2, "supermarket"), (3, "green_space"), (3, "park")]


@pytest.mark.parametrize("seed, box", [(1, (49.9, 60.9, -8.0, 2.0)), (2, (51.40, 51.45, -0.25, -0.18)),
                                       (3, (-89.9, 89.9, -180.0, 180.0)), (4, (0.0, 0.4, 179.8, 180.2))])
def test_nearest_and_within_equal_every_pair(spark, seed, box):
    rng = random.Random(seed)

    def spot():
        lon = rng.uniform(box[2], box[3])
        return round(rng.uniform(box[0], box[1]), 4), round(lon - 360 if lon > 180 else lon, 4)

    points = list({spot() for _ in range(60)})
    pois = [(i, rng.choice(["pub", "gym", "rail"]), None, f"n{i}", None, None, *spot()) for i in range(1, 50)]
    pois += [(100, "rail", None, "same place", None, None, *pois[0][6:]), (101, "hospital", None, "only", None, None, *spot())]
    points.append(pois[0][6:])
    places = spark.createDataFrame(points, "lat double, lon double").distinct()
    targets = spatial.with_targets(spark.createDataFrame(pois, POI))
    wanted = ("pub", "gym", "rail", "hospital", "port")
    got = {(r["lat"], r["lon"], r["target"]): (round(r["arc_km"], 6)) for r in spatial.nearest(places, targets, wanted).collect()}
    want = {}
    for p in set(points):
        for kind in ("pub", "gym", "rail", "hospital"):
            want[(*p, kind)] = round(min(arc(p, x[6:]) for x in pois if x[1] == kind), 6)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    radii = {"pub": 1.0, "gym": 25.0, "rail": 300.0}
    counts = {(r["lat"], r["lon"], r["target"]): r["n"] for r in spatial.within_radius(places, targets, radii).collect()}
    chord = lambda a, b: 2 * 6371.0 * math.sin(arc(a, b) / 2 / 6371.0)
    for p in set(points):
        for kind, radius in radii.items():
            assert counts.get((*p, kind), 0) == sum(1 for x in pois if x[1] == kind and chord(p, x[6:]) <= radius)


def test_transport_example(spark):
    poi = spark.createDataFrame([
        (1, "rail", None, "Wimbledon", None, None, 51.4213, -0.2064), (2, "tube", None, "Bank", None, None, 51.5133, -0.0886),
        (3, "bus", None, "Bus Stop A", None, None, 51.42, -0.21)], POI)
    props = spark.createDataFrame([(1, 51.42, -0.21), (2, 51.42, -0.21), (3, None, None)], "id int, latitude double, longitude double")
    out = spatial.enrich_proximity(props, poi.unionByName(spatial.fixed_points(spark), allowMissingColumns=True))
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["nearest_rail_station"] == "Wimbledon" and rows[1]["dist_nearest_bus_km"] == 0.0
    assert rows[1]["bus_stops_within_500m"] == 1 and rows[1]["nearest_airport"] == "Heathrow"
    assert rows[1]["pubs_within_1km"] == 0 and rows[1]["dist_nearest_pub_km"] is None
    assert rows[3]["dist_nearest_rail_km"] is None and rows[2]["nearest_port"] == rows[1]["nearest_port"]
