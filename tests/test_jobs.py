import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plotwise import schemas
from plotwise.operators import dataset, model
from plotwise.plans import enrichment, price_model
from plotwise.session import materialise, staging_path
from plotwise.streaming import jobs


def records(spark, rows):
    full = [dict(seq=s, ingested_at=datetime(2024, 5, 1), address=a, postcode="SW20 8NE", property_type="flat", bedrooms=b, bathrooms=1,
                 extra_features=[], floorplan_urls=[], url="/u", sales=[dict(date_sold=d, price="£1", price_change_pct="", property_type="", tenure="")],
                 asking_price=None, asking_price_display="", listing_id="") for s, a, b, d in rows]
    return spark.createDataFrame(full, schemas.record_schema())


def test_streams_of_one_file_and_of_a_folder_agree(spark):
    folder = staging_path(spark, "layouts")
    df = spark.range(100).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) ts", "id % 4 k")
    df.repartition(5).write.parquet(f"{folder}/many/events.parquet")
    df.coalesce(1).write.parquet(f"{folder}/tmp")
    one = Path(folder, "one")
    one.mkdir()
    shutil.copy(next(Path(folder, "tmp").glob("part-*.parquet")), one / "events.parquet")
    counts = []
    for layout in ("many", "one"):
        stream = jobs.stream_files(spark, f"{folder}/{layout}/events.parque[t]", df.schema)
        counts.append(sorted(jobs.collect_updates(jobs.freshness_view(stream, "k", "ts"), ["k"], "fresh").collect()))
    assert counts[0] == counts[1] and sum(r["property_count"] for r in counts[0]) == 100
    Path(folder, "none").mkdir()
    empty = jobs.collect_updates(jobs.freshness_view(jobs.stream_files(spark, f"{folder}/none", df.schema), "k", "ts"), ["k"], "fresh")
    assert empty.count() == 0


def test_streams_equal_batch(spark):
    start = datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [(i, start + timedelta(minutes=rng.randrange(0, 6000)), rng.randrange(5), float(i)) for i in range(200)]
    path = staging_path(spark, "events")
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, k int, v double").repartition(3)
    df.write.parquet(path)
    stream = lambda: jobs.stream_files(spark, path, df.schema, files_per_batch=1)
    live = jobs.collect_updates(jobs.freshness_view(stream(), "k", "ts"), ["k"], "fresh")
    want = df.groupBy("k").agg(F.count("*").alias("property_count"), F.max("ts").alias("last_updated"))
    assert sorted(live.collect()) == sorted(want.collect())
    totals = jobs.collect_updates(jobs.period_totals(stream(), "ts", "v", "1 day", "30 days"), ["period_start"], "totals")
    assert totals.agg(F.sum("count")).first()[0] == 200
    once = jobs.deduplicate(stream(), ["k"], "ts", "30 days").select("id", "k")
    assert sorted(r["k"] for r in jobs.collect_updates(once, ["id"], "once", "append").collect()) == [0, 1, 2, 3, 4]


def market_tables(spark):
    rng = random.Random(5)
    props, sold = [], []
    for i in range(1, 61):
        beds = i % 5 + 1
        props.append((i, f"{i} High St", "SW20 8NE", "SW208NE", ["FLAT", "HOUSE", None][i % 3], beds, i % 3 + 1, 51.4 + i / 1000, -0.2, '["Garage", "1,000 sq ft"]'))
        for y in (2022, 2023, 2024):
            sold.append((len(sold) + 1, i, 100000 * beds + 1000 * (y - 2022) + rng.randrange(100), f"{y}-03-0{i % 9 + 1}", None, "FREEHOLD"))
    p = spark.createDataFrame(props, "id bigint, address string, postcode string, postcode_clean string, property_type string, bedrooms int, bathrooms int, latitude double, longitude double, extra_features string")
    s = spark.createDataFrame(sold, "id bigint, property_id bigint, price_numeric bigint, date_sold_iso string, property_type string, tenure string")
    return p, s


FEATURES = ["bedrooms", "property_type", "sale_year", "parking", "epc_score"]


def test_training_and_prediction(spark, tmp_path):
    p, s = market_tables(spark)
    report = price_model.train(s, p, None, FEATURES, rounds=8, depth=3, log_transform=True)
    assert (report.train_size, report.test_size) == (120, 60)
    row = report.metrics.first()
    assert row["r_squared"] > 0.8 and row["n"] == 60
    shares = {r["feature"]: r["importance"] for r in report.importances.collect()}
    assert max(shares, key=shares.get) == "bedrooms" and sum(shares.values()) == pytest.approx(100, abs=0.1)
    assert model.worst_predictions(report.predictions).count() == 10
    assert model.residual_histogram(report.predictions).agg(F.sum("count")).first()[0] == 60
    predicted = price_model.predict(report, s, p, None, FEATURES, "2025-06-01").collect()
    assert len(predicted) == 60 and predicted[0]["predicted_value"] >= predicted[-1]["predicted_value"]
    model.save(spark, report.model, str(tmp_path / "m"))
    loaded = model.load(spark, str(tmp_path / "m"))
    rows = dataset.scoring_dataset(s, p, None, FEATURES)
    assert model.score(loaded, rows).agg(F.sum("predicted")).first()[0] == pytest.approx(
        model.score(report.model, rows).agg(F.sum("predicted")).first()[0])


def test_splits(spark):
    p, s = market_tables(spark)
    data = dataset.price_dataset(s, p, None, ["bedrooms"])
    train, test = model.split(data, "random")
    assert train.count() + test.count() == 180 and 15 <= test.count() <= 60
    assert train.join(test, "sale_id").count() == 0
    assert model.split(data, "random", max_train_rows=10)[0].count() == 10
    with pytest.raises(ValueError):
        price_model.train(s.where("date_sold_iso < '2024'"), p, None, ["bedrooms"])


def test_dataset_kinds(spark):
    p, s = market_tables(spark)
    per_area = dataset.price_dataset(s, p, None, ["bedrooms"], "price_per_sqft").first()
    assert per_area["price_per_sqft"] == per_area["price_numeric"] / 1000
    change = dataset.price_change_dataset(s, p, None, ["bedrooms", "sale_year"])
    assert change.count() == 60 and change.first()["sale_year"] == 2024.0
    small = dict(dataset.downcast(dataset.price_dataset(s, p, None, ["bedrooms", "sale_year", "gym", "latitude", "distance_to_station"])).dtypes)
    assert (small["bedrooms"], small["sale_year"], small["gym"], small["latitude"], small["distance_to_station"]) == (
        "tinyint", "smallint", "tinyint", "double", "float")
    names = [r["name"] for r in dataset.feature_registry(spark).collect()]
    assert len(names) == len(set(names)) and {"total_crime", "vehicle_crime", "first_time_buy", "tenure"} <= set(names)


def test_enrichment_fills_gaps(spark):
    p, _ = market_tables(spark)
    p = p.withColumns({"latitude": F.when(F.col("id") > 1, F.col("latitude")), "epc_rating": F.when(F.col("id") == 2, F.lit("A"))})
    poi = spark.createDataFrame([(1, "pub", None, "The Fox", None, None, 51.4, -0.2)],
                                "id bigint, kind string, subtype string, name string, brand string, rating string, lat double, lon double")
    places = spark.createDataFrame([("SW20 8NE", "E01", 51.4, -0.2)], "postcode string, lsoa string, lat double, lng double")
    certs = spark.createDataFrame([(1, "SW20 8NE", "2 High St", "C", 1, 2, 3), (2, "SW20 8NE", "3 High St", "D", 1, 2, 3)],
                                  "seq bigint, postcode string, address string, epc_rating string, epc_score int, environment_impact int, estimated_energy_cost int")
    out = enrichment.enrich(p, enrichment.ReferenceData(postcode_lookup=places, poi=poi, certificates=certs), ("pub",))
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 60 and rows[1]["latitude"] == 51.4 and rows[1]["dist_nearest_pub_km"] == 0.0
    assert (rows[2]["epc_rating"], rows[3]["epc_rating"], rows[4]["epc_rating"]) == ("A", "D", None)


def test_materialise_keeps_rows_in_the_shared_folder(spark):
    df = materialise(spark.range(10), "ten")
    assert df.count() == 10
    assert df.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get("spark.checkpoint.dir"))
