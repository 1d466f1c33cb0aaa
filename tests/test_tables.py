import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from plotwise import schemas
from plotwise.operators import upsert
from plotwise.session import materialise, staging_path
from plotwise.streaming import jobs, tables


def records(spark, rows):
    full = [dict(seq=s, ingested_at=datetime(2024, 5, 1), address=a, postcode="SW20 8NE", property_type="flat", bedrooms=b, bathrooms=1,
                 extra_features=[], floorplan_urls=[], url="/u", sales=[dict(date_sold=d, price="£1", price_change_pct="", property_type="", tenure="")],
                 asking_price=None, asking_price_display="", listing_id="") for s, a, b, d in rows]
    return spark.createDataFrame(full, schemas.record_schema())


def new_store(spark, **options):
    return jobs.ingest_store(spark, staging_path(spark, "tables"), schemas.property_schema(), schemas.sale_schema(), **options)


def beds(snapshot):
    return {r["address"]: r["bedrooms"] for r in snapshot.read(jobs.PROPERTY).collect()}


def test_ingest_resumes_and_is_idempotent(spark):
    landing, check = staging_path(spark, "landing"), staging_path(spark, "check")
    store = new_store(spark)
    assert store.snapshot().read(jobs.PROPERTY).count() == 0

    def run():
        jobs.ingest(jobs.stream_files(spark, landing, schemas.record_schema()), store, check)

    records(spark, [(1, "A", 2, "04 Nov 2023"), (2, "B", 1, "5 Nov 2023")]).write.mode("append").parquet(landing)
    run()
    before = store.snapshot()
    records(spark, [(3, "A", 3, "4 Nov 2023"), (4, "C", 1, "6 Nov 2023")]).write.mode("append").parquet(landing)
    run()
    run()
    now = store.snapshot()
    assert beds(now) == {"A": 3, "B": 1, "C": 1}
    # A reader stays with the version it began with, in both tables.
    assert beds(before) == {"A": 2, "B": 1} and before.read(jobs.SALE).count() == 2
    assert sorted(r["date_sold"] for r in now.read(jobs.SALE).collect()) == ["4 Nov 2023", "5 Nov 2023", "6 Nov 2023"]
    assert {r["property_id"] for r in now.read(jobs.SALE).collect()} == {r["id"] for r in now.read(jobs.PROPERTY).collect()}
    # A repeated batch does nothing; from a new checkpoint the same records change nothing.
    jobs.ingest_batch(store, check)(records(spark, [(3, "A", 9, "9 Nov 2023")]), 1)
    assert store.snapshot().version == now.version
    jobs.ingest(jobs.stream_files(spark, landing, schemas.record_schema()), store, staging_path(spark, "check"))
    assert beds(store.snapshot()) == {"A": 3, "B": 1, "C": 1} and store.snapshot().read(jobs.SALE).count() == 3


def test_a_batch_that_dies_between_the_tables_leaves_nothing(spark, monkeypatch):
    landing, check = staging_path(spark, "landing"), staging_path(spark, "check")
    store = new_store(spark)
    store.load(property=spark.createDataFrame([(7, "A", 1)], "id bigint, address string, bedrooms int").select(
        *[F.col(f.name) if f.name in ("id", "address", "bedrooms") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.property_schema()]))
    records(spark, [(1, "A", 2, "4 Nov 2023"), (2, "B", 1, "5 Nov 2023")]).write.parquet(landing)

    def run():
        jobs.ingest(jobs.stream_files(spark, landing, schemas.record_schema()), store, check)

    with monkeypatch.context() as broken:
        def die(*_):
            raise RuntimeError("lost")
        broken.setattr(upsert, "insert_sales", die)
        with pytest.raises(StreamingQueryException):
            run()
    seen = store.snapshot()
    assert seen.version == 1 and beds(seen) == {"A": 1} and seen.read(jobs.SALE).count() == 0
    # Nor does one that dies while the list of its version is being written.
    with monkeypatch.context() as broken:
        def half(change, *_):
            Path(store.path, "versions", f"version={change.base.version + 1}", "_temporary", "0").mkdir(parents=True)
            raise RuntimeError("lost")
        broken.setattr(tables.Change, "commit", half)
        with pytest.raises(StreamingQueryException):
            run()
    assert store.snapshot().version == 1
    run()
    assert beds(store.snapshot()) == {"A": 2, "B": 1} and store.snapshot().read(jobs.SALE).count() == 2
    assert {r["id"] for r in store.snapshot().read(jobs.PROPERTY).where("address = 'A'").collect()} == {7}


def test_parts_grow_with_the_bytes_and_batches_rewrite_what_they_touch(spark):
    table = tables.KeyedTable(spark.range(1).selectExpr("id AS k", "'' AS v").schema, ("k",))
    store = tables.TableStore(spark, staging_path(spark, "tables"), {"t": table}, part_bytes=20_000)
    rng = random.Random(3)
    want, widths = {}, []
    for batch in range(5):
        new = {rng.randrange(4000): f"{batch}-{rng.random()}" for _ in range(1200)}
        rows = materialise(spark.createDataFrame(list(new.items()), table.schema), "rows")
        change = store.begin()
        old = change.touched("t", rows)
        change.replace("t", old.join(rows, "k", "left_anti").unionByName(rows))
        change.commit("s", batch)
        want |= new
        widths.append(store.snapshot().tables["t"].parts)
    now = store.snapshot()
    assert {r["k"]: r["v"] for r in now.read("t").collect()} == want and now.read("t").count() == len(want)
    assert widths == sorted(widths) and widths[-1] > widths[0] > 1
    assert sum(p.rows for p in now.tables["t"].files.values()) == len(want)
    assert max(p.bytes for p in now.tables["t"].files.values()) < 2.5 * store.part_bytes
    for p in now.tables["t"].files:
        assert now.read("t", [p]).select(tables.part_of(table.key, widths[-1]).alias("p")).distinct().collect() == [(p,)]
    # One key rewrites one part.
    rows = materialise(spark.createDataFrame([(5, "new")], table.schema), "rows")
    change = store.begin()
    old = change.touched("t", rows)
    change.replace("t", old.where("k <> 5").unionByName(rows))
    change.commit("s", 9)
    files = store.snapshot().tables["t"].files
    assert sum(files[p] != f for p, f in now.tables["t"].files.items()) == 1
    assert store.begin().has("s", 9) and not store.begin().has("s", 10) and not store.begin().has("other", 0)


def test_splitting_moves_keys_of_the_split_parts_only(spark):
    keys = spark.range(3000).withColumnRenamed("id", "k")
    for old, new in ((1, 2), (3, 4), (5, 7), (4, 32), (6, 50)):
        moved = keys.select(tables.part_of(["k"], old).alias("a"), tables.part_of(["k"], new).alias("b")).where("a <> b").distinct().collect()
        assert {r["a"] for r in moved} <= tables.split_sources(old, new)
        assert all(r["b"] >= old for r in moved) and {r["b"] for r in moved} == set(range(old, new))


def test_late_rows_are_dropped_and_state_is_let_go(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, d, start + timedelta(days=d, minutes=i % 1400), d + (3 if i % 10 == 0 else 0)) for d in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, day int, ts timestamp, turn int")
    state, dropped = [], []

    def seen(query):
        batches = [b for b in query.recentProgress if b["stateOperators"]]
        state.append(batches[-1]["stateOperators"][0]["numRowsTotal"])
        dropped.append(sum(b["stateOperators"][0]["numRowsDroppedByWatermark"] for b in batches))

    totals = jobs.replay(jobs.in_turns(df.withColumn("v", F.lit(1.0)), "turn"),
                         lambda s: jobs.period_totals(s, "ts", "v", "1 day", "1 day"), ["period_start"], "late", seen=seen)
    got = {r["period_start"]: r["count"] for r in totals.collect()}
    assert got == {start + timedelta(days=d): 36 for d in range(12)} | {start: 36} | {
        start + timedelta(days=d): 40 for d in range(12) if d + 3 > 12}
    assert sum(dropped) > 0 and max(state) <= 4
    nothing = jobs.replay(jobs.in_turns(df.limit(0).withColumn("v", F.lit(1.0)), "turn"),
                          lambda s: jobs.period_totals(s, "ts", "v", "1 day", "1 day"), ["period_start"], "none")
    assert nothing.count() == 0


def test_a_large_part_is_written_by_many_tasks(spark):
    rows = spark.range(20000).select("id", F.col("id").alias("property_id"), F.sha2(F.col("id").cast("string"), 256).alias("price"))
    fields = schemas.sale_schema()
    sales = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    store = new_store(spark)
    staged = materialise(sales.repartition(8), "sales")
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(advised, "64k")
    try:
        store.load(sale=staged)
        now = store.snapshot()
        change = store.begin()
        fresh = materialise(sales.where("id < 10").withColumn("price", F.lit("new")), "fresh")
        change.replace(jobs.SALE, change.touched(jobs.SALE, fresh).unionByName(fresh))
        change.commit()
    finally:
        spark.conf.unset(advised)
    assert now.tables[jobs.SALE].parts == 1 and now.tables[jobs.SALE].files[0].rows == 20000
    assert len(now.read(jobs.SALE).inputFiles()) > 1
    assert sorted(r["price"] for r in now.read(jobs.SALE).collect()) == sorted(r["price"] for r in rows.collect())
    assert store.snapshot().read(jobs.SALE).count() == 20010
