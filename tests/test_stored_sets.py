from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, StringType, TimestampType,
)

from plotwise.operators import sales
from plotwise.session import staging_path
from plotwise.sources import sinks
from plotwise.streaming import jobs


def test_types_meet_in_the_narrowest_that_holds_both():
    cases = [
        (IntegerType(), LongType(), LongType()), (ByteType(), IntegerType(), IntegerType()), (IntegerType(), DoubleType(), DoubleType()),
        (LongType(), FloatType(), DoubleType()), (NullType(), StringType(), StringType()), (NullType(), NullType(), NullType()),
        (DecimalType(5, 1), DecimalType(9, 3), DecimalType(9, 3)), (DecimalType(12, 0), DecimalType(4, 3), DecimalType(15, 3)),
        (DateType(), TimestampType(), TimestampType()),
    ]
    for a, b, want in cases:
        assert sinks.promoted(a, b) == want == sinks.promoted(b, a)
    with pytest.raises(TypeError):
        sinks.promoted(StringType(), IntegerType())


def test_merge_of_missing_widened_and_null_columns(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "price": pa.array([5, None], pa.int32()), "note": pa.nulls(2), "none": pa.nulls(2)}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"price": pa.array([2.5], pa.float64()), "id": pa.array([2**40], pa.int64()), "note": pa.array(["x"]), "none": pa.nulls(1)}), deep / "2.parquet")
    pq.write_table(pa.table({"id": pa.array([7], pa.int32()), "day": pa.array([date(2024, 1, 2)])}), deep / "3.parquet")
    pq.write_table(pa.table({"id": pa.array(["derived"])}), tmp_path / "all_properties.parquet")
    out = sinks.merge_parquet(spark, str(tmp_path), skip=["all_properties.parquet"])
    assert dict(out.dtypes) == {"id": "bigint", "price": "double", "note": "string", "none": "string", "day": "date"}
    got = {r["id"]: (r["price"], r["note"], r["none"], r["day"]) for r in out.collect()}
    assert got == {1: (5.0, None, None, None), 2: (None, None, None, None), 2**40: (2.5, "x", None, None), 7: (None, None, None, date(2024, 1, 2))}
    with pytest.raises(TypeError, match="column id"):
        sinks.merge_parquet(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        sinks.merge_parquet(spark, str(tmp_path), "*.none")


def history(spark):
    homes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id bigint, address string")
    rows = [(9, 1, "2024-02-01", 300, "F", "Flat"), (8, 1, "2024-01-01", 100, "L", None), (7, 1, None, 50, None, None),
            (6, 1, "2024-02-01", None, "F", ""), (5, 2, None, None, None, None)]
    return homes, spark.createDataFrame(rows, "id bigint, property_id bigint, date_sold_iso string, price_numeric bigint, tenure string, property_type string")


def test_nested_sales_are_ordered_and_come_apart_again(spark):
    homes, sold = history(spark)
    nested = sales.nested_sales(homes, sold)
    got = {r["id"]: [s["sale_id"] for s in r["sales"]] for r in nested.collect()}
    assert got == {1: [7, 8, 6, 9], 2: [5], 3: []}
    figures = {r["id"]: tuple(r)[1:] for r in sales.history_figures(nested).collect()}
    assert figures == {1: (4, 3, 450, 300, 200), 2: (1, 0, 0, None, None), 3: (0, 0, 0, None, None)}
    flat = sales.flat_sales(nested).select("sale_id", "property_id", "date_sold_iso", "price_numeric", "tenure", "sale_type")
    assert sorted(map(tuple, flat.collect()), key=str) == sorted(map(tuple, sold.select("id", "property_id", "date_sold_iso", "price_numeric", "tenure", "property_type").collect()), key=str)
    assert sales.nested_sales(homes.limit(0), sold).count() == 0


def test_questions_read_only_the_nested_fields_they_use(spark):
    homes, sold = history(spark)
    path = staging_path(spark, "nested")
    sales.nested_sales(homes, sold).write.parquet(path)
    prices = spark.read.parquet(path).select("id", F.col("sales.price_numeric"))
    plan = prices._jdf.queryExecution().executedPlan().toString()
    assert "price_numeric" in plan and "tenure" not in plan.split("ReadSchema")[1] and "address" not in plan.split("ReadSchema")[1]


def test_only_stale_and_missing_parts_are_fetched(spark):
    path, asked = staging_path(spark, "cache"), []
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")

    def fetch(version, without=()):
        def run(due):
            keys = sorted(r["k"] for r in due.collect())
            asked.append(keys)
            return spark.createDataFrame([(version, k) for k in keys if k not in without] + [(99, "not asked for")], "v int, k string")
        return run

    def held():
        return {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}

    day = timedelta(days=1)
    now = datetime.now()
    sinks.refresh_cache(spark, path, "k", now, day, fetch(1), wanted.where("k <> 'z'"))
    assert held() == {"x": 1, "y": 1}
    sinks.refresh_cache(spark, path, "k", now, day, fetch(2), wanted)
    assert held() == {"x": 1, "y": 1, "z": 2}
    sinks.refresh_cache(spark, path, "k", now, day, fetch(3), wanted)
    later = datetime.now() + 2 * day
    sinks.refresh_cache(spark, path, "k", later, day, fetch(4, without=("y",)), wanted.where("k <> 'x'"))
    assert held() == {"x": 1, "y": 1, "z": 4}
    assert asked == [["x", "y"], ["z"], [], ["y", "z"]]


def test_interrupted_work_goes_on_after_its_last_batch(spark):
    work = spark.createDataFrame([(f"P{i}",) for i in range(40)] + [("P1",), (None,)], "postcode string")
    results = spark.createDataFrame([], "postcode string, n bigint").schema
    store = jobs.work_store(spark, staging_path(spark, "work"), results)
    seen = []

    def do(items):
        if len(seen) == 2:
            seen.append(set())
            raise InterruptedError
        seen.append({r["postcode"] for r in items.collect()})
        return items.withColumn("n", F.length("postcode").cast("long"))

    with pytest.raises(InterruptedError):
        jobs.run_work(work, store, do, 4)
    part = store.snapshot().read("done").count()
    assert part == len(seen[0]) + len(seen[1]) == store.snapshot().read("result").count()
    assert jobs.run_work(work, store, do, 4) == 40 - part
    assert sorted(p for s in seen for p in s) == sorted(f"P{i}" for i in range(40))
    assert store.snapshot().read("result").count() == store.snapshot().read("done").count() == 40
    assert jobs.run_work(work, store, do, 1) == 0 and jobs.pending_work(work.where("postcode IS NOT NULL"), store).count() == 0
