"""Writers: exports, merged datasets and versioned tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, StructType, TimestampType,
)

from plotwise.functions import text
from plotwise.functions.features import parse_features
from plotwise.session import materialise

EXPORT_COLUMNS = (
    "address", "postcode", "property_type", "bedrooms", "bathrooms", "extra_features",
    "floorplan_urls", "url", "date_sold", "date_sold_iso", "price", "price_numeric",
    "price_change_pct", "tenure",
)


def _sales_of(properties: DataFrame, sales: DataFrame) -> DataFrame:
    sold = sales.select(
        F.col("id").alias("sale_id"), F.col("property_id").alias("id"), "date_sold", "date_sold_iso",
        "price", "price_numeric", "price_change_pct", "tenure",
        F.when(text.strip(F.col("property_type")) != "", F.col("property_type")).alias("_sale_type"),
    )
    return properties.join(sold, "id").withColumn(
        "property_type", F.coalesce("_sale_type", "property_type")
    )


def sales_export(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Property and sale in the 14 export columns plus the outcode folder."""
    known = properties.where(text.blank_to_null(F.col("postcode")).isNotNull())
    return _sales_of(known, sales).select(
        text.export_outcode(F.col("postcode")).alias("outcode"), *EXPORT_COLUMNS
    )


def write_sales_export(export: DataFrame, path: str, files_per_outcode: int = 8) -> None:
    """One folder per outcode.

    Rows are spread over a few writers per outcode, so that one large outcode is
    not a single task and a small one is not hundreds of files.
    """
    spread = F.pmod(F.xxhash64("address", "date_sold", "price"), F.lit(files_per_outcode))
    export.repartition("outcode", spread).write.mode("overwrite").partitionBy("outcode").parquet(
        path, compression="snappy"
    )


# --- merging files whose schemas differ ---------------------------------------

#: Numbers from narrow to wide: two of different width meet in the wider one.
NUMBERS = (ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType())


def promoted(a: DataType, b: DataType) -> DataType:
    """The narrowest type that holds the values of both; TypeError where none does.

    A column without a type (all null) takes the other's. Whole numbers beside a float meet
    in double, since a float does not hold them all.
    """
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if a in NUMBERS and b in NUMBERS:
        wide = max(a, b, key=NUMBERS.index)
        return DoubleType() if isinstance(wide, FloatType) else wide
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        return DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if {type(a), type(b)} == {DateType, TimestampType}:
        return TimestampType()
    raise TypeError(f"no common type for {a.simpleString()} and {b.simpleString()}")


def file_schemas(spark: SparkSession, path: str, pattern: str = "*.parquet", skip: Sequence[str] = ()) -> DataFrame:
    """path and schema (as JSON) of every Parquet file below a folder, from its footer.

    Footers are read in tasks; nothing of the columns is.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    if skip:
        listed = listed.where(~F.element_at(F.split("path", "/"), -1).isin(*skip))

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            schemas = []
            for p in paths:
                files, inside = pa.fs.FileSystem.from_uri(p)
                with files.open_input_file(inside) as opened:
                    arrow = pq.ParquetFile(opened).schema_arrow
                schemas.append(from_arrow_schema(arrow, prefer_timestamp_ntz=False).json())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(schemas, pa.string())], names=["path", "schema"])

    return listed.repartition("path").mapInArrow(footers, "path string, schema string")


def merge_parquet(spark: SparkSession, path: str, pattern: str = "*.parquet", skip: Sequence[str] = ()) -> DataFrame:
    """All Parquet files below a folder under one promoted schema.

    Files are read by groups of equal schema, each cast to the common one: columns that a
    group lacks, or that are null throughout, are null, numbers are widened. Derived outputs
    are left out by ``pattern`` or by name (``skip``). Columns stand in the order in which
    schemas, by first path, bring them in.
    """
    found = file_schemas(spark, path, pattern, skip).orderBy("path").collect()  # one short row per file
    if not found:
        raise FileNotFoundError(f"no Parquet files below {path}")
    groups: dict[str, list[str]] = {}
    for r in found:
        groups.setdefault(r["schema"], []).append(r["path"])
    schemas = {text_: StructType.fromJson(json.loads(text_)) for text_ in groups}
    common: dict[str, DataType] = {}
    for schema in schemas.values():
        for f in schema.fields:
            try:
                common[f.name] = promoted(common.get(f.name, NullType()), f.dataType)
            except TypeError as error:
                raise TypeError(f"column {f.name}: {error}") from None
    frames = []
    for text_, schema in schemas.items():
        typed = StructType([f for f in schema.fields if not isinstance(f.dataType, NullType)])
        rows = spark.read.schema(typed).parquet(*groups[text_])
        here = set(typed.fieldNames())
        # A column that is null in all files is text.
        kinds = {c: StringType() if isinstance(t, NullType) else t for c, t in common.items()}
        frames.append(rows.select(*[(F.col(c) if c in here else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))
    return reduce(DataFrame.unionByName, frames)


def write_enriched(properties: DataFrame, path: str) -> None:
    """Properties with the 112 parsed columns; a stored column keeps its name and
    its parsed namesake is written as ``parsed_<name>``."""
    parsed = parse_features(properties, prefix="parsed_")
    renames = {
        c: c.removeprefix("parsed_") for c in parsed.columns
        if c.startswith("parsed_") and c.removeprefix("parsed_") not in properties.columns
    }
    parsed.withColumnsRenamed(renames).write.mode("overwrite").parquet(path, compression="snappy")


def csv_export(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """Property and sale ordered by postcode, address and entry order.

    A global sort: range-partitioned, each task writes one ordered file.
    """
    sold = sales.select(F.col("id").alias("sale_id"), F.col("property_id").alias("id"),
                        "date_sold", "price", "tenure")
    return properties.join(sold, "id").orderBy("postcode", "address", "sale_id").select(
        "address", "postcode", "property_type", "bedrooms", "bathrooms", "date_sold", "price", "tenure"
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


# --- caches and versions -----------------------------------------------------

def write_cache(df: DataFrame, path: str, now: datetime) -> None:
    """Parquet copy of a reference set, stamped with its time of arrival."""
    df.withColumn("ingested_at", F.lit(now)).write.mode("overwrite").parquet(path)


def cache_is_stale(spark: SparkSession, path: str, now: datetime, max_age_days: int) -> bool:
    """True when a reference set is missing or past its age.

    Reads one column of one row's worth of aggregate; the set itself stays put.
    """
    try:
        newest = spark.read.parquet(path).agg(F.max("ingested_at")).first()[0]
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path this way
        if "PATH_NOT_FOUND" in str(error):
            return True
        raise
    return newest is None or (now - newest).total_seconds() > max_age_days * 86400


def stale_parts(spark: SparkSession, path: str, part: str, now: datetime, max_age: timedelta) -> DataFrame:
    """Values of the partition column whose newest file is older than ``max_age`` at ``now``."""
    cached = spark.read.parquet(path)
    newest = cached.select(F.col(part), F.col("_metadata.file_modification_time").alias("at")).groupBy(part).agg(F.max("at").alias("at"))
    return newest.where(F.lit(now) - F.col("at") > F.lit(max_age)).select(part)


def refresh_cache(spark: SparkSession, path: str, part: str, now: datetime, max_age: timedelta,
                  fetch: Callable[[DataFrame], DataFrame], wanted: DataFrame) -> DataFrame:
    """A partitioned copy of a reference set, with the parts that are missing or too old fetched anew.

    ``wanted`` holds the values of the partition column that should be there; ``fetch`` gets
    those to fetch and returns their rows. Ages are those of the files, so nothing is stamped
    into the rows, and other parts are neither read nor written. A part that is fetched
    without rows keeps what it has.
    """
    try:
        have = spark.read.parquet(path)
        due = stale_parts(spark, path, part, now, max_age).unionByName(wanted.join(have.select(part).distinct(), part, "left_anti").select(part))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        due = wanted.select(part)
    due = materialise(due.join(wanted, part, "left_semi").distinct(), "due-parts")
    fresh = materialise(fetch(due).join(due, part, "left_semi"), "fetched")
    fresh.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return spark.read.parquet(path)


def write_version(df: DataFrame, table_path: str, version: int, partition: Column | None = None) -> str:
    """Store the next version of a table beside the current one.

    Readers move on once the version is complete, so a lost job never leaves a
    half-written table in use.
    """
    path = f"{table_path}/version={version}"
    if partition is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.withColumn("bucket", partition).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def save_bucketed(properties: DataFrame, sales: DataFrame, property_table: str, sale_table: str,
                  buckets: int) -> None:
    """Store both tables bucketed by property, so that their joins need no shuffle.

    Worth it once the tables are joined more often than they are written.
    """
    properties.write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").saveAsTable(property_table)
    sales.write.mode("overwrite").bucketBy(buckets, "property_id").sortBy("property_id").saveAsTable(sale_table)
