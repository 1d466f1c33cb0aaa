"""Streaming jobs: continuous ingest, in-flight de-duplication, periods, freshness.

Sources are folders of files; progress lives in a checkpoint below the shared
folder, so a restarted job resumes where it stopped. Results go to parquet, one
folder per micro-batch, and re-running a batch overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from plotwise.operators import upsert
from plotwise.session import materialise, staging_path
from plotwise.streaming.tables import KeyedTable, TableStore


def stream_files(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.parquet",
                 fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Process what is there now and stop; a later call goes on from the checkpoint."""
    query = (
        stream.writeStream.foreachBatch(each_batch).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _write_batches(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )
    return write


def collect_updates(stream: DataFrame, keys: Sequence[str], label: str, mode: str = "update") -> DataFrame:
    """Run a stream over the available input and return the newest row per key.

    Every micro-batch writes the rows it changed; the final state is the latest
    version of each key.
    """
    out, checkpoint = staging_path(stream.sparkSession, label), staging_path(stream.sparkSession, f"{label}-checkpoint")
    run_available(stream, _write_batches(out), checkpoint, mode)
    return _newest(stream, out, keys)


def _newest(stream: DataFrame, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest of the rows that batches have written below ``out``."""
    spark = stream.sparkSession
    fields = StructType.fromJson(stream.schema.jsonValue()).add("batch_id", LongType())
    try:
        written = spark.read.schema(fields).option("recursiveFileLookup", True).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        written = spark.createDataFrame([], fields)  # nothing arrived, so no batch wrote anything
    return upsert.latest_version(written, list(keys), "batch_id").drop("batch_id")


def replay(arrivals: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], keys: Sequence[str], label: str,
           mode: str = "update", seen: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Newest row per key of a stream whose input lands in turns.

    Each of ``arrivals`` is written to the landing folder, then the query goes on from its
    checkpoint: state and watermark carry over, rows behind the watermark are dropped, and
    state it has passed is let go before the next turn. ``seen`` is told of each run.
    """
    stream = out = None
    for part in arrivals:
        spark = part.sparkSession
        if out is None:
            landing, out, checkpoint = (staging_path(spark, f"{label}-{x}") for x in ("landing", "batches", "checkpoint"))
        part.write.mode("append").parquet(landing)
        stream = build(stream_files(spark, landing, part.schema))
        query = run_available(stream, _write_batches(out), checkpoint, mode)
        if seen:
            seen(query)
    if out is None:
        raise ValueError("nothing to replay")
    return _newest(stream, out, keys)


def in_turns(df: DataFrame, turn: str) -> Iterable[DataFrame]:
    """The rows of ``df`` turn by turn, without the column that numbers the turns.

    An empty table has one empty turn.
    """
    numbers = [r[0] for r in df.select(turn).distinct().orderBy(turn).collect()]
    for number in numbers or [None]:
        yield df.where(F.col(turn).eqNullSafe(F.lit(number))).drop(turn)


# --- in-flight operators -----------------------------------------------------

def deduplicate(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats that arrive within the delay; state older than it is let go."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def period_totals(stream: DataFrame, event_time: str, value: str, period: str, delay: str,
                  *keys: str) -> DataFrame:
    """Count and price figures per tumbling period, late rows included up to the delay."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, period).alias("w"), *keys)
        .agg(
            F.count("*").alias("count"), F.avg(value).alias("avg_price"),
            F.min(value).alias("min_price"), F.max(value).alias("max_price"),
        )
        .select(F.col("w.start").alias("period_start"), *keys, "count", "avg_price", "min_price", "max_price")
    )


def freshness_view(stream: DataFrame, key: str, event_time: str) -> DataFrame:
    """Rows and latest update per key; state is one small row per key."""
    return stream.groupBy(key).agg(
        F.count("*").alias("property_count"), F.max(event_time).alias("last_updated")
    )


# --- continuous ingest -------------------------------------------------------

PROPERTY, SALE = "property", "sale"


def ingest_store(spark: SparkSession, path: str, properties: StructType, sales: StructType, **options) -> TableStore:
    """Properties by address and sales by what makes a sale unique, changed together."""
    return TableStore(spark, path, {
        PROPERTY: KeyedTable(properties, ("address",)), SALE: KeyedTable(sales, ("property_id", "date_sold", "price"))}, **options)


def ingest_batch(store: TableStore, source: str = "records") -> Callable[[DataFrame, int], None]:
    """Batch function that brings scraped records of a source into both tables of a store."""
    def apply(records: DataFrame, batch_id: int) -> None:
        change = store.begin()
        if change.has(source, batch_id):
            return
        changes = materialise(upsert.record_changes(records), "record-changes")
        merged = change.replace(PROPERTY, upsert.upsert_properties(change.touched(PROPERTY, changes), changes))
        arriving = materialise(upsert.with_property_id(upsert.sale_rows(records), merged), "arriving-sales")
        change.replace(SALE, upsert.insert_sales(change.touched(SALE, arriving), arriving))
        change.commit(source, batch_id)
    return apply


def ingest(stream: DataFrame, store: TableStore, checkpoint: str) -> StreamingQuery:
    """Bring in what has arrived; batches are counted by checkpoint."""
    return run_available(stream, ingest_batch(store, checkpoint), checkpoint)


def work_store(spark: SparkSession, path: str, results: StructType, key: str = "postcode") -> TableStore:
    """Results of work items next to the log of the items that are done."""
    log = StructType([results[key]]).add("batch", LongType())
    return TableStore(spark, path, {"result": KeyedTable(results, tuple(results.fieldNames())), "done": KeyedTable(log, (key,))})


def pending_work(work: DataFrame, store: TableStore) -> DataFrame:
    """Work items that no run has finished."""
    key = store.tables["done"].key[0]
    return upsert.not_done(work, store.snapshot().read("done"), key)


def run_work(work: DataFrame, store: TableStore, do: Callable[[DataFrame], DataFrame], batches: int = 1) -> int:
    """Finish the pending items of ``work``, batch by batch, and return how many there were.

    The results of a batch and the log of its items become visible in one commit, so a run
    that is interrupted goes on after its last whole batch: no item is lost and none is done
    twice. Items are dealt to batches by a hash of their key.
    """
    key = store.tables["done"].key[0]
    named = work.where(F.col(key).isNotNull())  # without a key there is nothing to log
    todo = materialise(pending_work(named, store).dropDuplicates([key]).withColumn("_turn", F.pmod(F.xxhash64(key), F.lit(batches))), "pending")
    for turn in range(batches):
        items = materialise(todo.where(F.col("_turn") == turn).drop("_turn"), "work-items")
        change = store.begin()
        for name, rows in (("result", do(items)), ("done", items.select(key, F.lit(change.base.version + 1).cast("long").alias("batch")))):
            fresh = materialise(rows.select(*store.tables[name].schema.fieldNames()), f"work-{name}")
            change.replace(name, change.touched(name, fresh).unionByName(fresh))
        change.commit()
    return todo.count()
