"""Keyed tables that micro-batches change: parts that grow with the data, versions that appear at once.

A table is kept in parts by a hash of its key. A batch rewrites only the parts it touches,
into a new folder; nothing is overwritten. What belongs to a version is listed in one small
file, whose appearance is the commit for all tables of the store together, with the number
of the batch it came from. Readers hold on to the version they started with, a batch that
dies leaves nothing visible, and a batch that is repeated after its commit does nothing.

The number of parts follows the bytes (linear hashing): part p splits into p and a new last
one, so growing by one part rewrites one part. Keys are hashed whole, and keys are unique, so
parts stay near ``part_bytes`` whatever the keys look like.

One writer at a time, as for the checkpoint of a stream. Folders of old versions stay until
whoever owns the store clears them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from plotwise.session import materialise

PART_BYTES = 128 * 2**20
#: A batch may make a table this many times as wide at most; the next one goes on.
WIDEN = 8

LISTED = (
    "tables map<string, struct<parts int, files array<struct<part int, folder string, rows bigint, bytes bigint>>>>,"
    " applied map<string, bigint>")


def part_of(key: Sequence[str], parts: int) -> Column:
    """Part of a key among ``parts``, which need not be a power of two."""
    low = 2 ** int(math.log2(parts))
    hashed = F.xxhash64(*key)
    fine = F.pmod(hashed, F.lit(2 * low))
    return F.when(fine < parts, fine).otherwise(F.pmod(hashed, F.lit(low))).cast("int")


def split_sources(old: int, new: int) -> set[int]:
    """Parts among ``old`` that give keys away when there are ``new``."""
    found = set()
    for p in range(old, new):
        while p >= old:
            p -= 2 ** int(math.log2(p))
        found.add(p)
    return found


@dataclass(frozen=True)
class KeyedTable:
    """Columns of a table and those that are its unique key."""

    schema: StructType
    key: tuple[str, ...]


@dataclass(frozen=True)
class Part:
    folder: str
    rows: int
    bytes: int


@dataclass
class Listing:
    parts: int = 1
    files: dict[int, Part] = field(default_factory=dict)

    @property
    def bytes(self) -> int:
        return sum(f.bytes for f in self.files.values())


class Snapshot:
    """One version of all tables; what it reads never changes."""

    def __init__(self, store: TableStore, version: int, tables: dict[str, Listing], applied: dict[str, int]):
        self.store, self.version, self.tables, self.applied = store, version, tables, applied

    def read(self, name: str, parts: Iterable[int] | None = None) -> DataFrame:
        """The table, or those of its parts that are asked for."""
        files = self.tables[name].files
        wanted = files if parts is None else [p for p in parts if p in files]
        paths = [f"{files[p].folder}/_part={p}" for p in wanted]
        schema = self.store.tables[name].schema
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class TableStore:
    """Tables below one path that change together."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, KeyedTable], part_bytes: int = PART_BYTES) -> None:
        self.spark, self.path, self.tables, self.part_bytes = spark, path.rstrip("/"), tables, part_bytes

    def snapshot(self) -> Snapshot:
        """The newest version; an empty one before the first commit."""
        tables, applied, newest = {name: Listing() for name in self.tables}, {}, 0
        try:
            listed = self.spark.read.schema(f"{LISTED}, version bigint").parquet(f"{self.path}/versions")
            newest = listed.agg(F.max("version")).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        if newest:
            # One row; as many entries as there are parts, which follow the bytes of the tables.
            row = listed.where(F.col("version") == newest).first()
            applied = dict(row["applied"])
            for name, t in row["tables"].items():
                tables[name] = Listing(t["parts"], {f["part"]: Part(f["folder"], f["rows"], f["bytes"]) for f in t["files"]})
        return Snapshot(self, newest, tables, applied)

    def begin(self) -> Change:
        return Change(self, self.snapshot())

    def load(self, **frames: DataFrame) -> None:
        """First contents of tables, in one version."""
        change = self.begin()
        for name, df in frames.items():
            staged = materialise(df.select(*self.tables[name].schema.fieldNames()), "load")
            change.touched(name, staged, bound=None)
            change.replace(name, staged)
        change.commit()


class Change:
    """New parts on top of a version, invisible until ``commit``."""

    def __init__(self, store: TableStore, base: Snapshot) -> None:
        self.store, self.base = store, base
        self.next = {name: Listing(t.parts, dict(t.files)) for name, t in base.tables.items()}
        self.taken: dict[str, set[int]] = {}

    def has(self, source: str, batch: int) -> bool:
        """Whether the batch of this source is part of the version already."""
        return self.base.applied.get(source, -1) >= batch

    def touched(self, name: str, rows: DataFrame, bound: int | None = WIDEN) -> DataFrame:
        """Stored rows of the parts that hold a key of ``rows``, and of parts due for a split.

        ``rows`` is read from files, whose bytes count as about to arrive.
        """
        table, now = self.store.tables[name], self.base.tables[name]
        arriving = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct().agg(F.sum("n")).first()[0] or 0
        wanted = max(now.parts, math.ceil((now.bytes + arriving) / self.store.part_bytes))
        parts = min(wanted, now.parts * bound) if bound else wanted
        self.next[name].parts = parts
        # At most as many numbers as there are parts.
        hit = {r[0] for r in rows.select(part_of(table.key, now.parts).alias("p")).distinct().collect()}
        self.taken[name] = hit | split_sources(now.parts, parts)
        return self.base.read(name, sorted(self.taken[name]))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Put ``df`` in the place of what ``touched`` returned, and return it as written."""
        table, listing = self.store.tables[name], self.next[name]
        folder = f"{self.store.path}/data/{name}/{uuid.uuid4().hex}"
        dealt = df.select(*table.schema.fieldNames()).withColumn("_part", part_of(table.key, listing.parts))
        # A part holds many times its bytes once it is unpacked: tasks get an even share of the
        # rows instead of a part each, and a large part becomes several files in its folder.
        dealt.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(folder)
        written = self.store.spark.read.schema(StructType(list(table.schema.fields)).add("_part", IntegerType())).parquet(folder)
        files = written.groupBy("_part", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
        sizes = files.groupBy("_part").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()
        for p in self.taken.pop(name):
            listing.files.pop(p, None)
        listing.files |= {r["_part"]: Part(folder, r["rows"], r["bytes"]) for r in sizes}
        return written.drop("_part")

    def commit(self, source: str | None = None, batch: int = 0) -> int:
        """Publish all replaced parts as the next version, and return its number."""
        applied = dict(self.base.applied) | ({source: batch} if source else {})
        tables = {name: (t.parts, [(p, f.folder, f.rows, f.bytes) for p, f in sorted(t.files.items())]) for name, t in self.next.items()}
        version = self.base.version + 1
        row = self.store.spark.createDataFrame([(tables, applied)], LISTED).coalesce(1)
        # One file: it is renamed into place as the last step of the write.
        row.write.mode("overwrite").parquet(f"{self.store.path}/versions/version={version}")
        return version
