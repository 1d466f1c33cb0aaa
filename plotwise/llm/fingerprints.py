"""SimHash fingerprints of documents, and all neighbours within a Hamming radius.

Every term of a text votes with its length on each of 64 bits: for, where its hash has a
one, against, where it has a zero. The fingerprint takes the majority. Terms are split at
blanks, tabs and line ends and put in lower case.

For the search, the 64 bits are cut into blocks. Two fingerprints within the radius agree
on all blocks but as many as the radius; so there is a table for each choice of agreeing
blocks, keyed by their bits, and fingerprints that meet in a table are compared.

Only DataFrame operations are used. Null texts count as empty; a text without terms has
fingerprint 0.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.session import materialise

BITS = 64
BLOCKS = 6
RADIUS = 3
#: Bit k of the hash in the low half of a number, bit k + 32 in the high half.
LANES = (1 << 32) + 1


def terms(text: Column) -> Column:
    return F.split(F.translate(F.lower(text), "\t\n\r", "   "), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def with_fingerprint(df: DataFrame, keys: list[str], text: str, name: str = "fingerprint") -> DataFrame:
    """The ``keys`` of every row with the fingerprint of its text.

    Votes are summed where the row is read, so that a text leaves its task as 33 sums.
    Rows with equal keys must have equal texts; they stay separate rows.
    """
    words = df.select(*keys, F.posexplode(terms(F.coalesce(F.col(text), F.lit("")))).alias("_at", "_term"))
    votes = words.select(*keys, "_at", F.length("_term").alias("_weight"), F.xxhash64("_term").alias("_hash"))
    lanes = [
        F.sum(F.shiftrightunsigned("_hash", k).bitwiseAND(F.lit(LANES)) * F.col("_weight")).alias(f"_v{k}") for k in range(BITS // 2)
    ]
    sums = votes.groupBy(*keys).agg(F.sum("_weight").alias("_all"), F.sum(F.when(F.col("_at") == 0, 1).otherwise(0)).alias("_rows"), *lanes)

    def bit(k: int) -> Column:
        lane = F.col(f"_v{k % 32}")
        ones = F.shiftrightunsigned(lane, 32) if k >= 32 else lane.bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftleft(F.when(2 * ones > F.col("_all"), F.lit(1)).otherwise(F.lit(0)).cast("long"), k)

    fingerprint = bit(0)
    for k in range(1, BITS):
        fingerprint = fingerprint.bitwiseOR(bit(k))
    # Equal rows voted together, which changes no majority; they are told apart again.
    return sums.select(*keys, fingerprint.alias(name), F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy")).drop("_copy")


def masks(blocks: int, radius: int) -> list[int]:
    """One mask for each choice of blocks that must agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    out = [sum(whole[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance) of all pairs of distinct fingerprints within ``radius``.

    Both frames have one column ``fingerprint``; repeated values are reduced to one. A
    pair that meets in several tables is kept in the first of them.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    tables = masks(blocks, radius)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        cells = F.array(*[F.struct(F.lit(t).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(tables)])
        return one.select(name, F.explode(cells).alias("cell")).select(name, F.col("cell.table").alias(f"{name}_table"), F.col("cell.bits").alias(f"{name}_bits"))

    a, b = keyed(queries, "query"), keyed(fingerprints, "fingerprint")
    differs = F.col("query").bitwiseXOR(F.col("fingerprint"))
    met = F.array_position(F.array(*[differs.bitwiseAND(F.lit(m)) == 0 for m in tables]), True) - 1
    return a.join(
        b, (F.col("query_table") == F.col("fingerprint_table")) & (F.col("query_bits") == F.col("fingerprint_bits"))
        & (F.bit_count(differs) <= radius) & (met == F.col("query_table")),
    ).select("query", "fingerprint", F.bit_count(differs).alias("distance"))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, text, next_id, next_hash and next_text: the next document by descending id.

    The last document is followed by the first. Documents with equal ids follow each
    other by the hash of their text. Rows are dealt into ranges of ids; a range also
    gets the last document of the range before it, so that no task sees all rows. There
    are at most a few ranges for each shuffle partition, so the table of their ends is
    small whatever the data.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("text_hash"), content.alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = docs.agg(F.percentile_approx(F.col(doc_id), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = F.array(*[F.lit(p) for p in sorted(set(points or []))]).cast("array<bigint>")
    # Documents without an id come before all others, in the first range.
    dealt = rows.withColumn("range", F.coalesce(F.size(F.filter(bounds, lambda p: p <= F.col("doc_id"))), F.lit(0)))
    # (false, null) sorts before (true, id), whatever the id.
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    ends = dealt.groupBy("range").agg(F.max(place).alias("last")).collect()
    follower = dict(zip(sorted(r["range"] for r in ends), sorted(r["range"] for r in ends)[1:]))
    first = min((r["range"] for r in ends), default=0)
    heirs = spark.createDataFrame(
        [(r["last"]["id"], r["last"]["hash"], follower.get(r["range"], first)) for r in ends], "last_id long, last_hash long, heir int")
    lent = dealt.join(F.broadcast(heirs), F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("text_hash") == F.col("last_hash")), "left")
    copies = F.when(F.col("heir").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(1).alias("own")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(1).alias("own")), F.struct(F.col("heir").alias("range"), F.lit(0).alias("own"))))
    placed = lent.select("doc_id", "text_hash", "text", F.explode(copies).alias("_to")).select("doc_id", "text_hash", "text", "_to.range", "_to.own")
    before = Window.partitionBy("range").orderBy("own", F.col("doc_id").asc_nulls_first(), "text_hash")
    return placed.select(
        "doc_id", "text_hash", "text", "own", F.lag("doc_id").over(before).alias("next_id"),
        F.lag("text_hash").over(before).alias("next_hash"), F.lag("text").over(before).alias("next_text"),
    ).where("own = 1").drop("own")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document.

    Columns: doc_id, text_hash, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    next_fingerprint (long).
    """
    pairs = with_next(docs, text, doc_id).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["doc_id", "text_hash", "next_id", "next_hash", "n_chars", "edited_sha256", "which"]
    both = pairs.select(
        "doc_id", "text_hash", "next_id", "next_hash", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("_t"),
    ).select(*keys[:-1], "_t.which", "_t.body")
    prints = materialise(with_fingerprint(both, keys, "body"), "fingerprints")
    # Copies of one row are numbered on either side, so that they pair off.
    rest = keys[:-1]
    one = prints.groupBy(*rest).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        F.sum(F.when(F.col("which") == 0, 1).otherwise(0)).alias("_rows"))
    by_text = prints.where("which = 0").groupBy(F.col("text_hash").alias("_hash")).agg(F.max("fingerprint").alias("next_fingerprint"))
    joined = one.join(by_text, F.col("next_hash") == F.col("_hash"))
    return joined.select(
        "doc_id", "text_hash", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint",
        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy")).drop("_copy")
