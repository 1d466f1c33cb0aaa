"""N-gram Jaccard join: exact near-duplicate classes by a metric-space join.

A document is the set of its word n-grams. Under the Jaccard distance almost all
documents are at distance 1 from each other, so regions around documents would take in
everything; instead the pivots are single n-grams, from which a document is at distance
1 - 1/size if it holds them and 1 if not. Pivots are ordered by how many documents hold
them, rarest first. A document's home region is that of its first shared pivot, and by
the triangle inequality a document within the radius can only miss so many of its first
pivots; up to that bound it is replicated into the regions that follow. Pivots of one
document only come first in the order and use up the bound, so most documents are in no
region at all.

Two members of a region can only be linked if the pivots both have missed leave enough
in common. Within a region a few members become the new pivots: every other member is
compared with them exactly, linked members fall into one class, and only members of
different classes go into the next round, until a region holds one class or the pairs
between its classes are few enough to be compared each. So no link between different
classes is lost, and no region lists all its pairs.

Sets are 64-bit hashes; documents with equal sets are one entry throughout, named by a
64-bit digest of the set. Texts are read and hashed once, as bytes and many at a time; that
pass gives both the name of each document's set and the n-grams of the sets. Counting who
shares an n-gram is done on blocks of hashes, dealt by hash, whose number grows with the
input.

Texts that are null or have no words have empty sets, which are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.batches import release
from plotwise.llm.graphs import components
from plotwise.llm.sizes import if_few
from plotwise.session import materialise

WORDS = 4
PERCENT = 85
#: n-grams in a block of hashes, and bytes of text that are taken for one.
BLOCK, WIDTH = 1_500_000, 5
#: Bytes of texts that are looked at together.
SPAN = 1 << 16
#: n-grams gathered in a task before they are dealt to the blocks.
GATHER = 1_000_000
#: Members of a region that all others are compared with in a round.
LEADERS = 4
#: Pairs between classes, for each member of a region, up to which they are looked at one by
#: one: in the first round, when a region's documents are still classes of their own, and later.
DENSE = (16, 1024)

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX_TWO = np.uint64(0x94D049BB133111EB)
SHORT_HASH = "<u8"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, A-Z in lower case; words are what white space separates."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    cut = F.btrim(plain, F.lit(" \t\n\x0b\x0c\r"))
    words = F.transform(F.split(cut, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    return F.when(F.coalesce(cut, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(words)


def mixed(x: np.ndarray, factor: np.uint64 = MIX) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * factor
    return x ^ (x >> np.uint64(27))


def letter_values() -> np.ndarray:
    """A number for each of 256 bytes at each of NEAR places of a word."""
    x = np.arange(1, 256 * NEAR + 1, dtype=np.uint64) * ODD
    x = mixed(mixed(x), MIX_TWO)
    return x ^ (x >> np.uint64(31))


#: Places of a word that have values of their own; those behind share them, mixed with the distance.
NEAR = 64
VALUES = letter_values()
LOWER = np.arange(256, dtype=np.intp)
LOWER[65:91] += 32
IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each text begins; the last edge is the end."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[edges[0]: edges[-1]], edges - edges[0]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and where the words of each text begin.

    Words are what white space separates. A word's hash is the sum of the values of its
    bytes at their places, mixed.
    """
    data, edges = bytes_of(texts)
    word = IN_WORD[data]
    follows = np.zeros(len(word) + 1, bool)  # places that go on with the word of the place before
    np.logical_and(word[1:], word[:-1], out=follows[1:-1])
    follows[edges] = False
    starts = np.flatnonzero(word & ~follows[:-1])
    lengths = np.flatnonzero(word & ~follows[1:]) + 1 - starts
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    letters = LOWER[data[word]]
    if lengths.max(initial=0) <= NEAR:
        values = VALUES[place * 256 + letters]
    else:
        values = VALUES[(place % NEAR) * 256 + letters]
        far = np.flatnonzero(place >= NEAR)
        values[far] = mixed(values[far] + (place[far] // NEAR).astype(np.uint64) * ODD, MIX_TWO)
    return mixed(run_sums(values, np.append(0, ends))), np.searchsorted(starts, edges)


def run_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of the values between each two edges."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, one set after another, and where each begins."""
    words, edges = hashed_words(texts)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mixed(grams * ODD + words[k: k + len(grams)])
    grams = np.append(grams, np.zeros(len(words) - len(grams), np.uint64))
    lengths = np.diff(edges)
    for size in range(1, n):
        at = edges[:-1][lengths == size]
        whole = np.full(len(at), size, np.uint64)
        for k in range(size):
            whole = mixed(whole * ODD + words[at + k])
        grams[at] = whole
    counts = np.where(lengths > 0, np.maximum(lengths - n + 1, 1), 0)
    of = np.repeat(np.arange(len(lengths)), lengths)
    grams = grams[np.arange(len(words)) - edges[of] < counts[of]]
    edges = np.append(0, np.cumsum(counts))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[edges[:-1][counts > 0]] = True
    return grams[fresh], np.append(0, np.cumsum(fresh))[edges]


def digests(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A signed 64-bit number that names each set."""
    return run_sums(mixed(grams), edges).view(np.int64)


def allowed_misses(n, percent: int):
    """n-grams of a set of n that a linked set may lack: n - ceil(n * percent / 100)."""
    return n - (n * percent + 99) // 100


def as_bytes(hashes: np.ndarray) -> bytes:
    """The upper five bytes of each hash; the block stands for the rest."""
    return np.ascontiguousarray((hashes >> np.uint64(24)).astype(SHORT_HASH).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(SHORT_HASH).ravel()


BLOCKS = "block int, ids binary, sizes binary, counts binary, hashes binary"
NAMES = "doc_id long, text_hash long, size long, set_id long"
#: How often an n-gram occurs, and the n-gram.
SHARED = np.dtype([("times", "<u4"), ("hash", "<u8")])


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    other = np.ones(len(keys[0]), bool)
    other[1:] = False
    for key in keys:
        other[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(other)


def packed(data: bytes, starts: np.ndarray, width: int) -> pa.Array:
    """Values of ``width`` bytes, cut at ``starts``."""
    edges = np.append(starts * width, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def block_rows(block: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, hashes: bytes) -> list[pa.Array]:
    """Columns of BLOCKS, a row for each block, of values sorted by block and owner, the place of a set in ``ids``."""
    first = run_starts(block, owner)
    who, counts, of = owner[first], np.diff(np.append(first, len(block))), block[first]
    rows = run_starts(of)
    return [pa.array(of[rows].astype(np.int32)), packed(ids[who].astype("<i8").tobytes(), rows, 8), packed(sizes[who].astype("<i4").tobytes(), rows, 4),
            packed(counts.astype("<i4").tobytes(), rows, 4), packed(hashes, first[rows], len(hashes) // max(1, len(block)))]


def with_nulls(blocks: list[pa.Array] | None, names: list[pa.Array] | None) -> pa.RecordBatch:
    """A batch of rows of BLOCKS or of rows of NAMES, which also have a block."""
    if names is None:
        arrays = blocks + [pa.nulls(len(blocks[0]), pa.int64())] * 4
    else:
        arrays = names[:1] + [pa.nulls(len(names[0]), pa.binary())] * 4 + names[1:]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "sizes", "counts", "hashes", "doc_id", "text_hash", "size", "set_id"])


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of rows with about SPAN bytes of text, the third column."""
    _, edges = bytes_of(batch.column(2))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + SPAN, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def deal_grams(docs: DataFrame, n: int, blocks: int, text: str, doc_id: str) -> DataFrame:
    """Rows of BLOCKS and of NAMES in one pass over the texts.

    Rows of BLOCKS: in each block, the set ids, set sizes and n-grams that fall into it.
    Rows of NAMES, in blocks below 0: one for each row of ``docs``; set_id is null for an empty set.
    """
    def emit(gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, flat = map(np.concatenate, zip(*gathered))
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        # Numbers of 16 bits are sorted by their digits.
        block = (flat % np.uint64(blocks)).astype(np.uint16 if blocks <= 65536 else np.int32)
        order = np.argsort(block, kind="stable")
        return with_nulls(block_rows(block[order], owner[order], ids, sizes, as_bytes(flat[order])), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        gathered, seen, held = [], set(), 0
        for batch in batches:
            for part in text_slices(batch):
                grams, edges = gram_sets(part.column(2), n)
                ids, sizes = digests(grams, edges), np.diff(edges)
                # Rows are dealt in turn, as no block should hold many.
                turn = (turn + np.arange(len(ids) + 1)) % blocks
                yield with_nulls(None, [
                    pa.array((-1 - turn[:-1]).astype(np.int32)), part.column(0), part.column(1),
                    pa.array(sizes), pa.array(ids, mask=sizes == 0)])
                turn = int(turn[-1])
                fresh = np.zeros(len(ids), bool)
                for i, (name, size) in enumerate(zip(ids.tolist(), sizes.tolist())):
                    if size and name not in seen:
                        seen.add(name)
                        fresh[i] = True
                if fresh.any():
                    gathered.append((ids[fresh], sizes[fresh], grams[np.repeat(fresh, sizes)]))
                    held += len(gathered[-1][2])
                if held >= GATHER:
                    yield emit(gathered)
                    gathered, seen, held = [], set(), 0
        if gathered:
            yield emit(gathered)
        batch = part = grams = gathered = seen = None
        release()

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, f"{BLOCKS}, {NAMES}")


def shared_grams(dealt: DataFrame, blocks: int) -> DataFrame:
    """Rows of BLOCKS, dealt by set id: the n-grams that more than one set holds. Rows of NAMES stay as they are.

    ``hashes`` holds values of the kind SHARED.
    """
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        if block < 0:
            return table
        ids, sizes, owner, hashes, base = [], [], [], [], 0
        for i, s, c, h in zip(*[table.column(x).to_pylist() for x in ("ids", "sizes", "counts", "hashes")]):
            ids.append(np.frombuffer(i, "<i8"))
            sizes.append(np.frombuffer(s, "<i4"))
            owner.append(base + np.repeat(np.arange(len(ids[-1])), np.frombuffer(c, "<i4")))
            hashes.append(from_bytes(h))
            base += len(ids[-1])
        hashes, owner = np.concatenate(hashes), np.concatenate(owner)
        # Most n-grams are met once; the rest is looked at more closely.
        order = np.argsort(hashes)
        hashes = hashes[order]
        again = np.zeros(len(hashes) + 1, bool)
        again[1:-1] = hashes[1:] == hashes[:-1]
        again = again[1:] | again[:-1]
        hashes, owner = hashes[again], owner[order[again]]
        names, first, same = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        sizes, owner = np.concatenate(sizes)[first], same[owner]
        # A set that was met in several tasks counts once.
        order = np.lexsort((owner, hashes))
        fresh = order[run_starts(hashes[order], owner[order])]
        hashes, owner = hashes[fresh], owner[fresh]
        starts = run_starts(hashes)
        times = np.diff(np.append(starts, len(hashes)))
        times = np.repeat(times, times)
        keep = times > 1
        owner, found = owner[keep], np.zeros(int(keep.sum()), SHARED)
        found["times"], found["hash"] = times[keep], hashes[keep] * np.uint64(blocks) + np.uint64(block)
        target = (names[owner].view(np.uint64) % np.uint64(blocks)).astype(np.int32)
        order = np.lexsort((owner, target))
        return pa.Table.from_batches([with_nulls(block_rows(target[order], owner[order], names, sizes, found[order].tobytes()), None)])

    return dealt.groupBy("block").applyInArrow(run, f"{BLOCKS}, {NAMES}")


def memberships(shared: DataFrame, percent: int) -> DataFrame:
    """set_id, size, pivots (in order, with the number missed before) and grams of sets in any region."""
    def run(table: pa.Table) -> pa.Table:
        ids, sizes, owner, times, hashes, base = [], [], [], [], [], 0
        for i, s, c, h in zip(*[table.column(x).to_pylist() for x in ("ids", "sizes", "counts", "hashes")]):
            ids.append(np.frombuffer(i, "<i8"))
            sizes.append(np.frombuffer(s, "<i4"))
            owner.append(base + np.repeat(np.arange(len(ids[-1])), np.frombuffer(c, "<i4")))
            found = np.frombuffer(h, SHARED)
            times.append(found["times"])
            hashes.append(found["hash"])
            base += len(ids[-1])
        names, first, same = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        sizes = np.concatenate(sizes)[first].astype(np.int64)
        owner, times, hashes = same[np.concatenate(owner)], np.concatenate(times), np.concatenate(hashes)
        order = np.lexsort((hashes, times, owner))
        owner, hashes = owner[order], hashes[order]
        edges = np.searchsorted(owner, np.arange(len(names) + 1))
        alone = sizes - np.diff(edges)  # n-grams that no other set has
        room = allowed_misses(sizes, percent) + 1 - alone
        chosen = np.flatnonzero(room > 0)
        pivots = [hashes[edges[i]: edges[i] + min(room[i], edges[i + 1] - edges[i])].view(np.int64).tolist() for i in chosen]
        return pa.table({
            "set_id": pa.array(names[chosen], pa.int64()), "size": pa.array(sizes[chosen], pa.int64()), "alone": pa.array(alone[chosen], pa.int64()),
            "pivots": pa.array(pivots, pa.list_(pa.int64())),
            "grams": pa.array([np.sort(hashes[edges[i]: edges[i + 1]]).tobytes() for i in chosen], pa.binary()),
        })

    return shared.groupBy("block").applyInArrow(run, "set_id long, size long, alone long, pivots array<long>, grams binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    one = sets.select(F.col("set_id").alias("a"), F.col("size").alias("size_a"), F.col("grams").alias("grams_a"))
    two = sets.select(F.col("set_id").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("grams_b"))

    def run(batches):
        for batch in batches:
            a, b, sa, ga, sb, gb = (batch.column(i) for i in range(6))
            keep = []
            for x, y, p, q in zip(sa.to_pylist(), sb.to_pylist(), ga, gb):
                both = np.concatenate([np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (x + y - common))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "size_a", "grams_a", "size_b", "grams_b").mapInArrow(run, "a long, b long")


def feasible(percent: int) -> Column:
    """Whether two members can be linked, given what each has missed before their common pivot."""
    most = F.least(F.col("x.size") - F.col("x.missed"), F.col("y.size") - F.col("y.missed"))
    return (100 + percent) * most >= percent * (F.col("x.size") + F.col("y.size"))


def still_in_reach(members: DataFrame, percent: int) -> DataFrame:
    """Members that can be linked with a set of some size that has missed no more pivots than
    the best member of the region."""
    best = members.groupBy(F.col("pivot").alias("_pivot")).agg(F.min("missed").alias("_least"))
    joined = members.join(best, F.col("pivot") == F.col("_pivot"))
    whole = 100 + percent
    # The other set must be large enough for its own misses and small enough for these ones.
    smallest = (percent * F.col("size") + whole * F.col("_least")) * percent
    largest = (whole * (F.col("size") - F.col("missed")) - percent * F.col("size")) * 100
    return joined.where(smallest <= largest).drop("_pivot", "_least")


def classes(sets: DataFrame, percent: int) -> DataFrame:
    """node and component of every set that is linked with another one."""
    placed = sets.select("set_id", "size", "alone", F.posexplode("pivots").alias("at", "pivot")).select("pivot", "set_id", "size", "alone", (F.col("alone") + F.col("at")).alias("missed"))
    crowded = placed.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1").select("pivot")
    members = placed.join(crowded, "pivot", "left_semi")
    links: DataFrame | None = None
    found = None
    while True:
        members = still_in_reach(members, percent)
        if found is None:
            labelled = members.withColumn("class", F.col("set_id"))
        else:
            labelled = members.join(found, F.col("set_id") == F.col("node"), "left").select(
                "pivot", "set_id", "size", "alone", "missed", F.coalesce("component", "set_id").alias("class"))
        labelled = materialise(labelled, "labelled-regions")
        by_class = labelled.groupBy("pivot", "class").agg(F.count("*").alias("n"))
        regions = by_class.groupBy("pivot").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        # Pairs between classes are at most half of n * n - squares.
        open_regions = materialise(regions.where("classes > 1").select("pivot", (F.col("n") * F.col("n") - F.col("squares") <= 2 * DENSE[found is not None] * F.col("n")).alias("few")), "open-regions")
        if open_regions.limit(1).count() == 0:
            break
        active = materialise(labelled.join(if_few(open_regions), "pivot"), "active-regions")
        few = active.where("few")
        within = few.alias("x").join(few.alias("y"), F.col("x.pivot") == F.col("y.pivot")).where(
            (F.col("x.class") != F.col("y.class")) & (F.col("x.set_id") < F.col("y.set_id")) & feasible(percent)).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))
        many = active.where("not few")
        # At first, sets with the fewest n-grams of their own lead: they are likeliest to be close
        # to all others, and as they lead every region they are in, few pairs are compared twice.
        # Later, those that have missed least: without them most others are out of reach.
        first = F.col("alone") if found is None else F.col("missed")
        leaders = many.groupBy("pivot", F.pmod(F.xxhash64("set_id"), F.lit(LEADERS)).alias("part")).agg(F.min(F.struct(first.alias("first"), "set_id", "missed", "size", "class")).alias("l")).select("pivot", "l.*")
        leaders = materialise(leaders, "leaders")
        led = many.alias("x").join(leaders.alias("y"), F.col("x.pivot") == F.col("y.pivot")).where(
            (F.col("x.class") != F.col("y.class")) & (F.col("x.set_id") != F.col("y.set_id")) & feasible(percent)).select(
            F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))
        pairs = materialise(within.unionByName(led).distinct(), "pairs")
        fresh = materialise(compared(pairs, sets, percent), "links")
        links = fresh if links is None else links.unionByName(fresh)
        found = materialise(components(links), "classes")
        # Leaders have met all members of their region; few-pair regions are done.
        members = materialise(many.join(leaders.select("pivot", "set_id"), ["pivot", "set_id"], "left_anti").select("pivot", "set_id", "size", "alone", "missed"), "regions")
    if found is None:
        return sets.sparkSession.createDataFrame([], "node long, component long")
    return found


def classed(docs: DataFrame, words: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, size and class of every row; the class is null for an empty set."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")) + 1)).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (BLOCK * WIDTH)))
    shared = materialise(shared_grams(deal_grams(docs, words, blocks, text, doc_id), blocks), "shared-grams")
    named = shared.where("block < 0").select("doc_id", "text_hash", "size", "set_id")
    sets = materialise(memberships(shared.where("block >= 0"), percent), "region-sets")
    found = classes(sets, percent)
    return named.join(found, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", "text_hash", "size", F.coalesce("component", "set_id").alias("class"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    rows = classed(docs, words, percent, text, doc_id)
    smallest = rows.where("class is not null").groupBy(F.col("class").alias("_class")).agg(F.min("doc_id").alias("smallest"))
    return rows.join(smallest, F.col("class") == F.col("_class"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: of the smallest doc_id, then of the smallest text hash.

    Rows with empty sets all stay.
    """
    rows = materialise(classed(docs, words, percent, text, doc_id), "classed")
    times = rows.where("class is not null").groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    first = times.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash", "times")).alias("f")).select(
        F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash"), F.col("f.times").alias("_times"))
    empty = rows.where("class is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().withColumn("_times", F.lit(1).cast("long"))
    kept = docs.join(first.unionByName(empty), F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")))
    # Rows that are equal in id and text are one document; these few are reduced to one row.
    single, repeated = kept.where("_times = 1"), kept.where("_times > 1").dropDuplicates(["_id", "_hash"])
    return single.unionByName(repeated).select(*docs.columns)
