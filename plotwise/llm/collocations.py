"""Phrases whose words occur together, counted on a prefix-free parse of the corpus.

Texts are cut into pieces at punctuation and line ends, pieces into words. Each text is parsed
into chunks: a word whose hash leaves 0 when divided by ``EVERY`` triggers a new chunk, and
every chunk reaches ``longest - 1`` words into the next one, but not into another piece. Ends
of pieces stand in the chunks as marks that no phrase spans. Where chunks begin depends on the
words alone, so a passage that repeats is parsed alike everywhere and the dictionary of
distinct chunks with their frequencies keeps it once. All counting is done on the dictionary:
an n-gram of a chunk counts as often as the chunk occurs, and one that starts in the overlap
belongs to the next chunk only, so each occurrence is counted once.

A phrase can only reach the bound if both phrases one word shorter have. So words are counted
first, then pairs of words that passed, then longer phrases whose parts passed, each by a
64-bit hash; which have passed is kept in a bitmap of ``SLOTS`` bits, a fixed size whatever
the corpus holds. Phrases that share a hash or a slot pass together, which costs work and
changes nothing: a last count tells the phrases whose parts all passed apart by 128 bits. Only
those that reach the bound are spelled out, each once, from one chunk that holds it: spelled out
while they are counted, each would be written by every task that meets it, and these rows grow
with tasks times phrases. Hashes are dealt to buckets by their first bits and shuffled as arrays, one
row for each bucket of a task, as a row for each hash costs Spark more than the counting itself.

Languages are counted apart; a null one is ``und``. Null and empty texts have no words. Extra
columns are ignored and repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from plotwise.llm.batches import release, slices
from plotwise.session import materialise

UNKNOWN = "und"
LEAST, LONGEST, TOP = 30, 4, 2000
#: One word in EVERY starts a chunk; a chunk without one is cut after WIDEST words.
EVERY, WIDEST = 12, 200
#: Bytes of distinct chunks or phrases gathered in a task before they are handed on.
HELD = 24_000_000
#: Bytes of a text that are split into words together, and on to the end of the piece.
SPAN = 1_000_000
#: Bytes of chunks that are looked at together.
TOGETHER = 8_000_000
#: Bits of the map of phrases that reached the bound, and of one row of it.
SLOTS, ROW = 2**26, 32_768
#: Copies of the counts that a join by parts of phrases is spread over.
SALTS = 16
#: A phrase goes if a longer one around it occurs at least this often for each 100 of its own.
COVERED = 80

#: Buckets of hashes for each part of the dictionary.
BUCKETS = 8

#: Stands for the end of a piece; no word holds it.
END = b"."
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", END * 9)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lower case, with END between pieces; of a long text those of whole pieces at a time."""
    # bytes.lower() touches A-Z only.
    text, start = text.lower().translate(ENDS), 0
    while start < len(text):
        stop = text.find(END, start + SPAN) + 1 or len(text)
        yield text[start:stop].replace(END, b" " + END + b" ").split()
        start = stop


def chunks(words: list[bytes], overlap: int) -> list[tuple[int, bytes]]:
    """(words that start in it, words and ends of pieces) of each chunk of a text."""
    start, out = 0, []
    hashes = np.fromiter(map(crc32, words), np.int64, len(words))
    for trigger in [*np.flatnonzero(hashes % EVERY == 0).tolist(), len(words)]:
        while start < trigger:
            cut = min(trigger, start + WIDEST)
            inside = words[start:cut]
            own = cut - start - inside.count(END)
            if inside[-1] != END:
                following = words[cut: cut + overlap]
                inside += following[: following.index(END)] if END in following else following
            if own:
                out.append((own, b" ".join(inside)))
            start = cut
    return out


def dictionary(docs: DataFrame, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, own, chunk, times: distinct chunks, the words that start in them, and how often they occur."""
    def emit(langs: list, found: list) -> Iterator[pa.RecordBatch]:
        arrays = [pa.array(langs, pa.string()), pa.array([own for own, _ in found], pa.int32()), pa.array([chunk for _, chunk in found], pa.binary()).cast(pa.string())]
        same = pa.table(arrays, names=["lang", "own", "chunk"]).group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
        yield from same.rename_columns(["lang", "own", "chunk", "times"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, found, held = [], [], 0
        for batch in batches:
            for a, b, texts in slices(batch.column(1).cast(pa.binary())):
                for name, content in zip(batch.column(0).slice(a, b - a).to_pylist(), texts):
                    for words in tokens(content or b""):
                        made = chunks(words, longest - 1)
                        langs += [name] * len(made)
                        found += made
                        held += sum(len(chunk) + 64 for _, chunk in made)
                        if held >= HELD:
                            yield from emit(langs, found)
                            langs, found, held = [], [], 0
        if found:
            yield from emit(langs, found)
        batch = texts = words = made = langs = found = None
        release()

    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    parts = read.mapInArrow(run, "lang string, own int, chunk string, times long")
    return parts.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


# ---- counting --------------------------------------------------------------

ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Seed of the second 64 bits that tell phrases apart.
OTHER = 0x94D049BB133111EB


def passed_map(hashes: DataFrame) -> np.ndarray:
    """Bitmap of SLOTS bits, set for the column ``hash``; all that reaches the driver."""
    numbered = hashes.select((F.col("hash").bitwiseAND(F.lit(SLOTS - 1)) + 1).alias("slot"))
    rows = numbered.groupBy(F.bitmap_bucket_number("slot").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((SLOTS // ROW, ROW // 8), np.uint8)
    for r in rows.collect():
        out[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def has_passed(passed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64(8 * len(passed) - 1)).astype(np.int64)
    return (passed[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about TOGETHER bytes, none of them empty."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += batch.nbytes
        if held >= TOGETHER:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def distinct(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, all below ``bound``, and the place of each value among them."""
    if bound > 4 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(bound, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(values, starts)


def summed_pairs(hashes: np.ndarray, others: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of hashes sorted by the first, the sum of the counts of each and one of its ids."""
    if not len(hashes):
        return hashes, others, counts, ids
    order = np.argsort(hashes)
    first, other = hashes[order], others[order]
    if np.any((first[1:] == first[:-1]) & (other[1:] != other[:-1])):
        # Phrases that share the first hash may lie mixed.
        order = np.lexsort((others, hashes))
        first, other = hashes[order], others[order]
    starts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (other[1:] != other[:-1])))
    return first[starts], other[starts], np.add.reduceat(counts[order], starts), ids[order[starts]]


def longer_hashes(hashes: np.ndarray, single: np.ndarray, size: int) -> np.ndarray:
    """The hash of the phrase of one word more at each place, from those of ``size`` words and of single words."""
    following = np.zeros(len(single), np.uint64)
    following[: max(0, len(single) - size)] = single[size:]
    hashes = hashes * ODD + following
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX
    return hashes ^ (hashes >> np.uint64(32))


def dealt(buckets: int, names: list[str], columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """A row for each bucket, a range of hashes, that some of the sorted hashes, the first column, fall into."""
    of = ((columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    ends = np.append(starts, len(of))
    arrays = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in columns]
    return pa.RecordBatch.from_arrays([pa.array(of[starts]), *arrays], names=["bucket", *names])


def undealt(bucket: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    """Columns of all rows of a bucket, each joined to one array."""
    return [np.frombuffer(b"".join(bucket.column(name).to_pylist()), kind) for name, kind in kinds.items()]


class Places:
    """The places of all words and ends of pieces of a batch of chunks, one after another.

    ``numbers`` tells apart the pairs of language and word; ``word`` holds for places of words,
    ``own`` for those that count, ``last`` for the last words of chunks, ``row`` is the chunk's.
    """

    def __init__(self, batch: pa.RecordBatch):
        lists = pc.split_pattern(batch.column(2), " ")
        coded = lists.values.dictionary_encode()
        self.dictionary = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        offsets = lists.offsets.to_numpy()
        sizes = np.diff(offsets)
        self.row = row = np.repeat(np.arange(len(sizes)), sizes)
        self.word = self.code != pc.index(self.dictionary, END.decode()).as_py()
        before = np.append(0, np.cumsum(self.word))
        # The first words of a chunk, as many as it has of its own, count.
        self.own = self.word & (before[:-1] < (before[offsets[:-1]] + batch.column(1).to_numpy())[row])
        self.last = np.zeros(len(row), bool)
        self.last[offsets[1:] - 1] = True
        self.times = batch.column(3).to_numpy()[row]
        langs = batch.column(0).dictionary_encode()
        self.lang_names = langs.dictionary
        pairs = langs.indices.to_numpy().astype(np.int64)[row] * len(self.dictionary) + self.code
        pairs, self.numbers = distinct(pairs, len(self.lang_names) * len(self.dictionary))
        self.lang_of, self.word_of = np.divmod(pairs, max(1, len(self.dictionary)))

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """The hash of language and word for every place; another ``seed`` gives independent ones."""
        seeds = np.array([xxh64_intdigest(x, seed) for x in self.lang_names.to_pylist()], object)[self.lang_of]
        words = self.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)[self.word_of]
        return np.fromiter(map(xxh64_intdigest, words.tolist(), seeds.tolist()), np.uint64, len(words))[self.numbers]

    def candidates(self, maps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hash, whether it may reach the bound) of the phrase that starts at each place, for 1, 2, ... words.

        One size more than there are bitmaps: both parts of these have passed.
        """
        single = hashes = self.word_hashes()
        may = self.word
        out = []
        for size, passed in enumerate(maps, 1):
            good = may.copy()
            good[may] = has_passed(passed, hashes[may])
            out.append((hashes, good))
            # A phrase goes on inside its chunk; where its second part starts there, it ends there.
            may = good & ~self.last & np.append(good[1:], False)
            hashes = longer_hashes(hashes, single, size)
        return [*out, (hashes, may)]

    def sums(self, inverse: np.ndarray, places: np.ndarray, many: int) -> np.ndarray:
        """Occurrences of each of ``many`` numbers over the ``places`` they stand for."""
        total = np.zeros(many, np.int64)
        np.add.at(total, inverse, self.times[places])
        return total

    def phrases_found(self, maps: list[np.ndarray], ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(hash, hash with OTHER, occurrences, id of its chunk) of words, each once, and longer phrases whose parts have passed."""
        single = others = self.word_hashes(OTHER)
        for size, (hashes, good) in enumerate(self.candidates(maps)):
            places = np.flatnonzero(good & self.own)
            times = self.times[places]
            if size:
                others = longer_hashes(others, single, size)
            else:
                numbers, inverse = distinct(self.numbers[places], len(self.word_of))
                times, counted = self.sums(inverse, places, len(numbers)), places
                places = np.zeros(len(numbers), np.int64)
                places[inverse] = counted
            yield hashes[places], others[places], times, ids[self.row[places]]

    def spelled(self, hashes: np.ndarray, others: np.ndarray, longest: int) -> Iterator[pa.Table]:
        """lang, phrase, a: for each row the phrase of its chunk that has the row's two hashes; a is its ``times``."""
        first = one = self.word_hashes()
        second = two = self.word_hashes(OTHER)
        for size in range(longest):
            if size:
                first, second = longer_hashes(first, one, size), longer_hashes(second, two, size)
            places = np.flatnonzero((first == hashes[self.row]) & (second == others[self.row]))
            places = places[np.unique(self.row[places], return_index=True)[1]]
            parts = [self.dictionary.take(pa.array(self.code[places + i])) for i in range(size + 1)]
            phrase = pc.binary_join_element_wise(*parts, " ") if size else parts[0]
            langs = self.lang_names.take(pa.array(self.lang_of[self.numbers[places]]))
            yield pa.table([langs, phrase, pa.array(self.times[places])], names=["lang", "phrase", "a"])


def chunk_id() -> Column:
    """Names a chunk in few bytes; chunks may share it."""
    return F.hash("lang", "own", "chunk").alias("id")


def count_found(parsed: DataFrame, maps: list[np.ndarray], least: int) -> DataFrame:
    """hash, other, a, id: words and longer phrases with at least ``least`` occurrences, and a chunk that holds them."""
    shared = parsed.sparkSession.sparkContext.broadcast(maps)
    buckets = BUCKETS * parsed.rdd.getNumPartitions()
    kinds = {"hashes": np.uint64, "others": np.uint64, "counts": np.int64, "ids": np.int32}

    def merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return summed_pairs(*map(np.concatenate, zip(*found)))

    def size(found: list[tuple[np.ndarray, ...]]) -> int:
        return sum(x.nbytes for columns in found for x in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in gathered(batches):
            kept.append(merged([*Places(batch).phrases_found(shared.value, batch.column(4).to_numpy())]))
            if size(kept) >= HELD:
                kept = [merged(kept)]
                if 2 * size(kept) >= HELD:
                    yield dealt(buckets, [*kinds], kept[0])
                    kept = []
        if size(kept):
            yield dealt(buckets, [*kinds], merged(kept))
        batch = kept = None
        release()

    def enough(bucket: pa.Table) -> pa.Table:
        found = summed_pairs(*undealt(bucket, kinds))
        hashes, others, counts, ids = (x[found[2] >= least] for x in found)
        return pa.table([pa.array(x) for x in (hashes.view(np.int64), others.view(np.int64), counts, ids)], names=["hash", "other", "a", "id"])

    parts = parsed.select("lang", "own", "chunk", "times", chunk_id()).mapInArrow(run, "bucket int, hashes binary, others binary, counts binary, ids binary")
    return parts.groupBy("bucket").applyInArrow(enough, "hash long, other long, a long, id int")


def spell(parsed: DataFrame, counted: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, a: the phrases of ``counted``, each read off the chunk that it names."""
    shared = parsed.sparkSession.sparkContext.broadcast(passed_map(counted.select(F.col("id").cast("long").alias("hash"))))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_passed(shared.value, batch.column(3).to_numpy().astype(np.int64).view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            hashes, others = (batch.column(i).to_numpy().view(np.uint64) for i in (4, 5))
            for found in Places(batch).spelled(hashes, others, longest):
                yield from found.to_batches()
        batch = hashes = others = found = None
        release()

    holders = parsed.select("lang", "own", "chunk", chunk_id()).mapInArrow(holding, "lang string, own int, chunk string, id int")
    rows = holders.join(counted, "id").select("lang", "own", "chunk", "a", "hash", "other")
    # Two chunks with one id may both hold a phrase.
    return rows.mapInArrow(run, "lang string, phrase string, a long").dropDuplicates(["lang", "phrase"])


def count_hashed(parsed: DataFrame, maps: list[np.ndarray], least: int) -> DataFrame:
    """hash: of phrases one word longer than there are ``maps``, whose parts passed, that occur ``least`` times together."""
    shared = parsed.sparkSession.sparkContext.broadcast(maps)
    buckets = BUCKETS * parsed.rdd.getNumPartitions()
    kinds = {"hashes": np.uint64, "counts": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in gathered(batches):
            places = Places(batch)
            hashes, may = places.candidates(shared.value)[-1]
            at = np.flatnonzero(may & places.own)
            if len(at):
                kept.append((hashes[at], places.times[at]))
                held += 16 * len(at)
            if held >= HELD:
                yield dealt(buckets, [*kinds], summed(*map(np.concatenate, zip(*kept))))
                kept, held = [], 0
        if kept:
            yield dealt(buckets, [*kinds], summed(*map(np.concatenate, zip(*kept))))
        batch = places = hashes = may = at = kept = None
        release()

    def enough(bucket: pa.Table) -> pa.Table:
        found, total = summed(*undealt(bucket, kinds))
        return pa.table([pa.array(found[total >= least].view(np.int64))], names=["hash"])

    parts = parsed.select("lang", "own", "chunk", "times").mapInArrow(run, "bucket int, hashes binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(enough, "hash long")


# ---- scoring ---------------------------------------------------------------

def joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def with_count(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``.

    Many phrases may share one part: rows are spread over SALTS copies of its count. Spark takes the
    copies, and rows that were exploded, for as small as the table they come from, so it would send
    millions of rows through the driver; both sides are shuffled.
    """
    copies = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy"))
    mine = (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase")) & (F.pmod(F.xxhash64("phrase"), F.lit(SALTS)) == F.col("_copy"))
    return rows.join(copies.hint("merge"), mine).drop("_lang", "_phrase", "_copy", part)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Of a phrase with a occurrences, cut after its first k words, l and r are those of its
    parts; its score is the least floor(2000000 * a / (l + r)) over all cuts (the smallest k
    among equals). n counts the words of the language. A phrase inside a longer one of at
    least COVERED percent of its occurrences is left out. Order: score and a descending, phrase.
    """
    parsed = materialise(dictionary(docs, longest, text, lang), "chunks")
    maps: list[np.ndarray] = []
    while len(maps) < longest - 1:
        maps.append(passed_map(count_hashed(parsed, maps, least)))
    counted = materialise(count_found(parsed, maps, least), "counted")
    counts = materialise(spell(parsed, counted, longest).withColumn("size", F.size(F.split("phrase", " "))), "phrases")
    longer = counts.where("size > 1")
    words = F.split("phrase", " ")

    cuts = longer.select("lang", "phrase", "a", "size", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", joined(F.col("words"), F.lit(1), F.col("k")).alias("first"),
                        joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    shorter = counts.where(F.col("size") < longest)
    both = with_count(with_count(parts, shorter, "first", "l"), shorter, "rest", "r")
    # Decimals hold the products beyond 64 bits.
    scored = both.withColumn("score", F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    around = longer.where("size > 2").select(F.col("lang"), F.col("a"), F.explode(spans).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    wide = F.expr("CAST(around AS DECIMAL(20, 0)) * 100")
    free = best.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (wide < F.expr("CAST(a AS DECIMAL(20, 0))") * COVERED))

    sizes = parsed.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    chosen = free.select("lang", "phrase", "a", "best.*").withColumn("rank", F.expr(
        "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top)
    return chosen.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), F.col("score").cast("long").alias("score"))
