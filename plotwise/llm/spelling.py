"""Spelling variants: words one edit apart, found by scanning sorted word lists.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced
code point turns one into the other. Near words are searched in sorted lists: the rows of
the edit matrix of a query against a list are banded to three cells (more than one edit
off the diagonal is out of reach), a row is worked out once for all words of the list that
share the prefix it belongs to (their longest common prefix), and a range of words is
skipped as soon as the row of its shared prefix exceeds one edit. All queries of a task
walk their lists together, one code point deeper at a time.

Lists are kept short by where two words first differ. If the shorter word has L code points
and the words agree on exactly p of them from the left, p in [low, high), then their first
low code points are equal, and so are the last L - high of them. Words are dealt to lists by
that prefix and suffix, for the two halves of the places; every pair meets in exactly one
list. A list with more than ``CROWDED`` words is dealt again by halves of its places, down to
a single place, where a list cannot hold more words than there are pairs of symbols. So no
list is unbounded and no word is left out.

Null and empty texts have no words; a null id counts as an empty one. Extra columns are
ignored. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.batches import slices
from plotwise.llm.sizes import if_few
from plotwise.session import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
LENGTH = 5
COUNT = 3
#: Letters of distinct words counted in a task before they are handed on.
HELD = 4_000_000
#: Words of one list beyond which it is dealt again by shorter ranges of places.
CROWDED = 2_000
#: Words, and pairs of a query and a range of a list, looked at together.
BLOCK, FRONT = 60_000, 400_000
FAR = 2

Change = Callable[[str, str], str]


def count_words(docs: DataFrame, change: Change | None = None, length: int = LENGTH, count: int = COUNT,
                text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: letter runs of at least ``length`` code points that occur ``count`` times or more.

    A-Z are lower-cased, nothing else. ``change`` maps the id (as text) and a run to the
    word it stands for, for all occurrences of the run in the document.
    """
    schema = "word string, n long"

    def emit(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        held = 0
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                for name, content in zip(batch.column(0).slice(a, b - a).to_pylist(), texts):
                    own: dict[str, int] = {}
                    # bytes.lower() touches A-Z only.
                    for w in RUN.findall((content or "").encode().lower().decode()):
                        if len(w) >= length:
                            own[w] = own.get(w, 0) + 1
                    for w, n in own.items():
                        if change:
                            w = change(name, w)
                            if len(w) < length:
                                continue
                        if w in counts:
                            counts[w] += n
                        else:
                            counts[w] = n
                            held += len(w) + 16
                    if held >= HELD:
                        yield emit(counts)
                        counts, held = {}, 0
        yield emit(counts)

    read = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    return read.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# ---- lists -----------------------------------------------------------------

def list_key(size: Column, low: Column, high: Column) -> Column:
    """Names the words that share the first ``low`` and the last ``size - high`` code points."""
    tail = F.greatest(size - high, F.lit(0))
    word = F.col("word")
    return F.xxhash64(size, low, high, F.substring(word, F.lit(1), low), F.substring(word, F.length(word) - tail + 1, tail))


def dealt(words: DataFrame, places: Column) -> DataFrame:
    """One row for each (size, low, high) of ``places``, with the list it belongs to."""
    rows = words.select("word", "n", F.explode(places).alias("at")).select("word", "n", "at.*")
    return rows.withColumn("key", list_key(F.col("size"), F.col("low"), F.col("high")))


def places(size: Column, low: Column, high: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def first_places() -> Column:
    """Both halves of the places, for a word as the shorter (or equal) and as the longer one of a pair."""
    own = F.length("word")
    halves = []
    for size in (own, own - 1):
        middle = F.floor((size + 1) / 2)
        halves += [places(size, F.lit(0), middle), places(size, middle, size + 1)]
    return F.array(*halves)


def near_lists(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, n, size, low, high, key: every word in all the lists in which it can meet a near one."""
    todo, ready = dealt(words, first_places()), None
    while True:
        dense = materialise(
            todo.where(F.col("high") - F.col("low") > 1).groupBy("key").agg(F.count("*").alias("members"))
            .where(F.col("members") > crowded).select("key"), "crowded-lists")
        if dense.limit(1).count() == 0:
            return todo if ready is None else ready.unionByName(todo)
        dense = if_few(dense)
        short = todo.join(dense, "key", "left_anti")
        ready = short if ready is None else ready.unionByName(short)
        size, low, high = F.col("size"), F.col("low"), F.col("high")
        middle = F.floor((low + high) / 2)
        again = todo.join(dense, "key", "left_semi").where(high - low > 1)
        cut = again.select("word", "n", F.array(places(size, low, middle), places(size, middle, high)).alias("parts"))
        todo = materialise(dealt(cut, F.col("parts")).select(*todo.columns), "short-lists")


# ---- scanning --------------------------------------------------------------

def common_prefixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Longest common prefix of each word with the one before it; -1 where ``together`` is false."""
    out = np.where(together, 0, -1).astype(np.int64)
    live = np.flatnonzero(together)
    depth = 0
    while len(live):
        live = live[np.minimum(size[live], size[live - 1]) > depth]
        live = live[flat[start[live] + depth] == flat[start[live - 1] + depth]]
        depth += 1
        out[live] = depth
    return out


def scan(words: list[str], group: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near words of one group, j of ``size`` code points, that first differ in [low, high).

    ``words`` are distinct and sorted within each group; i may be one code point longer.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # One symbol that equals no other before and two after each word.
    flat = np.frombuffer("".join(f"\x00{w}\x00\x00" for w in words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(lengths + 3) - lengths - 2
    listed = np.flatnonzero(lengths == size)
    if not len(listed):
        return listed, listed
    together = np.zeros(len(listed), bool)
    together[1:] = group[listed[1:]] == group[listed[:-1]]
    shared = common_prefixes(flat, start[listed], lengths[listed], together)
    begin = start[listed]
    found_i, found_j = [], []
    first, last = np.searchsorted(group[listed], group), np.searchsorted(group[listed], group, side="right")
    queries = np.flatnonzero(first < last)
    n = len(queries)
    # Front: query, range [a, b) of the list, three cells of the matrix row, place of the first difference.
    row = [np.full(n, v, np.int8) for v in (FAR, 0, 1)]
    stack = [(0, queries, first[queries], last[queries], *row, np.full(n, -1, np.int64))]
    edges: dict[int, np.ndarray] = {}
    while stack:
        depth, q, a, b, left, mid, right, differ = stack.pop()
        if len(q) > FRONT:
            half = len(q) // 2
            for part in (slice(None, half), slice(half, None)):
                stack.append((depth, *[x[part] for x in (q, a, b, left, mid, right, differ)]))
            continue
        # Words that have been read to their end; there the range is one word.
        done = size[q] == depth
        if done.any():
            longer = lengths[q] > size[q]
            place = np.where(differ < 0, size[q], differ)
            hit = done & (np.where(longer, right, mid) == 1) & (place >= low[q]) & (place < high[q])
            found_i.append(q[hit])
            found_j.append(listed[a[hit]])
            q, a, b, left, mid, right, differ = (x[~done] for x in (q, a, b, left, mid, right, differ))
        if not len(q):
            continue
        if depth not in edges:
            edges[depth] = np.append(np.flatnonzero(shared <= depth), len(listed))
        cuts = edges[depth]
        one, end = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
        parts = end - one
        at = np.repeat(one - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
        q, left, mid, right, differ = (np.repeat(x, parts) for x in (q, left, mid, right, differ))
        a, b = cuts[at], cuts[at + 1]
        symbol = flat[begin[a] + depth]
        here = start[q] + depth
        new_left = np.minimum(left + (flat[here - 1] != symbol), mid + 1)
        apart = flat[here] != symbol
        new_mid = np.minimum(np.minimum(mid + apart, right + 1), new_left + 1)
        inside = np.minimum(here + 1, start[q] + lengths[q])
        new_right = np.minimum(right + (flat[inside] != symbol), new_mid + 1)
        differ = np.where((differ < 0) & apart, depth, differ)
        keep = np.minimum(np.minimum(new_left, new_mid), new_right) < FAR
        keep &= np.where(differ < 0, depth + 1 < high[q], (differ >= low[q]) & (differ < high[q]))
        # Of two words of one length, the later one is looked for.
        keep &= (lengths[q] > size[q]) | (listed[b - 1] > q)
        cells = (np.minimum(x, FAR)[keep].astype(np.int8) for x in (new_left, new_mid, new_right))
        stack.append((depth + 1, q[keep], a[keep], b[keep], *cells, differ[keep]))
    i, j = np.concatenate(found_i or [listed[:0]]), np.concatenate(found_j or [listed[:0]])
    # An equal length is met from both sides where its range held other words as well.
    once = (lengths[i] > lengths[j]) | (i < j)
    return i[once], j[once]


NEAR = "word string, n_near long, form string, form_n long"


def near_words(lists: DataFrame) -> DataFrame:
    """NEAR: for the words of each list, how many near words it holds and the most frequent of them."""
    def best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        word, near = np.concatenate([i, j]), np.concatenate([j, i])
        # Positions stand for code-point order: lists are sorted, and both words are of one list.
        order = np.lexsort((near, -n[near], word))
        word, near = word[order], near[order]
        who, at, many = np.unique(word, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([
            pa.array([words[k] for k in who.tolist()], pa.string()), pa.array(many, pa.int64()),
            pa.array([words[k] for k in near[at].tolist()], pa.string()), pa.array(n[near[at]], pa.int64()),
        ], names=["word", "n_near", "form", "form_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        names = ("key", "size", "low", "high")

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key, size, low, high = (part.column(c).to_numpy() for c in names)
            new = np.ones(len(key), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in (key, size, low, high)], axis=0)
            group = np.cumsum(new)
            # Words alone in their list meet nobody.
            company = np.bincount(group)[group] > 1
            if company.any():
                part = part.filter(pa.array(company))
                words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                i, j = scan(words, group[company], *(x[company].astype(np.int64) for x in (size, low, high)))
                if len(i):
                    yield best(words, n, i, j)

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                table = pa.Table.from_batches([batch.slice(start, BLOCK)])
                kept = table if kept is None else pa.concat_tables([kept, table])
                key = kept.column("key").to_numpy()
                full = int(np.searchsorted(key, key[-1]))
                if full:
                    yield from done(kept.slice(0, full))
                    kept = kept.slice(full).combine_chunks()
        if kept is not None and len(kept):
            yield from done(kept)

    ordered = lists.repartition("key").sortWithinPartitions("key", "size", "low", "high", "word")
    return ordered.select("key", "size", "low", "high", "word", "n").mapInArrow(run, NEAR)


# ---- forms and roots -------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """word, root: where each word's chain of forms ends.

    A form occurs at least twice as often as its word, so chains are short and free of
    circles; every round doubles the steps taken.
    """
    reached = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = materialise(reached.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return reached


def spelling_variants(words: DataFrame, times: int = 2, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n), words distinct.

    The form of a word is its near word of largest n, the smallest in code-point order among
    equals, if that n is at least ``times`` the word's own; else null, as is form_n. The root
    is where following forms ends, the word itself if it has none.
    """
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = near_words(near_lists(words, crowded)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best"))
    most = -F.col("best.less")
    strong = most >= F.col("n") * times
    named = materialise(words.join(found, "word", "left").select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, most).alias("form_n")), "spelling-forms")
    ends = roots(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
