"""Substring dedup: fuzzy passages that repeat across documents, by collinear chaining.

Every document is reduced to a winnowed sequence of word k-mers: any run of WINDOW + K - 1
words that two documents share has a common seed. Each seed is matched with its earliest
document (smallest doc_id), never with all others, so the matches grow with the corpus.
The earliest holder of a few words need not be the document that shares the passage around
them. So the longer runs of words that begin at the place of a seed are seeds as well,
each with an earliest document of its own, which shares all of these words.
The matches of two documents are chained: seeds that keep their order in both add their
words, distance costs, and a Fenwick tree over the places in the earlier document finds
the best predecessor of each seed. Chains are aligned word by word between their seeds
and beyond their ends; those similar enough are pieces of repeated passages. Of a chain
that is not, the longest stretches between seeds that are similar enough are pieces. Pieces
that touch are joined, and passages of at least ``min_words`` words count.

The earliest holder of a passage keeps it and is named as the source. Words are what
white space separates, with A-Z in lower case. Null texts have no words. Rows equal in id
and text are one document and repeat nothing of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plotwise.llm.batches import row_slices
from plotwise.llm.ngram_join import mixed, word_hashes
from plotwise.session import materialise

K = 5
WINDOW = 10
#: Words of the longer runs that are matched from the place of each seed.
LONG = (20, 40)
MIN_WORDS = 50
SIMILARITY = 0.8
#: Words of a piece that is worth aligning.
PIECE = 20
#: What a word of distance, in either document, costs in a chain.
GAP = 0.05
#: Words that an alignment may go on beyond the last seed.
BEYOND = 32
#: Words that touching pieces may lie apart.
TOUCH = 3
#: Words in a stretch by which documents are cut for alignment.
STRETCH = 64
#: Seeds in a block of hashes, and seeds gathered in a task before they are dealt.
BLOCK = GATHER = 1_000_000
#: Words of a gap up to which it is aligned word by word; a longer one counts as unequal.
LONGEST_GAP = 64


def grams_of(words: np.ndarray) -> np.ndarray:
    """Hashes of all word k-mers of a sequence of word hashes."""
    n = max(len(words) - K + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(K):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + words[k: k + n])
    return grams


def winnow(words: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of sequences of word hashes, one after the other between ``edges``, and their places in all."""
    edges = np.array([0, len(words)]) if edges is None else edges
    grams = grams_of(words)
    starts, n = edges[:-1], np.maximum(np.diff(edges) - K + 1, 0)
    chosen = np.zeros(len(grams), bool)
    for i in np.flatnonzero((n > 0) & (n < WINDOW)).tolist():
        chosen[starts[i] + int(grams[starts[i]: starts[i] + n[i]].argmin())] = True
    if len(grams) >= WINDOW:
        windows = len(grams) - WINDOW + 1
        least, at = grams[:windows].copy(), np.arange(windows)
        for k in range(1, WINDOW):
            less = grams[k: k + windows] < least
            least[less] = grams[k: k + windows][less]
            at[less] = np.flatnonzero(less) + k
        whole = n >= WINDOW
        turns = np.bincount(starts[whole], minlength=len(words) + 1) - np.bincount((starts + n - WINDOW + 1)[whole], minlength=len(words) + 1)
        chosen[at[np.cumsum(turns)[:windows] > 0]] = True
    places = np.flatnonzero(chosen)
    return grams[places], places


def long_runs(words: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place a hash of the run of each length in LONG (multiples of K) from there, or 0 where its text ends before."""
    grams, out = grams_of(words), np.zeros((len(places), len(LONG)), np.uint32)
    for level, length in enumerate(LONG):
        fits = places + length <= ends
        run = np.zeros(int(fits.sum()), np.uint64)
        for k in range(0, length, K):
            run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + grams[places[fits] + k])
        out[fits, level] = np.maximum(run >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    return out


def as_binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows of bytes: what lies between neighbouring ``edges`` of ``data``."""
    offsets = (edges * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def within(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Edges of the lists and their values, both from 0."""
    edges = lists.offsets.to_numpy().astype(np.int64)
    return edges - edges[0], lists.values.slice(edges[0], edges[-1] - edges[0])


def seeds_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, doc_key, n_words, seeds, places, runs (four bytes for each seed and length in LONG) and codes (two bytes of each word's hash)."""
    def run(batches):
        for batch in batches:
            for part in row_slices(batch):
                edges, values = within(part.column(2))
                flat = values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                seeds, places = winnow(flat, edges)
                owner = np.searchsorted(edges, places, side="right") - 1
                held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])
                runs = long_runs(flat, places, edges[owner + 1]).astype("<u4").ravel()
                offsets = pa.array(held, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.diff(edges), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(seeds.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(places - edges[owner], pa.int32())),
                    as_binary(runs, held * len(LONG)), as_binary((flat >> np.uint64(20)).astype("<u2"), edges)],
                    names=["doc_id", "doc_key", "n_words", "seeds", "places", "runs", "codes"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("doc_key"), word_hashes(F.col(text)).alias("words"))
    return read.mapInArrow(run, "doc_id long, doc_key long, n_words long, seeds array<long>, places array<int>, runs binary, codes binary")


def deal_seeds(sequences: DataFrame, blocks: int) -> DataFrame:
    """Seeds with their documents in blocks by hash: arrays of ids, keys, places, seeds and runs."""
    kinds = {"block": pa.int32(), "ids": pa.binary(), "known": pa.binary(), "keys": pa.binary(), "places": pa.binary(), "seeds": pa.binary(), "runs": pa.binary()}

    def emit(held: list[tuple]):
        owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        ids, known, keys = (np.array(x) for x in zip(*[(h[0] or 0, h[0] is not None, h[1]) for h in held]))
        seeds, places = np.concatenate([h[2] for h in held]).view(np.uint64), np.concatenate([h[3] for h in held])
        runs = np.concatenate([np.frombuffer(h[4], "<u4").reshape(-1, len(LONG)) for h in held])
        block = (seeds % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(blocks + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = order[edges[b]: edges[b + 1]]
            who = owner[part]
            rows.append((b, ids[who].astype("<i8").tobytes(), known[who].astype("u1").tobytes(), keys[who].astype("<i8").tobytes(), places[part].astype("<i4").tobytes(), seeds[part].astype("<u8").tobytes(), runs[part].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc_id, key, seeds, places, runs in zip(*[batch.column(i).to_pylist() for i in (0, 1)], *[batch.column(i) for i in (2, 3, 4)]):
                if len(seeds.values):
                    held.append((doc_id, key, seeds.values.to_numpy(), places.values.to_numpy(), runs.as_py()))
                    size += len(held[-1][2])
                if size >= GATHER:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return sequences.select("doc_id", "doc_key", "seeds", "places", "runs").mapInArrow(run, "block int, ids binary, known binary, keys binary, places binary, seeds binary, runs binary")


def matches_of(dealt: DataFrame) -> DataFrame:
    """doc_key, at, source_key and source_at of every seed whose earliest document is another one.

    The same for the longer runs from a seed, as a match of their first and of their last
    K words; where a shorter run has led to the same place, only what that did not give.
    """
    def run(table: pa.Table) -> pa.Table:
        ids, known, keys, places, seeds, runs = (
            np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
            for name, kind in (("ids", "<i8"), ("known", "u1"), ("keys", "<i8"), ("places", "<i4"), ("seeds", "<u8"), ("runs", "<u4")))
        order = np.lexsort((places, keys, ids, known, seeds))
        first = np.ones(len(seeds), bool)
        first[1:] = seeds[order][1:] != seeds[order][:-1]
        # What stands alone has no partner.
        several = ~(first & np.append(first[1:], True))
        order, first = order[several], first[several]
        keys, places, runs = keys[order], places[order], runs.reshape(-1, len(LONG))[order]
        group = np.cumsum(first) - 1
        lead = np.flatnonzero(first)[group]
        other = np.flatnonzero(keys != keys[lead])
        found = [(other, lead[other], 0)]
        for level, length in enumerate(LONG):
            alike = np.lexsort((np.arange(len(group)), runs[:, level], group))
            new = np.ones(len(group), bool)
            new[1:] = (group[alike][1:] != group[alike][:-1]) | (runs[alike, level][1:] != runs[alike, level][:-1])
            longer = lead.copy()
            longer[alike] = alike[np.flatnonzero(new)[np.cumsum(new) - 1]]
            longer = np.where(runs[:, level] > 0, longer, lead)
            apart, moved = keys != keys[longer], longer != lead
            start = np.flatnonzero(apart & moved)
            end = start if level else np.flatnonzero(apart & (runs[:, level] > 0))
            found += [(start, longer[start], 0), (end, longer[end], length - K)]
            lead = longer
        at, source, shift = (np.concatenate(x) for x in zip(*[(a, b, np.full(len(a), c, np.int32)) for a, b, c in found]))
        return pa.table({
            "doc_key": pa.array(keys[at], pa.int64()), "at": pa.array(places[at] + shift, pa.int32()),
            "source_key": pa.array(keys[source], pa.int64()), "source_at": pa.array(places[source] + shift, pa.int32())})

    return dealt.groupBy("block").applyInArrow(run, "doc_key long, at int, source_key long, source_at int")


def chain(at: np.ndarray, source_at: np.ndarray) -> list[list[int]]:
    """Chains of matches, best first, as indices in order; no match is in two chains.

    A chain's score is its words less GAP for each word of distance between neighbours
    in either document. As that cost is a difference of sums, the best predecessor is
    the largest score plus GAP times its places among all that come before in both.
    """
    order = np.lexsort((-source_at, at)).tolist()
    rank = (np.unique(source_at, return_inverse=True)[1] + 1).tolist()
    size = max(rank)
    at, source_at = at.tolist(), source_at.tolist()
    tree, holder = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(at), [-1] * len(at)
    waiting: list[int] = []

    for i in order:
        if waiting and at[waiting[0]] < at[i]:
            for j in waiting:
                value, r = score[j] + GAP * (at[j] + source_at[j]), rank[j]
                while r <= size:
                    if tree[r] < value:
                        tree[r], holder[r] = value, j
                    r += r & -r
            waiting = []
        best, last, r = -np.inf, -1, rank[i] - 1
        while r > 0:
            if best < tree[r] or best == tree[r] and last < holder[r]:
                best, last = tree[r], holder[r]
            r -= r & -r
        gain = best - GAP * (at[i] + source_at[i])
        if gain > 0:
            score[i], before[i] = min(K, at[i] - at[last], source_at[i] - source_at[last]) + gain, last
        else:
            score[i] = K
        waiting.append(i)
    used, chains = [False] * len(at), []
    for i in sorted(range(len(at)), key=lambda j: -score[j]):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = before[i]
        if links:
            chains.append(links[::-1])
    return chains


def chains_in(at: np.ndarray, source_at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chains of at least two matches of all pairs: places in both documents, the number of each chain's pair and the edges of the chains.

    Where every match of a pair comes after the one before in both documents, and adds
    more than its distance costs, all of them are one chain and none is searched for.
    """
    order = np.lexsort((source_at, at, pair))
    at, source_at, pair = at[order].astype(np.int64), source_at[order].astype(np.int64), pair[order]
    new = np.ones(len(at), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1]) | (source_at[1:] != source_at[:-1])
    at, source_at, pair = at[new], source_at[new], pair[new]
    on, source_on = np.diff(at), np.diff(source_at)
    rising = (on > 0) & (source_on > 0) & (np.minimum(np.minimum(on, source_on), K) - GAP * (on + source_on) > 1e-9)
    total = int(pair.max()) + 1 if len(pair) else 0
    counts = np.bincount(pair, minlength=total)
    edges = np.concatenate([[0], np.cumsum(counts)])
    searched = np.zeros(total, bool)
    searched[pair[1:][(pair[1:] == pair[:-1]) & ~rising]] = True
    plain = np.flatnonzero((counts > 1) & ~searched)
    links, owners, sizes = [np.flatnonzero(np.isin(pair, plain))], [plain], [counts[plain]]
    for i in np.flatnonzero(searched).tolist():
        found = [c for c in chain(at[edges[i]: edges[i + 1]], source_at[edges[i]: edges[i + 1]]) if len(c) > 1]
        if found:
            links.append(np.concatenate(found) + edges[i])
            owners.append(np.full(len(found), i))
            sizes.append(np.array([len(c) for c in found]))
    links = np.concatenate(links)
    return at[links], source_at[links], np.concatenate(owners), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def chains_of(matches: DataFrame) -> DataFrame:
    """doc_key, source_key, at and source_at (arrays) of every chain long enough to be aligned."""
    pairs = matches.groupBy("doc_key", "source_key").agg(F.collect_list(F.struct("at", "source_at")).alias("m")).where(F.size("m") > 1)
    listed = pairs.select("doc_key", "source_key", F.col("m.at").alias("at"), F.col("m.source_at").alias("source_at"))

    def run(batches):
        for batch in batches:
            for part in row_slices(batch):
                (edges, at), (_, source_at) = within(part.column(2)), within(part.column(3))
                pair = np.repeat(np.arange(part.num_rows), np.diff(edges))
                at, source_at, owner, ends = chains_in(at.to_numpy(), source_at.to_numpy(), pair)
                offsets, owner = pa.array(ends, pa.int32()), pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(owner), part.column(1).take(owner), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(source_at, pa.int32()))], names=["doc_key", "source_key", "at", "source_at"])

    return listed.mapInArrow(run, "doc_key long, source_key long, at array<int>, source_at array<int>")


def ends_alike(a: list, b: list) -> tuple[int, int]:
    """Numbers of equal words at the start and, of the others, at the end of both."""
    n, left, right = min(len(a), len(b)), 0, 0
    while left < n and a[left] == b[left]:
        left += 1
    while right < n - left and a[-1 - right] == b[-1 - right]:
        right += 1
    return left, right


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences of words, of which the part between equal ends is short."""
    left, right = ends_alike(a, b)
    a, b = a[left: len(a) - right], b[left: len(b) - right]
    if max(len(a), len(b)) > LONGEST_GAP or not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def extend(a: np.ndarray, b: np.ndarray) -> int:
    """Words at the start of both, place by place, up to where the balance of equal ones is best."""
    n = min(len(a), len(b), BEYOND)
    if n == 0:
        return 0
    balance = np.cumsum(np.where(a[:n] == b[:n], 1, -3))
    best = int(balance.argmax())
    return best + 1 if balance[best] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, at: list[int], source_at: list[int]) -> tuple[int, int, float]:
    """Start, end and similarity of the piece of ``a`` around a chain of seeds."""
    first, last = (at[0], source_at[0]), (at[-1] + K, source_at[-1] + K)
    left = extend(a[: first[0]][::-1], b[: first[1]][::-1])
    right = extend(a[last[0]:], b[last[1]:])
    if last[0] - first[0] == last[1] - first[1] and (a[first[0] - left: last[0] + right] == b[first[1] - left: last[1] + right]).all():
        return first[0] - left, last[0] + right, 1.0
    edits = int((a[first[0] - left: first[0]] != b[first[1] - left: first[1]]).sum()) + int((a[last[0]: last[0] + right] != b[last[1]: last[1] + right]).sum())
    end = (at[0] + K, source_at[0] + K)
    for x, y in zip(at[1:], source_at[1:]):
        edits += distance(a[end[0]: x].tolist(), b[end[1]: y].tolist()) if x >= end[0] and y >= end[1] else abs((x - end[0]) - (y - end[1]))
        end = (x + K, y + K)
    words = last[0] - first[0] + left + right
    return first[0] - left, last[0] + right, 1 - edits / max(words, 1)


def similar_parts(a: np.ndarray, b: np.ndarray, at: list[int], source_at: list[int], similarity: float) -> list[tuple[int, int]]:
    """Starts and ends of the similar pieces of ``a`` around a chain of seeds.

    That is the whole chain if it is similar enough. Otherwise the longest run of its seeds
    that is, without the words that differ before and after it, and the same again with
    the seeds on either side. Runs of seeds shorter than a piece are left out.
    """
    start, stop, alike = align(a, b, at, source_at)
    if alike >= similarity:
        return [(start, stop)] if stop - start >= PIECE else []
    n, x = len(at), np.array(at, np.int64)
    # Equal words directly before and after each seed, and edits between neighbours.
    left, right, edits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left[0] = ends_alike(a[: at[0]][::-1][:BEYOND].tolist(), b[: source_at[0]][::-1][:BEYOND].tolist())[0]
    right[-1] = ends_alike(a[at[-1] + K: at[-1] + K + BEYOND].tolist(), b[source_at[-1] + K: source_at[-1] + K + BEYOND].tolist())[0]
    for i in range(n - 1):
        if at[i + 1] >= at[i] + K and source_at[i + 1] >= source_at[i] + K:
            gap, source_gap = a[at[i] + K: at[i + 1]].tolist(), b[source_at[i] + K: source_at[i + 1]].tolist()
            edits[i + 1] = distance(gap, source_gap)
            if edits[i + 1]:
                right[i], left[i + 1] = ends_alike(gap, source_gap)
        else:
            edits[i + 1] = abs((at[i + 1] - at[i]) - (source_at[i + 1] - source_at[i]))
    found = []
    for first, final in longest_runs(x, left, right, edits, similarity):
        begin, end = int(x[first] - left[first]), int(x[final] + K + right[final])
        wider = align(a, b, at[first: final + 1], source_at[first: final + 1])
        found.append((min(begin, wider[0]), max(end, wider[1])) if wider[2] >= similarity else (begin, end))
    return sorted(found)


def longest_runs(x: np.ndarray, left: np.ndarray, right: np.ndarray, edits: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """First and last seeds of the longest similar run of a chain, and of those on either side of it.

    ``x`` are the places of the seeds, ``left`` and ``right`` the equal words directly
    before and after each, ``edits`` those between a seed and the one before.
    """
    # A run is similar enough if its share of words that may differ is not below its edits.
    share, n = 1 - similarity, len(x)
    balance = share * (x - x[0]) - np.cumsum(edits)
    gains, losses = balance + share * (right + K), balance - share * left
    stops, starts = x + K + right, x - left
    found, waiting = [], [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if low >= high or stops[high - 1] - starts[low] < PIECE:
            continue
        # The best gain from each seed on never rises, so the last one that is enough can be searched for.
        most = np.maximum.accumulate(gains[low:high][::-1])
        last = high - 1 - np.searchsorted(most, losses[low:high] - 1e-9)
        words = np.where(last >= np.arange(low, high), stops[last] - starts[low:high], 0)
        first = low + int(words.argmax())
        if words[first - low] < PIECE:
            continue
        final = int(last[first - low])
        found.append((first, final))
        waiting += [(low, first), (final + 1, high)]
    return found


def extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of places in ``text``, what ``extend`` gives from there in the direction of ``step``, the unequal words in it, and the equal words at its start."""
    reach = np.arange(BEYOND)
    inside = reach < room[:, None]
    way = np.where(inside, reach * step, 0)
    top = max(len(text) - 1, 0)
    alike = inside & (text[np.clip(a[:, None] + way, 0, top)] == text[np.clip(b[:, None] + way, 0, top)])
    balance = np.cumsum(np.where(inside, np.where(alike, 1, -3), -BEYOND), axis=1)
    best = balance.argmax(axis=1)
    words = np.where(balance[np.arange(len(a)), best] > 0, best + 1, 0)
    return words, (~alike & (reach < words[:, None])).sum(axis=1), np.where(alike.all(axis=1), BEYOND, alike.argmin(axis=1))


def edits_between(text: np.ndarray, at: np.ndarray, source_at: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits between each match and the one before, where ``linked``, and the equal words directly before and after each match if there are any edits."""
    edits, left, right = (np.zeros(len(at), np.int64) for _ in range(3))
    on, source_on = np.diff(at, prepend=0), np.diff(source_at, prepend=0)
    edits[linked] = np.abs(on - source_on)[linked]
    both = np.flatnonzero(linked & (on > K) & (source_on > K))
    # Of gaps of one length, those without a differing word need no look.
    level = both[on[both] == source_on[both]]
    sizes = on[level] - K
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    unlike = text[np.repeat(at[level] - sizes, sizes) + inner] != text[np.repeat(source_at[level] - sizes, sizes) + inner]
    differ = np.bincount(np.repeat(np.arange(len(level)), sizes)[unlike], minlength=len(level)) > 0
    for i in np.concatenate([level[differ], both[on[both] != source_on[both]]]).tolist():
        gap, source_gap = text[at[i - 1] + K: at[i]].tolist(), text[source_at[i - 1] + K: source_at[i]].tolist()
        edits[i] = distance(gap, source_gap)
        if edits[i]:
            right[i - 1], left[i] = ends_alike(gap, source_gap)
    return edits, left, right


def similar_pieces(text: np.ndarray, bounds: tuple, at: np.ndarray, source_at: np.ndarray, edges: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the chains, starts and stops (in ``text``) of what ``similar_parts`` gives for each chain.

    ``text`` holds the words of both documents of every chain, ``bounds`` where the first
    begins, where it ends and the second begins, and where that ends; ``at`` and ``source_at`` are
    places in ``text``. The ends of all chains are compared at once, and so are those of all runs.
    """
    begin, middle, end = bounds
    owner = np.repeat(np.arange(len(begin)), np.diff(edges))

    def ends(first: np.ndarray, last: np.ndarray, of: np.ndarray):
        before = extended(text, at[first] - 1, source_at[first] - 1, np.minimum(at[first] - begin[of], source_at[first] - middle[of]), -1)
        after = extended(text, at[last] + K, source_at[last] + K, np.minimum(middle[of] - at[last], end[of] - source_at[last]) - K, 1)
        return before, after

    first, last = edges[:-1], edges[1:] - 1
    (left, left_edits, left_same), (right, right_edits, right_same) = ends(first, last, np.arange(len(begin)))
    words = at[last] + K - at[first] + left + right
    # A chain that is too short even with its ends has no piece.
    long = words >= PIECE
    linked = long[owner]
    linked[first] = False
    edits, before, after = edits_between(text, at, source_at, linked)
    before[first], after[last] = left_same, right_same
    total = np.concatenate([[0], np.cumsum(edits)])
    whole = long & (1 - (total[edges[1:]] - total[first] + left_edits + right_edits) / np.maximum(words, 1) >= similarity)
    runs = []
    for i in np.flatnonzero(long & ~whole).tolist():
        x, y = int(edges[i]), int(edges[i + 1])
        runs += [(i, x + low, x + high) for low, high in longest_runs(at[x:y], before[x:y], after[x:y], edits[x:y], similarity)]
    of, low, high = np.array(runs, np.int64).reshape(-1, 3).T
    (wide, wide_edits, _), (further, further_edits, _) = ends(low, high, of)
    length = at[high] + K - at[low] + wide + further
    enough = 1 - (total[high + 1] - total[low + 1] + wide_edits + further_edits) / np.maximum(length, 1) >= similarity
    starts = at[low] - np.where(enough, np.maximum(before[low], wide), before[low])
    stops = at[high] + K + np.where(enough, np.maximum(after[high], further), after[high])
    chosen = np.flatnonzero(whole)
    return np.concatenate([chosen, of]), np.concatenate([(at[first] - left)[chosen], starts]), np.concatenate([(at[last] + K + right)[chosen], stops])


def stretches(chains: DataFrame, key: str, at: str) -> DataFrame:
    """Chains with the numbers of the stretches of one of their documents that they touch."""
    low = F.greatest(F.element_at(at, 1) - BEYOND, F.lit(0))
    high = F.element_at(at, -1) + K + BEYOND
    return chains.select("chain", F.col(key).alias("key"), F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH))).alias("stretch"))


def aligned(chains: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """doc_key, source_key, start and stop of every piece similar enough and long enough."""
    chains = materialise(chains.withColumn("chain", F.xxhash64("doc_key", "source_key", F.element_at("at", 1), F.element_at("source_at", 1))), "chains")
    asked = stretches(chains, "doc_key", "at").withColumn("side", F.lit(0)).unionByName(stretches(chains, "source_key", "source_at").withColumn("side", F.lit(1)))
    asked = materialise(asked, "asked-stretches")
    wanted = asked.select("key", "stretch").distinct()
    codes = sequences.select(F.col("doc_key").alias("key"), "codes").dropDuplicates(["key"])
    size = 2 * STRETCH
    cut = wanted.join(codes, "key").select("key", "stretch", F.expr(f"substring(codes, cast(stretch * {size} + 1 as int), {size})").alias("part"))
    parts = materialise(cut, "stretches")
    given = asked.join(parts, ["key", "stretch"]).groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("side", "stretch", "part"))).alias("parts"))
    ready = chains.join(given, "chain").select("doc_key", "source_key", "at", "source_at", "parts.side", "parts.stretch", "parts.part")

    def run(batches):
        for batch in batches:
            for part in row_slices(batch):
                (edges, at), (_, source_at), (cut, side), (_, stretch), (_, pieces) = (within(part.column(i)) for i in range(2, 7))
                side, stretch, chain_of = side.to_numpy(), stretch.to_numpy(), np.repeat(np.arange(part.num_rows), np.diff(edges))
                ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset: pieces.offset + len(pieces) + 1].astype(np.int64)
                text, ends = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0]: ends[-1]].view("<u2"), (ends - ends[0]) // 2
                source = cut[:-1] + np.add.reduceat(side == 0, cut[:-1])
                begin, middle, end = ends[cut[:-1]], ends[source], ends[cut[1:]]
                base, source_base = begin - stretch[cut[:-1]] * STRETCH, middle - stretch[source] * STRETCH
                owners, starts, stops = similar_pieces(
                    text, (begin, middle, end), at.to_numpy() + base[chain_of], source_at.to_numpy() + source_base[chain_of], edges, similarity)
                shift, owners = base[owners], pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(owners), part.column(1).take(owners), pa.array(starts - shift, pa.int32()), pa.array(stops - shift, pa.int32())], names=["doc_key", "source_key", "start", "stop"])

    return ready.mapInArrow(run, "doc_key long, source_key long, start int, stop int")


def joined_pieces(pieces: DataFrame, min_words: int) -> DataFrame:
    """doc_key, start, stop and sources of every passage: touching pieces, long enough together."""
    inside = Window.partitionBy("doc_key").orderBy("start", "stop")
    reached = F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(F.col("start") <= reached + TOUCH, 0).otherwise(1))
    numbered = marked.withColumn("passage", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_key", "passage").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("source_id").alias("sources"),
    ).where(F.col("stop") - F.col("start") >= min_words).select("doc_key", "start", "stop", F.array_sort("sources").alias("sources"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words and passages of every row.

    A passage is a struct of start and stop (words, stop exclusive) and the ids of the
    earlier documents that its pieces come from.
    """
    sequences = materialise(seeds_of(docs, text, doc_id), "seeds")
    total = sequences.agg(F.sum(F.size("seeds"))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK))
    matches = materialise(matches_of(deal_seeds(sequences, blocks)), "seed-matches")
    pieces = aligned(chains_of(matches), sequences, similarity)
    names = sequences.select(F.col("doc_key").alias("source_key"), F.col("doc_id").alias("source_id")).dropDuplicates(["source_key"])
    passages = joined_pieces(materialise(pieces.join(names, "source_key"), "pieces"), min_words)
    listed = passages.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "sources"))).alias("passages"))
    return sequences.select("doc_id", "doc_key", "n_words").join(listed, "doc_key", "left").select(
        "doc_id", "n_words", F.coalesce("passages", F.array().cast("array<struct<start:int,stop:int,sources:array<bigint>>>")).alias("passages"))
