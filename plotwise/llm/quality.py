"""Quality of a text by histogram gradient-boosted trees over its statistics.

A text becomes a row of statistics (``STATISTICS``: shares of kinds of characters, entropy,
lengths and repeats of words and lines, how well it packs). The trees are grown on labelled
rows in numpy: every statistic is cut into bins at quantiles, gradients of the logistic loss
are summed per bin, and all nodes of a level take their best split from those sums. Trees
are full to ``DEPTH`` and flattened into three arrays, so that scoring a batch walks all
trees of all rows one level at a time, without branches.

Labels are fitted on at most ``SAMPLE`` labelled ids, those of smallest hash; everything
else covers all rows, and whole texts.

Null and empty texts are the row of zeros and get a score like others. Labels that are null
or not 0 or 1, and labels without a document, are ignored; of documents that repeat an id
the one with the smallest statistics is learned from. Without any label every score is 0.5.
Repeated rows are scored alike; columns of the input that have the name of a new one are
replaced.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from plotwise.llm.batches import append_columns

#: Labelled ids that the trees are grown on.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
#: Penalty on leaf values, and the least sum of second derivatives on a side of a split.
PENALTY, LEAST = 1.0, 1.0

STATISTICS = (
    "bytes", "lower", "upper", "digits", "blanks", "breaks", "stops", "marks", "other_bytes", "entropy", "commonest_byte",
    "words", "word_length", "longest_word", "distinct_words", "commonest_word", "words_twice", "word_ends",
    "lines", "line_length", "distinct_lines", "lines_twice", "packed",
)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def byte_kinds() -> np.ndarray:
    """Which of lower, upper, digits, blanks, breaks, stops, marks, other_bytes each byte counts for."""
    kinds = np.full(256, 7)
    kinds[:128] = 6
    for k, found in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".,;:?!")):
        kinds[list(found)] = k
    return kinds


KINDS = byte_kinds()
LETTER = np.isin(KINDS, (0, 1, 7))
SPACE = np.isin(KINDS, (3, 4))


def repeats(items: list) -> tuple[float, float, float]:
    """Shares of distinct items, of the commonest one, and of those equal to the one before."""
    n = len(items)
    counts = Counter(items)
    return len(counts) / n, max(counts.values()) / n, sum(map(operator.eq, items, items[1:])) / n


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for a text."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(data, np.uint8)
    histogram = np.bincount(codes, minlength=256)
    shares = np.bincount(KINDS, histogram, 8) / n
    present = histogram[histogram > 0] / n
    words = data.split()
    space = SPACE[codes]
    last = np.append(~space[:-1] & space[1:], ~space[-1])
    ends = int(LETTER[codes[last]].sum())
    lines = data.split(b"\n")
    per_word = repeats(words) if words else (0.0, 0.0, 0.0)
    per_line = repeats(lines)
    many = max(1, len(words))
    return [
        np.log1p(n), *shares, float(-(present * np.log2(present)).sum()), float(present.max()),
        np.log1p(len(words)), sum(map(len, words)) / many, np.log1p(max(map(len, words), default=0)), *per_word, ends / many,
        np.log1p(len(lines)), np.log1p(n / len(lines)), per_line[0], per_line[2], len(zlib.compress(data, 1)) / (n + 32),
    ]


def table(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


@dataclass
class Trees:
    """``feature`` and ``cut`` hold the inner nodes of each tree level by level, ``leaf`` its leaves from left to right."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, rows = np.arange(len(self.leaf)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def level_splits(binned: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best statistic and last bin of the left side for each node; a node without a gain sends all rows left."""
    rows, features = binned.shape
    slot = ((node[:, None] * features + np.arange(features)) * BINS + binned).ravel()
    size = nodes * features * BINS
    shape = nodes, features, BINS
    g = np.bincount(slot, np.repeat(gradient, features), size).reshape(shape).cumsum(axis=2)
    h = np.bincount(slot, np.repeat(weight, features), size).reshape(shape).cumsum(axis=2)
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
    gain[(h < LEAST) | (all_h - h < LEAST)] = -np.inf
    best = gain.reshape(nodes, -1).argmax(axis=1)
    at = best % BINS
    at[gain.reshape(nodes, -1)[np.arange(nodes), best] <= 1e-9] = BINS - 1
    return best // BINS, at


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the logistic loss of labels 0 and 1."""
    inner = 2**DEPTH - 1
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    # Upper ends of the bins but the last, which is open.
    ends = np.quantile(x, np.arange(1, BINS) / BINS, axis=0, method="lower")
    binned = np.stack([np.searchsorted(ends[:, f], x[:, f]) for f in range(x.shape[1])], axis=1)
    tops = np.vstack([ends, np.full(x.shape[1], np.inf)])
    margin = np.full(len(y), base)
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.zeros((TREES, inner)), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            best, at = level_splits(binned, node, nodes, gradient, weight)
            feature[t, first: first + nodes], cut[t, first: first + nodes] = best, tops[at, best]
            node = 2 * node + (binned[np.arange(len(y)), best[node]] > at[node])
        leaves = inner + 1
        leaf[t] = RATE * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + PENALTY)
        margin += leaf[t, node]
    return Trees(base, feature, cut, leaf)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Trees grown on labelled texts that are not held out."""
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    # At most ``sample`` pairs of id and label, which is what is broadcast.
    chosen = named.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    fields = [StructField("_values", ArrayType(DoubleType()))]
    rows = append_columns(texts, "_text", fields, lambda: lambda batch: [table(batch).tolist()])
    learned = rows.groupBy("_id", "_label").agg(F.min("_values").alias("_values")).orderBy("_id", "_label").collect()
    x = np.array([r["_values"] for r in learned], np.float64).reshape(len(learned), len(STATISTICS))
    return grow(x, np.array([r["_label"] for r in learned], np.float64))


def score(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 if score is at least 0.5, else 0)."""
    scored = append_columns(docs, text, [StructField("score", DoubleType())], lambda: lambda batch: [trees.scores(table(batch)).tolist()])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
