"""Language of a text by a byte convolutional network.

Filters of several widths slide over windows of bytes; the strongest response of each
filter in a window feeds a softmax over the languages. The network is trained in numpy on
windows of labelled texts. A text is cut into consecutive windows of fixed length, all of
them are scored, and their probabilities are averaged, weighted by their bytes.

A null text, or one without a letter, is ``und`` with score 0; so is every text if no
language was learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from plotwise.llm.batches import append_columns

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Texts of each language that the network is trained on, and windows taken from each.
SAMPLE = 400
PLACES = 3
ROUNDS, BATCH, RATE = 12, 64, 0.01
#: Windows scored together.
TOGETHER = 64


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """``filters[w][k]`` holds, for each byte value, what byte k adds to the filters of width w."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    base: np.ndarray

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """For each width, the response of its filters at each place of each window."""
        out = []
        for w, table in self.filters.items():
            n = windows.shape[1] - w + 1
            out.append(sum(table[k][windows[:, k: k + n]] for k in range(w)))
        return out

    def pair_tables(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """What two neighbouring bytes add: at the start of all filters, then pair by pair of each width."""
        pair = {w: [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w - 1, 2)] for w, t in self.filters.items()}
        return np.concatenate([p[0] for p in pair.values()], axis=1), {w: p[1:] for w, p in pair.items()}

    def strongest(self, windows: np.ndarray, tables: tuple) -> np.ndarray:
        """The largest of ``responses`` over all places, with two bytes in one lookup."""
        start, rest = tables
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        begun = start[pairs]
        out = []
        for i, (w, table) in enumerate(self.filters.items()):
            n = windows.shape[1] - w + 1
            total = begun[:, :n, i * FILTERS: (i + 1) * FILTERS]
            if w > 2:
                total = total.copy()
            for k, more in enumerate(rest[w]):
                total += more[pairs[:, 2 * k + 2: 2 * k + 2 + n]]
            if w % 2:
                total += table[w - 1][windows[:, w - 1: w - 1 + n]]
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray, tables: tuple) -> np.ndarray:
        return softmax(np.maximum(self.strongest(windows, tables) + self.bias, 0) @ self.weights + self.base)

    def predict(self, texts: list[str | None], tables: tuple) -> tuple[list[str], list[float]]:
        """Language and score of each text, over all its bytes."""
        rows, owner, size = [], [], []
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                data = np.frombuffer(text.encode("utf-8"), np.uint8)
                cut = np.zeros((-(-len(data) // WINDOW), WINDOW), np.uint8)
                cut.reshape(-1)[: len(data)] = data
                rows.append(cut)
                owner += [i] * len(cut)
                size += [WINDOW] * (len(cut) - 1) + [len(data) - WINDOW * (len(cut) - 1)]
        if not rows or not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        windows = np.concatenate(rows)
        each = np.concatenate([self.probabilities(windows[i: i + TOGETHER], tables) for i in range(0, len(windows), TOGETHER)])
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owner, each * np.array(size)[:, None])
        weight = np.bincount(owner, weights=size, minlength=len(texts))
        share = total / np.maximum(weight, 1)[:, None]
        best = share.argmax(axis=1)
        names = [self.languages[b] if w else UNKNOWN for b, w in zip(best, weight)]
        return names, [float(min(1.0, share[i, b])) if weight[i] else 0.0 for i, b in enumerate(best)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def as_window(data: bytes) -> np.ndarray:
    out = np.zeros(WINDOW, np.uint8)
    data = data[:WINDOW]
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> Network:
    """Gradient descent (Adam) on (language, bytes); half of the windows are cut short at random."""
    languages = sorted({s[0] for s in samples})
    rng = np.random.default_rng(seed)
    wide = FILTERS * len(WIDTHS)
    net = Network(
        languages, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(wide, np.float32), rng.normal(0, 0.3, (wide, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    if len(languages) < 2:
        return net
    full = np.stack([as_window(s[1]) for s in samples])
    length = np.array([max(1, min(WINDOW, len(s[1]))) for s in samples])
    label = np.array([languages.index(s[0]) for s in samples])
    parts = [*net.filters.values(), net.bias, net.weights, net.base]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(ROUNDS):
        keep = np.where(rng.random(len(full)) < 0.5, length, rng.integers(np.minimum(8, length), length + 1))
        windows = np.where(np.arange(WINDOW) < keep[:, None], full, 0)
        order = rng.permutation(len(full))
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            x, y = windows[rows], label[rows]
            responses = net.responses(x)
            place = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, p[:, None, :], 1)[:, 0] for r, p in zip(responses, place)], axis=1) + net.bias
            hidden = np.maximum(pooled, 0)
            slope = softmax(hidden @ net.weights + net.base)
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            back = slope @ net.weights.T * (pooled > 0)
            changes = []
            for i, (w, table) in enumerate(net.filters.items()):
                g = np.zeros_like(table)
                part = back[:, i * FILTERS: (i + 1) * FILTERS]
                f = np.arange(FILTERS)
                for k in range(w):
                    # Only the place of the strongest response learns.
                    np.add.at(g[k], (np.take_along_axis(x, place[i] + k, 1), f[None, :]), part)
                changes.append(g)
            changes += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, a, b in zip(parts, changes, first, second):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= (RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(p.dtype)
    return net


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network:
    """The network, trained on at most SAMPLE texts of each language with PLACES windows each.

    Only texts with a language whose id is not held out are used. The sample is the
    texts whose hash is smallest; counts of the languages set how small it has to be, so
    that little more than the sample leaves the executors.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * (SAMPLE + 20) / n))])
    draw = F.xxhash64(F.col(doc_id), F.lit("language"))
    size = F.length(text)
    places = [F.substring(F.col(text), F.greatest(F.lit(1), (size - WINDOW) * i / (PLACES - 1)).cast("int") + F.lit(int(i > 0)), F.lit(WINDOW)) for i in range(PLACES)]
    rows = (
        known.withColumn("_draw", draw)
        .where((F.col("_draw").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < share[F.col(lang)])
        .select(F.col(lang).alias("lang"), "_draw", F.array(*places).alias("windows"))
        .limit(4 * SAMPLE * len(counts)).collect()
    )
    chosen: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["_draw"], r["windows"])):
        chosen.setdefault(r["lang"], []).append(r["windows"])
    # A text that fits into one window gives one sample.
    return train([(k, w.encode("utf-8")) for k, texts in chosen.items() for ws in texts[:SAMPLE] for w in dict.fromkeys(ws) if w])


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    plain = (net.languages, net.filters, net.bias, net.weights, net.base)

    def make():
        model = Network(*plain)
        tables = model.pair_tables()

        def compute(texts):
            return list(model.predict(texts, tables))
        return compute

    return append_columns(docs, text, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make, tidy=True)
