"""Secret scans by grammar inference.

Three patterns find the plain cases: assignments, access keys and long hexadecimal runs.
Their values are labelled credentials. For each kind a prefix tree of these values is
built and states with statistically equal continuations are merged (Hoeffding bound),
which leaves a probabilistic automaton of the format; another one is learned from
tokens that no pattern matched. Every token of every text is then scored by how much
better a credential format explains it than ordinary text does, and tokens beyond the
threshold are added as spans of kind ``format``. Pattern matches always stay. Of a value
longer than LEARN_LENGTH symbols the rest is not learned; scoring takes whole tokens.

Null texts count as empty. A kind without any labelled value has no automaton; without
any, nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField

from plotwise.llm.batches import append_columns, slices
from plotwise.llm.spans import SPANS, free_of, in_order
from plotwise.session import materialise

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "format")
#: Labelled values of each kind, and ordinary tokens, that the automata are learned from.
SAMPLE = 3000
#: Symbols of a value used for learning. Of a longer value nothing is learned about its end.
LEARN_LENGTH = 64
#: Chance for a merge test to keep equal states apart.
ALPHA = 0.05
#: Share of credentials among tokens assumed before looking, and certainty asked for.
PRIOR, CERTAIN = 1e-5, 0.99

# The patterns of the plain cases.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
SYMBOL = np.zeros(128, np.int64)
SYMBOL[[ord(x) for x in ALPHABET]] = np.arange(len(ALPHABET))
N_SYMBOLS = len(ALPHABET)
#: Log probability of a symbol where an automaton has no path for it.
ANY_SYMBOL, OFF_FORMAT = -float(np.log(N_SYMBOLS + 1)), -20.0


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Matches of the three patterns.

    A run matched by ``[0-9a-f]+`` or ``AKIA[A-Z0-9]+`` is maximal, so asking for the
    length in the pattern drops just the runs that are too short. An assignment that
    is too short consumes its text, hence the test after the match.
    """
    found = [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    return found


def labelled(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(kind, value) of the credentials of a text, and its other tokens."""
    values = [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    values += [("access", m) for m in ACCESS.findall(text)]
    values += [("hex", m) for m in HEX.findall(text)]
    known = [v for _, v in values]
    tokens = TOKEN.findall(text)
    if known:
        tokens = [t for t in tokens if not any(v in t for v in known)]
    return values, tokens


def symbols(token: str) -> list[int]:
    return SYMBOL[np.frombuffer(token.encode("ascii"), np.uint8)].tolist()


@dataclass
class Automaton:
    """States with the next state and the log probability of each symbol and of the end.

    The last state takes what was never seen and keeps it. There every symbol is equally
    likely in ordinary text, and next to impossible in a credential format.
    """

    step: np.ndarray
    log_step: np.ndarray
    log_end: np.ndarray

    def score(self, tokens: list[str]) -> np.ndarray:
        """Log likelihood of each token, all tokens one symbol at a time."""
        length = np.array([len(t) for t in tokens], np.int64)
        order = np.argsort(-length, kind="stable")
        code = SYMBOL[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
        first = (np.cumsum(length) - length)[order]
        length = length[order]
        state = np.zeros(len(tokens), np.int64)
        total = np.zeros(len(tokens))
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))  # tokens longer than i
            s = code[first[:n] + i]
            total[:n] += self.log_step[state[:n], s]
            state[:n] = self.step[state[:n], s]
        total += self.log_end[state]
        out = np.empty(len(tokens))
        out[order] = total
        return out


@dataclass
class PrefixTree:
    """Counts of values that pass, end and go on with each symbol, by state."""

    passed: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    going: list[dict[int, int]] = field(default_factory=lambda: [{}])
    child: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def add(self, value: list[int], times: int = 1, ends: bool = True) -> None:
        """Count a value; of one that was cut, what follows its last symbol is unknown."""
        at = 0
        self.passed[0] += times
        for i, s in enumerate(value, 1):
            self.going[at][s] = self.going[at].get(s, 0) + times
            if s not in self.child[at]:
                self.child[at][s] = len(self.passed)
                self.passed.append(0)
                self.ended.append(0)
                self.going.append({})
                self.child.append({})
            at = self.child[at][s]
            if ends or i < len(value):
                self.passed[at] += times
        if ends:
            self.ended[at] += times

    def differ(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > np.sqrt(0.5 * np.log(2 / ALPHA)) * (n ** -0.5 + m ** -0.5)

    def alike(self, a: int, b: int) -> bool:
        """Whether the continuations of two states can come from one distribution."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if self.differ(self.ended[a], n, self.ended[b], m):
                return False
            for s in self.going[a].keys() | self.going[b].keys():
                if self.differ(self.going[a].get(s, 0), n, self.going[b].get(s, 0), m):
                    return False
                if s in self.child[a] and s in self.child[b]:
                    todo.append((self.child[a][s], self.child[b][s]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the counts below ``b``, which is a tree, to those below ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for s, n in self.going[b].items():
                self.going[a][s] = self.going[a].get(s, 0) + n
                if s in self.child[a]:
                    todo.append((self.child[a][s], self.child[b][s]))
                else:
                    self.child[a][s] = self.child[b][s]

    def merged(self, unseen: float) -> Automaton:
        """Visit states from the start; each joins a kept state that it is like, or is kept.

        The latest kept state is tried first: a rare state is like any other, and the
        one just before it is the likeliest to share its future.
        """
        kept, i = [0], 0
        while i < len(kept):
            state = kept[i]
            for s in sorted(self.child[state]):
                target = self.child[state][s]
                if target in kept:
                    continue
                twin = next((k for k in reversed(kept) if self.alike(k, target)), None)
                if twin is None:
                    kept.append(target)
                else:
                    self.child[state][s] = twin
                    self.fold(twin, target)
                    i = -1  # the twin may have gained symbols
                    break
            i += 1
        return self.automaton(kept, unseen)

    def automaton(self, kept: list[int], unseen: float) -> Automaton:
        place = {k: i for i, k in enumerate(kept)}
        lost = len(kept)
        step = np.full((lost + 1, N_SYMBOLS), lost, np.int64)
        log_step = np.full((lost + 1, N_SYMBOLS), unseen)
        log_end = np.full(lost + 1, unseen)
        for k, i in place.items():
            total = self.passed[k] + 0.1 * (N_SYMBOLS + 1)
            for s in range(N_SYMBOLS):
                log_step[i, s] = np.log((self.going[k].get(s, 0) + 0.1) / total)
                step[i, s] = place.get(self.child[k].get(s, -1), lost)
            log_end[i] = np.log((self.ended[k] + 0.1) / total)
        return Automaton(step, log_step, log_end)


def learn(values: list[str], unseen: float) -> Automaton:
    """The automaton of some values; ``unseen`` is the log probability of a symbol off all paths."""
    tree = PrefixTree()
    for value in sorted(values):
        tree.add(symbols(value[:LEARN_LENGTH]), ends=len(value) <= LEARN_LENGTH)
    return tree.merged(unseen)


class Smallest:
    """The ``size`` distinct values of smallest crc32 among those offered, ties by value."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.bound = size, set(), 1 << 32

    def offer(self, values: Iterable[str]) -> None:
        for value in values:
            rank = zlib.crc32(value.encode())
            if rank <= self.bound:
                self.held.add((rank, value))
        if len(self.held) > 2 * self.size:
            self.held = set(sorted(self.held)[: self.size])
            self.bound = max(self.held)[0]

    def values(self) -> list[str]:
        return [value for _, value in sorted(self.held)[: self.size]]


def learn_formats(docs: DataFrame, text: str = "text") -> dict[str, Automaton]:
    """An automaton for each kind of credential found in ``docs``, and for ``ordinary`` tokens.

    Of each kind the SAMPLE distinct values of smallest crc32 are learned from, here. Each
    task passes on the SAMPLE smallest of its own rows, among which those of all rows are,
    so what is shuffled grows with the tasks and nothing depends on the size of a table.
    """
    def gather(batches):
        pools = {kind: Smallest(SAMPLE) for kind in (*BASE_KINDS, "ordinary")}
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for t in texts:
                    values, tokens = labelled(t or "")
                    for kind, value in values:
                        pools[kind].offer([value])
                    pools["ordinary"].offer(set(tokens))
        for kind, pool in pools.items():
            values = pool.values()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values), pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    seen = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(gather, "kind string, value string")
    pool = materialise(seen.distinct(), "secret-values")
    models = {}
    for kind in (*BASE_KINDS, "ordinary"):
        rows = pool.where(F.col("kind") == kind).orderBy(F.crc32(F.col("value").cast("binary")), "value").limit(SAMPLE).collect()
        if rows:
            models[kind] = learn([r["value"] for r in rows], ANY_SYMBOL if kind == "ordinary" else OFF_FORMAT)
    return models


def scan(docs: DataFrame, models: dict[str, Automaton], text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: pattern matches, and tokens that look like a credential.

    The score of an added span is the probability that it is one. A column named
    ``spans`` is replaced.
    """
    plain = {k: (m.step, m.log_step, m.log_end) for k, m in models.items()}

    def make():
        formats = {k: Automaton(*m) for k, m in plain.items()}
        ordinary = formats.pop("ordinary", None)
        odds = np.log(PRIOR / (1 - PRIOR))
        asked = np.log(CERTAIN / (1 - CERTAIN))

        def compute(texts):
            found = [base_spans(t or "") for t in texts]
            if not formats or ordinary is None:
                return [[in_order(f, KINDS) for f in found]]
            tokens = [TOKEN.findall(t or "") for t in texts]
            distinct = list({x for ts in tokens for x in ts})
            best = np.max([m.score(distinct) for m in formats.values()], axis=0) if distinct else np.zeros(0)
            gain = best - ordinary.score(distinct) + odds if distinct else best
            likely = {distinct[i]: float(1 / (1 + np.exp(-gain[i]))) for i in np.flatnonzero(gain > asked)}
            for i, ts in enumerate(tokens):
                if likely and not likely.keys().isdisjoint(ts):
                    taken = list(found[i])
                    found[i] += [("format", *m.span(), likely[m[0]]) for m in TOKEN.finditer(texts[i])
                                 if m[0] in likely and free_of(taken, *m.span())]
            return [[in_order(f, KINDS) for f in found]]
        return compute

    return append_columns(docs, text, [StructField("spans", SPANS)], make)
