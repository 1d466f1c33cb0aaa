"""BPE encoding and decoding by speculation and verification.

A word is first cut by greedy longest match. A cut is the BPE result exactly when each
pair of neighbours is: no merge across their border would have come before the merges
that built them. That test runs on arrays over the distinct pairs of a batch; only words
with a failing pair go through the merges one by one.

Null texts have no tokens; an empty text has none and decodes to the empty string.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField

from plotwise.llm.batches import append_columns

#: Stands for the end-of-word suffix, so that it is one character long.
END = "\x00"
#: Words remembered in a worker; the memory is emptied when full.
REMEMBERED = 400_000
NEVER = np.int64(1 << 40)
NONE = (1 << 40, -1)
#: Letters up to which a scan for the next merge is cheaper than a heap.
SHORT = 40

# The white space and the word pattern of the vocabulary file.
SPACES = "\t-\r \x85\xa0  -     　"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+"

SPACE_RUN = re.compile(f"[{SPACES}]+")
PIECES = regex.compile(PIECE)
#: Python's own split() also splits at these four, which are not white space here.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def joined(a: int, b: int) -> int:
    return a << 32 | b


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a BPE vocabulary file with word ends, ready for array work."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        bpe = model["model"]
        suffix = bpe["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*bpe["vocab"].values(), *self.specials.values()])
        self.names = np.full(size, "", dtype=object)
        for name, i in [*bpe["vocab"].items(), *self.specials.items()]:
            self.names[i] = name
        inner = {(n[: -len(suffix)] + END if n.endswith(suffix) and n != suffix else n): i for n, i in bpe["vocab"].items()}
        self.rank = np.full(size, -1, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        pairs = []
        vocab = bpe["vocab"]
        for rank, (a, b) in enumerate(bpe["merges"]):
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
            pairs.append((a << 32 | b, rank, whole))
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs], np.int64)
        self.merge = {k: (r, w) for k, r, w in pairs}
        # A token takes part in the greedy cut only if the merges lead to it.
        sound = self.rank < 0
        for i in np.argsort(self.rank, kind="stable"):
            if self.rank[i] >= 0:
                sound[i] = sound[self.left[i]] and sound[self.right[i]]
        made = np.flatnonzero(sound & (self.rank >= 0))
        sound[made] &= self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in np.argsort(self.rank, kind="stable"):
            if self.rank[i] >= 0:
                sound[i] = sound[i] and sound[self.left[i]] and sound[self.right[i]]
        self.symbol = {n: i for n, i in inner.items() if self.rank[i] < 0}
        self.greedy = {n: i for n, i in inner.items() if sound[i]}
        self.letters = {b: ord(x) for b, x in enumerate(byte_letters()) if ord(x) != b}
        self.width = np.zeros(size, np.int64)
        for n, i in inner.items():
            self.width[i] = len(n)
        self.finder = None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of tokens stays a pair when its joined text is encoded.

        The latest merge of either side is undone step by step; on the way, a merge
        across the border that ranks before the merges undone so far would have won.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            key = a[at] << 32 | b[at]
            place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            across = np.where(self.pair_key[place] == key, self.pair_rank[place], NEVER)
            lost = across < limit[at]
            good[at[lost]] = False
            ra, rb = self.rank[a[at]], self.rank[b[at]]
            go = ~lost & ((ra >= 0) | (rb >= 0))
            from_left = at[go & (ra > rb)]
            from_right = at[go & (ra <= rb)]
            limit[from_left] = self.rank[a[from_left]]
            a[from_left] = self.right[a[from_left]]
            # On the right side an equal merge across the border comes first: it lies to the left.
            limit[from_right] = self.rank[b[from_right]] + 1
            b[from_right] = self.left[b[from_right]]
            at = at[go]
        return good

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: tokens, the word of each, stuck words."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for name, i in self.greedy.items():
                self.finder.add_word(name, i)
            self.finder.make_automaton()
        found = np.array(list(self.finder.iter_long("".join(words))), np.int64).reshape(-1, 2)
        stop = np.cumsum([len(w) for w in words])
        owner = np.searchsorted(stop, found[:, 0], side="right")
        covered = np.bincount(owner, weights=self.width[found[:, 1]], minlength=len(words))
        return found[:, 1], owner, covered != np.diff(stop, prepend=0)

    def merged(self, word: str) -> list[int]:
        """The merges in order of rank, then from the left."""
        symbol, merge = self.symbol, self.merge
        ids: list = [symbol[x] for x in word[:-2]]
        ids.append(symbol[word[-2:]])
        if len(ids) > SHORT:
            return self.merged_long(ids)
        found = [merge.get(k, NONE) for k in map(joined, ids, ids[1:])]
        while found and (best := min(found)) is not NONE:
            i = found.index(best)
            ids[i: i + 2] = best[1:]
            del found[i]
            if i:
                found[i - 1] = merge.get(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(found):
                found[i] = merge.get(ids[i] << 32 | ids[i + 1], NONE)
        return ids

    def merged_long(self, ids: list) -> list[int]:
        """As ``merged``, through a heap of neighbours."""
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = [(*self.merge[k], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (k := ids[i] << 32 | ids[i + 1]) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, whole, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = whole, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := ids[x] << 32 | ids[y]) in self.merge:
                    heapq.heappush(heap, (*self.merge[k], x, ids[x], ids[y]))
        return [i for i in ids if i is not None]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, a word being byte letters with END behind."""
        tokens, owner, failed = self.propose(words)
        inside = owner[1:] == owner[:-1]
        pairs, where = np.unique((tokens[:-1] << 32 | tokens[1:])[inside], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]
        failed[owner[1:][inside][~fits]] = True
        flat = tokens.astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        out = [flat[a:b] for a, b in zip([0, *stop], stop)]
        for i in np.flatnonzero(failed).tolist():
            ids = self.merged(words[i])
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks of text without white space."""
        letters = self.letters
        spelled: dict[str, list[str]] = {}
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                spelled[chunk] = [chunk + END]
            else:
                spelled[chunk] = [p.encode("utf-8").decode("latin-1").translate(letters) + END for p in PIECES.findall(chunk)]
        ids = self.words
        if fresh := list({w for ws in spelled.values() for w in ws if w not in ids}):
            ids.update(zip(fresh, self.encode_words(fresh)))
        for chunk, ws in spelled.items():
            self.known[chunk] = b"".join([ids[w] for w in ws])

    def segments(self, text: str) -> list:
        """Chunks without white space, in order; a special token is its id in bytes."""
        out: list = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += chunks_of(text[at: m.start()])
            out.append(self.specials[m[0]].to_bytes(4, "little"))
            at = m.end()
        return out + chunks_of(text[at:]) if at else chunks_of(text)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [None if t is None else self.segments(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.words.clear()
        known = self.known
        if fresh := {c for s in cut if s for c in s if c not in known and type(c) is str}:
            self.learn(list(fresh))
        return [None if s is None else b"".join([known[c] if type(c) is str else c for c in s]) for s in cut]

    def decode(self, ids: bytes | None) -> str | None:
        """Token names joined by blanks: the file names no decoder."""
        return None if ids is None else " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


def chunks_of(text: str) -> list[str]:
    """Composed and in lower case, split at white space."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # Lower case goes letter by letter, so a final sigma is an ordinary one.
    text = text.replace("Σ", "σ").lower()
    if ODD_SPACE.search(text):
        return [c for c in SPACE_RUN.split(text) if c]
    return text.split()


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    ``vocabulary`` is the path of the file; it is read once, here, and sent to the
    executors (its size does not depend on the data). Rows keep their order and number,
    repeated rows included; existing columns of the two names are replaced.
    """
    # Plain state is sent, not the object, so that workers need not import this module.
    shared = df.sparkSession.sparkContext.broadcast(vars(Vocabulary(vocabulary)))

    def make():
        v = Vocabulary.__new__(Vocabulary)
        v.__dict__ = shared.value  # what a worker has learned stays for its next task

        def compute(texts):
            ids = v.encode(texts)
            return [ids, [v.decode(i) for i in ids]]
        return compute

    fields = [StructField("token_ids", BinaryType()), StructField("decoded", StringType())]
    return append_columns(df, text, fields, make)
