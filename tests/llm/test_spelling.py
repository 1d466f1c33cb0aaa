import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from plotwise.llm import spelling
from plotwise.llm.queries import QUERIES, dropped_letter

LETTERS = "abcéÿß"


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts):
    """Forms by trying every pair of words that share a word with one letter left out."""
    by_rest = defaultdict(set)
    for w in counts:
        for rest in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by_rest[rest].add(w)
    found = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            found[a] |= {b for b in group if b not in found[a] and near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(found[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(found[w]), counts[form[w]] if form[w] else None)
    return out


def as_dict(rows):
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_words_of_random_letters(spark):
    rng = random.Random(4)
    for crowded in (2, 7, spelling.CROWDED):
        counts = {}
        for _ in range(900):
            counts["".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 8)))] = rng.choice([3, 4, 6, 9, 20, 80])
        counts |= {"a" * k: 3 ** k for k in range(5, 12)}
        out = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), crowded=crowded)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert as_dict(out.collect()) == expected(counts)


def test_a_list_of_one_prefix_is_cut_further(spark):
    """Thousands of words that share their first half, and as many that share the last."""
    counts = {f"common{a}{b}{c}": 3 + i % 5 for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefgh")}
    counts |= {f"{w[6:]}common": n for w, n in counts.items()}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), crowded=50)
    assert as_dict(got.collect()) == expected(counts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=2, max_size=5), min_size=1, max_size=30, unique=True), st.integers(0, 3), st.integers(1, 4))
def test_scan_finds_what_pairs_find(words, low, wide):
    words = sorted(words)
    for size in {len(w) for w in words}:
        group = [w for w in words if len(w) in (size, size + 1)]
        n = len(group)
        full = [np.full(n, v, np.int64) for v in (0, size, low, low + wide)]
        i, j = spelling.scan(group, *full)

        def place(a, b):
            return next((k for k in range(size) if a[k] != b[k]), size)

        wanted = {(a, b) for a in range(n) for b in range(n) if len(group[b]) == size and near(group[a], group[b])
                  and (len(group[a]) > size or a < b) and low <= place(group[a], group[b]) < low + wide}
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(wanted)


def test_odd_rows(spark):
    long = "x" * 30_000
    rows = [(1, None), (2, ""), (None, "Straße straße STRASSE strasse strasse"), (3, f"{long} {long}y {long} {long} 1234"),
            (4, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ"), (4, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ"), (5, "naïve naïve Naïve naive naive naive naive naive naive naive")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n long, word string")
    out = spelling.spelling_variants(spelling.count_words(docs, dropped_letter))
    got = as_dict(out.collect())
    assert got == expected(counted(rows)) and got["naïve"][0] == "naive"
    assert spelling.spelling_variants(spelling.count_words(docs.limit(0))).collect() == []
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.count_words(nothing, dropped_letter)).count() == 0


def test_small_hand_overs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 60)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rows = [(i, f"common commons comon word{'s' * (i % 7)} " * 3) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.count_words(docs, dropped_letter)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(rows)
    assert as_dict(spelling.spelling_variants(words).collect()) == expected(counted(rows))


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    wanted = expected(counted([(d["doc_id"], d["text"]) for d in docs]))
    assert as_dict(QUERIES["op13_spelling"](spark, sf).collect()) == wanted
