import random

import numpy as np

from plotwise.llm import passages
from plotwise.llm.queries import QUERIES


def best_score(at, source_at):
    """The best chain by comparing every match with every earlier one."""
    order = sorted(range(len(at)), key=lambda i: (at[i], source_at[i]))
    score = {}
    for i in order:
        score[i] = passages.K
        for j in order:
            if at[j] < at[i] and source_at[j] < source_at[i]:
                a, b = int(at[i] - at[j]), int(source_at[i] - source_at[j])
                gain = score[j] - passages.GAP * (a + b)
                if gain > 0:
                    score[i] = max(score[i], min(passages.K, a, b) + gain)
    return max(score.values())


def score_of(links, at, source_at):
    total = passages.K
    for j, i in zip(links, links[1:]):
        a, b = int(at[i] - at[j]), int(source_at[i] - source_at[j])
        assert a > 0 and b > 0
        total += min(passages.K, a, b) - passages.GAP * (a + b)
    return total


def test_chains_keep_order_and_are_about_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        at, source_at = rng.integers(0, 120, n), rng.integers(0, 120, n)
        chains = passages.chain(at, source_at)
        assert sorted(i for c in chains for i in c) == list(range(n))
        scores = [score_of(c, at, source_at) for c in chains]
        # The words a seed adds depend on its predecessor by at most K.
        assert max(scores) >= best_score(at, source_at) - passages.K
    # Seeds further apart than they are wide have no such freedom.
    at = np.arange(0, 400, 10)
    source_at = rng.permutation(at)
    assert abs(max(score_of(c, at, source_at) for c in passages.chain(at, source_at)) - best_score(at, source_at)) < 1e-6


def test_every_long_common_run_has_a_common_seed():
    rng = np.random.default_rng(3)
    run = rng.integers(0, 1 << 60, passages.WINDOW + passages.K - 1, dtype=np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 40), dtype=np.uint64), run, rng.integers(0, 1 << 60, rng.integers(0, 40), dtype=np.uint64)])
        b = np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 40), dtype=np.uint64), run])
        assert set(passages.winnow(a)[0].tolist()) & set(passages.winnow(b)[0].tolist())


def test_distance():
    assert passages.distance(list("kitten"), list("sitting")) == 3
    assert passages.distance([], [1, 2]) == 2 and passages.distance([1], [1]) == 0


def planted(rng, edits=0):
    vocabulary = [f"w{i}" for i in range(5000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = text(120)
    copy = list(passage)
    for _ in range(edits):
        at = rng.randrange(len(copy))
        copy[at: at + 1] = rng.choice([[], text(1), text(2)])
    first = text(80) + passage + text(50)
    second = text(30) + copy + text(200)
    return " ".join(first), " ".join(second), 30, 30 + len(copy), [" ".join(text(150)) for _ in range(20)]


def found_in(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, passages string")
    out = passages.repeated_passages(docs, **options).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: [(p["start"], p["stop"], p["sources"]) for p in r["passages"]] for r in out}


def test_exact_and_fuzzy_passages(spark):
    rng = random.Random(4)
    for edits in (0, 5, 10):
        first, second, start, stop, clean = planted(rng, edits)
        found = found_in(spark, [(1, first), (2, second)] + [(10 + i, t) for i, t in enumerate(clean)])
        held = set().union(*(range(a, b) for a, b, _ in found[2]))
        assert len(held & set(range(start, stop))) >= (0.8 if edits else 1) * (stop - start)
        assert len(held - set(range(start, stop))) <= 8 and all(s == [1] for _, _, s in found[2])
        assert not any(v for k, v in found.items() if k != 2)


def test_passages_of_stock_sentences(spark):
    rng = random.Random(9)
    stock = [[f"s{i}n{k}" for k in range(15)] for i in range(40)]
    rows = [(i, [w for _ in range(12) for w in rng.choice(stock)]) for i in range(120)]
    held = [[w for s in rng.sample(stock, 4) for w in s] for _ in range(30)]
    rows += [(200 + i, [f"a{i}b{k}" for k in range(30)] + p + [f"c{i}d{k}" for k in range(30)]) for i, p in enumerate(held)]
    rows += [(300 + i, [f"e{i}f{k}" for k in range(30)] + p + [f"g{i}h{k}" for k in range(30)]) for i, p in enumerate(held)]
    found = found_in(spark, [(i, " ".join(w)) for i, w in rows])
    # Brute force: words in a run of MIN_WORDS that an earlier document holds.
    seen, exact = set(), {}
    for doc_id, words in rows:
        runs = [tuple(words[i: i + passages.MIN_WORDS]) for i in range(len(words) - passages.MIN_WORDS + 1)]
        exact[doc_id] = {k for i, r in enumerate(runs) if r in seen for k in range(i, i + passages.MIN_WORDS)}
        seen.update(runs)
    assert all(len(exact[300 + i]) == 60 for i in range(30))
    for doc_id, words in exact.items():
        assert words <= set().union(*(range(a, b) for a, b, _ in found[doc_id]))


def test_passages_of_one_pair_are_found_at_any_gap(spark):
    rng = random.Random(5)
    fresh = iter(range(10 ** 6))

    def text(n):
        return [f"g{next(fresh)}x{rng.random()}" for _ in range(n)]

    rows, want = [], {}
    for i, (size, gap) in enumerate((s, g) for s in (60, 200) for g in (20, 40, 60, 100, 200, 500)):
        one, two = text(size), text(size)
        rows.append((2 * i, " ".join(text(30) + one + text(gap) + two + text(30))))
        rows.append((2 * i + 1, " ".join(text(50) + one + text(gap) + two + text(10))))
        want[2 * i + 1] = set(range(50, 50 + size)) | set(range(50 + size + gap, 50 + 2 * size + gap)), gap / (2 * size + gap) <= 0.2
    found = found_in(spark, rows)
    for i, (words, whole) in want.items():
        held = set().union(*(range(a, b) for a, b, _ in found[i]))
        assert words <= held and len(found[i]) == (1 if whole else 2)
        assert whole or held == words
        assert all(s == [i - 1] for _, _, s in found[i])
    assert not any(found[i - 1] for i in want)


def test_parts_of_a_chain_are_the_longest_similar_runs():
    rng = np.random.default_rng(6)
    for _ in range(40):
        a, b, at, source_at = [], [], [], []
        for _ in range(int(rng.integers(2, 9))):
            run = rng.integers(0, 60000, int(rng.integers(6, 50))).tolist()
            for k in range(0, len(run) - passages.K + 1, 7):
                at.append(len(a) + k)
                source_at.append(len(b) + k)
            a += run + rng.integers(60000, 62000, int(rng.integers(1, 30))).tolist()
            b += run + rng.integers(62001, 65000, int(rng.integers(1, 30))).tolist()
        a, b = np.array(a, "<u2"), np.array(b, "<u2")
        parts = passages.similar_parts(a, b, at, source_at, 0.8)
        longest = 0
        for i in range(len(at)):
            for j in range(i, len(at)):
                start, stop, alike = passages.align(a, b, at[i: j + 1], source_at[i: j + 1])
                longest = max(longest, stop - start if alike >= 0.8 else 0)
        assert max((y - x for x, y in parts), default=0) >= (longest if longest >= passages.PIECE else 0)
        same = np.zeros(len(a), bool)
        for i, j in zip(at, source_at):
            same[i: i + passages.K] = True
        assert all(same[x:y].mean() > 0.5 for x, y in parts)


def test_many_texts_are_winnowed_as_one_by_one():
    rng = np.random.default_rng(10)
    for _ in range(100):
        edges = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 6))])
        words = rng.integers(0, rng.choice([5, 1 << 60]), edges[-1]).astype(np.uint64)
        want = []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            grams = passages.grams_of(words[a:b])
            width = min(passages.WINDOW, len(grams))
            want += sorted({a + i + int(grams[i: i + width].argmin()) for i in range(len(grams) - width + 1)}) if width else []
        assert passages.winnow(words, edges)[1].tolist() == want


def test_chains_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(11)
    for _ in range(60):
        lists, want = [], []
        for pair in range(5):
            n = int(rng.integers(1, 25))
            at = np.sort(rng.choice(400, n, replace=False))
            source_at = at + np.cumsum(rng.integers(0, 3, n)) if rng.random() < 0.6 else rng.permutation(at)
            lists.append((at, source_at, np.full(n, pair)))
            want += [(pair, at[c].tolist(), source_at[c].tolist()) for c in passages.chain(at, source_at) if len(c) > 1]
        columns = [np.concatenate(c) for c in zip(*lists)]
        mixed = rng.permutation(np.tile(np.arange(len(columns[0])), 2))
        at, source_at, owner, edges = passages.chains_in(*[c[mixed] for c in columns])
        assert sorted((int(o), at[a:b].tolist(), source_at[a:b].tolist()) for o, a, b in zip(owner, edges, edges[1:])) == sorted(want)


def test_pieces_of_many_chains_are_those_of_each():
    rng = np.random.default_rng(12)
    for _ in range(40):
        texts, bounds, ats, sources, sizes, want, start = [], [], [], [], [], [], 0
        for i in range(8):
            a = rng.integers(0, 4 if i % 4 == 0 else 60000, int(rng.integers(10, 200)))
            keep = rng.random(len(a)) > rng.choice([0, 0.02, 0.1, 0.3])
            b = np.concatenate([rng.integers(0, 60000, int(rng.integers(0, 20))), a[keep]])
            places = np.flatnonzero(keep)
            seeds = [(k, int(len(b) - len(places) + np.searchsorted(places, k))) for k in range(0, len(a) - passages.K, int(rng.integers(1, 12))) if keep[k: k + passages.K].all()]
            if len(seeds) < 2:
                continue
            at, source_at = (np.array(x) for x in zip(*seeds))
            parts = passages.similar_parts(a, b, at.tolist(), source_at.tolist(), 0.8)
            want += [(len(bounds), start + x, start + y) for x, y in parts]
            bounds.append((start, start + len(a), start + len(a) + len(b)))
            ats.append(at + start)
            sources.append(source_at + start + len(a))
            sizes.append(len(at))
            texts += [a, b]
            start += len(a) + len(b)
        got = passages.similar_pieces(np.concatenate(texts), np.array(bounds).T, np.concatenate(ats), np.concatenate(sources), np.concatenate([[0], np.cumsum(sizes)]), 0.8)
        assert sorted(zip(*[x.tolist() for x in got])) == sorted(want)


def test_short_common_runs_are_left_alone(spark):
    rng = random.Random(7)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(60)) + " " + line) for i in range(30)]
    assert not any(found_in(spark, rows).values())
    assert sum(map(bool, found_in(spark, rows, min_words=25).values())) == 29


def test_many_holders_of_one_passage(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{rng.random()} {rng.random()} {passage.upper() if i % 2 else passage} {rng.random()}") for i in range(200)]
    found = found_in(spark, rows)
    assert found[0] == [] and all(found[i] == [(2, 72, [0])] for i in range(1, 200))


def test_edge_rows(spark):
    text = " ".join(f"t{i}" for i in range(90))
    found = found_in(spark, [(1, None), (2, ""), (3, "a b"), (4, text), (5, text), (6, text + " " + text), (None, "unrelated")])
    assert found[1] == found[2] == found[3] == found[4] == found[None] == []
    assert found[5] == [(0, 90, [4])] and found[6][0][0] == 0 and found[6][-1][1] == 180
    again = passages.repeated_passages(spark.createDataFrame([(4, text), (4, text)], "doc_id long, text string")).collect()
    assert [r["passages"] for r in again] == [[], []]
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op10_passages"](spark, sf).collect()}
    assert len(got) == len(docs)
    seen, exact = set(), {}
    for doc_id, text in docs:
        words = text.lower().split()
        runs = [tuple(words[i: i + 50]) for i in range(len(words) - 49)]
        exact[doc_id] = sum(r in seen for r in runs)
        seen.update(runs)
    assert all(got[i]["n_repeated"] >= 50 for i, n in exact.items() if n)
    assert sum(bool(r["n_passages"]) for r in got.values()) <= 2 * sum(map(bool, exact.values())) + 5
