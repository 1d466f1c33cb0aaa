import random
import zlib

import numpy as np

from plotwise.llm import quality
from plotwise.llm.queries import QUERIES


def walk(trees, row):
    """Margin of one row, node by node."""
    total = trees.base
    inner = trees.feature.shape[1]
    for t in range(len(trees.leaf)):
        node = 0
        while node < inner:
            node = 2 * node + (2 if row[trees.feature[t, node]] > trees.cut[t, node] else 1)
        total += trees.leaf[t, node - inner]
    return total


def test_flat_trees_equal_a_walk_and_fit_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.grow(x, y)
    assert np.allclose(trees.margins(x[:200]), [walk(trees, r) for r in x[:200]])
    new = rng.normal(size=(2000, 6))
    right = (trees.scores(new) >= 0.5) == ((new[:, 0] > 0.3) ^ (new[:, 1] > 0))
    assert right.mean() > 0.95


def test_splits_equal_all_cuts_tried():
    rng = np.random.default_rng(2)
    binned = rng.integers(0, quality.BINS, (400, 3))
    node = rng.integers(0, 2, 400)
    gradient, weight = rng.normal(size=400), rng.uniform(0.1, 0.25, 400)
    best, at = quality.level_splits(binned, node, 2, gradient, weight)
    for k in range(2):
        def gain(f, b):
            mine = node == k
            left = mine & (binned[:, f] <= b)
            parts = [(gradient[m].sum(), weight[m].sum()) for m in (left, mine & ~left, mine)]
            if min(parts[0][1], parts[1][1]) < quality.LEAST:
                return -np.inf
            terms = [g * g / (h + quality.PENALTY) for g, h in parts]
            return terms[0] + terms[1] - terms[2]

        tried = {(f, b): gain(f, b) for f in range(3) for b in range(quality.BINS)}
        assert np.isclose(tried[best[k], at[k]], max(tried.values()))


def test_statistics_of_small_texts():
    zero = quality.statistics("")
    assert quality.statistics(None) == zero == [0.0] * len(quality.STATISTICS)
    got = dict(zip(quality.STATISTICS, quality.statistics("ab ab AB 12!\nab ab AB 12!\né")))
    assert np.isclose(got["words"], np.log1p(9)) and np.isclose(got["distinct_words"], 4 / 9) and np.isclose(got["words_twice"], 2 / 9)
    assert np.isclose(got["word_ends"], 7 / 9) and np.isclose(got["distinct_lines"], 2 / 3) and np.isclose(got["lines_twice"], 1 / 3)
    assert np.isclose(got["lower"] * 28, 8) and np.isclose(got["stops"] * 28, 2) and np.isclose(got["other_bytes"] * 28, 2)


def test_learns_and_scores_odd_rows(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "house", "a", "the", "light", "under", "green"]) + rng.choice(["", "s", "."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "now###", "now###"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), 7) for i in range(600)]
    odd = [(700, None, 1), (701, "", 1), (702, "x" * 2_000_000, 1), (703, " \n\t ", 1), (None, good(), 1), (5, good(), 1), (5, good(), 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score int")
    labels = [(i, int(i % 3 > 0), 0) for i in range(600)] + [(700, None, 0), (701, 9, 0), (999, 1, 0), (None, 1, 0), (7, 1, 0), (7, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    out = quality.score(docs, quality.learn(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    seen = {r["doc_id"]: r["predicted"] for r in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1 and i != 5]
    assert np.mean([seen[i] == int(i % 3 > 0) for i in held]) > 0.97
    for nothing in (labels.limit(0), labels.where("quality = 9")):
        assert {r["score"] for r in quality.score(docs, quality.learn(docs, nothing)).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 9)) for i in range(300)], "doc_id long, text string")
    labels = [(i, int(i % 9 > 4)) for i in range(300)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = (quality.learn(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, other))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.cut, b.cut)


def test_held_out_accuracy_on_given_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op12_quality"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    pairs = []
    for row in spark.read.parquet(f"{sf}/labels.parquet").collect():
        r = got[row["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        if r["held_out"]:
            pairs.append((row["quality"], r["predicted"]))
    for q in (0, 1):
        assert np.mean([p == q for true, p in pairs if true == q]) > 0.9
    assert np.mean([p == q for q, p in pairs]) > 0.95
