import random
import re

from pyspark.sql import functions as F

from plotwise.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, window):
    cut = set()
    for item, text in items:
        w = words(text)
        if w:
            cut |= {(item, tuple(w[i: i + window])) for i in range(max(1, len(w) - window + 1))}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in cut:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i: i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def check(spark, docs, items, window):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    out = decontaminate.contamination(d, b, window)
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect()), key=repr)
    assert got == expected(docs, items, window)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "É", "é", "x9", "ÄB", "word"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    items = [(i, text(rng.randint(0, 9))) for i in range(25)]
    check(spark, docs, items, 3)
    check(spark, docs, items, 5)


def test_edge_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, None), (2, ""), (3, "..."), (4, f"X {passage.upper()}!"), (4, f"X {passage.upper()}!"), (4, "other"), (None, passage),
            (6, " ".join(["filler"] * 3000 + [passage] + ["filler"] * 3000)), (7, passage.replace("five", "5ive")), (8, "hi there hi"), (9, "İstanbul K")]
    items = [(1, passage), (2, None), (3, ""), (10, "there"), (11, "hi there hi"), (11, "hi there hi"), (12, "hi there hi"), (13, "ten hi"), (14, "İstanbul k")]
    check(spark, docs, items, 10)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")], 10)
    check(spark, [(1, "a b")], [], 10)


def test_larger_tables_are_shuffled(spark, monkeypatch):
    from plotwise.llm import sizes

    monkeypatch.setattr(sizes.if_few, "__defaults__", (0,))
    check(spark, [(1, "a b c d"), (2, "b c")], [(1, "b c"), (2, "z")], 2)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "q alpha x beta q"), (2, "alpha beta x"), (3, "x beta alpha"), (4, "x alpha a b c d beta x x")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha x beta")], "item_id long, text string")
    terms = {r["term"]: r["offset"] for r in decontaminate.rarest_terms(decontaminate.windows_of(items, 3), docs).collect()}
    assert len(terms) == 2
    for slack in (0, 1, 3):
        want = set()
        for d in docs.collect():
            w = words(d["text"])
            one, two = ([i - o for i, x in enumerate(w) if x == t and i >= o] for t, o in terms.items())
            if any(abs(a - b) <= slack for a in one for b in two):
                want.add(d["doc_id"])
        assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, items, slack, 3).collect()} == want
        assert 1 in want


def test_planted_passages_in_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    out = decontaminate.contamination(docs, items)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect()), key=repr)
    assert got == expected([tuple(r) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert out.where(F.col("n_hit") > 0).count() > 0
