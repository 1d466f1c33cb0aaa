import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from plotwise.llm import collocations
from plotwise.llm.queries import ORACLE, QUERIES


def expected(rows, least, top, longest=4):
    counts, words_of = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            words_of[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in wanted.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in wanted.items() if len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if all(100 * b < 80 * a for b in inside):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, words_of[lang], -score))
    return out


def found(docs, **options):
    rows = collocations.collocations(docs, **options).collect()
    got = {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def some_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Of", "river", "bank", "É", "new", "York", "city", "x y", " ", "z"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(8)]
    rows = []
    for _ in range(120):
        parts = [rng.choice(lines) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(5)]
        rows.append((rng.choice([". ", "\n", " ", "\t", "\r\n", "! "]).join(parts), rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("every, widest, held", [(12, 200, 8_000_000), (2, 5, 300), (1000, 7, 100)])
def test_equals_plain_counts(spark, monkeypatch, every, widest, held):
    for name, value in (("EVERY", every), ("WIDEST", widest), ("HELD", held), ("TOGETHER", held)):
        monkeypatch.setattr(collocations, name, value)
    rows = some_rows(every)
    docs = spark.createDataFrame([(i, *r, 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int")
    assert found(docs, least=3, top=40) == expected(rows, 3, 40)
    assert found(docs, least=1, top=100_000, longest=3) == expected(rows, 1, 100_000, 3)
    assert found(docs, least=2, top=100_000, longest=2) == expected(rows, 2, 100_000, 2)


def test_shared_slots_change_nothing(spark, monkeypatch):
    """With as few slots as one row of the bitmap almost all phrases pass."""
    monkeypatch.setattr(collocations, "SLOTS", collocations.ROW)
    rows = some_rows(9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(docs, least=5, top=50) == expected(rows, 5, 50)


def test_each_start_belongs_to_one_chunk():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c", b"dd", b"e5"]) for _ in range(rng.randint(0, 60))]
        at = 0
        for own, chunk in collocations.chunks(words, 3):
            assert chunk.split(b" ") == words[at: at + own + 3] if at + own < len(words) else words[at:]
            at += own
        assert at == len(words)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), ("a b " * 50_000, "en"), ("...,,,", "en"), ("word", "en"), ("q r s t. " * 40, None), ("q r s t. " * 40, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, phrase string")
    assert found(docs) == expected(rows, 30, 2000)
    assert found(docs.limit(0)) == set()
    assert found(docs.where("text = 'word'")) == set()


def test_large_counts_are_exact(spark):
    """2000000 * a passes 64 bits; the join of the parts and the quotient stay exact."""
    huge = 9 * 10**15
    score = spark.sql(f"SELECT CAST({huge}L AS DECIMAL(20, 0)) * 2000000 DIV (CAST({huge}L AS DECIMAL(20, 0)) + {huge - 1}L) AS s").first()["s"]
    assert score == 2000000 * huge // (2 * huge - 1)


def test_given_table(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = QUERIES["op11_collocations"](spark, sf).collect()
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = con.sql(ORACLE["op11_collocations"]).df()[names]
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(wanted.itertuples(index=False, name=None)) and len(rows) > 1000


def test_hashes_of_a_batch_are_summed():
    keys = np.array([5, 2**64 - 1, 5, 0, 2**63], np.uint64)
    found, total = collocations.summed(keys, np.array([1, 2, 3, 4, 2**40]))
    assert found.tolist() == [0, 5, 2**63, 2**64 - 1] and total.tolist() == [4, 4, 2**40, 2]
    assert [len(x) for x in collocations.summed(keys[:0], np.array([], np.int64))] == [0, 0]


def test_a_chunk_holds_many_pieces(spark, monkeypatch):
    """Pieces are shorter than chunks: a row for each piece made twice as many rows to count."""
    monkeypatch.setattr(collocations, "EVERY", 2**40)
    docs = spark.createDataFrame([("A b, c! d\n" * 20, "en"), ("A b, c! d\n" * 20, "en"), ("...", "en"), (None, "en")], "text string, lang string")
    assert [tuple(r) for r in collocations.dictionary(docs).collect()] == [("en", 80, " ".join(["a b . c . d ."] * 20), 2)]


def test_chunks_end_with_their_piece():
    words = [b"a", b"b", b".", b".", b"c", b"d"]
    for widest, wanted in ((2, [(2, b"a b"), (2, b"c d")]), (4, [(2, b"a b . ."), (2, b"c d")]), (1, [(1, b"a b"), (1, b"b"), (1, b"c d"), (1, b"d")])):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(collocations, "EVERY", 2**40)
            patch.setattr(collocations, "WIDEST", widest)
            assert collocations.chunks(words, 3) == wanted


@pytest.mark.parametrize("span, buckets, held", [(1, 1, 200), (40, 3, 10_000), (10**6, 50, 10**6)])
def test_spans_and_buckets_change_nothing(spark, monkeypatch, span, buckets, held):
    for name, value in (("SPAN", span), ("BUCKETS", buckets), ("HELD", held)):
        monkeypatch.setattr(collocations, name, value)
    rows = some_rows(buckets)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(docs, least=3, top=100) == expected(rows, 3, 100)


def test_hashes_are_shuffled_as_arrays(spark):
    """A row for each hash took most of the time of the JVM."""
    docs = spark.createDataFrame(some_rows(3), "text string, lang string")
    parsed = collocations.dictionary(docs).localCheckpoint()
    everything = np.full(collocations.SLOTS // 8, 255, np.uint8)
    hashed = collocations.count_hashed(parsed, [everything], 3)
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert "hashes" in plan and "Aggregate" not in plan
    pairs = Counter()
    for text, lang in some_rows(3):
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            w = re.findall("[^\x20\x09]+", piece)
            pairs.update((lang or "und", *p) for p in zip(w, w[1:]))
    assert hashed.distinct().count() == hashed.count() == sum(n >= 3 for n in pairs.values())


def made_by(plan):
    """(output columns, rows made) of each MapInArrow of an executed plan."""
    found = [(plan.output().mkString(","), plan.metrics().apply("pythonNumRowsReceived").value())] if "MapInArrow" in plan.nodeName() else []
    children = plan.children()
    return found + [x for i in range(children.size()) for x in made_by(children.apply(i))]


@pytest.mark.parametrize("tasks", [2, 9])
def test_each_phrase_is_spelled_once(spark, monkeypatch, tasks):
    """Every task spelled out all phrases it met: rows grew with tasks times phrases."""
    made = []

    def noted(df, label):
        rows = spark.createDataFrame(df.collect(), df.schema)
        made.extend(n for columns, n in made_by(df._jdf.queryExecution().executedPlan()) if "phrase" in columns)
        return rows.repartition(tasks) if label == "chunks" else rows

    monkeypatch.setattr(collocations, "materialise", noted)
    monkeypatch.setattr(collocations, "EVERY", 2)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = some_rows(5)
        got = found(spark.createDataFrame(rows, "text string, lang string"), least=1, top=10**6)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == expected(rows, 1, 10**6)
    phrases = set()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            w = re.findall("[^\x20\x09]+", piece)
            phrases |= {(lang or "und", *w[i: i + k]) for k in range(1, 5) for i in range(len(w) - k + 1)}
    assert made == [len(phrases)]


def test_pairs_of_hashes_are_summed():
    """Phrases that share one of their hashes stay apart, also when they lie mixed."""
    hashes = np.array([7, 7, 7, 2**64 - 1, 7, 0], np.uint64)
    others = np.array([1, 2, 1, 1, 2, 5], np.uint64)
    got = collocations.summed_pairs(hashes, others, np.array([1, 10, 2, 2**40, 20, 4]), np.array([3, 4, 3, -5, 4, 6], np.int32))
    assert [tuple(map(int, x)) for x in zip(*got)] == [(0, 5, 4, 6), (7, 1, 3, 3), (7, 2, 30, 4), (2**64 - 1, 1, 2**40, -5)]
    assert [len(x) for x in collocations.summed_pairs(*(x[:0] for x in got))] == [0, 0, 0, 0]


def test_chunks_may_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(collocations, "chunk_id", lambda: collocations.F.lit(5).alias("id"))
    rows = some_rows(6)[:30]
    assert found(spark.createDataFrame(rows, "text string, lang string"), least=2, top=1000) == expected(rows, 2, 1000)


def test_copies_of_counts_are_not_broadcast(spark, tmp_path):
    """Spark sizes copies as the file they are made from, which may be below the bound of a broadcast."""
    path = str(tmp_path / "counts")
    spark.createDataFrame([("en", "a", 40), ("en", "a b", 30), ("en", "b", 50)], "lang string, phrase string, a long").write.parquet(path)
    counts = spark.read.parquet(path)
    parts = counts.where("phrase = 'a b'").selectExpr("lang", "phrase", "a", "explode(array('a')) AS first", "'b' AS rest")
    both = collocations.with_count(collocations.with_count(parts, counts, "first", "l"), counts, "rest", "r")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in both.collect()] == [("en", "a b", 30, 40, 50)]
