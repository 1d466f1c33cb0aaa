import random
import zlib

import numpy as np

from plotwise.llm import language
from plotwise.llm.queries import QUERIES

SYLLABLES = {"aa": ["the", "tion", "ing", "er"], "bb": ["sch", "ung", "ü", "ein"], "cc": ["eau", "é", "que", "ment"]}


def text_in(lang, rng, words=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_learns_and_reads_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, text_in(lang, rng), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    long = " ".join([text_in("aa", rng, 60)] + [text_in("bb", rng, 400)])
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "1234 !?", None, "s"), (903, long, None, "s"), (904, "the", None, "s"), (904, "the", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language.identify(docs, language.learn(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "bb" and 0 < got[903]["score"] < 1
    right = [got[r[0]]["lang_pred"] == r[2] for r in rows[:300]]
    assert sum(right) / len(right) > 0.97
    assert out.count() == len(rows)


def test_pairs_of_bytes_give_the_same_responses():
    rng = np.random.default_rng(0)
    net = language.train([("a", b"abc def"), ("b", b"xyz uvw")] * 20)
    windows = rng.integers(0, 256, (9, language.WINDOW), dtype=np.uint8)
    plain = np.concatenate([r.max(axis=1) for r in net.responses(windows)], axis=1)
    assert np.allclose(plain, net.strongest(windows, net.pair_tables()), atol=1e-5)


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some words", None), (None, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs, language.learn(docs)).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.learn(docs.limit(0))).count() == 0


def test_held_out_accuracy_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert sum(right) / len(right) > 0.95
