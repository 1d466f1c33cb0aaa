import struct
from collections import Counter

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plotwise.llm import language, line_dedup
from test_decontaminate import expected as contaminated
from test_line_dedup import expected as repeated_lines
from test_ngram_join import gram_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def stage(number, spark, docs, sf=SF):
    return corpus_pipeline.STAGES[number][1](spark, docs, sf)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


ODD = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "12 34 !", "en", None, None)]


def test_stages_take_any_rows_and_columns(spark, documents):
    docs = documents.limit(40).union(spark.createDataFrame(ODD, documents.schema)).union(documents.limit(3))
    docs = docs.selectExpr("*", "'x' as score", "1 as n_lines", "2 as items", "3 as n_hit", "4 as lang_pred", "5 as spans", "'y' as token_ids")
    for i in range(4):
        for rows in (docs, docs.limit(0)):
            out = stage(i, spark, rows)
            assert out.columns == docs.columns
            assert out.count() <= rows.count()
    assert stage(4, spark, docs).count() == docs.count()


def test_language_stage(spark, documents):
    docs = documents.union(spark.createDataFrame(ODD, documents.schema))
    net = language.learn(docs)
    names, scores = net.predict([r["text"] for r in docs.collect()], net.pair_tables())
    want = Counter(tuple(r) for r, n, s in zip(docs.collect(), names, scores) if n != "und" and s >= corpus_pipeline.LIKELY)
    got = rows_of(stage(0, spark, docs))
    assert got == want and sum(got.values()) >= 0.98 * documents.count()


def after_lines(rows):
    gone = repeated_lines([(r["doc_id"], r["text"] or "", r["text"]) for r in rows], line_dedup.MIN_WORDS, line_dedup.NEAR_WORDS)
    out = []
    for r in rows:
        lines = r["text"].split("\n")
        dropped = gone.get((r["doc_id"], r["text"]), ())
        kept = [x for i, x in enumerate(lines) if i not in dropped]
        if not dropped or any(len(x.strip(" ").split(" ")) >= line_dedup.MIN_WORDS for x in kept):
            out.append((r["doc_id"], "\n".join(kept), r["lang"], r["source"], len("\n".join(kept))))
    return out


def test_line_stage(spark, documents):
    assert rows_of(stage(1, spark, documents)) == Counter(after_lines(documents.collect()))


def test_line_stage_keeps_documents_with_lines_of_their_own(spark):
    licence = "all rights to this text are reserved"
    texts = {1: f"{licence}\nfirst verse", 2: f"{licence}\na verse of mine\n\nfirst verse", 3: f"{licence}\n FIRST verse\n",
             4: licence, 5: f"{licence}\n我们在河边走了很久", 6: f"{licence}\n \n", 7: f"{licence}\na verse of mine", None: f"{licence}\nno number"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"]: r for r in stage(1, spark, docs).collect()}
    # The row without an id comes first, so that the licence line is its own.
    assert {i: r["text"] for i, r in got.items()} == {None: texts[None], 1: "first verse", 2: "a verse of mine\n\nfirst verse", 5: "我们在河边走了很久"}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicate_stage(spark, documents):
    rows = documents.collect()
    sets = {r["doc_id"]: gram_set(r["text"], corpus_pipeline.SHINGLE) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.PERCENT * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert rows_of(stage(2, spark, documents)) == Counter(tuple(r) for r in rows if find(r["doc_id"]) == r["doc_id"])
    twice = documents.union(documents.limit(5))
    assert rows_of(stage(2, spark, twice)) == rows_of(stage(2, spark, documents))


def test_decontamination_stage(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in contaminated([(r["doc_id"], r["text"]) for r in documents.collect()], items, 10) if n}
    assert hit
    assert rows_of(stage(3, spark, documents)) == Counter(tuple(r) for r in documents.collect() if r["doc_id"] not in hit)


def test_encoding_stage_and_run(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents
    for i in range(4):
        docs = spark.createDataFrame(stage(i, spark, docs).collect(), documents.schema)
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for doc_id, ids in want.items():
        assert list(struct.unpack(f"<{len(ids)}I", got[doc_id]["token_ids"])) == ids and got[doc_id]["n_tokens"] == len(ids)
