import hashlib
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotwise.llm.bpe import Vocabulary, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "", " ", "a", "Hello, world!", "don't it's I'll 'S 'RE", "x<|endoftext|>y <|startoftext|>", "a</w>b </w>",
    "ΟΔΟΣ Σας İstanbul ẞ ß ﬁ", "é é ﬁ", "x\x1cy\x85z q　r\n\n\ts", "漢字かな 😀👍🏽", "12 １２ ½ Ⅷ", "\x00\x01\x7f",
    "a" * 3000, "ab" * 700 + "!" * 999, "thhehea thtionre anerthst. Uneaea, ththnt", "The the THE tHe",
]


def test_matches_the_library(library):
    v = Vocabulary(PATH)
    for text, ids in zip(TEXTS, v.encode(TEXTS)):
        want = library.encode(text, add_special_tokens=False)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, text
        assert v.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert v.encode([None]) == [None]


def test_merges_by_scan_and_by_heap_agree():
    v = Vocabulary(PATH)
    for word in ("thestotherin", "aaaaabaaaab", "internationalisation" * 3):
        spelled = word + "\x00"
        symbols = [*map(v.symbol.get, spelled[:-2]), v.symbol[spelled[-2:]]]
        assert v.merged(spelled) == v.merged_long(list(symbols))


def test_forgets_without_change(library):
    from plotwise.llm import bpe

    v = Vocabulary(PATH)
    first = v.encode(TEXTS)
    v.known.update((str(i), b"") for i in range(bpe.REMEMBERED + 1))
    assert v.encode(TEXTS) == first


def test_rows_columns_and_nulls(spark):
    rows = [(i, t, "old") for i, t in enumerate([*TEXTS, None, "Hello, world!"])]
    out = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), PATH)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert got[len(TEXTS)]["token_ids"] is None and got[len(TEXTS)]["decoded"] is None
    assert got[3]["token_ids"] == got[len(TEXTS) + 1]["token_ids"]
    assert encode_decode(spark.createDataFrame([], "text string"), PATH).count() == 0


def test_query_on_given_table(spark, library):
    from plotwise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
