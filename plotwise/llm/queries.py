"""The registered queries of the text operators, and SQL where SQL can state them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.llm import bpe, collocations, decontaminate, fingerprints, language, line_dedup, ngram_join, passages, pii, quality, secrets, sharding, spelling
from plotwise.session import materialise
from plotwise.llm.spans import as_text, count_of, of_kinds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_secrets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.learn_formats(docs))
    return found.select(
        "doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(as_text(of_kinds(F.col("spans"), secrets.BASE_KINDS)), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


@query
def op2_decontamination(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op2_decontamination"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
hits AS (
    SELECT DISTINCT doc_id, d.n, i, item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.phrase = t.phrase),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op3_ngram_join(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query
def op4_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs, min_chars=line_dedup.MIN_CHARS)


@query
def op6_language(spark, sf):
    docs = table(spark, sf, "documents")
    net = language.learn(docs)
    found = language.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_sharding(spark, sf):
    sharded = sharding.into_shards(table(spark, sf, "documents"), 40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_fingerprints(spark, sf):
    prints = materialise(fingerprints.compare_with_edits(table(spark, sf, "documents")), "document-prints")
    # Rows whose id is divisible by 100 ask for all documents near their fingerprint.
    asking = prints.where("doc_id % 100 = 0").select("fingerprint")
    documents = prints.groupBy(F.col("fingerprint").alias("found")).agg(F.count("*").alias("n"))
    pairs = fingerprints.within_radius(prints.select("fingerprint"), asking)
    near = pairs.join(documents, pairs["fingerprint"] == documents["found"]).groupBy("query").agg(F.sum("n").alias("n_near"))
    a, b = F.col("fingerprint"), F.col("edited_fingerprint")
    return prints.join(near, F.col("fingerprint") == F.col("query"), "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_hex(a).alias("fingerprint"), fingerprints.as_hex(b).alias("edited_fingerprint"),
        fingerprints.likeness(a, b).alias("near_edited"), fingerprints.likeness(a, F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near") - 1).alias("n_near"),
    )


@query
def op9_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    return found.select(
        "doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(as_text(of_kinds(F.col("spans"), pii.BASE_KINDS)), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


@query
def op10_passages(spark, sf):
    found = passages.repeated_passages(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["stop"] - p["start"]).alias("n_repeated"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["stop"].cast("string"))), ",").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.col("passages.sources")))).alias("source_ids"),
    )


@query
def op11_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


ORACLE["op11_collocations"] = r"""
WITH piece AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
          FROM documents)),
gram AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(w) >= k)
    GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f) AS n FROM gram WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1 AND f >= 30),
cut AS (
    SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS c FROM candidate)),
scored AS (
    SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS score
    FROM cut JOIN gram x ON x.lang = cut.lang AND x.phrase = head JOIN gram y ON y.lang = cut.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
    SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS around
    FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM candidate, (VALUES (2), (3)) sizes(m) WHERE m < k)
    GROUP BY lang, phrase),
ranked AS (
    SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
    FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase
    WHERE around IS NULL OR CAST(100 AS HUGEINT) * around < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op12_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    trees = quality.learn(docs, table(spark, sf, "labels"))
    return quality.score(docs, trees).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def dropped_letter(doc_id: str, word: str) -> str:
    """The word without one code point, for the pairs of id and word whose crc32 97 divides."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


@query
def op13_spelling(spark, sf):
    words = spelling.count_words(table(spark, sf, "documents"), dropped_letter)
    return spelling.spelling_variants(words)
