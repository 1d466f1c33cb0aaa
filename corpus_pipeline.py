"""A corpus made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the documents of the next one. All but the last return the
columns of ``docs``, whatever they are besides doc_id and text. Other tables are read
from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plotwise.llm import bpe, decontaminate, language, line_dedup, ngram_join
from plotwise.session import materialise

#: A text whose likeliest language is less likely than this is in none of the learned ones.
LIKELY = 0.4
#: Near duplicates: words in a shingle, and percentage of shingles in common.
SHINGLE, PERCENT = 5, 80


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of the row, so that no column of a row clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def unpacked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``docs`` from packed rows."""
    return rows.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``docs`` from packed rows whose text has changed."""
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; null texts, texts without a letter and other languages go.

    Without any labelled text there is nothing to tell languages by, and every text
    with a letter stays.
    """
    net = language.learn(docs)
    if not net.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language.identify(packed(docs), net)
    return unpacked(docs, found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LIKELY)))


def holders_of_short_lines(docs: DataFrame) -> DataFrame:
    """_id and _hash (of the text) of every document that is the earliest to hold a short line that is not blank."""
    lines = line_dedup.lines_of(docs, "text", "doc_id")
    short = lines.where((F.col("line") != "") & (line_dedup.word_count(F.col("line")) < line_dedup.MIN_WORDS))
    first = short.groupBy(F.xxhash64("line").alias("line_hash"), F.hash("line").alias("line_check")).agg(F.min(F.struct("doc_id", "text_hash")).alias("place"))
    return first.select(F.col("place.doc_id").alias("_id"), F.col("place.text_hash").alias("_hash")).distinct()


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents all of whose lines left after that are blank or occur in earlier documents."""
    shorter = line_dedup.without_repeats(packed(docs).withColumn("_before", F.xxhash64("text")))
    words = F.transform(F.split("text", "\n"), lambda line: F.size(F.split(F.trim(line), " ")))
    # A longer line that is left is the first of its kind; short ones are never taken out.
    only_short = (F.col("n_removed") > 0) & ~F.exists(words, lambda n: n >= line_dedup.MIN_WORDS)
    cut = materialise(shorter.select("text", "_before", "_row", F.coalesce(only_short, F.lit(False)).alias("_short")), "shorter-texts")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_before") == F.col("_hash"))
    kept = cut.where("_short").join(holders_of_short_lines(docs), same, "left_semi")
    return with_text(docs, cut.where("not _short").select("text", "_row").unionByName(kept.select("text", "_row")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id."""
    return unpacked(docs, ngram_join.one_of_each(packed(docs), SHINGLE, PERCENT))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(docs, found.where("n_hit = 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids (little-endian unsigned 32-bit) of every document."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.coalesce(F.octet_length("token_ids") / 4, F.lit(0)).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language identification", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: Neither a trained network nor BPE merges can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
