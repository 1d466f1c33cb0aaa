"""Benchmark decontamination with a positional inverted index.

Test items are cut into windows of consecutive words. Occurrences of all words of the
items are counted in the whole training corpus; each window then looks up its two rarest
words. The index stores the postings of these words: document, position and the words
around. Shifted by the place of the word in the window, the two lists of a window meet
where it may start, and the words around decide whether it does.

Only DataFrame operations are used. Null texts have no words. Documents are told apart
by id and text, so equal ids with different texts have results of their own, and repeated
rows repeated results.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.llm.sizes import if_few
from plotwise.session import materialise

WINDOW = 10
#: Posting lists that are intersected for a window.
LISTS = 2
# Fixed value: what separates words, in texts of either case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in their case; the first and the last entry may be empty."""
    return F.split(text, SEPARATORS)


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def n_words(words: Column) -> Column:
    empty = (F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.coalesce(F.greatest(F.size(words) - empty, F.lit(0)), F.lit(0)).cast("long")


def document_key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))


def windows_of(items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, window_id and words of every window of every item.

    An item with fewer words than a window, but not none, is one window.
    """
    cleaned = F.filter(words_of(lowered(F.col(text))), lambda w: w != "")
    whole = items.select(F.col(item_id).alias("item_id"), cleaned.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = whole.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), window).alias("words"))
    return cut.select("item_id", F.xxhash64(F.array_join("words", " ")).alias("window_id"), "words").distinct()


def tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, words, at and term of every word of every document."""
    listed = docs.select(document_key(doc_id, text).alias("doc"), words_of(F.col(text)).alias("words"))
    return listed.select("doc", "words", F.posexplode("words").alias("at", "word")).select("doc", "words", "at", lowered(F.col("word")).alias("term"))


def rarest_terms(windows: DataFrame, docs: DataFrame, lists: int = LISTS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each window that can occur, its ``lists`` rarest words in all ``docs``.

    Columns: window_id, words, rank (from 1), lists (how many the window has), term,
    offset. A window with a word that no document has is left out.
    """
    distinct = windows.select("window_id", "words").distinct()
    placed = distinct.select("window_id", "words", F.posexplode("words").alias("offset", "term")).groupBy("window_id", "words", "term").agg(F.min("offset").alias("offset"))
    terms = materialise(placed.select("term").distinct(), "benchmark-terms")
    counts = tokens(docs, text, doc_id).join(if_few(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("occurrences"))
    counted = placed.join(counts, "term", "left")
    window = Window.partitionBy("window_id")
    ranked = counted.select(
        "window_id", "words", "term", "offset", F.count("occurrences").over(window).alias("known"), F.count("*").over(window).alias("terms"),
        F.row_number().over(window.orderBy("occurrences", "term")).alias("rank"))
    return ranked.where((F.col("known") == F.col("terms")) & (F.col("rank") <= lists)).select(
        "window_id", "words", "rank", F.least("terms", F.lit(lists)).alias("lists"), "term", "offset")


def index(docs: DataFrame, terms: DataFrame, around: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored postings of ``terms``: term, doc, at, first and words, the words from place ``first`` on.

    ``around`` words on either side are kept with a posting.
    """
    found = tokens(docs, text, doc_id).join(if_few(terms), "term", "left_semi")
    first = F.greatest(F.col("at") - around, F.lit(0))
    near = F.slice("words", first + 1, F.col("at") - first + around + 1)
    postings = found.select("term", "doc", "at", first.alias("first"), F.split(F.translate(F.array_join(near, " "), ascii_uppercase, ascii_lowercase), " ").alias("near"))
    return materialise(postings, "postings")


def list_of(postings: DataFrame, terms: DataFrame, rank: int) -> DataFrame:
    """The list of each window for its word of this rank, shifted to where the window would start."""
    chosen = terms.where(F.col("rank") == rank).select("window_id", F.col("term").alias("_term"), "offset")
    return postings.join(chosen, postings["term"] == chosen["_term"]).where("at >= offset").select(
        "window_id", "doc", (F.col("at") - F.col("offset")).alias("start"), "first", "near")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
                   item_text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Exact occurrences (window_id, doc, start, length), and the windows of the items."""
    windows = materialise(windows_of(items, window, item_text, item_id), "windows")
    terms = materialise(rarest_terms(windows, docs, LISTS, text, doc_id), "rarest-terms")
    postings = index(docs, materialise(terms.select("term").distinct(), "index-terms"), window - 1, text, doc_id)
    rarest = list_of(postings, terms, 1)
    more = terms.where("lists > 1 and rank = 1").select("window_id")
    second = list_of(postings, terms, 2).select("window_id", "doc", "start")
    met = rarest.join(more, "window_id", "left_semi").join(second, ["window_id", "doc", "start"], "left_semi")
    alone = rarest.join(more, "window_id", "left_anti")
    asked = terms.where("rank = 1").select("window_id", "words")
    checked = met.unionByName(alone).join(asked, "window_id").where(
        F.slice("near", F.col("start") - F.col("first") + 1, F.size("words")) == F.col("words"))
    return checked.select("window_id", "doc", "start", F.size("words").alias("length")), windows


def proximity_matches(docs: DataFrame, items: DataFrame, slack: int, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
                      item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, window_id, doc_id) where the two rarest words of a window stand as they do in
    it, or up to ``slack`` words further apart or closer."""
    windows = materialise(windows_of(items, window, item_text, item_id), "windows")
    terms = materialise(rarest_terms(windows, docs, LISTS, text, doc_id), "rarest-terms")
    postings = index(docs, materialise(terms.select("term").distinct(), "index-terms"), 0, text, doc_id)
    # Starts that differ by up to the slack share one of two neighbouring cells.
    width = max(1, 2 * slack)
    a = list_of(postings, terms, 1).select("window_id", "doc", "start", F.floor(F.col("start") / width).alias("cell"))
    b = list_of(postings, terms, 2).select("window_id", "doc", F.col("start").alias("other"), F.explode(
        F.array_distinct(F.array(F.floor((F.col("start") - slack) / width), F.floor((F.col("start") + slack) / width)))).alias("cell"))
    near = a.join(b, ["window_id", "doc", "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slack)
    return near.select("window_id", F.col("doc.doc_id").alias("doc_id")).distinct().join(windows.select("item_id", "window_id"), "window_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit (words inside any occurrence) and items.

    ``items`` lists the ids, as strings and sorted, of the items with an occurring
    window; it is as long as the benchmark makes it, not as the corpus does.
    """
    matches, windows = phrase_matches(docs, items, window, text, doc_id, item_text, item_id)
    matches = materialise(matches, "phrase-matches")
    spans = matches.select("doc", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    before = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = spans.select("doc", F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0)).alias("fresh"))
    hit = fresh.groupBy("doc").agg(F.sum("fresh").cast("long").alias("n_hit"))
    found = matches.select("doc", "window_id").distinct().join(windows.select("window_id", "item_id"), "window_id")
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    clash = {"n_words", "n_hit", "items", "doc", "_doc"}
    kept = docs.select(*[c for c in docs.columns if c not in clash], n_words(words_of(F.col(text))).alias("n_words"), document_key(doc_id, text).alias("_doc"))
    joined = kept.join(hit.join(listed, "doc"), F.col("_doc") == F.col("doc"), "left")
    return joined.select(
        *[c for c in kept.columns if c != "_doc"], F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
