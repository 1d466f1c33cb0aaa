"""Line dedup by a deletion-neighbourhood join.

A line is a repeat if an earlier line of the corpus is equal to it or differs by one word
put in, left out or replaced. Every line is listed under the hash of its words and under
the hash of its words without each one of them. Lines one word apart meet under a common
key: two lines that lack the same place, or a whole line and one that lacks a word.
Meeting lines are compared word by word, and all but the earliest go.

Two lines one word apart share their first or their last half, so only lines that share
a half with another one are listed at all. Within a key, lines are compared with the
earliest one, or whole lines with shortened ones, never all with all.

Words are what single blanks separate, in lower case, without blanks around the line.
Lines with fewer than ``min_words`` words are repeats only if they have ``min_chars`` code
points; with fewer than ``near_words`` words, only when equal. A line of ``min_chars`` code
points without a blank, as in scripts that write none, is compared by its code points in
place of words, so one code point put in, left out or replaced makes it a repeat. It is
compared with lines of its kind alone. Without ``min_chars`` words alone count.

Earlier means a smaller doc_id, then text hash, then line number; rows equal in id and text
are one document. A line counts as a repeat of an earlier one whether or not that one is a
repeat itself. Null texts stay null.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.sizes import if_few
from plotwise.session import materialise

MIN_WORDS = 5
NEAR_WORDS = 8
#: Code points of a line that counts as long enough however few its words are.
MIN_CHARS = 20
#: Word hashes are kept this small so that their sums over a line do not overflow.
SPAN = 1 << 40

PLACE = ["doc_id", "text_hash", "line_no"]
LINE = ["line_hash", "line_check"]


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def lines_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, line_no and line of every line."""
    split = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return split.withColumn("line", normal(F.col("line")))


def word_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def unspaced(line: Column, min_chars: int | None) -> Column:
    """Whether the line is compared by its code points."""
    return F.lit(False) if min_chars is None else (F.length(line) >= min_chars) & ~F.contains(line, F.lit(" "))


def units(line: Column, min_chars: int | None) -> Column:
    """What an edit puts in, leaves out or replaces: words, or the code points of an unspaced line.

    Code points carry a line end, which no word holds, so that they never equal words.
    """
    words = F.split(line, " ")
    if min_chars is None:
        return words
    return F.when(unspaced(line, min_chars), F.transform(F.split(line, ""), lambda c: F.concat(c, F.lit("\n")))).otherwise(words)


def half_keys(line: Column, n: Column, by_chars: bool = False) -> Column:
    """Hashes of the first and the last half, also as a line one unit shorter would cut them."""
    def ends(k: Column) -> list[Column]:
        if by_chars:
            return [F.xxhash64(F.lit("head"), k, F.left(line, k)), F.xxhash64(F.lit("tail"), k, F.right(line, k))]
        return [F.xxhash64(F.lit("front"), k, F.call_function("substring_index", line, F.lit(" "), k)),
                F.xxhash64(F.lit("back"), k, F.call_function("substring_index", line, F.lit(" "), -k))]

    half, shorter = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(half == shorter, F.array(*ends(half))).otherwise(F.array(*ends(half), *ends(shorter)))


def word_hash(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SPAN))


def pair_hash(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(SPAN))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def neighbourhood(lines: DataFrame) -> DataFrame:
    """key and at of each line: itself (at 0) and itself without its word at 1, 2, ...

    A key is the number of words, the sum of their hashes and the sum over neighbouring
    words, so leaving a word out changes it in three terms.
    """
    hashed = lines.select(*LINE, *PLACE, F.size("words").alias("n"), F.concat(F.array(F.lit(0).cast("long")), F.transform("words", word_hash), F.array(F.lit(0).cast("long"))).alias("h"))
    steps = F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: pair_hash(F.element_at("h", i), F.element_at("h", i + 1)))
    summed = hashed.select("*", total(F.col("h")).alias("s"), total(steps).alias("t"))

    def without(i: Column) -> Column:
        left, here, right = (F.element_at("h", i + d) for d in (0, 1, 2))
        t = F.col("t") - pair_hash(left, here) - pair_hash(here, right) + pair_hash(left, right)
        return F.struct(F.xxhash64(F.col("n") - 1, F.col("s") - here, t).alias("key"), i.alias("at"))

    whole = F.array(F.struct(F.xxhash64("n", "s", "t").alias("key"), F.lit(0).alias("at")))
    listed = summed.select(*LINE, *PLACE, F.explode(F.concat(whole, F.transform(F.sequence(F.lit(1), F.col("n")), without))).alias("v"))
    return listed.select("v.key", "v.at", *LINE, F.struct(*PLACE).alias("place"))


def common(a: Column, b: Column) -> Column:
    """Number of equal words at the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(F.array_position(same, False) - 1)


def one_word_apart(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def near_repeats(docs: DataFrame, table: DataFrame, first: DataFrame, min_chars: int | None, text: str, doc_id: str) -> DataFrame:
    """Places of lines whose first occurrence is one word apart from an earlier line."""
    keyed = table.select(*LINE, F.explode("halves").alias("half"))
    shared = materialise(
        keyed.groupBy("half").agg(F.min("line_hash").alias("low"), F.max("line_hash").alias("high")).where("low <> high").select("half"), "shared-halves")
    chosen = keyed.join(if_few(shared), "half", "left_semi").select(*LINE).distinct()
    places = materialise(chosen.join(first, LINE).select(*LINE, "place.*"), "lines-with-shared-half")
    few = if_few(places.select(*LINE, *[F.col(c).alias(f"_{c}") for c in PLACE]))
    at_place = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("line_no") == F.col("_line_no"))
    lines = materialise(
        lines_of(docs, text, doc_id).join(few, at_place).select(*LINE, *PLACE, units(F.col("line"), min_chars).alias("words")).dropDuplicates(LINE), "line-words")
    variants = materialise(neighbourhood(lines), "line-variants")
    met = materialise(variants.groupBy("key").agg(F.min("line_hash").alias("low"), F.max("line_hash").alias("high")).where("low <> high").select("key"), "met-keys")
    meeting = materialise(variants.join(if_few(met), "key", "left_semi"), "meeting-lines")
    # Lines that lack the same place: each with the earliest of them.
    shortened = meeting.where("at > 0")
    earliest = shortened.groupBy("key", "at").agg(F.min(F.struct("place", *LINE)).alias("e"))
    replaced = shortened.join(earliest, ["key", "at"]).where(F.col("place") > F.col("e.place")).select(
        *LINE, F.col("e.line_hash").alias("e_hash"), F.col("e.line_check").alias("e_check"))
    # A whole line and the lines that become equal to it: the later one of each pair.
    whole = meeting.where("at = 0").select("key", *[F.col(c).alias(f"w_{c}") for c in [*LINE, "place"]])
    pairs = shortened.join(whole, "key")
    later = F.col("place") > F.col("w_place")
    longer = pairs.select(
        *[F.when(later, F.col(c)).otherwise(F.col(f"w_{c}")).alias(c) for c in LINE],
        F.when(later, F.col("w_line_hash")).otherwise(F.col("line_hash")).alias("e_hash"),
        F.when(later, F.col("w_line_check")).otherwise(F.col("line_check")).alias("e_check"))
    asked = replaced.unionByName(longer).distinct()
    other = lines.select(F.col("line_hash").alias("e_hash"), F.col("line_check").alias("e_check"), F.col("words").alias("e_words"))
    sure = asked.join(lines, LINE).join(other, ["e_hash", "e_check"]).where(one_word_apart(F.col("words"), F.col("e_words")))
    return sure.select(*PLACE).distinct()


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, text: str = "text", doc_id: str = "doc_id",
            min_chars: int | None = None) -> DataFrame:
    """doc_id, text_hash and line_no (from 0) of every line that repeats an earlier one."""
    line, n = F.col("line"), F.col("n")
    long_enough = n >= min_words
    halves = F.when(n >= near_words, half_keys(line, n))
    if min_chars is not None:
        long_enough |= F.length(line) >= min_chars
        halves = F.when(unspaced(line, min_chars), half_keys(line, F.length(line), by_chars=True)).when(n >= near_words, half_keys(line, n))
    listed = lines_of(docs, text, doc_id).withColumn("n", word_count(line)).where(long_enough)
    table = materialise(listed.select(
        *PLACE, "n", F.xxhash64("line").alias("line_hash"), F.hash("line").alias("line_check"),
        halves.otherwise(F.array().cast("array<bigint>")).alias("halves")), "lines")
    first = table.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("place"), F.count("*").alias("times"))
    again = first.where("times > 1").select(*LINE, F.col("place").alias("first_place"))
    equal = table.join(again, LINE).where(F.struct(*PLACE) > F.col("first_place")).select(*PLACE)
    near = near_repeats(docs, table, first.select(*LINE, "place"), min_chars, text, doc_id)
    return equal.unionByName(near).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, text: str = "text", doc_id: str = "doc_id",
                    min_chars: int | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines and n_removed.

    All rows stay; a text all of whose lines are repeats becomes empty. Columns named
    n_lines and n_removed are replaced.
    """
    gone = repeats(docs, min_words, near_words, text, doc_id, min_chars)
    listed = gone.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("_gone")).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_gone")
    joined = docs.join(listed, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    shorter = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    columns = [F.when(F.col("_gone").isNull(), F.col(text)).otherwise(shorter).alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *columns, F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).alias("n_removed"))
