"""Reports over listing phrases and over the parsed feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions.features import FEATURE_COLUMNS
from plotwise.operators import market

# Ordered category rules and the patterns that count as caught.
CATEGORY_RULES: tuple[tuple[str, str], ...] = (
    ("bedrooms", r"(\d+|one|two|three|four|five|six)\s*(double\s*)?bed"),
    ("bathrooms", r"(\d+|one|two|three|four|five)\s*bath"),
    ("parking", r"parking|garage|driveway|off.street"),
    ("garden", r"garden|balcony|terrace|patio|outdoor"),
    ("heating", r"heating|underfloor|boiler"),
    ("epc_rating", r"epc|energy"),
    ("council_tax", r"council.tax"),
    ("chain_status", r"chain|onward"),
    ("property_type",
     r"detached|semi.detached|terraced|maisonette|flat|apartment|bungalow|cottage|penthouse|townhouse"),
    ("glazing", r"glaz"),
    ("lease", r"lease|freehold|share.of"),
    ("kitchen", r"kitchen"),
    ("reception", r"reception|lounge|living|sitting"),
)
CAUGHT_PATTERNS: tuple[str, ...] = (
    r"(\d+|one|two|three|four|five|six)\s*(double\s*)?bed",
    r"(\d+|one|two|three|four|five)\s*bath",
    r"parking|garage|driveway|off.street",
    r"garden|balcony|terrace|patio|outdoor",
    r"heating|underfloor|boiler",
    r"epc|energy",
    r"council.tax",
    r"chain|onward",
    r"detached|semi.detached|terraced|maisonette|flat|apartment|bungalow",
    r"glaz",
    r"lease|freehold|share.of",
    r"kitchen",
    r"reception|lounge|living|sitting",
    r"^(un)?furnished",
    r"part.furnished",
    r"period\s*(features|property|house|home|character)",
    r"utility\s*room",
    r"conservatory",
    r"en[\s-]?suite",
    r"cloakroom|downstairs\s*w\.?c|separate\s*wc",
    r"ground\s*floor|first\s*floor|second\s*floor|top\s*floor|basement|lower\s*ground",
    r"\d[\d,]*\s*sq\s*\.?\s*ft",
    r"service\s*(charge|/maintenance)",
    r"ground\s*rent",
    r"wood(?:en)?\s*floor|hardwood\s*floor",
    r"\bgym\b",
    r"\blift\b|elevator",
    r"\bdining\s*room\b",
    r"\bev\s*charg|charging\s*point",
    r"fireplace|log\s*burner|wood\s*burner|open\s*fire",
)
# Words of which any match of the pattern holds one; patterns of plain words need none.
PATTERN_WORDS: dict[str, str] = {
    r"(\d+|one|two|three|four|five|six)\s*(double\s*)?bed": "bed",
    r"(\d+|one|two|three|four|five)\s*bath": "bath",
    r"parking|garage|driveway|off.street": "parking|garage|driveway|street",
    r"council.tax": "council",
    r"detached|semi.detached|terraced|maisonette|flat|apartment|bungalow": "detached|terraced|maisonette|flat|apartment|bungalow",
    r"detached|semi.detached|terraced|maisonette|flat|apartment|bungalow|cottage|penthouse|townhouse": "detached|terraced|maisonette|flat|apartment|bungalow|cottage|penthouse|townhouse",
    r"lease|freehold|share.of": "lease|freehold|share",
    r"^(un)?furnished": "furnished",
    r"part.furnished": "furnished",
    r"period\s*(features|property|house|home|character)": "period",
    r"utility\s*room": "utility",
    r"en[\s-]?suite": "suite",
    r"cloakroom|downstairs\s*w\.?c|separate\s*wc": "cloakroom|downstairs|separate",
    r"ground\s*floor|first\s*floor|second\s*floor|top\s*floor|basement|lower\s*ground": "floor|basement|ground",
    r"\d[\d,]*\s*sq\s*\.?\s*ft": "sq",
    r"service\s*(charge|/maintenance)": "service",
    r"ground\s*rent": "ground",
    r"wood(?:en)?\s*floor|hardwood\s*floor": "floor",
    r"\bgym\b": "gym",
    r"\blift\b|elevator": "lift|elevator",
    r"\bdining\s*room\b": "dining",
    r"\bev\s*charg|charging\s*point": "charg",
    r"fireplace|log\s*burner|wood\s*burner|open\s*fire": "fireplace|burner|open",
}
TOP_VALUES = 10


def phrases_of(df: DataFrame, array_column: str) -> DataFrame:
    """One row per non-empty phrase."""
    lines = df.select(F.explode(array_column).alias("phrase"))
    return lines.select(F.trim("phrase").alias("phrase")).where(F.col("phrase") != "")


def phrase_counts(phrases: DataFrame) -> DataFrame:
    """Distinct phrases with their counts: every later step works on these."""
    counts = phrases.groupBy("phrase").agg(F.count("*").alias("count"))
    return counts.withColumn("low", F.lower("phrase"))


def _search(pattern: str) -> Column:
    """Case-insensitive search; the pattern runs only where one of its words is."""
    words = PATTERN_WORDS.get(pattern, pattern).split("|")
    found = F.contains("low", F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains("low", F.lit(word))
    if pattern in PATTERN_WORDS:
        return found & F.col("phrase").rlike("(?i)" + pattern)
    return found


def is_caught() -> Column:
    """True when any known pattern matches the phrase."""
    caught = _search(CAUGHT_PATTERNS[0])
    for pattern in CAUGHT_PATTERNS[1:]:
        caught = caught | _search(pattern)
    return caught


def uncaught_phrases(phrases: DataFrame, at_least: int = 3) -> DataFrame:
    """Phrases no pattern catches, with the ones seen often enough.

    Patterns run once per distinct phrase that is frequent enough. The condition is
    one expression over the count, or the optimiser would move the pattern part
    below the aggregation and run it once per mention.
    """
    frequent_and_missed = F.when(F.col("count") >= at_least, ~is_caught())
    return (
        phrase_counts(phrases).where(frequent_and_missed)
        .select("phrase", "count").orderBy(F.desc("count"), "phrase")
    )


def caught_totals(phrases: DataFrame) -> DataFrame:
    """One row: mentions, caught, uncaught, share uncaught, distinct uncaught."""
    judged = phrase_counts(phrases).withColumn("caught", is_caught())
    missed = F.sum(F.when(~F.col("caught"), F.col("count")).otherwise(0))
    return judged.agg(
        F.sum("count").alias("mentions"),
        F.sum(F.when(F.col("caught"), F.col("count")).otherwise(0)).alias("caught"),
        missed.alias("uncaught"),
        F.bround(missed * 100.0 / F.sum("count"), 1).alias("uncaught_pct"),
        F.count_if(~F.col("caught")).alias("uncaught_unique"),
    )


def phrase_category() -> Column:
    """First category rule that matches, else ``other``."""
    label = F.when(_search(CATEGORY_RULES[0][1]), CATEGORY_RULES[0][0])
    for name, pattern in CATEGORY_RULES[1:]:
        label = label.when(_search(pattern), name)
    return label.otherwise("other")


def category_totals(phrases: DataFrame) -> DataFrame:
    return phrase_counts(phrases).groupBy(phrase_category().alias("category")).agg(
        F.count("*").alias("unique_phrases"), F.sum("count").alias("mentions")
    )


def category_top_phrases(phrases: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """Most frequent phrases per category; the rank limit applies before the shuffle."""
    best = Window.partitionBy("category").orderBy(F.desc("count"), "phrase")
    return (
        phrase_counts(phrases).withColumn("category", phrase_category())
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("low")
    )


def fill_rates(features: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Filled rows, all rows and percentage per parsed column, from one aggregate."""
    counted = features.agg(
        F.count("*").alias("_total"), *[F.count(c).alias(c) for c in columns]
    )
    long = counted.unpivot("_total", list(columns), "feature", "filled")
    return long.select(
        "feature", "filled", F.col("_total").alias("total"),
        F.bround(F.col("filled") / F.nullif(F.col("_total"), F.lit(0)) * 100, 1).alias("pct"),
    )


def fill_totals(rates: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Filled values per version group, e.g. ``{"views": "v2"}``, others ``v1``."""
    label = F.lit("v1")
    for group in sorted(set(groups.values())):
        members = [c for c, g in groups.items() if g == group]
        label = F.when(F.col("feature").isin(*members), F.lit(group)).otherwise(label)
    share = F.sum("filled") / F.nullif(market.single_row(rates.agg(F.sum("filled").alias("s")))["s"], F.lit(0))
    return rates.groupBy(label.alias("version")).agg(
        F.sum("filled").alias("filled"), F.bround(share * 100, 1).alias("pct")
    )


def value_distribution(features: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS,
                       top: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of every parsed column, in one pass."""
    as_text = features.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = as_text.unpivot([], list(columns), "feature", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("count"))
    best = Window.partitionBy("feature").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
