"""Boosted stumps over integer columns: an exact fit in aggregates.

Each round looks at every cut of every column. Rows are reduced to the distinct values of
each column (count, sum of what is left to explain) in one pass, running sums over the
values give both sides of each cut, and the cut that explains most becomes a stump. Prices
are whole numbers and so are the values of leaves, so sums are exact, the order of rows does
not matter and the fit is the same on any cluster.

A missing value goes to the left of every cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plotwise.functions.numbers import half_even


@dataclass(frozen=True)
class Stump:
    """Rows with ``feature`` up to ``cut``, or without it, get ``left``, the others ``right``."""

    feature: str
    cut: int
    left: int
    right: int
    gain: float

    def value(self) -> Column:
        return F.when(F.col(self.feature).cast("bigint") > self.cut, F.lit(self.right)).otherwise(F.lit(self.left)).cast("bigint")


@dataclass(frozen=True)
class StumpModel:
    target: str
    features: tuple[str, ...]
    base: int
    stumps: tuple[Stump, ...]

    def value(self) -> Column:
        return reduce(lambda total, s: total + s.value(), self.stumps, F.lit(self.base).cast("bigint"))


def value_sums(rows: DataFrame, features: Sequence[str], left_over: Column) -> DataFrame:
    """feature, value, n and s: rows with a value, and what is left to explain over them."""
    named = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("bigint").alias("value")) for f in features])
    return rows.select(F.explode(named).alias("x"), left_over.alias("r")).groupBy("x.feature", "x.value").agg(
        F.count("*").alias("n"), F.sum("r").alias("s"))


def best_cut(sums: DataFrame, shrink: int) -> Stump | None:
    """The cut of the largest gain; of equal ones the first by name and value. One row comes to the driver."""
    upto = Window.partitionBy("feature").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("feature")
    sides = sums.select(
        "feature", "value", F.sum("n").over(upto).alias("ln"), F.sum("s").over(upto).alias("ls"),
        (F.sum("n").over(whole) - F.sum("n").over(upto)).alias("rn"), (F.sum("s").over(whole) - F.sum("s").over(upto)).alias("rs"))

    def explained(s: Column, n: Column) -> Column:
        return s.cast("double") * s.cast("double") / n.cast("double")

    ln, ls, rn, rs = map(F.col, ("ln", "ls", "rn", "rs"))
    gain = explained(ls, ln) + explained(rs, rn) - explained(ls + rs, ln + rn)
    leaf = [F.floor(s.cast("double") / (n * shrink).cast("double")).cast("bigint").alias(name) for s, n, name in ((ls, ln, "left"), (rs, rn, "right"))]
    cuts = sides.where(F.col("value").isNotNull() & (rn > 0)).select("feature", "value", *leaf, gain.alias("gain"))
    best = cuts.orderBy(F.desc("gain"), "feature", "value").first()
    return Stump(best["feature"], best["value"], best["left"], best["right"], best["gain"]) if best else None


def fit(rows: DataFrame, target: str, features: Sequence[str], rounds: int = 8, shrink: int = 2) -> StumpModel:
    """A stump for each round, each worth 1 / ``shrink`` of what it explains.

    Rows without a target are left out. Without rows, or where no column has two values,
    fewer stumps are grown.
    """
    known = rows.where(F.col(target).isNotNull())
    label = F.col(target).cast("bigint")
    start = known.agg(F.floor(F.sum(label).cast("double") / F.count("*")).cast("bigint")).first()[0]
    model = StumpModel(target, tuple(features), start or 0, ())
    for _ in range(rounds):
        stump = best_cut(value_sums(known, features, label - model.value()), shrink)
        if stump is None or stump.gain <= 0:
            break
        model = StumpModel(target, model.features, model.base, (*model.stumps, stump))
    return model


def score(model: StumpModel, rows: DataFrame) -> DataFrame:
    return rows.withColumn("predicted", model.value().cast("double"))


def stump_table(spark: SparkSession, model: StumpModel) -> DataFrame:
    rows = [(i, s.feature, s.cut, s.left, s.right, s.gain) for i, s in enumerate(model.stumps, 1)]
    return spark.createDataFrame(rows, "round int, feature string, cut bigint, left_value bigint, right_value bigint, gain double")


def importance_table(spark: SparkSession, model: StumpModel) -> DataFrame:
    """Share of each column in all that the stumps explain, in percent, largest first."""
    total = sum(s.gain for s in model.stumps)
    rows = [(f, float(sum(s.gain for s in model.stumps if s.feature == f))) for f in model.features]
    table = spark.createDataFrame(rows, "feature string, gain double")
    return table.select("feature", half_even(F.col("gain") / F.lit(total or 1.0) * 100, 2).alias("importance")).orderBy(F.desc("importance"), "feature")
