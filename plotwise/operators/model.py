"""Price models on Spark ML: split, train, score, measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plotwise.functions.numbers import half_even
from plotwise.operators.dataset import feature_kinds
from plotwise.session import materialise

DEFAULT_CUTOFF = "2024-01-01"
TEST_RATIO, SPLIT_SEED = 0.2, 42
MIN_ROWS, MIN_TRAIN_ROWS, MIN_TEST_ROWS = 20, 5, 2
# Rows that the overall mean counts for in the mean of a category.
PRIOR_ROWS = 10.0
SPLIT_BUCKETS = 10000
FOLDS = 5


def _split_hash() -> Column:
    return F.xxhash64("sale_id", F.lit(SPLIT_SEED))


def split(data: DataFrame, strategy: str = "temporal", cutoff: str = DEFAULT_CUTOFF,
          test_ratio: float = TEST_RATIO, max_train_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows.

    The random split hashes the sale id, so it is the same on every run and
    cluster. A row cap keeps the training rows with the smallest hashes.
    """
    if strategy == "temporal":
        in_test = F.col("date_sold_iso") >= cutoff
        train, test = data.where(F.col("date_sold_iso") < cutoff), data.where(in_test)
    else:
        in_test = F.pmod(_split_hash(), F.lit(SPLIT_BUCKETS)) < int(test_ratio * SPLIT_BUCKETS)
        train, test = data.where(~in_test), data.where(in_test)
    if max_train_rows:
        train = train.orderBy(_split_hash(), "sale_id").limit(max_train_rows)
    return train, test


@dataclass
class PriceModel:
    """A fitted model with what is needed to prepare rows for it."""

    fitted: PipelineModel
    target: str
    numeric: list[str]
    categorical: list[str]
    log_transform: bool = False
    encodings: dict[str, DataFrame] = field(default_factory=dict)
    overall: float = 0.0
    importances: list[tuple[str, float]] = field(default_factory=list)


def _missing(name: str) -> str:
    return f"{name}__missing"


def _category(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def encode_categories(rows: DataFrame, categorical: Sequence[str], label: str) -> tuple[dict[str, DataFrame], float]:
    """Mean label of every category of the training rows, drawn to the overall mean where rows are few.

    Each category keeps a value of its own, however many there are; the tables are as
    long as the categories and are joined, never collected.
    """
    overall = rows.agg(F.avg(label)).first()[0] or 0.0
    tables = {}
    for c in categorical:
        mean = (F.sum(label) + F.lit(PRIOR_ROWS * overall)) / (F.count(label) + F.lit(PRIOR_ROWS))
        tables[c] = materialise(rows.groupBy(_category(c).alias(f"{c}__key")).agg(mean.alias(f"{c}__mean")), "encoding")
    return tables, overall


def means_of_other_folds(rows: DataFrame, category: str, label: str, overall: float, fold: Column) -> DataFrame:
    """``rows`` with the mean label of their category over the rows of other folds.

    A training row must not see its own label; drawn to the overall mean like
    ``encode_categories``, and equal to it where no other fold has the category.
    """
    placed = rows.withColumn("_fold", fold)
    cells = placed.groupBy(_category(category).alias("_key"), F.col("_fold").alias("_of")).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    whole = Window.partitionBy("_key")  # one row per fold
    mean = (F.sum("_s").over(whole) - F.coalesce("_s", F.lit(0.0)) + F.lit(PRIOR_ROWS * overall)) / (F.sum("_n").over(whole) - F.col("_n") + F.lit(PRIOR_ROWS))
    table = cells.select("_key", "_of", mean.alias(f"{category}__mean"))
    joined = placed.join(table, (_category(category) == F.col("_key")) & F.col("_fold").eqNullSafe(F.col("_of")), "left")
    return joined.drop("_key", "_of", "_fold").fillna({f"{category}__mean": overall})


def prepare_training(data: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, overall: float) -> DataFrame:
    """As ``prepare``, with categories by the mean of the other folds."""
    ready = prepare(data, numeric, {}, overall)
    for c in categorical:
        ready = means_of_other_folds(ready, c, label, overall, F.pmod(F.xxhash64("sale_id", F.lit(SPLIT_SEED + 1)), F.lit(FOLDS)))
    return ready


def prepare(data: DataFrame, numeric: Sequence[str], encodings: dict[str, DataFrame], overall: float) -> DataFrame:
    """Numbers with a missing flag, categories as their mean label; unseen ones get the overall mean."""
    ready = data.select("*", *[F.col(c).isNull().cast("double").alias(_missing(c)) for c in numeric])
    for c, table in encodings.items():
        ready = ready.join(table, _category(c) == F.col(f"{c}__key"), "left").drop(f"{c}__key").fillna({f"{c}__mean": overall})
    return ready


def _varying(data: DataFrame, numeric: Sequence[str]) -> list[str]:
    """Numeric columns that hold any value: an empty one cannot be imputed.

    One aggregate row with a count per chosen column comes to the driver.
    """
    if not numeric:
        return []
    filled = data.agg(*[F.count(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if filled[c]]


def train(rows: DataFrame, target: str, features: Sequence[str], log_transform: bool = False,
          rounds: int = 100, depth: int = 6, learning_rate: float = 0.1) -> PriceModel:
    """Gradient-boosted regression over numeric and categorical features."""
    kinds = feature_kinds()
    present = [f for f in features if f in rows.columns and f != target]
    if not present:
        raise ValueError("no usable features in the dataset")
    categorical = [f for f in present if kinds.get(f) == "categorical"]
    rows = rows.where(F.col(target).isNotNull())
    numeric = _varying(rows, [f for f in present if f not in categorical])
    label = F.log1p(F.col(target)) if log_transform else F.col(target)
    labelled = rows.withColumn("_label", label.cast("double"))
    encodings, overall = encode_categories(labelled, categorical, "_label")
    ready = materialise(prepare_training(labelled, numeric, categorical, "_label", overall), "training-rows")
    inputs = (
        [f"{c}__filled" for c in numeric] + [_missing(c) for c in numeric]
        + [f"{c}__mean" for c in categorical]
    )
    stages = []
    if numeric:
        stages.append(Imputer(inputCols=numeric, outputCols=[f"{c}__filled" for c in numeric],
                              strategy="mean"))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep"))
    stages.append(GBTRegressor(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=rounds,
        maxDepth=depth, stepSize=learning_rate, seed=SPLIT_SEED, cacheNodeIds=False,
    ))
    fitted = Pipeline(stages=stages).fit(ready)
    weights = fitted.stages[-1].featureImportances.toArray()
    shares: dict[str, float] = {}
    for column, weight in zip(inputs, weights):
        name = column.rsplit("__", 1)[0]
        shares[name] = shares.get(name, 0.0) + float(weight)
    return PriceModel(fitted, target, numeric, categorical, log_transform, encodings, overall,
                      sorted(shares.items(), key=lambda kv: -kv[1]))


def score(model: PriceModel, rows: DataFrame) -> DataFrame:
    """Add ``predicted`` on the original scale."""
    scored = model.fitted.transform(prepare(rows, model.numeric, model.encodings, model.overall))
    raw = F.expm1("_prediction") if model.log_transform else F.col("_prediction")
    return scored.select(*rows.columns, raw.alias("predicted"))


def with_residual(scored: DataFrame, target: str) -> DataFrame:
    return scored.withColumns({
        "actual": F.col(target).cast("double"),
        "residual": F.col("predicted") - F.col(target).cast("double"),
    })


def metrics(residuals: DataFrame) -> DataFrame:
    """R², RMSE, MAE and MAPE; actual zeros are left out of MAPE.

    The total sum of squares comes from the variance of the same pass.
    """
    miss = F.col("residual")
    stats = residuals.agg(
        F.count("*").alias("n"),
        F.sum(miss * miss).alias("ss_res"),
        (F.var_pop("actual") * F.count("*")).alias("ss_tot"),
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(F.when(F.col("actual") != 0, F.abs(miss / F.nullif(F.col("actual"), F.lit(0.0))))).alias("mape"),
    )
    return stats.select(
        "n",
        half_even(F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0), 4)
        .alias("r_squared"),
        half_even(F.sqrt(F.col("ss_res") / F.col("n")), 2).alias("rmse"),
        half_even(F.col("mae"), 2).alias("mae"),
        half_even(F.coalesce(F.col("mape"), F.lit(0.0)) * 100, 2).alias("mape"),
    )


def worst_predictions(residuals: DataFrame, limit: int = 10) -> DataFrame:
    return residuals.orderBy(F.desc(F.abs("residual")), "sale_id").limit(limit)


def importance_table(spark, model: PriceModel) -> DataFrame:
    """Feature importance as a share of the total, largest first."""
    rows = spark.createDataFrame(model.importances, "feature string, weight double")
    total = rows.agg(F.sum("weight").alias("t")).scalar()
    share = F.when(total > 0, half_even(F.col("weight") / total * 100, 2)).otherwise(0.0)
    return rows.select("feature", share.alias("importance")).orderBy(F.desc("importance"), "feature")


def predictions(scored: DataFrame) -> DataFrame:
    """Predicted value against the last sale price, highest value first."""
    value = half_even(F.col("predicted"), 2)
    last = F.nullif(F.col("last_sale_price").cast("double"), F.lit(0.0))
    return scored.select(
        "property_id", "address", value.alias("predicted_value"), "last_sale_price",
        half_even(value - last, 2).alias("difference"),
        half_even((value - last) / last * 100, 1).alias("difference_pct"),
    ).orderBy(F.desc("predicted_value"), "property_id")


def save(spark: SparkSession, model: PriceModel, path: str) -> None:
    """Store the fitted stages and the column roles below one path."""
    model.fitted.write().overwrite().save(f"{path}/stages")
    roles = [(model.target, model.numeric, model.categorical, model.log_transform, model.overall)]
    spark.createDataFrame(
        roles, "target string, numeric array<string>, categorical array<string>, log_transform boolean, overall double"
    ).write.mode("overwrite").parquet(f"{path}/roles")
    for name, table in model.encodings.items():
        table.write.mode("overwrite").parquet(f"{path}/encodings/{name}")


def load(spark: SparkSession, path: str) -> PriceModel:
    roles = spark.read.parquet(f"{path}/roles").first()
    categorical = list(roles["categorical"])
    encodings = {name: spark.read.parquet(f"{path}/encodings/{name}") for name in categorical}
    return PriceModel(PipelineModel.load(f"{path}/stages"), roles["target"], list(roles["numeric"]),
                      categorical, roles["log_transform"], encodings, roles["overall"])


def residual_histogram(residuals: DataFrame, buckets: int = 20) -> DataFrame:
    """Residual counts in equal-width bins between the extremes."""
    extremes = residuals.agg(F.struct(F.min("residual").alias("lo"), F.max("residual").alias("hi"))).scalar()
    placed = residuals.select("residual", extremes.alias("_x"))
    width = F.nullif((F.col("_x.hi") - F.col("_x.lo")) / buckets, F.lit(0.0))
    slot = F.coalesce(F.least(F.floor((F.col("residual") - F.col("_x.lo")) / width), F.lit(buckets - 1)), F.lit(0))
    return placed.groupBy(slot.cast("int").alias("bucket")).agg(
        F.count("*").alias("count"), F.min("residual").alias("min_residual"),
        F.max("residual").alias("max_residual"),
    ).orderBy("bucket")
