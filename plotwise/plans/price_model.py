"""Train a price model on the assembled dataset and report on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plotwise.operators import dataset, model
from plotwise.session import materialise


@dataclass(frozen=True)
class TrainingReport:
    model: model.PriceModel
    metrics: DataFrame
    importances: DataFrame
    predictions: DataFrame
    train_size: int
    test_size: int


def train(sales: DataFrame, properties: DataFrame, crime: DataFrame | None, features: Sequence[str],
          target: str = "price_numeric", strategy: str = "temporal", cutoff: str = model.DEFAULT_CUTOFF,
          test_ratio: float = model.TEST_RATIO, max_train_rows: int | None = None,
          log_transform: bool = False, **settings) -> TrainingReport:
    """Assemble, split, fit and measure. The dataset is written once, as training
    passes over it many times."""
    if target == "price_change_pct":
        data = dataset.price_change_dataset(sales, properties, crime, features)
    else:
        data = dataset.price_dataset(sales, properties, crime, features, target)
    data = materialise(data, "training-data")
    rows, held_out = model.split(data, strategy, cutoff, test_ratio, max_train_rows)
    train_size, test_size = rows.count(), held_out.count()
    if train_size + test_size < model.MIN_ROWS:
        raise ValueError(f"dataset too small: {train_size + test_size} rows")
    if train_size < model.MIN_TRAIN_ROWS:
        raise ValueError(f"training set too small: {train_size} rows")
    if test_size < model.MIN_TEST_ROWS:
        raise ValueError(f"test set too small: {test_size} rows")
    fitted = model.train(rows, target, features, log_transform, **settings)
    scored = model.with_residual(model.score(fitted, held_out), target)
    return TrainingReport(
        fitted, model.metrics(scored), model.importance_table(sales.sparkSession, fitted),
        scored, train_size, test_size,
    )


def predict(report: TrainingReport, sales: DataFrame, properties: DataFrame, crime: DataFrame | None,
            features: Sequence[str], prediction_date: str | None = None) -> DataFrame:
    """Predictions for every property, next to its last sale price."""
    rows = dataset.scoring_dataset(sales, properties, crime, features, prediction_date)
    return model.predictions(model.score(report.model, rows))
