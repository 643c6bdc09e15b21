"""Scoring models on a hold-out table, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.forecast import first_moves, forecast_terms, price_from_rate, rmse
from ..operators.layout import SeriesLayout
from ..operators.rules import Sets, antecedent_counts, covariate_terms, forecast_steps
from ..operators.series import series_keys
from .batch_fitness import STRATEGIES, batch_scores


def score_models(
    train: DataFrame,
    test: DataFrame,
    models: DataFrame,
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
    consequent: str = "by_position",
    rate_divisor: float = 100.0,
    align_test: bool = False,
    strategy: str = "batch",
) -> DataFrame:
    """``(key, model, rmse)``: rules of each model are mined from ``train`` and
    forecast ``test``; keys missing in any of the three tables drop out. A test series of
    one point has nothing to forecast: its rmse is NULL and counts in no mean.

    ``train`` and ``test`` are indexed series. They are read more than once, so
    pass written or settled tables rather than long plans.

    ``batch`` mines and forecasts in Arrow batches of many series, where the layout proves
    that all are short; ``relational``, and ``batch`` for longer ones, forms a row for each
    antecedent of a step. Both give the same.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    terms = covariate_terms(models)
    known = models.join(series_keys(train), "key").join(series_keys(test), "key")
    if terms and strategy == "batch" and layout.whole_keys:
        tried = forecast_steps(test, layout, aligned=align_test)
        return batch_scores(forecast_steps(train, layout), tried, known, sets, consequent, rate_divisor)
    counts = None
    if terms:
        counts = antecedent_counts(forecast_steps(train, layout), known, terms, layout, sets)
    forecast = forecast_terms(
        forecast_steps(test, layout, aligned=align_test), first_moves(test, sets),
        counts, known, terms, layout, sets, consequent=consequent,
    )
    return rmse(price_from_rate(forecast, rate_divisor, keep_head=True), least=2)


def mean_score(scores: DataFrame) -> DataFrame:
    """Mean RMSE over the models of a key."""
    return scores.groupBy("key").agg(F.avg("rmse").alias("rmse"))


def report_sorted(means: DataFrame) -> DataFrame:
    """Scores in key order (a range-partitioned sort)."""
    return means.orderBy("key")


def report_slice_mean(means: DataFrame, skip: int = 1, take: int = 9) -> DataFrame:
    """Mean score of ``take`` keys after the first ``skip`` in key order; NULL if
    there are none. Only skip + take rows leave the tasks."""
    few = means.orderBy("key").limit(skip + take)
    place = F.row_number().over(Window.orderBy("key"))
    return (
        few.select("rmse", place.alias("place")).where(F.col("place") > skip)
        .agg(F.avg("rmse").alias("slice_mean"))
    )


def write_scores(means: DataFrame, path: str) -> None:
    """Write a score table as parquet."""
    means.write.parquet(path)
