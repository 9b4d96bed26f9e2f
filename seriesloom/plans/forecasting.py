"""Forecast tables from fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.calendar import day
from seriesloom.operators.relevance import impute_medians
from seriesloom.operators.tidy import date_slice, latest_complete_row
from seriesloom.plans.training import BOOSTED, FOREST, model_features

Models = dict[int, dict[str, PipelineModel]]


def shift_to_target_date(df: DataFrame, horizon: str = "horizon", date: str = "date") -> DataFrame:
    """Move forecasts from the day they were made to the day they are for."""
    return df.select(
        *[
            F.date_add(F.col(date), F.col(horizon).cast("int")).alias(date) if c == date else F.col(c)
            for c in df.columns
        ]
    )


def forecast_latest(df: DataFrame, models: Models, series: str = "series_id") -> DataFrame:
    """Forecasts of both families and their mean from the latest complete row per series."""
    parts = []
    for h, pair in models.items():
        features = model_features(next(iter(pair.values())))
        rows = latest_complete_row(df, features, series)
        for model in pair.values():
            keep = rows.columns
            rows = model.transform(rows).select(*keep, model.stages[-1].getPredictionCol())
        both = (F.col(f"pred_{BOOSTED}") + F.col(f"pred_{FOREST}")) / 2
        parts.append(
            rows.select(
                series,
                F.lit(h).alias("horizon"),
                "as_of_date",
                "feature_date",
                F.date_add("as_of_date", h).alias("forecast_date"),
                F.round(f"pred_{BOOSTED}", 2).alias(f"pred_{BOOSTED}"),
                F.round(f"pred_{FOREST}", 2).alias(f"pred_{FOREST}"),
                F.round(both, 2).alias("pred_mean"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def forecast_period(
    df: DataFrame, models: Models, start: str, end: str, series: str = "series_id"
) -> DataFrame:
    """Forecasts of both families for every day of a period; medians are the period's own."""
    period = date_slice(df, start, end)
    parts = []
    for h, pair in models.items():
        features = model_features(next(iter(pair.values())))
        target = f"target_h{h}d"
        actual = F.col(target) if target in df.columns else F.lit(None).cast("double")
        rows = impute_medians(
            period.select(series, "date", actual.alias("y_true"), *features), features
        )
        for model in pair.values():
            keep = rows.columns
            rows = model.transform(rows).select(*keep, model.stages[-1].getPredictionCol())
        parts.append(
            rows.select(
                series,
                "date",
                F.lit(h).alias("horizon"),
                F.round("y_true", 2).alias("y_true"),
                *[F.round(f"pred_{k}", 2).alias(f"pred_{k}") for k in pair],
            )
        )
    return reduce(DataFrame.unionByName, parts)


def forecast_vs_actual(
    actuals: DataFrame,
    oof: DataFrame,
    start: str,
    horizons: list[int],
    price: str = "price_a",
    prediction: str = "y_pred",
    series: str = "series_id",
) -> DataFrame:
    """Actual prices from `start` on, with the forecasts of each horizon at their target date.

    One column per horizon. Forecasts may reach past the last actual by their horizon; those
    days are kept with a missing actual.
    """
    shifted = shift_to_target_date(oof).where(
        (F.col("date") >= day(start)) & F.col("horizon").isin(*horizons)
    )
    known = actuals.where(F.col("date") >= day(start))
    stacked = known.select(
        series, "date", F.col(price).alias("actual"), *[F.lit(None).cast("double").alias(f"h{h}") for h in horizons]
    ).unionByName(
        shifted.select(
            series,
            "date",
            F.lit(None).cast("double").alias("actual"),
            *[F.when(F.col("horizon") == h, F.col(prediction)).alias(f"h{h}") for h in horizons],
        )
    )
    return stacked.groupBy(series, "date").agg(
        F.max("actual").alias("actual"), *[F.max(f"h{h}").alias(f"h{h}") for h in horizons]
    )
