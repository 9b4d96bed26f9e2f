"""Error metrics and the tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.tidy import wide_to_rows
from seriesloom.settings import (
    LONG_TOLERANCE,
    PERCENT_EPSILON,
    SHORT_HORIZONS,
    SHORT_TOLERANCE,
)
from seriesloom.functions.dates import month_label

METRICS = ("rmse", "mae", "mape")


def metric_columns(y: str, p: str, skip_zero: bool = False) -> dict[str, Column]:
    """RMSE, MAE and MAPE in percent over rows with both values.

    A zero actual makes the MAPE of its group missing; with `skip_zero` such rows are left
    out of the MAPE only.
    """
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    error = F.when(both, F.col(y) - F.col(p))
    share = F.abs(F.try_divide(error, F.col(y)))
    mape = F.avg(share) * 100
    if not skip_zero:
        mape = F.when(F.count_if(both & (F.col(y) == 0)) == 0, mape)
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "mape": mape,
    }


def error_metrics(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_pred",
    keys: list[str] | None = None,
    skip_zero: bool = False,
) -> DataFrame:
    columns = metric_columns(y, p, skip_zero)
    return df.groupBy(*(keys or [])).agg(*[e.alias(n) for n, e in columns.items()])


def metrics_summary(
    df: DataFrame, models: dict[str, str], keys: list[str], y: str = "y_true"
) -> DataFrame:
    """One row per key and model: metrics of several prediction columns in one pass."""
    parts = list(METRICS)
    aggregates = [
        e.alias(f"{name}_{model}")
        for model, column in models.items()
        for name, e in metric_columns(y, column).items()
    ]
    return wide_to_rows(
        df.groupBy(*keys).agg(*aggregates), list(models), parts, "model", keep=keys
    )


def metrics_mean(summary: DataFrame, keys: list[str] | None = None, decimals: int = 4) -> DataFrame:
    """Mean of the fold metrics by horizon and model."""
    by = keys or ["horizon", "model"]
    return summary.groupBy(*by).agg(*[F.round(F.avg(m), decimals).alias(m) for m in METRICS])


def best_model(means: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Model with the smallest mean MAPE per horizon; the first by name on a tie."""
    by = keys or ["horizon"]
    scored = F.when(F.col("mape").isNotNull(), F.struct("mape", "model"))
    return means.groupBy(*by).agg(
        F.min_by("model", scored).alias("model"),
        F.min("mape").alias("mape"),
    )


def metrics_crosstab(
    means: DataFrame, models: list[str], keys: list[str] | None = None, decimals: int = 2
) -> DataFrame:
    """MAPE with one row per horizon and one column per model; absent pairs are NULL."""
    return means.groupBy(*(keys or ["horizon"])).agg(
        *[F.round(F.max(F.when(F.col("model") == m, F.col("mape"))), decimals).alias(m) for m in models]
    )


def seasonal_error(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", date: str = "date", keys: list[str] | None = None
) -> DataFrame:
    """Mean absolute and percent error by calendar month, per key; all twelve months are present."""
    by = keys or []
    error = F.abs(F.col(y) - F.col(p))
    monthly = df.groupBy(*by, F.month(date).alias("month")).agg(
        F.avg(error).alias("abs_error"),
        F.avg(error / (F.abs(y) + PERCENT_EPSILON) * 100).alias("pct_error"),
    )
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    months = groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return months.join(monthly, [*by, "month"], "left").select(
        *by, "month", month_label(F.col("month")).alias("label"), "abs_error", "pct_error"
    )


def tolerance_status(
    before: DataFrame, after: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Whether recalibration kept the MAPE within the tolerance of its horizon."""
    by = keys or ["horizon", "model"]
    tolerance = F.when(F.col("horizon").isin(*SHORT_HORIZONS), F.lit(SHORT_TOLERANCE)).otherwise(
        F.lit(LONG_TOLERANCE)
    )
    joined = before.select(*by, F.col("mape").alias("mape_before")).join(
        after.select(*by, F.col("mape").alias("mape_after")), by
    )
    delta = F.col("mape_after") - F.col("mape_before")
    return joined.select(
        *by,
        "mape_before",
        "mape_after",
        delta.alias("delta"),
        tolerance.alias("tolerance"),
        F.when(delta <= tolerance, F.lit("ok")).otherwise(F.lit("degradou")).alias("status"),
    )


def distinct_sorted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
