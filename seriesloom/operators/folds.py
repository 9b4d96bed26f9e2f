"""Walk-forward folds and naive baselines.

A fold assignment is a column, not a list of index arrays: row `i` of a series belongs to
the test part of one fold (or none) and to the training part of all later folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.features import (
    baseline_columns,
    target_columns,
    with_columns,
)
from seriesloom.operators.metrics import METRICS, metric_columns
from seriesloom.settings import HORIZONS, MIN_TRAIN_DAYS, N_FOLDS, TARGET_PRICE


def fold_number(row: Column, n: Column, min_train: int, n_folds: int) -> Column:
    """Test fold (1..n_folds) of the zero-based row; NULL when it is never tested.

    The test size is (n - min_train) div n_folds. Leftover rows at the end are never tested,
    and a series with too few rows has no folds.
    """
    test_size = F.floor((n - min_train) / n_folds)
    number = F.floor(F.try_divide(row - min_train, test_size)) + 1
    return F.when((test_size > 0) & (row >= min_train) & (number <= n_folds), number).cast("int")


def walk_forward_folds(
    df: DataFrame,
    min_train: int = MIN_TRAIN_DAYS,
    n_folds: int = N_FOLDS,
    keys: list[str] | None = None,
    date: str = "date",
) -> DataFrame:
    """Add the zero-based row number per series and the test fold."""
    by = Window.partitionBy(*(keys or ["series_id"]))
    numbered = df.select(
        "*",
        (F.row_number().over(by.orderBy(date)) - 1).alias("row_no"),
        F.count(F.lit(1)).over(by).alias("_n"),
    )
    return numbered.select(
        *df.columns,
        "row_no",
        fold_number(F.col("row_no"), F.col("_n"), min_train, n_folds).alias("fold"),
    )


def fold_boundaries(
    df: DataFrame,
    min_train: int = MIN_TRAIN_DAYS,
    n_folds: int = N_FOLDS,
    keys: list[str] | None = None,
    date: str = "date",
) -> DataFrame:
    """First and last training and test date of every fold.

    Training starts at the first row and ends just before the test part, so both follow from
    the test rows and the row before them; no row is duplicated per fold.
    """
    by = keys or ["series_id"]
    order = Window.partitionBy(*by).orderBy(date)
    whole = Window.partitionBy(*by)
    folds = walk_forward_folds(df.select(*by, date), min_train, n_folds, by, date).select(
        *by,
        date,
        "fold",
        F.min(date).over(whole).alias("_start"),
        F.lag(date).over(order).alias("_before"),
    )
    return (
        folds.where(F.col("fold").isNotNull())
        .groupBy(*by, "fold")
        .agg(
            F.min("_start").alias("train_start"),
            F.min("_before").alias("train_end"),
            F.min(date).alias("test_start"),
            F.max(date).alias("test_end"),
            F.count(F.lit(1)).alias("n_test"),
        )
    )


def panel_fold_dates(
    df: DataFrame,
    min_train: int = MIN_TRAIN_DAYS,
    n_folds: int = N_FOLDS,
    embargo_days: int = 0,
    date: str = "date",
) -> DataFrame:
    """Fold boundaries over the dates of the whole panel: `(fold, train_end, test_start, test_end)`.

    A model trained on many series at once needs one cut for all of them, else one series'
    later rows would train a model tested on another's earlier rows. The set of dates is
    bounded by the calendar, and the result has one row per fold. `embargo_days` moves the
    end of training back so that no training target lies in the test period.
    """
    dates = df.agg(F.sort_array(F.collect_set(date)).alias("_dates")).select(
        "_dates", F.size("_dates").alias("_n")
    )
    test_size = F.floor((F.col("_n") - min_train) / n_folds)
    cuts = dates.withColumn("_size", test_size).where("_size > 0").select(
        "_dates", "_size", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold")
    )
    first = (F.lit(min_train) + (F.col("fold") - 1) * F.col("_size")).cast("int")
    last = (first + F.col("_size")).cast("int")
    return cuts.select(
        "fold",
        F.date_sub(F.element_at("_dates", first), embargo_days).alias("train_end"),
        F.element_at("_dates", first + 1).alias("test_start"),
        F.element_at("_dates", last).alias("test_end"),
    )


def horizon_rows(
    df: DataFrame,
    horizons=HORIZONS,
    price: str = TARGET_PRICE,
    series: str = "series_id",
    date: str = "date",
) -> DataFrame:
    """Long table `(series, date, horizon, y_true, baseline_last, baseline_ma7)`.

    One window stage gives all targets; the rows are then unfolded by horizon in place.
    """
    wide = with_columns(
        df,
        target_columns(price, horizons, series, date),
        baseline_columns(price, series=series, date=date),
        keep=[series, date],
    )
    cases = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"target_h{h}d").alias("y_true"))
            for h in horizons
        ]
    )
    return wide.select(
        series, date, "baseline_last", "baseline_ma7", F.inline(cases)
    ).where(F.col("y_true").isNotNull())


def baseline_oof(
    df: DataFrame,
    horizons=HORIZONS,
    price: str = TARGET_PRICE,
    min_train: int = MIN_TRAIN_DAYS,
    n_folds: int = N_FOLDS,
    series: str = "series_id",
    date: str = "date",
) -> DataFrame:
    """Out-of-fold rows of both naive forecasts for all horizons and folds.

    All folds come from one filter on the fold column; nothing is appended fold by fold.
    """
    rows = horizon_rows(df, horizons, price, series, date)
    return (
        walk_forward_folds(rows, min_train, n_folds, [series, "horizon"], date)
        .where(F.col("fold").isNotNull())
        .drop("row_no")
    )


def baseline_choice(oof: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per group, the naive forecast with the smaller MAPE (the moving mean on a tie)."""
    by = keys or ["series_id", "horizon", "fold"]
    pair = {"last": "baseline_last", "ma7": "baseline_ma7"}
    both = oof.groupBy(*by).agg(
        *[
            e.alias(f"{name}_{metric}")
            for name, column in pair.items()
            for metric, e in metric_columns("y_true", column).items()
        ]
    )
    mean_wins = F.col("ma7_mape") <= F.col("last_mape")
    return both.select(
        *by,
        F.when(mean_wins, F.lit("ma7")).otherwise(F.lit("last")).alias("chosen"),
        *[
            F.when(mean_wins, F.col(f"ma7_{m}")).otherwise(F.col(f"last_{m}")).alias(m)
            for m in METRICS
        ],
    )


def oof_with_choice(oof: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Out-of-fold rows with the chosen baseline of their fold as `baseline_chosen`."""
    by = keys or ["series_id", "horizon", "fold"]
    chosen = baseline_choice(oof, by).select(*by, "chosen")
    return oof.join(chosen, by, "left").select(
        *oof.columns,
        F.when(F.col("chosen") == "ma7", F.col("baseline_ma7"))
        .otherwise(F.col("baseline_last"))
        .alias("baseline_chosen"),
    )
