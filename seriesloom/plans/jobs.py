"""The batch jobs: train, evaluate, calibrate, validate features, predict.

Each job reads the tables the previous one wrote below one folder:

    features/        integrated panel with features and targets (published versions)
    holdout/         rows after the training cutoff
    clean/           what the cleaning saw, per column (CSV)
    models/          one saved model per family and horizon
    oof/             out-of-fold predictions, one row per series, horizon and date
    metrics/         metrics per series, horizon, fold and model
    tuning/          one record per tuning candidate
    forecasts/       latest forecasts (CSV)
    reports/         evaluation tables (CSV)
    calibration/     tables before and after recalibration (CSV)
    validation/      feature relevance per horizon and model (CSV)

What a job writes on the way lies in a scratch folder that is deleted when it ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import metrics, relevance, spread
from seriesloom.operators.features import (
    baseline_columns,
    feature_names,
    feature_table,
    with_columns,
)
from seriesloom.operators.folds import oof_with_choice
from seriesloom.operators.tidy import assert_cutoff, date_slice, holdout_split
from seriesloom.plans.dataset import Source, build_dataset, clean_and_write
from seriesloom.plans.forecasting import forecast_latest, forecast_vs_actual
from seriesloom.plans.training import (
    BOOSTED,
    CANDIDATES,
    FOREST,
    feature_importance,
    final_refit,
    isotonic_calibration,
    load_model,
    permutation_importance,
    tune_candidates,
    walk_forward_oof,
)
from seriesloom.session import scratch_dir, scratch_scope
from seriesloom.settings import (
    CALENDAR_END,
    CALENDAR_START,
    HOLDOUT_CUTOFF,
    HORIZONS,
    MAX_GAP_DAYS,
    MIN_TRAIN_DAYS,
    N_FOLDS,
    TARGET_PRICE,
)
from seriesloom.sources.store import (
    cached_table,
    cut_lineage,
    read_csv,
    read_published,
    write_csv,
    write_panel,
)

PREDICTIONS = {
    "boosted": "pred_boosted",
    "forest": "pred_forest",
    "baseline": "baseline_chosen",
    "persistence": "baseline_last",
}


@dataclass(frozen=True)
class JobSettings:
    """What the jobs need to know besides the sources."""

    folder: str
    start: str = CALENDAR_START
    end: str = CALENDAR_END
    cutoff: str = HOLDOUT_CUTOFF
    horizons: tuple[int, ...] = HORIZONS
    price: str = TARGET_PRICE
    max_gap: int = MAX_GAP_DAYS
    min_train: int = MIN_TRAIN_DAYS
    n_folds: int = N_FOLDS
    embargo_days: int = 0
    candidates: dict[str, list[dict]] = field(default_factory=lambda: CANDIDATES)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def feature_job(
    spark: SparkSession, sources: dict[str, Source], settings: JobSettings, use_cache: bool = True
) -> DataFrame:
    """Integrate, clean and derive features; read the published table when there is one.

    The integrated panel is computed once: the pass that writes it cleaned also yields the
    reports, and training and holdout rows are read from what it wrote.
    """

    def compute() -> DataFrame:
        panel = build_dataset(sources, settings.start, settings.end)
        values = [c for c in panel.columns if c not in ("series_id", "date")]
        folder = scratch_dir(spark, "cleaned")
        report = clean_and_write(panel, values, lambda df: write_panel(df, folder), settings.max_gap)
        write_csv(report.table(spark), settings.path("clean"))
        train, holdout = holdout_split(spark.read.parquet(folder), settings.cutoff)
        write_panel(holdout, settings.path("holdout"))
        return feature_table(train, price=settings.price, horizons=settings.horizons)

    return cached_table(spark, settings.path("features"), compute, use_cache)


def train_job(
    spark: SparkSession, sources: dict[str, Source], settings: JobSettings, use_cache: bool = True
) -> None:
    """Tune, validate and refit both families for every horizon; write all tables."""
    with scratch_scope(spark, "train-job"):
        _train(spark, sources, settings, use_cache)


def _train(spark: SparkSession, sources: dict[str, Source], settings: JobSettings, use_cache: bool) -> None:
    table = feature_job(spark, sources, settings, use_cache)
    assert_cutoff(table, settings.cutoff)
    inputs = feature_names(table.columns, settings.price)
    rows = cut_lineage(with_columns(table, baseline_columns(settings.price)), "train")
    for h in settings.horizons:
        target = f"target_h{h}d"
        best, log = tune_candidates(
            rows, inputs, target, settings.candidates,
            settings.min_train, settings.n_folds, settings.embargo_days,
        )
        log.write.mode("overwrite").json(settings.path(f"tuning/horizon={h}"))
        oof = walk_forward_oof(
            rows, inputs, target, best, settings.min_train, settings.n_folds,
            settings.embargo_days, carry=("baseline_last", "baseline_ma7"),
        ).withColumn("horizon", F.lit(h))
        oof = cut_lineage(oof, "oof")
        oof_with_choice(oof).drop("horizon").write.mode("overwrite").parquet(
            settings.path(f"oof/horizon={h}")
        )
        final_refit(rows, inputs, [h], settings.path("models"), best)
    keys = ["series_id", "horizon", "fold"]
    metrics.metrics_summary(read_oof(spark, settings), PREDICTIONS, keys).write.mode(
        "overwrite"
    ).parquet(settings.path("metrics"))


def read_oof(spark: SparkSession, settings: JobSettings) -> DataFrame:
    return spark.read.parquet(settings.path("oof"))


def _stacked(oof: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row per prediction: the columns of `models` as `model` and `y_pred`."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in models.items()])
    return oof.select("series_id", "date", "horizon", "fold", "y_true", F.inline(pairs))


def _saved(tables: dict[str, DataFrame], settings: JobSettings, folder: str) -> dict[str, DataFrame]:
    """Write every table as CSV, and give the tables as they were written."""
    out = {}
    for name, table in tables.items():
        path = settings.path(f"{folder}/{name}")
        write_csv(table, path)
        out[name] = read_csv(table.sparkSession, path, table.schema)
    return out


def evaluate_job(spark: SparkSession, settings: JobSettings, start: str | None = None) -> dict[str, DataFrame]:
    """Evaluation tables of every model and horizon, each saved as CSV.

    Distributions, seasons and calibration are per horizon and model, from `start` on; the
    importances are those of the saved models.
    """
    with scratch_scope(spark, "evaluate-job"):
        oof, summary = read_oof(spark, settings), spark.read.parquet(settings.path("metrics"))
        rows = cut_lineage(date_slice(_stacked(oof, PREDICTIONS), start, None), "stacked")
        keys = ["horizon", "model"]
        means = metrics.metrics_mean(summary)
        errors = spread.residuals(rows)
        panel = read_published(spark, settings.path("features")).select("series_id", "date", settings.price)
        first = start or str(oof.agg(F.min("date")).first()[0])
        versus = [
            forecast_vs_actual(
                panel, rows.where(F.col("model") == m), first, list(settings.horizons), settings.price
            ).withColumn("model", F.lit(m))
            for m in PREDICTIONS
        ]
        importances = [
            feature_importance(spark, load_model(settings.path("models"), kind, h)).select(
                F.lit(h).alias("horizon"), F.lit(kind).alias("model"), "feature", "importance"
            )
            for h in settings.horizons
            for kind in (BOOSTED, FOREST)
        ]
        return _saved(
            {
                "metrics": summary,
                "metrics_mean": means,
                "best_model": metrics.best_model(means),
                "metrics_crosstab": metrics.metrics_crosstab(means, list(PREDICTIONS)),
                "folds": oof.groupBy("horizon", "fold").agg(
                    F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count(F.lit(1)).alias("n")
                ),
                "seasonal_error": metrics.seasonal_error(rows, keys=keys),
                "residual_histogram": spread.histogram(errors, "residual", keys),
                "residual_normal": spread.residual_normal(errors, keys),
                "qq_line": spread.qq_line(spread.qq_points(errors, keys), keys),
                "density": spread.density_grid(rows, keys, shape="hexagon"),
                "price_bands": spread.price_band_counts(rows, ["y_true", "y_pred"], keys),
                "calibration": spread.calibration_curve(rows, keys),
                "forecast_vs_actual": reduce(DataFrame.unionByName, versus),
                "feature_importance": reduce(DataFrame.unionByName, importances),
            },
            settings,
            "reports",
        )


def calibrate_job(spark: SparkSession, settings: JobSettings) -> dict[str, DataFrame]:
    """Recalibrate both families' out-of-fold predictions by an isotonic fit per horizon.

    Metrics, bands and curves before and after, and the verdict on the MAPE per horizon.
    """
    with scratch_scope(spark, "calibrate-job"):
        families = {m: c for m, c in PREDICTIONS.items() if m in (BOOSTED, FOREST)}
        keys = ["horizon", "model"]
        rows = cut_lineage(
            isotonic_calibration(
                cut_lineage(_stacked(read_oof(spark, settings), families), "stacked"),
                keys, row_key=("series_id", "date", "horizon", "model"),
            ),
            "calibrated",
        )
        tables: dict[str, DataFrame] = {}
        for when, column in (("before", "y_pred"), ("after", "y_cal")):
            tables[f"metrics_{when}"] = metrics.error_metrics(rows, p=column, keys=keys, skip_zero=True)
            tables[f"curve_{when}"] = spread.calibration_curve(rows, keys, p=column)
            tables[f"bands_{when}"] = spread.price_band_counts(rows, ["y_true", column], keys)
        tables["verdict"] = metrics.tolerance_status(tables["metrics_before"], tables["metrics_after"])
        return _saved(tables, settings, "calibration")


def validate_job(spark: SparkSession, settings: JobSettings, repeats: int = 10) -> dict[str, DataFrame]:
    """Relevance of the features per horizon and model: rank correlation with the target,
    native importance and permutation importance of the saved models."""
    with scratch_scope(spark, "validate-job"):
        table = read_published(spark, settings.path("features"))
        inputs = feature_names(table.columns, settings.price)
        ranks, shuffled = [], []
        for h in settings.horizons:
            target = f"target_h{h}d"
            ranks.append(relevance.spearman(table, inputs, target, ["series_id", "date"]).withColumn("horizon", F.lit(h)))
            for kind in (BOOSTED, FOREST):
                model = load_model(settings.path("models"), kind, h)
                found = permutation_importance(table, model, target, ["series_id", "date"], repeats)
                shuffled.append(found.select(F.lit(h).alias("horizon"), F.lit(kind).alias("model"), "*"))
        return _saved(
            {"spearman": reduce(DataFrame.unionByName, ranks), "permutation": reduce(DataFrame.unionByName, shuffled)},
            settings,
            "validation",
        )


def predict_job(spark: SparkSession, settings: JobSettings) -> DataFrame:
    """Latest forecasts of the saved models, written as CSV and returned."""
    table = read_published(spark, settings.path("features"))
    models = {
        h: {kind: load_model(settings.path("models"), kind, h) for kind in (BOOSTED, FOREST)}
        for h in settings.horizons
    }
    forecasts = forecast_latest(table, models)
    write_csv(forecasts, settings.path("forecasts"))
    return read_csv(spark, settings.path("forecasts"), forecasts.schema)
