"""Tree models on the daily panel. Rows are checked, not values: learners are randomised.

The registered queries use the whole feature table, all folds, horizons, candidates and
repeats, with few and shallow trees; the library defaults in `plans.training` have the full
number of trees. Keys, folds, dates and counts are checked by queries of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.sql import with_ctes
from seriesloom.catalog.views import Views
from seriesloom.operators import features, metrics, monotone
from seriesloom.plans import forecasting, training
from seriesloom.plans.training import BOOSTED, FOREST
from seriesloom.session import scratch_dir
from seriesloom.settings import HORIZONS
from seriesloom.sources import store

QUICK = {
    BOOSTED: {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3},
    FOREST: {"numTrees": 6, "maxDepth": 5},
}
TRIALS = {
    BOOSTED: [
        {"maxIter": 2, "maxDepth": 3, "stepSize": 0.3},
        {"maxIter": 4, "maxDepth": 2, "stepSize": 0.5},
        {"maxIter": 3, "maxDepth": 4, "stepSize": 0.4},
    ],
    FOREST: [{"numTrees": 4, "maxDepth": 4}, {"numTrees": 6, "maxDepth": 5}, {"numTrees": 8, "maxDepth": 3}],
}
TARGET = "target_h7d"


def training_table(v: Views):
    """The feature table of the daily price, written once for the fits that follow."""
    return store.cut_lineage(features.feature_table(v.daily_price), "training")


def _inputs(df):
    return features.feature_names(df.columns)


def _fit_scores(v, kind):
    df = training_table(v)
    model = training.fit_model(df, _inputs(df), TARGET, kind, QUICK[kind])
    scored = training.predict(training.labelled(df, TARGET), model, kind, ["series_id", "label"])
    return metrics.error_metrics(scored, "label", f"pred_{kind}", ["series_id"])


@query("train_gbt")
def train_gbt(v):
    return _fit_scores(v, BOOSTED)


@query("train_rf")
def train_rf(v):
    return _fit_scores(v, FOREST)


@query("walk_forward_oof")
def walk_forward_oof(v):
    df = training_table(v)
    return training.walk_forward_oof(df, _inputs(df), TARGET, QUICK)


@query("tuning_log")
def tuning_log(v):
    """The log of a candidate search, written as JSON and read back."""
    df = training_table(v)
    _, log = training.tune_candidates(df, _inputs(df), TARGET, TRIALS)
    path = scratch_dir(v.spark, "tuning-log")
    store.write_json(log, path)
    return store.read_json(v.spark, path, training.LOG_SCHEMA)


@query("tune_candidates")
def tune_candidates(v):
    df = training_table(v)
    _, log = training.tune_candidates(df, _inputs(df), TARGET, TRIALS)
    return log.where("best").select("model", "candidate", "params", "mape")


@query("model_roundtrip")
def model_roundtrip(v):
    """Predictions of a model before and after saving; equal in every row."""
    df = training_table(v)
    folder = scratch_dir(v.spark, "models")
    fitted = training.final_refit(df, _inputs(df), [7], folder, {FOREST: QUICK[FOREST]})[7][FOREST]
    loaded = training.load_model(folder, FOREST, 7)
    first = training.predict(df, fitted, FOREST, df.columns).withColumnRenamed("pred_forest", "pred_fitted")
    both = loaded.transform(first)
    return both.select(
        "series_id", "date", "pred_fitted", "pred_forest",
        (F.col("pred_fitted") == F.col("pred_forest")).alias("equal"),
    )


def _models(v, df, horizons=HORIZONS):
    return training.final_refit(df, _inputs(df), list(horizons), scratch_dir(v.spark, "models"), QUICK)


@query("final_refit")
def final_refit(v):
    df = training_table(v)
    models = _models(v, df)
    rows = [
        (h, kind, len(training.model_features(m)), int(m.stages[-1].getNumTrees))
        for h, pair in models.items()
        for kind, m in pair.items()
    ]
    return v.spark.createDataFrame(rows, "horizon int, model string, n_features int, n_trees int")


@query("forecast_latest")
def forecast_latest(v):
    df = training_table(v)
    return forecasting.forecast_latest(df, _models(v, df))


@query("forecast_period")
def forecast_period(v):
    df = training_table(v)
    return forecasting.forecast_period(df, _models(v, df), "2001-01-01", "2001-07-31")


@query("feature_importance")
def feature_importance(v):
    df = training_table(v)
    model = training.fit_model(df, _inputs(df), TARGET, BOOSTED, QUICK[BOOSTED])
    return training.feature_importance(v.spark, model)


@query("permutation_importance")
def permutation_importance(v):
    df = training_table(v)
    model = training.fit_model(df, _inputs(df), TARGET, FOREST, QUICK[FOREST])
    return training.permutation_importance(df, model, TARGET, ["series_id", "date"])


# Keys, folds, dates, counts and actual values of the model queries: what does not depend on
# the learner is checked by value.


@query(
    "train_rows",
    with_ctes(
        """SELECT m.model, count(*) AS n_rows, round(sum(t7), 2) AS label_sum, TRUE AS beats_mean
           FROM base CROSS JOIN (SELECT unnest(['boosted', 'forest']) AS model) m
           WHERE t7 IS NOT NULL GROUP BY m.model"""
    ),
)
def train_rows(v):
    """Rows and labels both learners are fitted on; their error is below the labels' deviation."""
    df = training_table(v)
    rows = training.labelled(df, TARGET)
    for kind in (BOOSTED, FOREST):
        model = training.fit_model(df, _inputs(df), TARGET, kind, QUICK[kind])
        rows = training.predict(rows, model, kind, rows.columns)
    long = rows.unpivot(["label"], [f"pred_{BOOSTED}", f"pred_{FOREST}"], "model", "y_pred").withColumn(
        "model", F.substring_index("model", "pred_", -1)
    )
    error = F.sqrt(F.avg((F.col("y_pred") - F.col("label")) ** 2))
    return rounded(
        long.groupBy("model").agg(
            F.count("y_pred").alias("n_rows"), F.sum("label").alias("label_sum"),
            (error < F.stddev_pop("label")).alias("beats_mean"),
        ),
        label_sum=2,
    )


@query(
    "feature_importance_rows",
    """SELECT m.model, TRUE AS one_each, TRUE AS shares_of_one
       FROM (SELECT unnest(['boosted', 'forest']) AS model) m""",
)
def feature_importance_rows(v):
    """Importances of both learners: one for each input, none negative, one in sum."""
    df = training_table(v)
    inputs = _inputs(df)
    parts = [
        training.feature_importance(v.spark, training.fit_model(df, inputs, TARGET, kind, QUICK[kind]), n=len(inputs) + 1)
        .agg(
            ((F.count_distinct("feature") == len(inputs)) & (F.count("*") == len(inputs))).alias("one_each"),
            ((F.min("importance") >= 0) & (F.abs(F.sum("importance") - 1) < 1e-9)).alias("shares_of_one"),
        )
        .select(F.lit(kind).alias("model"), "one_each", "shares_of_one")
        for kind in (BOOSTED, FOREST)
    ]
    return parts[0].union(parts[1])


@query(
    "walk_forward_oof_rows",
    with_ctes(
        """SELECT b.series_id, b.date, CAST((d.rn - 730) // d.sz + 1 AS INTEGER) AS fold, round(b.t7, 6) AS y_true
           FROM base b JOIN (
                SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn, (count(*) OVER () - 730) // 5 AS sz
                FROM (SELECT DISTINCT date FROM base WHERE t7 IS NOT NULL) u) d ON d.date = b.date
           WHERE b.t7 IS NOT NULL AND d.rn >= 730 AND (d.rn - 730) // d.sz < 5"""
    ),
)
def walk_forward_oof_rows(v):
    return rounded(walk_forward_oof(v).select("series_id", "date", "fold", "y_true"), y_true=6)


@query(
    "tuning_log_rows",
    """SELECT m.model, CAST(c.candidate AS INTEGER) AS candidate, TRUE AS scored, CAST(1 AS BIGINT) AS n_best
       FROM (SELECT unnest(['boosted', 'forest']) AS model) m
       CROSS JOIN (SELECT unnest([0, 1, 2]) AS candidate) c""",
)
def tuning_log_rows(v):
    """Every candidate is logged with its scores, and one of each family is the best."""
    log = tuning_log(v)
    scored = (F.col("rmse") >= F.col("mae")) & (F.col("mae") > 0) & (F.col("mape") > 0)
    best = log.groupBy("model").agg(F.count_if("best").alias("n_best"))
    return log.select("model", "candidate", scored.alias("scored")).join(best, "model")


@query(
    "final_refit_rows",
    f"""SELECT h.horizon, m.model, m.n_trees
        FROM (SELECT CAST(unnest({list(HORIZONS)}) AS INTEGER) AS horizon) h
        CROSS JOIN (SELECT 'boosted' AS model, CAST({QUICK[BOOSTED]["maxIter"]} AS INTEGER) AS n_trees
                    UNION ALL SELECT 'forest', {QUICK[FOREST]["numTrees"]}) m""",
)
def final_refit_rows(v):
    return final_refit(v).select("horizon", "model", "n_trees")


@query(
    "forecast_latest_rows",
    with_ctes(
        f"""SELECT d.series_id, h.horizon, d.last AS as_of_date, d.last AS feature_date,
                   CAST(d.last + h.horizon AS DATE) AS forecast_date
            FROM (SELECT series_id, max(date) AS last FROM daily GROUP BY series_id) d
            CROSS JOIN (SELECT CAST(unnest({list(HORIZONS)}) AS INTEGER) AS horizon) h"""
    ),
)
def forecast_latest_rows(v):
    return forecast_latest(v).select("series_id", "horizon", "as_of_date", "feature_date", "forecast_date")


@query(
    "forecast_period_rows",
    with_ctes(
        f"""SELECT series_id, date, CAST(horizon AS INTEGER) AS horizon, round(y_true, 2) AS y_true
            FROM (SELECT series_id, date, unnest({list(HORIZONS)}) AS horizon,
                         unnest([{", ".join(f"t{h}" for h in HORIZONS)}]) AS y_true
                  FROM base WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-07-31') t"""
    ),
)
def forecast_period_rows(v):
    return forecast_period(v).select("series_id", "date", "horizon", "y_true")


@query("model_roundtrip_rows", with_ctes("SELECT series_id, date, TRUE AS equal FROM daily"))
def model_roundtrip_rows(v):
    return model_roundtrip(v).select("series_id", "date", "equal")


def _naive(v, prediction="baseline_ma7"):
    return store.cut_lineage(
        v.oof.select(
            "series_id", "date", "horizon", F.lit("ma7").alias("model"), "y_true", F.expr(prediction).alias("y_pred")
        ),
        "oof",
    )


@query("isotonic_calibration")
def isotonic_calibration(v):
    """Metrics of the naive forecasts before and after recalibration, with the verdict."""
    keys = ["horizon", "model"]
    calibrated = training.isotonic_calibration(_naive(v), keys, row_key=("series_id", "date", "horizon"))
    return metrics.tolerance_status(
        metrics.error_metrics(calibrated, p="y_pred", keys=keys, skip_zero=True),
        metrics.error_metrics(calibrated, p="y_cal", keys=keys, skip_zero=True),
    )


@query(
    "isotonic_fit",
    # The fit at point i is the largest, over starts s up to i, of the smallest mean from s to
    # an end t at or after i.
    with_ctes(
        """SELECT horizon, x, round(max(low), 6) AS level
           FROM (SELECT a.horizon, b.x, a.x AS s,
                        min((b.total - a.total + a.y) / (b.rows - a.rows + a.n)) OVER (
                            PARTITION BY a.horizon, a.x ORDER BY b.x
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low
                 FROM points a JOIN points b ON b.horizon = a.horizon AND b.x >= a.x) m
           GROUP BY horizon, x""",
        points="""
            SELECT horizon, x, sum(y_true) AS y, count(*) AS n,
                   sum(sum(y_true)) OVER w AS total, sum(count(*)) OVER w AS rows
            FROM (SELECT horizon, y_true, round(baseline_ma7) AS x FROM oof) r
            GROUP BY horizon, x WINDOW w AS (PARTITION BY horizon ORDER BY x)""",
    ),
)
def isotonic_fit(v):
    """The fitted level of every whole-number forecast."""
    rows = _naive(v, "round(baseline_ma7)")
    keys = ["horizon"]
    blocks = monotone.isotonic_blocks(rows, keys, "y_pred", "y_true")
    asked = rows.select("horizon", F.col("y_pred").alias("x")).distinct()
    fitted = monotone.recalibrate(asked, blocks, keys, "x", ["horizon", "x"], name="level")
    return rounded(fitted.select("horizon", "x", "level"), level=6)
