"""Tree models per horizon: walk-forward validation, tuning, refit, importance, calibration.

Models are pooled over the panel with Spark ML. Folds, horizons and candidates are driver
loops over a handful of settings; each step in them is a distributed job over a table that
was written once (`store.cut_lineage`), so the feature plan does not run again per fit.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.folds import panel_fold_dates
from seriesloom.operators.metrics import error_metrics
from seriesloom.operators.monotone import isotonic_blocks, recalibrate
from seriesloom.operators.ordered import RANGE_LIMIT, exact_quantiles, random_rank
from seriesloom.operators.relevance import median_values, top_features
from seriesloom.settings import MIN_TRAIN_DAYS, N_FOLDS
from seriesloom.sources.store import cut_lineage

BOOSTED = "boosted"
FOREST = "forest"

# Default parameters and the tuning candidates of both model families.
# Spark ML limits the depth of a tree to 30, which stands for "unlimited".
DEFAULT_PARAMS = {
    BOOSTED: {
        "maxIter": 500,
        "stepSize": 0.05,
        "maxDepth": 6,
        "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
        "minInstancesPerNode": 5,
        "seed": 42,
    },
    FOREST: {
        "numTrees": 500,
        "maxDepth": 30,
        "minInstancesPerNode": 5,
        "featureSubsetStrategy": "sqrt",
        "seed": 42,
    },
}
CANDIDATES = {
    BOOSTED: [
        {"maxIter": 300, "stepSize": 0.1, "maxDepth": 4, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"},
        {"maxIter": 450, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
        {"maxIter": 600, "stepSize": 0.03, "maxDepth": 8, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"},
    ],
    FOREST: [
        {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"},
        {"numTrees": 500, "maxDepth": 30, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"},
        {"numTrees": 700, "maxDepth": 20, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.6"},
    ],
}

_KINDS: dict[str, Callable[..., Estimator]] = {
    BOOSTED: GBTRegressor,
    FOREST: RandomForestRegressor,
}


def estimator(kind: str, params: dict | None = None, label: str = "label") -> Estimator:
    """A tree learner with the defaults of its family, overridden by `params`."""
    chosen = {**DEFAULT_PARAMS[kind], **(params or {})}
    return _KINDS[kind](
        featuresCol="features", labelCol=label, predictionCol=f"pred_{kind}", **chosen
    )


def preparation(spark: SparkSession, features: list[str], medians: dict[str, float]) -> PipelineModel:
    """Imputation by the given medians and vector assembly, as saved model stages.

    The stages are fitted on the one row of medians, so the imputer holds exactly these. A
    feature without any known value has no median; it is 0 everywhere and no split uses it.
    """
    filled = [f"{f}_filled" for f in features]
    row = spark.createDataFrame(
        [tuple(float(medians.get(f, 0.0)) for f in features)], ", ".join(f"`{f}` double" for f in features)
    )
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features"),
        ]
    ).fit(row)


def fold_medians(rows: DataFrame, features: list[str], cuts: list, date: str = "date") -> dict[int, dict[str, float]]:
    """Exact medians of every feature over the training rows of every fold, in one pass."""
    trained_in = F.array_compact(
        F.array(*[F.when(F.col(date) <= F.lit(c["train_end"]), F.lit(c["fold"])) for c in cuts])
    )
    cells = rows.select(F.explode(trained_in).alias("fold"), *[F.col(f).cast("double") for f in features]).unpivot(
        ["fold"], features, "feature", "value"
    )
    medians: dict[int, dict[str, float]] = {c["fold"]: {} for c in cuts}
    for r in exact_quantiles(cells, ["fold", "feature"], "value", [0.5]).collect():
        medians[r["fold"]][r["feature"]] = r["quantiles"][0]
    return medians


def labelled(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).withColumn("label", F.col(target))


def fit_models(
    df: DataFrame, features: list[str], target: str, kinds: dict[str, dict | None]
) -> dict[str, PipelineModel]:
    """Imputer, assembler and trees of each family as one saved unit; the medians and the
    vectors are made once for all families."""
    rows = labelled(df, target)
    ready = preparation(df.sparkSession, features, median_values(rows, features))
    vectors = cut_lineage(ready.transform(rows).select("features", "label"), "vectors")
    return {
        kind: PipelineModel(stages=[*ready.stages, estimator(kind, params).fit(vectors)])
        for kind, params in kinds.items()
    }


def fit_model(
    df: DataFrame, features: list[str], target: str, kind: str, params: dict | None = None
) -> PipelineModel:
    return fit_models(df, features, target, {kind: params})[kind]


def predict(df: DataFrame, model: PipelineModel, kind: str, keep: list[str]) -> DataFrame:
    return model.transform(df).select(*keep, f"pred_{kind}")


def _fold_list(df: DataFrame, min_train: int, n_folds: int, embargo_days: int) -> list:
    return panel_fold_dates(df, min_train, n_folds, embargo_days).orderBy("fold").collect()


def walk_forward_oof(
    df: DataFrame,
    features: list[str],
    target: str,
    kinds: dict[str, dict | None],
    min_train: int = MIN_TRAIN_DAYS,
    n_folds: int = N_FOLDS,
    embargo_days: int = 0,
    leaky: bool = False,
    keys: tuple[str, ...] = ("series_id", "date"),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Out-of-fold predictions `(keys, fold, y_true, carry, pred_*)` of expanding-window folds.

    Medians come from the training rows of each fold; `leaky` takes them from all rows.
    Both families predict in one pass over the test rows, without a join.
    """
    rows = labelled(df, target)
    cuts = _fold_list(rows, min_train, n_folds, embargo_days)
    if not cuts:
        raise ValueError("too few dates for the first training window")
    if leaky:
        medians = dict.fromkeys((c["fold"] for c in cuts), median_values(rows, features))
    else:
        medians = fold_medians(rows, features, cuts)
    parts = []
    for cut in cuts:
        train = rows.where(F.col("date") <= F.lit(cut["train_end"]))
        scored = rows.where(F.col("date").between(F.lit(cut["test_start"]), F.lit(cut["test_end"])))
        ready = preparation(df.sparkSession, features, medians[cut["fold"]])
        prepared = ready.transform(train).select("features", "label")
        scored = ready.transform(scored)
        for kind, params in kinds.items():
            scored = estimator(kind, params).fit(prepared).transform(scored)
        parts.append(
            scored.select(
                *keys,
                F.lit(cut["fold"]).alias("fold"),
                F.col("label").alias("y_true"),
                *carry,
                *[f"pred_{k}" for k in kinds],
            )
        )
    return reduce(DataFrame.unionByName, parts)


LOG_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("params", T.StringType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
        T.StructField("best", T.BooleanType()),
    ]
)


def tune_candidates(
    df: DataFrame,
    features: list[str],
    target: str,
    candidates: dict[str, list[dict]] | None = None,
    min_train: int = MIN_TRAIN_DAYS,
    n_folds: int = N_FOLDS,
    embargo_days: int = 0,
    parallelism: int = 3,
) -> tuple[dict[str, dict], DataFrame]:
    """Score all candidates by MAPE on the first fold; best parameters and the log table.

    The rows of the fold are imputed and assembled once into a written vector table; the
    fits of all candidates read it, some at a time, and share the cluster's free slots.
    Without a first fold the defaults are returned with an empty log.
    """
    spark = df.sparkSession
    best = {kind: dict(params) for kind, params in DEFAULT_PARAMS.items()}
    rows = labelled(df, target)
    folds = _fold_list(rows, min_train, n_folds, embargo_days)
    if not folds:
        return best, spark.createDataFrame([], LOG_SCHEMA)
    cut = folds[0]
    in_train = F.col("date") <= F.lit(cut["train_end"])
    in_check = F.col("date").between(F.lit(cut["test_start"]), F.lit(cut["test_end"]))
    medians = median_values(rows.where(in_train), features)
    vectors = cut_lineage(
        preparation(spark, features, medians).transform(rows.where(in_train | in_check))
        .select("features", "label", in_check.alias("check")),
        "tuning-vectors",
    )
    train, check = vectors.where(~F.col("check")), vectors.where("check")
    trials = [
        (kind, number, {**DEFAULT_PARAMS[kind], **params})
        for kind, listed in (candidates or CANDIDATES).items()
        for number, params in enumerate(listed)
    ]

    def score(trial):
        kind, _, merged = trial
        fitted = estimator(kind, merged).fit(train)
        return error_metrics(fitted.transform(check), "label", f"pred_{kind}").first()

    with ThreadPool(max(1, min(parallelism, len(trials)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(score), trials)
    winners: dict[str, int] = {}
    for kind in best:
        own = [(f["mape"], number) for (k, number, _), f in zip(trials, found, strict=True) if k == kind and f["mape"] is not None]
        if own:
            winners[kind] = min(own)[1]
    log = []
    for (kind, number, merged), f in zip(trials, found, strict=True):
        chosen = winners.get(kind) == number
        if chosen:
            best[kind] = merged
        log.append((kind, number, json.dumps(merged, sort_keys=True), f["rmse"], f["mae"], f["mape"], chosen))
    return best, spark.createDataFrame(log, LOG_SCHEMA)


def model_path(folder: str, kind: str, horizon: int) -> str:
    return f"{folder}/{kind}_h{horizon}d"


def final_refit(
    df: DataFrame,
    features: list[str],
    horizons: list[int],
    folder: str,
    kinds: dict[str, dict | None],
) -> dict[int, dict[str, PipelineModel]]:
    """Fit every horizon and family on all labelled rows, save the models and return them."""
    models: dict[int, dict[str, PipelineModel]] = {}
    for h in horizons:
        models[h] = fit_models(df, features, f"target_h{h}d", kinds)
        for kind, model in models[h].items():
            model.write().overwrite().save(model_path(folder, kind, h))
    return models


def load_model(folder: str, kind: str, horizon: int) -> PipelineModel:
    """A saved model; a missing folder raises."""
    return PipelineModel.load(model_path(folder, kind, horizon))


def model_features(model: PipelineModel) -> list[str]:
    """Input columns of a saved model, in the order of its importances."""
    return list(model.stages[0].getInputCols())


def feature_importance(spark: SparkSession, model: PipelineModel, n: int = 20) -> DataFrame:
    """Native importances of a model, largest first; one value per feature."""
    pairs = [
        (name, float(score))
        for name, score in zip(model_features(model), model.stages[-1].featureImportances.toArray())
    ]
    return top_features(spark.createDataFrame(pairs, "feature string, importance double"), n=n)


def permutation_importance(
    df: DataFrame,
    model: PipelineModel,
    target: str,
    row_key: list[str],
    repeats: int = 10,
    seed: int = 42,
    n: int = 20,
) -> DataFrame:
    """Rise of the mean absolute error when one feature is shuffled: mean and deviation.

    Every repeat permutes all rows: each row takes the values of the row that has its number
    in a fresh random order. The numbers are distributed ranks (`ordered.random_rank`), and
    rows meet by number, so the scheme is the same at every size and no task orders the
    table. One permutation of the rows serves all features of a repeat.
    """
    features = model_features(model)
    kind_column = model.stages[-1].getPredictionCol()
    preparation_stages = PipelineModel(stages=model.stages[:-1])
    trees = model.stages[-1]
    base = cut_lineage(
        random_rank(
            preparation_stages.transform(labelled(df, target)).select(
                *row_key, "label", vector_to_array("features").alias("x")
            ),
            row_key, seed, "_place",
        ),
        "permutation",
    )

    def errors(scored: DataFrame) -> F.Column:
        return F.avg(F.abs(F.col("label") - F.col(kind_column)))

    stacked = []
    for repeat in range(repeats):
        other = random_rank(base.select(*row_key, F.col("x").alias("_other")), row_key, seed + 1 + repeat, "_place")
        stacked.append(
            base.select("_place", "label", "x").join(other.select("_place", "_other"), "_place")
            .select("label", "x", "_other", F.lit(repeat).alias("repeat"))
        )
    slots = F.sequence(F.lit(0), F.lit(len(features) - 1))
    one_changed = reduce(DataFrame.unionByName, stacked).select(
        "label", "x", "_other", "repeat", F.explode(slots).alias("slot")
    ).select(
        "label",
        "repeat",
        "slot",
        array_to_vector(
            F.transform("x", lambda v, i: F.when(i == F.col("slot"), F.get("_other", i)).otherwise(v))
        ).alias("features"),
    )
    scored = trees.transform(one_changed)
    per_repeat = scored.groupBy("slot", "repeat").agg(errors(scored).alias("mae"))
    plain = trees.transform(base.select("label", array_to_vector("x").alias("features")))
    reference = plain.agg(errors(plain).alias("mae")).first()["mae"]
    names = F.array(*[F.lit(f) for f in features])
    result = per_repeat.groupBy("slot").agg(
        F.avg(F.col("mae") - reference).alias("importance"),
        F.stddev_pop(F.col("mae") - reference).alias("std"),
    )
    return top_features(
        result.select(F.get(names, F.col("slot")).alias("feature"), "importance", "std"), n=n
    )


def isotonic_calibration(
    oof: DataFrame,
    keys: list[str],
    prediction: str = "y_pred",
    label: str = "y_true",
    row_key: tuple[str, ...] = ("series_id", "date"),
    limit: int = RANGE_LIMIT,
) -> DataFrame:
    """Rows with both values and their recalibrated prediction `y_cal`, fitted per key."""
    known = oof.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    blocks = isotonic_blocks(known, keys, prediction, label, limit)
    return recalibrate(known, blocks, keys, prediction, list(row_key), "y_cal", limit)
