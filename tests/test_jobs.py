"""Train, evaluate and predict end to end on a small panel."""

import numpy as np
import pytest

from seriesloom.plans import jobs
from seriesloom.plans.dataset import INTERPOLATE, Source
from seriesloom.plans.training import BOOSTED, FOREST
from tests.helpers import day


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    return jobs.JobSettings(
        folder=str(tmp_path_factory.mktemp("jobs")),
        start="2020-01-01",
        end=str(day(219)),
        cutoff=str(day(209)),
        horizons=(1, 7),
        min_train=120,
        n_folds=1,
        candidates={
            BOOSTED: [{"maxIter": 1, "maxDepth": 2}],
            FOREST: [{"numTrees": 2, "maxDepth": 2}],
        },
    )


@pytest.fixture(scope="module")
def sources(spark):
    rng = np.random.default_rng(4)
    rows = [
        (s, day(i), float(100 + 10 * np.sin(i / 20) + rng.normal()))
        for s in ("s", "t")
        for i in range(0, 220, 2)
    ]
    prices = spark.createDataFrame(rows, "series_id string, date date, price_a double")
    index = spark.createDataFrame(
        [(day(31 * m).replace(day=1), 100.0 + m) for m in range(8)], "date date, price_index double"
    )
    return {
        "prices": Source(prices, ("price_a",), INTERPOLATE),
        "index": Source(index, ("price_index",), shared=True),
    }


def test_jobs(spark, sources, settings):
    jobs.train_job(spark, sources, settings)
    oof = jobs.read_oof(spark, settings).toPandas()
    assert set(oof["horizon"]) == {1, 7} and not oof.duplicated(["series_id", "horizon", "date"]).any()
    assert oof[["pred_boosted", "pred_forest", "baseline_chosen"]].notna().all().all()
    assert spark.read.parquet(settings.path("holdout")).count() == 20

    tables = jobs.evaluate_job(spark, settings)
    means = tables["metrics_mean"].toPandas()
    assert len(means) == 2 * 4
    best = tables["best_model"].toPandas().set_index("horizon")
    for h, part in means.groupby("horizon"):
        assert best.loc[h, "mape"] == part["mape"].min()
    assert spark.read.option("header", True).csv(settings.path("reports/metrics_mean")).count() == 8
    models = {"boosted", "forest", "baseline", "persistence"}
    for name, rows in (("seasonal_error", 12), ("residual_histogram", 30), ("residual_normal", 100), ("qq_line", 1)):
        found = tables[name].toPandas()
        assert {(h, m) for h in (1, 7) for m in models} == set(zip(found["horizon"], found["model"]))
        assert len(found) == 8 * rows
    errors = (oof["y_true"] - oof["pred_forest"])[oof["horizon"] == 7]
    line = tables["residual_normal"].where("horizon = 7 and model = 'forest'").first()
    assert line["mean"] == pytest.approx(errors.mean()) and line["std"] == pytest.approx(errors.std(ddof=0))
    assert tables["folds"].count() == 2 and set(tables["feature_importance"].toPandas()["model"]) == {"boosted", "forest"}
    versus = tables["forecast_vs_actual"].where("model = 'forest'").toPandas()
    assert versus["h7"].notna().sum() == (oof["horizon"] == 7).sum() and versus["actual"].notna().any()

    report = {r["column_name"]: r for r in spark.read.option("header", True).csv(settings.path("clean")).collect()}
    assert set(report) >= {"price_a", "price_index"} and int(report["price_a"]["n_missing"]) == 0

    after = jobs.calibrate_job(spark, settings)
    verdict = after["verdict"].toPandas()
    assert len(verdict) == 4 and set(verdict["status"]) <= {"ok", "degradou"}
    rmse = lambda name: after[name].toPandas().set_index(["horizon", "model"])["rmse"]
    assert (rmse("metrics_after") <= rmse("metrics_before") + 1e-9).all()

    relevance = jobs.validate_job(spark, settings, repeats=2)
    assert set(relevance["spearman"].toPandas()["horizon"]) == {1, 7}
    assert relevance["permutation"].select("horizon", "model").distinct().count() == 4

    forecasts = jobs.predict_job(spark, settings).toPandas()
    assert len(forecasts) == 4 and (forecasts["as_of_date"] == day(209)).all()
    assert forecasts["pred_mean"].between(50, 150).all()


def test_training_refuses_rows_past_the_cutoff(spark, sources, settings):
    late = jobs.JobSettings(**{**settings.__dict__, "cutoff": str(day(150))})
    with pytest.raises(ValueError, match="past the allowed"):
        jobs.train_job(spark, sources, late, use_cache=True)
