"""Integration, training and forecasting jobs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import features
from seriesloom.plans import forecasting, reports, training
from seriesloom.plans.dataset import CARRY_BOTH_WAYS, INTERPOLATE, Source, build_dataset, clean, daily_panel
from seriesloom.plans.training import BOOSTED, FOREST
from seriesloom.sources.store import cut_lineage
from tests.helpers import EPOCH, day

START, END = "2020-01-01", "2020-04-30"
KINDS = {BOOSTED: {"maxIter": 2, "maxDepth": 2, "stepSize": 0.5}, FOREST: {"numTrees": 3, "maxDepth": 3}}


@pytest.fixture(scope="module")
def sources(spark):
    prices = spark.createDataFrame(
        [("s", day(0), 100.0, 10.0), ("s", day(10), 110.0, None), ("t", day(5), 50.0, 5.0), ("t", day(100), 60.0, 7.0)],
        "series_id string, date date, price_a double, price_b double",
    )
    months = spark.createDataFrame(
        [(dt.date(2020, m, 1), 100.0 * (1 + m / 10), None if m == 3 else float(m)) for m in (1, 2, 3, 4)],
        "date date, price_index double, rain_mm double",
    )
    fx = spark.createDataFrame([(day(3), 4.0), (day(40), None), (day(60), 5.0)], "date date, fx double")
    return {
        "prices": Source(prices, ("price_a", "price_b"), INTERPOLATE),
        "months": Source(months, ("price_index", "rain_mm"), shared=True),
        "fx": Source(fx, ("fx",), CARRY_BOTH_WAYS, shared=True),
    }


def reference_table():
    """The same table with plain pandas calls for one series."""
    index = pd.date_range(START, END)
    a = pd.Series([100.0, 110.0], index=pd.to_datetime([day(0), day(10)])).reindex(index).interpolate()
    b = pd.Series([10.0], index=pd.to_datetime([day(0)])).reindex(index).interpolate()
    starts = pd.to_datetime([dt.date(2020, m, 1) for m in (1, 2, 3, 4)])
    index_now = pd.Series([110.0, 120.0, 130.0, 140.0], index=starts).reindex(index, method="ffill")
    rain = pd.Series([1.0, 2.0, np.nan, 4.0], index=starts).reindex(index, method="ffill")
    fx = pd.Series([4.0, 5.0], index=pd.to_datetime([day(3), day(60)])).reindex(index, method="ffill").bfill()

    def lagged(s):
        return s.resample("MS").first().shift(1).reindex(index, method="ffill")

    return pd.DataFrame(
        {
            "price_a": a / (index_now / 100), "price_b": b / (index_now / 100), "price_a_nominal": a,
            "price_index": lagged(index_now), "rain_mm": lagged(rain), "fx": fx,
        }
    )


def test_build_dataset(sources):
    got = build_dataset(sources, START, END).toPandas()
    assert len(got) == 2 * 121
    mine = got[got.series_id == "s"].sort_values("date")
    for c, want in reference_table().items():
        np.testing.assert_allclose(mine[c].to_numpy(dtype=float), want.to_numpy(), err_msg=c)
    other = got[got.series_id == "t"].sort_values("date")
    assert other["price_a_nominal"].isna().sum() == 5


def test_source_selection(sources):
    nominal = build_dataset(sources, START, END, include=["prices"], deflate_prices=False)
    assert nominal.columns == ["series_id", "date", "price_a", "price_b"]
    with pytest.raises(ValueError):
        build_dataset(sources, START, END, include=[])
    with pytest.raises(KeyError):
        build_dataset(sources, START, END, include=["prices", "fx"])
    shared = build_dataset(sources, START, END, include=["months"], deflate_prices=False)
    assert shared.count() == 121


def test_lagged_deflator_option(sources):
    row = build_dataset(sources, START, END, lag_deflator=True).where("series_id = 's' and date = '2020-02-10'").first()
    assert row["price_a"] == pytest.approx(row["price_a_nominal"] / (row["price_index"] / 100))


def test_panel_plan_broadcasts_only_the_calendar_table(sources):
    plan = build_dataset(sources, START, END)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_shuffle_per_panel(sources):
    plan = daily_panel([sources["prices"]], START, END)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_clean(spark):
    rows = [("s", day(i), v) for i, v in enumerate([5e9, 2000.0, None, 3000.0, 1.0, None])]
    df = spark.createDataFrame(rows, "series_id string, date date, head_count double")
    train, holdout = clean(df, ["head_count"], max_gap=1, cutoff=str(day(3)))
    assert [r["head_count"] for r in train.orderBy("date").collect()] == [None, 2000.0, 2500.0, 3000.0]
    assert [r["head_count"] for r in holdout.orderBy("date").collect()] == [3000.0, None]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in ("s", "t"):
        level = 100 + np.cumsum(rng.normal(0, 1, 160))
        rows += [(s, EPOCH + dt.timedelta(days=i), float(v), float(rng.normal())) for i, v in enumerate(level)]
    df = spark.createDataFrame(rows, "series_id string, date date, price_a double, noise double")
    return cut_lineage(
        features.with_columns(
            df.withColumn("constant", F.lit(1.0)),
            features.lag_columns(["price_a"], (1, 7)),
            features.mean_columns(["price_a"], (7,)),
            features.target_columns(horizons=(1, 7)),
        )
    )


def inputs(df):
    return features.feature_names(df.columns)


def test_walk_forward_oof(table):
    oof = training.walk_forward_oof(table, inputs(table), "target_h7d", KINDS, min_train=60, n_folds=3)
    got = oof.toPandas()
    # 153 dates with a target: three folds of 31 dates, two series.
    assert got.groupby("fold").size().to_dict() == {1: 62, 2: 62, 3: 62}
    assert got["date"].min() == day(60) and got["date"].max() == day(152)
    assert np.isfinite(got[["y_true", "pred_boosted", "pred_forest"]]).all().all()
    assert not got.duplicated(["series_id", "date"]).any()


def test_no_folds_is_an_error(table):
    with pytest.raises(ValueError):
        training.walk_forward_oof(table, inputs(table), "target_h7d", KINDS, min_train=1000)


def test_training_ignores_later_rows(table):
    """Changing prices after a fold's training window must not change that fold's model."""
    changed = table.withColumn(
        "target_h7d", F.when(F.col("date") > F.lit(day(59)), F.col("target_h7d") * 2).otherwise(F.col("target_h7d"))
    )
    run = lambda d: training.walk_forward_oof(
        d, inputs(d), "target_h7d", {FOREST: KINDS[FOREST]}, min_train=60, n_folds=3
    ).where("fold = 1").orderBy("series_id", "date").toPandas()
    np.testing.assert_allclose(run(table)["pred_forest"], run(changed)["pred_forest"])


def test_tuning(table):
    trials = {FOREST: [{"numTrees": 2, "maxDepth": 1}, {"numTrees": 4, "maxDepth": 5}], BOOSTED: [KINDS[BOOSTED]]}
    best, log = training.tune_candidates(table, inputs(table), "target_h7d", trials, min_train=60, n_folds=3)
    rows = log.toPandas()
    assert len(rows) == 3 and rows["best"].sum() == 2
    forest = rows[rows.model == FOREST]
    assert forest.loc[forest["mape"].idxmin(), "best"]
    assert best[FOREST]["numTrees"] in (2, 4) and best[FOREST]["seed"] == 42
    defaults, empty = training.tune_candidates(table, inputs(table), "target_h7d", trials, min_train=1000)
    assert defaults[FOREST]["numTrees"] == 500 and empty.count() == 0


@pytest.fixture(scope="module")
def models(table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    return folder, training.final_refit(table, inputs(table), [1, 7], folder, KINDS)


def test_saved_model_predicts_the_same(table, models):
    folder, fitted = models
    loaded = training.load_model(folder, FOREST, 7)
    assert training.model_features(loaded) == inputs(table)
    first = training.predict(table, fitted[7][FOREST], FOREST, ["series_id", "date"])
    second = training.predict(table, loaded, FOREST, ["series_id", "date"])
    assert first.exceptAll(second).count() == 0
    with pytest.raises(Exception):
        training.load_model(folder, FOREST, 99)


def test_forecasts(table, models):
    _, fitted = models
    latest = forecasting.forecast_latest(table, fitted).toPandas()
    assert len(latest) == 4
    assert (latest["as_of_date"] == day(159)).all()
    ahead = pd.to_datetime(latest["forecast_date"]) - pd.to_datetime(latest["as_of_date"])
    assert (ahead.dt.days == latest["horizon"]).all()
    assert np.allclose(latest["pred_mean"], (latest["pred_boosted"] + latest["pred_forest"]) / 2, atol=0.011)
    period = forecasting.forecast_period(table, fitted, str(day(150)), str(day(159))).toPandas()
    assert len(period) == 2 * 10 * 2
    assert period["y_true"].isna().sum() == 2 * (1 + 7)
    assert np.isfinite(period["pred_forest"]).all()


def test_importances(spark, table, models):
    _, fitted = models
    native = training.feature_importance(spark, fitted[7][FOREST], 3).toPandas()
    assert len(native) == 3 and native["importance"].is_monotonic_decreasing
    permuted = training.permutation_importance(
        table, fitted[1][FOREST], "target_h1d", ["series_id", "date"], repeats=2
    ).toPandas().set_index("feature")
    assert permuted.loc["constant", "importance"] == pytest.approx(0, abs=1e-12)
    assert permuted.loc["constant", "std"] == pytest.approx(0, abs=1e-12)
    assert permuted["importance"].max() > 0.1
    assert permuted["importance"].idxmax() != "noise"


def test_isotonic_calibration(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(50, 150, 400)
    df = spark.createDataFrame(
        pd.DataFrame({"horizon": 1, "model": "m", "y_true": p * 1.2 + rng.normal(0, 5, 400), "y_pred": p, "id": range(400)})
    )
    out = training.isotonic_calibration(df, ["horizon", "model"], row_key=("id",)).toPandas().sort_values("y_pred")
    assert (np.diff(out["y_cal"]) >= -1e-9).all()
    assert (out["y_true"] - out["y_cal"]).abs().mean() < (out["y_true"] - out["y_pred"]).abs().mean()


def test_exchange_ratio(spark):
    rows = [("s", day(0), 10.0, 60.0), ("s", day(1), 20.0, None), ("s", day(40), 10.0, 90.0), ("s", day(70), 10.0, None)]
    df = spark.createDataFrame(rows, "series_id string, date date, price_a double, price_b double")
    got = [tuple(r) for r in reports.exchange_ratio(df).orderBy("month").collect()]
    assert got == [
        ("s", dt.date(2020, 1, 1), 270.0, 60.0, 4.5, 3.25, True),
        ("s", dt.date(2020, 2, 1), 180.0, 90.0, 2.0, 3.25, False),
    ]


def test_sentiment(spark):
    df = spark.createDataFrame(
        [("s", dt.datetime(2020, 1, 2, 9), 0.5), ("s", dt.datetime(2020, 1, 2, 10), -0.1), ("s", dt.datetime(2020, 3, 1), 1.0)],
        "series_id string, ts timestamp, score double",
    )
    rows = reports.daily_sentiment(df, "2020-01-01", "2020-01-05", (1,)).orderBy("date").collect()
    assert [r["sentiment"] for r in rows] == pytest.approx([0.0, 0.2, 0.0, 0.0, 0.0])
    assert rows[2]["sentiment_lag1d"] == pytest.approx(0.2)


def test_slaughter_vs_price(spark):
    rows = [("s", day(i), 3e6 if i >= 31 else None, 100.0) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, date date, weight double, price_a double")
    assert [tuple(r) for r in reports.slaughter_vs_price(df).collect()] == [("s", dt.date(2020, 2, 1), 3.0, 100.0)]
