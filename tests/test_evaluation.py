"""Metrics, distribution tables and feature relevance."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from seriesloom.operators import metrics, relevance, spread
from seriesloom.plans.forecasting import forecast_vs_actual, shift_to_target_date
from tests.helpers import day


def test_error_metrics_with_zero_and_missing(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 8.0), ("a", 0.0, 1.0), ("a", None, 3.0), ("b", 4.0, 5.0), ("b", 2.0, None)],
        "g string, y_true double, y_pred double",
    )
    plain = {r["g"]: r for r in metrics.error_metrics(df, keys=["g"]).collect()}
    assert plain["a"]["mape"] is None and plain["a"]["mae"] == 1.5
    assert plain["a"]["rmse"] == pytest.approx(math.sqrt(2.5))
    assert plain["b"]["mape"] == pytest.approx(25.0)
    skipped = {r["g"]: r for r in metrics.error_metrics(df, keys=["g"], skip_zero=True).collect()}
    assert skipped["a"]["mape"] == pytest.approx(20.0)


def test_summary_mean_best_crosstab(spark):
    df = spark.createDataFrame(
        [(1, 1, 10.0, 9.0, 11.0), (1, 2, 10.0, 8.0, 12.0), (7, 1, 10.0, 5.0, 9.0)],
        "horizon int, fold int, y_true double, p double, q double",
    )
    summary = metrics.metrics_summary(df, {"first": "p", "second": "q"}, ["horizon", "fold"])
    assert summary.count() == 6
    means = metrics.metrics_mean(summary)
    best = {r["horizon"]: (r["model"], r["mape"]) for r in metrics.best_model(means).collect()}
    assert best == {1: ("first", 15.0), 7: ("second", 10.0)}
    cross = {r["horizon"]: (r["first"], r["second"], r["third"]) for r in metrics.metrics_crosstab(means, ["first", "second", "third"]).collect()}
    assert cross == {1: (15.0, 15.0, None), 7: (50.0, 10.0, None)}
    assert [tuple(r) for r in metrics.distinct_sorted(summary, ["horizon"]).collect()] == [(1,), (7,)]


def test_best_model_ignores_missing_scores(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 3.0)], "horizon int, model string, mape double")
    assert metrics.best_model(df).first()["model"] == "b"


def test_seasonal_error_has_all_months(spark):
    df = spark.createDataFrame([(day(0), 10.0, 8.0), (day(45), 0.0, 1.0)], "date date, y_true double, y_pred double")
    rows = metrics.seasonal_error(df).orderBy("month").collect()
    assert [r["label"] for r in rows][:2] == ["Jan", "Fev"] and len(rows) == 12
    assert rows[0]["abs_error"] == 2.0 and rows[0]["pct_error"] == pytest.approx(20.0)
    assert rows[1]["pct_error"] == pytest.approx(1e10) and rows[5]["abs_error"] is None


def test_tolerance_depends_on_horizon(spark):
    before = spark.createDataFrame([(1, "m", 10.0), (15, "m", 10.0), (30, "m", 10.0)], "horizon int, model string, mape double")
    after = spark.createDataFrame([(1, "m", 12.5), (15, "m", 14.0), (30, "m", 15.5)], "horizon int, model string, mape double")
    got = {r["horizon"]: r["status"] for r in metrics.tolerance_status(before, after).collect()}
    assert got == {1: "degradou", 15: "ok", 30: "degradou"}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(290, 40, 2000)
    p = np.round(y + rng.normal(0, 15, 2000))  # rounded: equal predictions
    h = np.where(rng.random(2000) < 0.5, 1, 7)
    pdf = pd.DataFrame({"horizon": h, "y_true": y, "y_pred": p})
    return pdf, spark.createDataFrame(pdf)


def test_price_bands_match_cut(scored):
    pdf, df = scored
    got = spread.price_band_counts(df, ["y_true", "y_pred"], ["horizon"]).toPandas()
    bins = [0, 240, 255, 270, 285, 300, 315, 330, 400]
    for h, part in pdf.groupby("horizon"):
        for c in ("y_true", "y_pred"):
            want = pd.cut(part[c], bins, right=False).value_counts().sort_index().tolist()
            mine = got[(got.horizon == h) & (got.source == c)].sort_values("band")["n"].tolist()
            assert mine == want


def test_empty_bands_count_zero(spark):
    df = spark.createDataFrame([(250.0,), (400.0,), (None,)], "x double")
    assert [r["n"] for r in spread.price_band_counts(df, ["x"]).orderBy("band").collect()] == [0, 1, 0, 0, 0, 0, 0, 0]


def test_histogram_matches_numpy(scored):
    pdf, df = scored
    got = spread.histogram(spread.residuals(df), "residual", ["horizon"]).toPandas()
    for h, part in pdf.groupby("horizon"):
        density, edges = np.histogram(part["y_true"] - part["y_pred"], bins=30, density=True)
        mine = got[got.horizon == h].sort_values("bin")
        np.testing.assert_allclose(mine["density"], density)
        np.testing.assert_allclose(mine["lo"], edges[:-1])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, v double")
    rows = spread.histogram(df, "v", ["g"], 3).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 0, 0] and rows[0]["density"] is None


def test_calibration_matches_qcut(scored):
    pdf, df = scored
    got = spread.calibration_curve(df, ["horizon"]).toPandas()
    for h, part in pdf.groupby("horizon"):
        part = part.assign(bin=pd.qcut(part["y_pred"], q=12, duplicates="drop", labels=False) + 1)
        want = part.groupby("bin").agg(p=("y_pred", "mean"), y=("y_true", "mean"), n=("y_pred", "size"))
        mine = got[got.horizon == h].set_index("bin").sort_index()
        np.testing.assert_allclose(mine["mean_pred"], want["p"])
        np.testing.assert_allclose(mine["mean_true"], want["y"])
        assert mine["n"].tolist() == want["n"].tolist()


def test_calibration_drops_duplicate_edges(spark):
    df = spark.createDataFrame([("a", float(i), 5.0 if i < 80 else float(i)) for i in range(100)], "g string, y_true double, y_pred double")
    pdf = df.toPandas()
    codes = pd.qcut(pdf["y_pred"], q=12, duplicates="drop", labels=False)
    got = spread.calibration_curve(df, ["g"]).orderBy("bin").toPandas()
    assert got["n"].tolist() == codes.value_counts().sort_index().tolist()


def test_density_grid_and_range(scored):
    pdf, df = scored
    grid = spread.density_grid(df, ["horizon"]).toPandas()
    assert grid["n"].sum() == len(pdf) and grid["cell_x"].between(0, 39).all()
    np.testing.assert_allclose(grid["log_n"], np.log10(grid["n"]))
    limits = spread.value_range(df, ["horizon"]).toPandas().set_index("horizon")
    for h, part in pdf.groupby("horizon"):
        assert limits.loc[h, "lo"] == min(part["y_true"].min(), part["y_pred"].min())


def test_qq_points_against_definition(scored):
    pdf, df = scored
    points = spread.qq_points(spread.residuals(df), ["horizon"]).toPandas()
    for h, part in pdf.groupby("horizon"):
        n = len(part)
        mine = points[points.horizon == h].sort_values("place")
        np.testing.assert_array_equal(mine["ordered"], np.sort(part["y_true"] - part["y_pred"]))
        medians = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
        medians[-1], medians[0] = 0.5 ** (1 / n), 1 - 0.5 ** (1 / n)
        want = [NormalDist().inv_cdf(m) for m in medians]
        np.testing.assert_allclose(mine["theoretical"], want, atol=1e-6)
    line = spread.qq_line(spread.qq_points(spread.residuals(df), ["horizon"]), ["horizon"]).toPandas()
    assert (line["r"] > 0.99).all()


def test_residual_normal_integrates_to_about_one(scored):
    _, df = scored
    out = spread.residual_normal(spread.residuals(df), ["horizon"]).toPandas()
    for _, part in out.groupby("horizon"):
        part = part.sort_values("point")
        assert len(part) == 100
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1, abs=0.02)


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(9)
    n = 800
    base = rng.normal(size=n)
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "f_strong": np.round(base + rng.normal(0, 0.3, n), 1),
            "f_zero": np.where(rng.random(n) < 0.5, 0.0, rng.exponential(1, n)),
            "f_gaps": np.where(rng.random(n) < 0.3, np.nan, -base),
            "y": np.round(base, 2),
        }
    )
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = relevance.spearman(df, ["f_strong", "f_zero", "f_gaps"], "y", ["id"], 3).toPandas()
    filled = pdf.fillna(pdf.median())
    want = {c: filled[c].rank().corr(filled["y"].rank()) for c in ("f_strong", "f_zero", "f_gaps")}
    assert list(got["feature"]) == sorted(want, key=lambda c: -abs(want[c]))
    for _, row in got.iterrows():
        assert row["rho"] == pytest.approx(want[row["feature"]], abs=1e-9)
    strong = got.set_index("feature").loc["f_strong"]
    assert strong["significant"] == "Sim" and strong["p_value"] < 1e-6


def test_medians_and_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (None, 6.0), (10.0, None)], "a double, b double")
    assert {r["feature"]: r["median"] for r in relevance.column_medians(df, ["a", "b"]).collect()} == {"a": 2.0, "b": 5.0}
    filled = relevance.impute_medians(df, ["a", "b"])
    assert [tuple(r) for r in filled.collect()] == [(1.0, 5.0), (2.0, 4.0), (2.0, 6.0), (10.0, 5.0)]
    other = relevance.impute_medians(df, ["a"], fit_on=df.where("a > 5"))
    assert [r["a"] for r in other.collect()] == [1.0, 2.0, 10.0, 10.0]


def test_sample_is_stable_and_bounded(spark):
    df = spark.range(2000)
    first = {r["id"] for r in relevance.hash_sample(df, "id", 100).collect()}
    again = {r["id"] for r in relevance.hash_sample(df.repartition(7), "id", 100).collect()}
    assert first == again and len(first) == 100
    assert relevance.hash_sample(spark.range(10), "id", 100).count() == 10
    assert {r["id"] for r in relevance.hash_sample(df, "id", 100, seed=10**9).collect()} != first


def test_attribution_rank(spark):
    df = spark.createDataFrame([("a", -3.0), ("a", 1.0), ("b", 1.5), ("c", 0.1)], "feature string, attribution double")
    assert [tuple(r) for r in relevance.attribution_rank(df, 2).collect()] == [("a", 2.0), ("b", 1.5)]


def test_forecasts_move_to_their_target_date(spark):
    oof = spark.createDataFrame([("s", day(0), 7, 5.0), ("s", day(3), 7, 6.0)], "series_id string, date date, horizon int, y_pred double")
    assert [r["date"] for r in shift_to_target_date(oof).collect()] == [day(7), day(10)]
    actual = spark.createDataFrame([("s", day(i), float(i)) for i in range(9)], "series_id string, date date, price_a double")
    rows = {r["date"]: (r["actual"], r["h7"]) for r in forecast_vs_actual(actual, oof, str(day(7)), [7]).collect()}
    assert rows == {day(7): (7.0, 5.0), day(8): (8.0, None), day(10): (None, 6.0)}
