"""Cleaning, combining, features and folds."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import combine, features, folds, tidy
from tests.helpers import PANEL_SCHEMA, assert_same, by_series, collected, day, random_panel, to_spark


@pytest.fixture(scope="module")
def panel(spark):
    pdf = random_panel(11, n_series=6)
    return pdf, to_spark(spark, pdf, PANEL_SCHEMA)


def test_dedupe_first(spark):
    df = spark.createDataFrame(
        [("a", 5, 1.0, None), ("a", 2, 2.0, "x"), ("a", 9, 3.0, "y"), ("b", 1, None, "z")],
        "k string, o long, v double, t string",
    )
    rows = {r["k"]: (r["v"], r["t"], r["o"]) for r in tidy.dedupe_first(df, ["k"], "o").collect()}
    assert rows == {"a": (2.0, "x", 2), "b": (None, "z", 1)}
    counted = tidy.duplicate_count(df, ["k"]).first()
    assert tuple(counted) == (4, 2, 2)


def test_last_known_skips_missing(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, None)], "d int, o long, v double")
    rows = {r["d"]: r["v"] for r in tidy.last_known_per_key(df, ["d"], "v", ["o"]).collect()}
    assert rows == {1: 5.0, 2: None}


def test_bounds(spark):
    df = spark.createDataFrame([(500.0, 1.0), (2e3, None), (2e7, 3.0)], "head_count double, other double")
    assert [r[0] for r in tidy.domain_bounds(df).collect()] == [None, 2e3, None]
    assert tuple(tidy.bound_violations(df).first()) == ("head_count", 1, 1)


def test_holdout_and_guard(panel):
    _, df = panel
    train, holdout = tidy.holdout_split(df, str(day(99)))
    assert (train.count(), holdout.count()) == (600, 120)
    with pytest.raises(ValueError):
        tidy.assert_cutoff(df, str(day(99)))
    tidy.assert_cutoff(train, str(day(99)))


def test_latest_complete_row(spark):
    rows = [("s", day(0), 1.0, 1.0), ("s", day(1), 2.0, 2.0), ("s", day(2), 3.0, None), ("t", day(0), None, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double")
    got = tidy.latest_complete_row(df, ["a", "b"]).collect()
    assert [(r["series_id"], r["as_of_date"], r["feature_date"], r["a"]) for r in got] == [("s", day(2), day(1), 2.0)]


def test_deflate_needs_the_index(spark):
    df = spark.createDataFrame([(200.0, 50.0), (100.0, None), (100.0, 0.0)], "price_a double, price_index double")
    got = tidy.deflate(df, ["price_a", "price_b"])
    assert got.columns == ["price_a", "price_index", "price_a_nominal"]
    assert [r["price_a"] for r in got.collect()] == [400.0, None, None]
    with pytest.raises(KeyError):
        tidy.deflate(df.drop("price_index"), ["price_a"])


def test_price_index_skips_a_missing_month(spark):
    pct = [1.0, None, 2.0, -0.5]
    months = [dt.date(2024, m, 1) for m in (1, 2, 3, 4)]
    df = spark.createDataFrame(list(zip(months, pct)), "month date, pct double")
    chain = (1 + pd.Series(pct) / 100).cumprod()
    got = tidy.price_index(df, "2024-03-01").orderBy("month").toPandas()["price_index"]
    np.testing.assert_allclose(got, chain / chain[2] * 100)
    with pytest.raises(Exception, match="base month"):
        tidy.price_index(df, "2025-01-01").collect()


def test_missing_report_and_most_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    rows = [tuple(r) for r in tidy.missing_report(df, ["a", "b"]).collect()]
    assert rows == [("a", 1, 25.0), ("b", 2, 50.0)]
    assert [r["column_name"] for r in tidy.most_missing(df, ["a", "b"], 1).collect()] == ["b"]


def test_describe_and_stats(panel):
    pdf, df = panel
    got = tidy.describe_series(df, ["value"]).toPandas().set_index("series_id")
    for name, s in by_series(pdf).items():
        want = s.describe().round(2)
        np.testing.assert_allclose(
            got.loc[name, ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), want, atol=0.011
        )
    stats = tidy.price_stats(df, ["value"]).toPandas().set_index("series_id")
    for name, s in by_series(pdf).items():
        assert stats.loc[name, "n_missing"] == s.isna().sum()
        assert stats.loc[name, "mean_value"] == pytest.approx(s.mean())


def test_join_sources_equals_outer_join(spark):
    a = spark.createDataFrame([("s", day(0), 1.0), ("s", day(1), None)], "series_id string, date date, a double")
    b = spark.createDataFrame([("s", day(1), 5.0, 9.0), ("t", day(3), 6.0, 8.0)], "series_id string, date date, b double, a double")
    got = combine.join_sources([a, b]).orderBy("series_id", "date")
    assert got.columns == ["series_id", "date", "a", "b"]
    assert [tuple(r) for r in got.collect()] == [
        ("s", day(0), 1.0, None), ("s", day(1), None, 5.0), ("t", day(3), None, 6.0),
    ]
    with pytest.raises(ValueError):
        combine.join_sources([])


def test_set_operations(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k int, v double")
    b = spark.createDataFrame([(2, 4.0), (3, 1.0)], "k int, v double")
    assert sorted(tuple(r) for r in combine.sum_parts([a, b], ["k"], ["v"]).collect()) == [(1, 5.0), (2, 5.0), (3, 1.0)]
    assert [r["k"] for r in combine.common_keys(a, b, ["k"]).collect()] == [2]
    assert {tuple(r) for r in combine.align(a.where("v > 2 or k = 2"), b.withColumnRenamed("v", "w"), ["k"], ["w"]).collect()} == {
        (1, 3.0, None), (2, 1.0, 4.0),
    }


@pytest.mark.parametrize("n", [1, 7, 30])
def test_window_features_match_pandas(panel, n):
    pdf, df = panel
    want = by_series(pdf)
    built = features.with_columns(
        features.padded(df, ["value"]),
        features.lag_columns(["value"], (n,)),
        features.mean_columns(["value"], (n,)),
        features.deviation_columns(["value"], (n,)),
        features.change_columns(["value"], (n,)),
        features.target_columns("value", (n,)),
    ).cache()
    assert_same(collected(built, f"value_lag{n}d"), {k: s.shift(n) for k, s in want.items()})
    assert_same(collected(built, f"value_ma{n}d"), {k: s.rolling(n, min_periods=1).mean() for k, s in want.items()})
    assert_same(
        collected(built, f"value_std{n}d"), {k: s.rolling(n, min_periods=1).std() for k, s in want.items()}
    ) if n > 1 else None
    padded = {k: s.ffill() for k, s in want.items()}
    assert_same(collected(built, f"value_pct{n}d"), {k: s / s.shift(n) - 1 for k, s in padded.items()})
    assert_same(collected(built, f"target_h{n}d"), {k: s.shift(-n) for k, s in want.items()})
    built.unpersist()


def test_zero_denominators(spark):
    rows = [("s", day(i), a, 0.0) for i, a in enumerate([1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "series_id string, date date, price_a double, price_c double")
    out = features.with_columns(
        features.padded(df, ["price_a"]), features.change_columns(["price_a"], (1,)), features.ratio_columns(df.columns)
    ).orderBy("date")
    assert [r["price_a_pct1d"] for r in out.collect()] == [None, -1.0, None]
    assert {r["ratio_a_c"] for r in out.collect()} == {None}


def _full_panel(spark, n=150):
    columns = list(features.FEATURE_COLUMNS)
    rows = [("s", day(i), *[float(10 + j + (i * (j + 3)) % 17) for j in range(len(columns))]) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, date date, " + ", ".join(f"{c} double" for c in columns))


def test_feature_table_counts(spark):
    df = _full_panel(spark)
    table = features.feature_table(df)
    added = set(table.columns) - set(df.columns)
    assert len(added) == 148 + 5
    names = features.feature_names(table.columns)
    assert len(names) == 148 + 6 and "price_a" not in names
    with pytest.raises(KeyError):
        features.feature_table(df.drop("price_a"))
    fewer = features.feature_table(df.drop("fx", "rain_mm"))
    assert not any(c.startswith(("fx", "rain")) for c in fewer.columns)


def test_features_do_not_see_the_future(spark):
    df = _full_panel(spark)
    cut = F.lit(str(day(100))).cast("date")
    changed = df.select(
        "series_id", "date", *[F.when(F.col("date") > cut, F.col(c) * 3 + 1).otherwise(F.col(c)).alias(c) for c in features.FEATURE_COLUMNS]
    )
    def past(d):
        table = features.feature_table(d)
        return table.select("date", *features.feature_names(table.columns)).where(F.col("date") <= cut).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(past(df), past(changed))


def test_window_features_take_one_window_shuffle(spark):
    plan = features.feature_table(_full_panel(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def brute_folds(n, min_train, k):
    size = (n - min_train) // k
    out = [None] * n
    if size > 0:
        for i in range(k):
            for r in range(min_train + i * size, min(min_train + (i + 1) * size, n)):
                out[r] = i + 1
    return out


@pytest.mark.parametrize("n,min_train,k", [(120, 50, 5), (120, 51, 5), (54, 50, 5), (40, 50, 5), (57, 50, 3)])
def test_walk_forward_folds(spark, n, min_train, k):
    df = spark.createDataFrame([("s", day(i)) for i in range(n)], "series_id string, date date")
    got = [r["fold"] for r in folds.walk_forward_folds(df, min_train, k).orderBy("date").collect()]
    assert got == brute_folds(n, min_train, k)


def test_fold_boundaries_and_panel_dates(spark):
    df = spark.createDataFrame([("s", day(i)) for i in range(123)], "series_id string, date date")
    rows = folds.fold_boundaries(df, 50, 5).orderBy("fold").collect()
    assert [(r["train_start"], r["train_end"], r["test_start"], r["test_end"], r["n_test"]) for r in rows] == [
        (day(0), day(49 + 14 * i), day(50 + 14 * i), day(63 + 14 * i), 14) for i in range(5)
    ]
    whole = folds.panel_fold_dates(df, 50, 5).orderBy("fold").collect()
    assert [(r["train_end"], r["test_start"], r["test_end"]) for r in whole] == [
        (r["train_end"], r["test_start"], r["test_end"]) for r in rows
    ]
    embargo = folds.panel_fold_dates(df, 50, 5, embargo_days=7).orderBy("fold").first()
    assert embargo["train_end"] == day(42)
    assert folds.panel_fold_dates(df, 200, 5).count() == 0


def test_baselines_against_brute_force(spark):
    rng = np.random.default_rng(5)
    prices = np.round(rng.normal(100, 10, 100), 2)
    df = spark.createDataFrame([("s", day(i), float(p)) for i, p in enumerate(prices)], "series_id string, date date, price_a double")
    oof = folds.baseline_oof(df, (3,), min_train=40, n_folds=4).toPandas().sort_values("date")
    y = prices[3:]
    assigned = brute_folds(97, 40, 4)
    want = [i for i in range(97) if assigned[i]]
    np.testing.assert_allclose(oof["y_true"], y[want])
    np.testing.assert_allclose(oof["baseline_last"], prices[want])
    ma7 = pd.Series(prices).rolling(7, min_periods=1).mean().to_numpy()
    np.testing.assert_allclose(oof["baseline_ma7"], ma7[want])
    chosen = folds.baseline_choice(folds.baseline_oof(df, (3,), min_train=40, n_folds=4)).toPandas()
    for _, row in chosen.iterrows():
        idx = [i for i in want if assigned[i] == row["fold"]]
        scores = {n: np.mean(np.abs((y[idx] - p[idx]) / y[idx])) * 100 for n, p in (("last", prices), ("ma7", ma7))}
        assert row["chosen"] == ("ma7" if scores["ma7"] <= scores["last"] else "last")
        assert row["mape"] == pytest.approx(min(scores.values()))


def test_baseline_choice_tie_goes_to_the_mean(spark):
    df = spark.createDataFrame(
        [("s", 1, 1, 10.0, 9.0, 11.0)],
        "series_id string, horizon int, fold int, y_true double, baseline_last double, baseline_ma7 double",
    )
    assert folds.baseline_choice(df).first()["chosen"] == "ma7"
    both = folds.oof_with_choice(df).first()
    assert both["baseline_chosen"] == 11.0
