import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import calendar
from tests.helpers import PANEL_SCHEMA, assert_same, by_series, collected, day, random_panel, to_spark

START, END = "2020-01-01", str(day(119))


@pytest.fixture(scope="module", params=[1, 2])
def panel(request, spark):
    pdf = random_panel(request.param)
    return pdf, to_spark(spark, pdf, PANEL_SCHEMA)


def test_interpolate_daily_matches_pandas(panel):
    pdf, df = panel
    got = collected(calendar.interpolate_daily(df, START, END, "value"))
    assert_same(got, {n: s.interpolate(method="linear") for n, s in by_series(pdf).items()})


@pytest.mark.parametrize("limit", [1, 7, None])
def test_interpolate_columns_matches_pandas(panel, limit):
    pdf, df = panel
    got = collected(calendar.interpolate_columns(df, ["value"], limit))
    want = {
        n: s.interpolate(method="linear", limit=limit, limit_direction="forward")
        for n, s in by_series(pdf).items()
    }
    assert_same(got, want)


def test_whole_gap_only_leaves_long_gaps(spark):
    rows = [("s", day(i), v) for i, v in enumerate([1.0, None, 3.0, None, None, None, 7.0, None])]
    df = spark.createDataFrame(rows, PANEL_SCHEMA)
    got = collected(calendar.interpolate_columns(df, ["value"], 2, whole_gap_only=True))["s"]
    np.testing.assert_array_equal(got.to_numpy(), [1, 2, 3, np.nan, np.nan, np.nan, 7, 7])


def test_fill_calendar_gap_limit_agrees_with_dense_form(panel):
    _, df = panel
    sparse = df.where("value is not null")
    limited = calendar.fill_calendar(
        sparse, ["series_id"], START, END, "value", calendar.INTERPOLATE, max_gap=7
    )
    assert_same(collected(limited), collected(calendar.interpolate_columns(df, ["value"], 7)))


def test_asof_carries_null_rows(spark):
    rows = [("s", day(3), 1.0), ("s", day(6), None), ("s", day(8), 5.0)]
    df = spark.createDataFrame(rows, PANEL_SCHEMA)
    got = collected(calendar.asof_daily(df, START, str(day(9)), ["value"]))["s"].to_numpy()
    np.testing.assert_array_equal(got, [np.nan] * 3 + [1, 1, 1, np.nan, np.nan, 5, 5])


def test_asof_matches_reindex(panel):
    pdf, df = panel
    keep = pdf[(pd.to_datetime(pdf["date"]).dt.day % 3) == 0]
    got = collected(
        calendar.asof_daily(df.where(F.dayofmonth("date") % 3 == 0), START, END, ["value"])
    )
    index = pd.date_range(START, END)
    assert_same(got, {n: s.reindex(index, method="ffill") for n, s in by_series(keep).items()})


def test_asof_uses_rows_before_the_calendar(spark):
    df = spark.createDataFrame([("s", dt.date(2019, 12, 1), 4.0), ("s", day(2), 6.0)], PANEL_SCHEMA)
    got = collected(calendar.asof_daily(df, START, str(day(3)), ["value"]))["s"].to_numpy()
    np.testing.assert_array_equal(got, [4, 4, 6, 6])


def test_fill_ways(panel):
    pdf, df = panel
    got = collected(df.select("series_id", "date", calendar.fill_both_ways("value").alias("value")))
    assert_same(got, {n: s.ffill().bfill() for n, s in by_series(pdf).items()})
    got = collected(df.select("series_id", "date", calendar.forward_fill("value").alias("value")))
    assert_same(got, {n: s.ffill() for n, s in by_series(pdf).items()})


def test_monthly_first_and_mean(panel):
    pdf, df = panel
    first = collected(calendar.monthly_first(df, "value").withColumnRenamed("month", "date"))
    assert_same(first, {n: s.resample("MS").first() for n, s in by_series(pdf).items()})
    mean = collected(calendar.monthly_mean(df, "value").withColumnRenamed("month", "date"))
    assert_same(mean, {n: s.resample("MS").mean().dropna() for n, s in by_series(pdf).items()})


def test_monthly_first_keeps_empty_months(spark):
    df = spark.createDataFrame([("s", day(0), 1.0), ("s", dt.date(2020, 5, 9), 2.0)], PANEL_SCHEMA)
    rows = calendar.monthly_first(df, "value").orderBy("month").collect()
    assert [(r["month"].month, r["value"]) for r in rows] == [(1, 1.0), (2, None), (3, None), (4, None), (5, 2.0)]


def test_publication_lag_matches_pandas(panel):
    pdf, df = panel
    got = collected(calendar.publication_lag(df, ["value"]))
    want = {
        n: s.resample("MS").first().shift(1).reindex(s.index, method="ffill")
        for n, s in by_series(pdf).items()
    }
    assert_same(got, want)


def test_publication_lag_never_looks_at_the_same_month(panel):
    _, df = panel
    changed = df.withColumn(
        "value", F.when(F.col("date") >= F.lit("2020-03-01").cast("date"), F.col("value") + 1000).otherwise(F.col("value"))
    )
    cut = F.col("date") < F.lit("2020-04-01").cast("date")
    before = collected(calendar.publication_lag(df, ["value"]).where(cut))
    after = collected(calendar.publication_lag(changed, ["value"]).where(cut))
    assert_same(after, before)


def test_spine_and_days(spark):
    df = spark.createDataFrame([("a", day(5)), ("b", day(7)), ("a", day(5))], "series_id string, date date")
    assert calendar.calendar_spine(df, START, str(day(9))).count() == 20
    assert calendar.calendar_days(spark, "2010-01-01", "2025-12-31").count() == 5844


def test_one_shuffle_from_sparse_rows_to_windows(spark):
    """Filling and a later window reuse the partitioning by series."""
    pdf = random_panel(3, 2)
    df = to_spark(spark, pdf, PANEL_SCHEMA).repartition("series_id")
    dense = calendar.interpolate_daily(df, START, END, "value")
    lagged = dense.select("*", calendar.forward_fill("value").alias("f"))
    plan = lagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
