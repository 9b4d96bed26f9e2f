"""Landed files to panel, and the panel's awkward inputs."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import tidy
from seriesloom.operators.calendar import fill_calendar
from seriesloom.operators.combine import join_sources, long_to_wide
from seriesloom.operators.features import feature_table
from seriesloom.plans import training
from seriesloom.plans.dataset import INTERPOLATE, Source, build_dataset, clean_and_write
from seriesloom.plans.landing import load_sources
from tests.helpers import day


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    for series in ("north", "south west"):
        folder = root / "quotes" / series
        folder.mkdir(parents=True)
        head = "Source;\nUnit;R$\nDate;Value\n"
        (folder / "price_a-1.csv").write_text(head + "01/01/2020;100,0\n11/01/2020;110,0\n11/01/2020;999\n", encoding="utf-8")
        (folder / "price_a-2.csv").write_text(head + "11/01/2020;500\n31/01/2020;130,0\n", encoding="utf-8")
        (folder / "price_b.csv").write_text(head + "05/01/2020;R$ 10,5\nbad;3\n", encoding="utf-8")

    def put(kind, name, document):
        (root / kind).mkdir(exist_ok=True)
        (root / kind / name).write_text(json.dumps(document, ensure_ascii=False), encoding="utf-8")

    label = {"D3C": "code", "D4N": "month", "D2N": "name", "V": "Valor"}
    record = lambda period, ordinal, v: {"D3C": period, "D4N": ordinal, "D2N": "Peso total das carcaças", "V": v}
    put("statistics", "a.json", [label, record("202001", "No 1º mês", "1000"), record("202001", "No 2º mês", "...")])
    put("statistics", "b.json", [label, record("202001", "No 1º mês", "7"), record("202001", "No 2º mês", "2000")])
    trade = lambda heading, fob: {"year": "2020", "monthNumber": "1", "heading": heading, "metricFOB": fob, "metricKG": "2"}
    put("trade", "2020.json", {"data": {"list": [trade("0201", "10"), trade("0202", "20")]}})
    put("trade", "again.json", {"data": {"list": []}})
    rate = lambda v, ts: {"cotacaoVenda": v, "dataHoraCotacao": ts}
    put("rates", "r.json", {"value": [rate(5.0, "2020-01-03 10:00:00"), rate(5.5, "2020-01-03 13:00:00"), rate(None, "2020-01-03 14:00:00")]})
    put("inflation", "i.json", [{"data": "01/01/2020", "valor": "1.0"}, {"data": "01/02/2020", "valor": "2.0"}])
    put("inflation", "j.json", [{"data": "01/02/2020", "valor": "2.0"}])
    cells = [(dt.date(2020, 1, 1), 0.0, 0.0, 0.001), (dt.date(2020, 1, 1), 0.0, 1.0, 0.003)]
    spark.createDataFrame(cells, "time date, latitude double, longitude double, tp double").write.parquet(str(root / "rain"))
    return str(root)


def test_landed_files_become_a_panel(spark, landed):
    sources = load_sources(spark, landed, base_month="2020-01-01", prices=("price_a", "price_b"))
    assert list(sources) == ["quotes", "statistics", "trade", "rates", "inflation", "rain"]
    panel = build_dataset(sources, "2020-01-01", "2020-03-31").toPandas().sort_values(["series_id", "date"])
    assert set(panel["series_id"]) == {"north", "south west"} and len(panel) == 2 * 91
    north = panel[panel["series_id"] == "north"].set_index("date")
    row = north.loc[dt.date(2020, 1, 6)]
    assert row["price_a_nominal"] == pytest.approx(105.0) and row["price_b_nominal"] == 10.5
    assert north.loc[dt.date(2020, 1, 11), "price_a_nominal"] == 110.0, "the first record of a day counts"
    assert north.loc[dt.date(2020, 2, 20), "price_a"] == pytest.approx(130 / 1.02)
    assert north["fx"].eq(5.5).all()
    february, march = north.loc[dt.date(2020, 2, 3)], north.loc[dt.date(2020, 3, 3)]
    assert (february["weight"], march["weight"]) == (1000.0, 2000.0), "published a month later"
    assert february["trade_value"] == 30.0 and february["trade_qty"] == 4.0
    assert february["rain_mm"] == pytest.approx(2.0) and march["price_index"] == pytest.approx(102.0)


def test_absent_folders_give_no_source(spark, landed, tmp_path):
    assert load_sources(spark, str(tmp_path), "2020-01-01") == {}
    assert list(load_sources(spark, landed, "2020-01-01", include=["rates", "rain"])) == ["rates", "rain"]


def test_duplicates_take_the_first_or_are_an_error(spark):
    rows = [("s", day(0), 10.0, 2), ("s", day(0), 99.0, 5), ("s", day(4), 14.0, 1), ("s", day(4), 0.0, 9)]
    quotes = spark.createDataFrame(rows, "series_id string, date date, price_a double, n int")
    span = (str(day(0)), str(day(4)))
    placed = build_dataset({"q": Source(quotes, ("price_a",), INTERPOLATE, order="n")}, *span, deflate_prices=False)
    assert [r["price_a"] for r in placed.orderBy("date").collect()] == [10.0, 11.0, 12.0, 13.0, 14.0]
    with pytest.raises(Exception, match="remove duplicates first"):
        build_dataset({"q": Source(quotes, ("price_a",), INTERPOLATE)}, *span, deflate_prices=False).collect()
    with pytest.raises(Exception, match="remove duplicates first"):
        fill_calendar(quotes, ["series_id"], *span, "price_a").collect()
    with pytest.raises(Exception, match="remove duplicates first"):
        join_sources([quotes.select("series_id", "date", "price_a")]).collect()
    with pytest.raises(Exception, match="remove duplicates first"):
        long_to_wide(quotes.withColumn("variable", F.lit("v")), ["v"], value="price_a").collect()


def test_an_index_of_each_series_deflates(spark):
    prices = spark.createDataFrame(
        [(s, day(0), 100.0, index) for s, index in (("s", 100.0), ("t", 200.0))],
        "series_id string, date date, price_a double, price_index double",
    )
    fx = spark.createDataFrame([(day(0), 5.0)], "date date, fx double")
    sources = {"own": Source(prices, ("price_a", "price_index")), "fx": Source(fx, ("fx",), shared=True)}
    got = build_dataset(sources, str(day(0)), str(day(3))).toPandas()
    assert dict(got.groupby("series_id")["price_a"].max()) == {"s": 100.0, "t": 50.0}
    assert set(got["fx"]) == {5.0}


def test_clean_report_equals_the_single_reports(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [
        (s, day(i), None if rng.random() < 0.4 else float(rng.normal(100, 30)), float(rng.choice([5.0, 900.0, 2e7])))
        for s in "st" for i in range(60)
    ]
    panel = spark.createDataFrame(rows, "series_id string, date date, price_a double, head_count double")
    path, columns = str(tmp_path / "clean"), ["price_a", "head_count"]
    plans = []

    def write(df):
        df.write.parquet(path)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())

    got = {r["column_name"]: r for r in clean_and_write(panel, columns, write, 3).table(spark).collect()}
    cleaned = spark.read.parquet(path)
    violations = {tuple(r)[-2:] for r in tidy.bound_violations(panel).collect()}
    assert (got["head_count"]["n_below"], got["head_count"]["n_above"]) in violations and min(max(violations)) > 0
    for r in tidy.missing_report(panel, columns).collect():
        assert got[r["column_name"]]["n_missing_before"] == r["n_missing"]
    for r in tidy.missing_report(cleaned, columns).collect():
        assert (got[r["column_name"]]["n_missing"], got[r["column_name"]]["pct_missing"]) == (r["n_missing"], r["pct_missing"])
    top = cleaned.agg(F.min("price_a"), F.max("price_a"), F.avg("price_a")).first()
    assert tuple(got["price_a"][k] for k in ("min_value", "max_value", "mean_value")) == pytest.approx(tuple(top))
    assert plans[0].count("LogicalRDD") + plans[0].count("LocalRelation") == 1, "one scan of the panel"


def test_a_feature_without_values_does_not_stop_training(spark):
    rows = [(s, day(i), 100.0 + i % 7) for s in "st" for i in range(150)]
    prices = spark.createDataFrame(rows, "series_id string, date date, price_a double")
    table = feature_table(prices, horizons=(7,)).withColumn("empty", F.lit(None).cast("double"))
    inputs = ["price_a_lag7d", "empty"]
    model = training.fit_model(table, inputs, "target_h7d", training.FOREST, {"numTrees": 2, "maxDepth": 2})
    assert training.predict(table, model, training.FOREST, ["date"]).where("pred_forest is null").count() == 0
    medians = training.fold_medians(
        training.labelled(table, "target_h7d"), inputs, [{"fold": 1, "train_end": day(80)}, {"fold": 2, "train_end": day(120)}]
    )
    for fold, last in ((1, 80), (2, 120)):
        known = [100.0 + (i - 7) % 7 for i in range(7, last + 1)]
        assert medians[fold] == {"price_a_lag7d": pytest.approx(float(np.median(known)))}


def test_tuning_keeps_targets_out_of_the_check_period(spark):
    """With an embargo the training rows end earlier; a price change inside it changes nothing."""
    rng = np.random.default_rng(1)
    rows = [("s", day(i), float(100 + rng.normal())) for i in range(200)]
    table = feature_table(spark.createDataFrame(rows, "series_id string, date date, price_a double"), horizons=(7,))
    trials = {training.FOREST: [{"numTrees": 2, "maxDepth": 3}]}
    cut = training._fold_list(training.labelled(table, "target_h7d"), 100, 2, 7)[0]
    inside = F.col("date").between(F.lit(cut["train_end"]) + F.expr("interval 1 day"), F.lit(cut["test_start"]) - F.expr("interval 1 day"))
    changed = table.withColumn("target_h7d", F.when(inside, 1e6).otherwise(F.col("target_h7d")))
    score = lambda t: training.tune_candidates(t, ["price_a_lag7d"], "target_h7d", trials, 100, 2, embargo_days=7)[1].first()["mae"]
    assert score(table) == pytest.approx(score(changed))
