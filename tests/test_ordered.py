import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from seriesloom.operators.ordered import (
    attach,
    attach_rank,
    exact_quantiles,
    ordered_points,
    random_rank,
    ranked_values,
    split_ranges,
)
from seriesloom.sources.store import cut_lineage


@pytest.fixture(scope="module")
def values(spark):
    """Three groups: continuous, very many ties on one value, and few distinct values."""
    rng = np.random.default_rng(7)
    smooth = rng.normal(0, 1, 3000)
    hot = np.where(rng.random(3000) < 0.4, 0.0, rng.exponential(5, 3000))
    steps = rng.integers(0, 5, 500).astype(float)
    pdf = pd.concat(
        [pd.DataFrame({"g": g, "x": x}) for g, x in (("smooth", smooth), ("hot", hot), ("steps", steps))],
        ignore_index=True,
    )
    pdf["id"] = range(len(pdf))
    missing = spark.createDataFrame([("smooth", None, -1)], "g string, x double, id long")
    return pdf, spark.createDataFrame(pdf[["g", "x", "id"]]).union(missing)


@pytest.mark.parametrize("limit", [3, 100, 10_000])
def test_ranked_values(values, limit):
    pdf, df = values
    got = ranked_values(df, ["g"], "x", limit).toPandas().sort_values(["g", "x"]).reset_index(drop=True)
    counts = pdf.groupby(["g", "x"]).size().rename("n_tied").reset_index()
    counts["n_below"] = counts.groupby("g")["n_tied"].cumsum() - counts["n_tied"]
    pd.testing.assert_frame_equal(got[["g", "x", "n_tied", "n_below"]], counts, check_dtype=False)
    assert dict(got.groupby("g")["n_total"].first()) == {"hot": 3000, "smooth": 3000, "steps": 500}


def test_exact_quantiles_match_numpy(values):
    pdf, df = values
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "x", probabilities, 16).collect()}
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(part["x"], probabilities), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("hot_share", [3, 1000])
def test_attach_rank_matches_pandas(values, hot_share):
    pdf, df = values
    known = df.where("x is not null")
    ranked = ranked_values(known, ["g"], "x", 16)
    got = attach_rank(known, ranked, ["g"], "x", "rank", ["id"], hot_share).toPandas().sort_values("id")
    want = pdf.groupby("g")["x"].rank()
    np.testing.assert_allclose(got["rank"].to_numpy(), want.to_numpy())


def test_ordered_points_unfold_ties(values):
    pdf, df = values
    got = ordered_points(ranked_values(df, ["g"], "x", 16), ["g"], "x", chunk=100).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got["g"] == g].sort_values("place")
        assert list(mine["place"]) == list(range(1, len(part) + 1))
        np.testing.assert_array_equal(mine["x"].to_numpy(), np.sort(part["x"].to_numpy()))


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_no_range_is_above_the_limit(values, limit):
    """Ranges above the limit are split again, however large the table is; order is kept."""
    _, df = values
    many = df.select("g", F.explode(F.array(*[F.col("x") + k * 1e-3 for k in range(10)])).alias("x"))
    distinct = many.where("x is not null").distinct()
    rows, sizes = split_ranges(distinct, ["g"], "x", limit)
    assert sizes.agg(F.max("_n")).first()[0] <= limit
    assert rows.count() == distinct.count() == sizes.agg(F.sum("_n")).first()[0]
    spans = rows.groupBy("g", "_range").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).toPandas()
    for _, part in spans.sort_values(["g", "_range"]).groupby("g"):
        assert (part["hi"].to_numpy()[:-1] < part["lo"].to_numpy()[1:]).all()


def test_a_small_group_is_one_range(values):
    _, df = values
    _, sizes = split_ranges(df.where("x is not null").select("g", "x").distinct(), ["g"], "x")
    assert sizes.count() == 3


def test_attach_broadcasts_only_counted_tables(values):
    _, df = values
    helper = cut_lineage(df.groupBy("g").agg(F.max("x").alias("top")), "helper")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(attach(df, helper, ["g"]))
    assert "SortMergeJoin" in plan(attach(df, helper, ["g"], most=2))
    assert attach(df, helper, ["g"]).count() == attach(df, helper, ["g"], most=2).count() == df.count()


@pytest.mark.parametrize("limit", [50, 100_000])
def test_random_rank_is_one_permutation(values, limit):
    _, df = values
    one, two = (random_rank(df, ["id"], seed, "place", limit).toPandas() for seed in (1, 2))
    assert sorted(one["place"]) == list(range(df.count())) == sorted(two["place"])
    again = random_rank(df.repartition(7), ["id"], 1, "place", limit).toPandas()
    assert dict(zip(one["id"], one["place"])) == dict(zip(again["id"], again["place"]))
    assert abs(np.corrcoef(one.sort_values("id")["place"], two.sort_values("id")["place"])[0, 1]) < 0.05


def test_exchanged_rows_keep_every_value(values):
    """Rows that meet by the numbers of two orders are a permutation: every value stays."""
    _, df = values
    base = random_rank(df, ["id"], 1, "place", 100)
    other = random_rank(df.select("id", F.col("x").alias("other")), ["id"], 9, "place", 100).drop("id")
    met = base.join(other, "place").toPandas()
    assert len(met) == df.count()
    np.testing.assert_array_equal(np.sort(met["x"].to_numpy()), np.sort(met["other"].to_numpy()))
    assert (met["x"] != met["other"]).mean() > 0.5
