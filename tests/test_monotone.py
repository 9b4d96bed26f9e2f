"""Isotonic fits against pooling of adjacent violators in plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.monotone import isotonic_blocks, recalibrate


def pooled(x, y):
    """Blocks [lo, hi, level, n] of the fit, one point at a time."""
    points = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "count"]).reset_index()
    blocks = []
    for x0, s, n in points.itertuples(index=False):
        blocks.append([x0, x0, s, n])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [(a, b, s / n, n) for a, b, s, n in blocks]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    n = 400
    x = rng.integers(0, 300, n).astype(float)
    rising = np.arange(n, dtype=float)
    heavy = np.append(rising, np.full(30, rising[-1] + 1))
    return {
        "noise": (x, rng.normal(0, 1, n)),
        "trend": (x, 0.1 * x + rng.normal(0, 3, n)),
        "rising": (rising, rising * 2),
        "falling": (rising, -rising),
        "low end": (heavy, np.append(rising, np.full(30, -50.0 * n))),
        "high start": (np.append(np.full(40, -1.0), rising), np.append(np.full(40, 1000.0 * n), rising)),
        "one point": (np.zeros(5), np.arange(5.0)),
        "steps": (x, np.floor(x / 50) + rng.integers(0, 2, n)),
    }


@pytest.fixture(scope="module")
def frame(spark, groups):
    parts = [pd.DataFrame({"g": g, "x": x, "y": y}) for g, (x, y) in groups.items()]
    rows = pd.concat(parts, ignore_index=True)
    rows["id"] = range(len(rows))
    missing = spark.createDataFrame([("noise", None, 1.0, -1), ("noise", 2.0, None, -2)], "g string, x double, y double, id long")
    return spark.createDataFrame(rows).union(missing)


@pytest.mark.parametrize("limit", [6, 40, 100_000])
def test_blocks_equal_pooling_at_any_range_size(frame, groups, limit):
    got = isotonic_blocks(frame, ["g"], "x", "y", limit).toPandas()
    assert set(got["g"]) == set(groups)
    for g, (x, y) in groups.items():
        mine = got[got["g"] == g].sort_values("lo")
        # Blocks of equal levels may be one or several; the fitted values are what counts.
        want = pooled(x, y)
        values = np.unique(x)
        fit = lambda blocks: [next(lv for lo, hi, lv in blocks if lo <= v <= hi) for v in values]
        np.testing.assert_allclose(
            fit(list(mine[["lo", "hi", "level"]].itertuples(index=False))), fit([b[:3] for b in want]), rtol=1e-9, atol=1e-9
        )
        assert mine["n"].sum() == len(x)
        assert (np.diff(mine["level"]) > -1e-9).all()


@pytest.mark.parametrize("limit", [7, 100_000])
def test_recalibrate_interpolates_and_clips(spark, limit):
    blocks = spark.createDataFrame(
        [("a", 1.0, 3.0, 10.0, 3), ("a", 5.0, 5.0, 20.0, 1), ("a", 6.0, 9.0, 22.0, 4)],
        "g string, lo double, hi double, level double, n long",
    )
    asked = [-4.0, 1.0, 2.0, 3.0, 4.0, 4.5, 5.0, 5.5, 7.0, 50.0, None] + [4.0] * 20
    rows = spark.createDataFrame([(g, v, i) for i, v in enumerate(asked) for g in ("a", "b")], "g string, x double, id long")
    got = {(r["g"], r["id"]): r["y_cal"] for r in recalibrate(rows, blocks, ["g"], "x", ["id"], limit=limit).collect()}
    want = [None if v is None else float(np.interp(v, [1, 3, 5, 6, 9], [10, 10, 20, 22, 22])) for v in asked]
    assert [got["a", i] for i in range(len(asked))] == pytest.approx(want)
    assert all(got["b", i] is None for i in range(len(asked)))


def test_no_points(spark):
    empty = spark.createDataFrame([], "g string, x double, y double")
    assert isotonic_blocks(empty, ["g"], "x", "y").count() == 0


def test_fit_uses_no_driver_points(frame, monkeypatch):
    """The fit takes nothing but single counts to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    taken, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        taken.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    blocks = isotonic_blocks(frame.where(F.col("g") == "trend"), ["g"], "x", "y", 40)
    assert blocks.count() > 1
    assert max(taken) <= 1
