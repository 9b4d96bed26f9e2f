"""Small builders for panel frames."""

import datetime as dt

import numpy as np
import pandas as pd

EPOCH = dt.date(2020, 1, 1)


def day(offset: int) -> dt.date:
    return EPOCH + dt.timedelta(days=offset)


def random_panel(seed: int, n_series: int = 12, n_days: int = 120, known: float = 0.4) -> pd.DataFrame:
    """Dense daily panel with missing values, long gaps and a constant stretch."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(n_series):
        values = np.round(rng.normal(100, 20, n_days), 3)
        values[rng.random(n_days) > known] = np.nan
        hole = rng.integers(0, n_days - 25)
        values[hole : hole + 20] = np.nan
        if s % 3 == 0:
            values[30:50] = 50.0
        if s == 1:
            values[: n_days // 2] = np.nan
        parts.append(pd.DataFrame({"series_id": f"s{s}", "date": [day(i) for i in range(n_days)], "value": values}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, df: pd.DataFrame, schema: str):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


PANEL_SCHEMA = "series_id string, date date, value double"


def by_series(df: pd.DataFrame) -> dict[str, pd.Series]:
    """Value series by day offset."""
    out = {}
    for name, part in df.groupby("series_id"):
        part = part.sort_values("date")
        out[name] = pd.Series(part["value"].to_numpy(dtype=float), index=pd.to_datetime(part["date"]))
    return out


def collected(df, value: str = "value") -> dict[str, pd.Series]:
    pdf = df.select("series_id", "date", value).toPandas().rename(columns={value: "value"})
    return by_series(pdf)


def assert_same(got: dict, want: dict, **kwargs):
    assert got.keys() == want.keys()
    for name in want:
        np.testing.assert_array_equal(got[name].index, want[name].index)
        np.testing.assert_allclose(
            got[name].to_numpy(), want[name].to_numpy(dtype=float), rtol=1e-9, atol=1e-9, err_msg=name, **kwargs
        )
