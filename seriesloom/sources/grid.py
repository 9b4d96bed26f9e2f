"""Gridded precipitation as a long table `(time, latitude, longitude, value)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.settings import METRES_TO_MM

GRID_KEYS = ("time", "latitude", "longitude", "lat", "lon")


def grid_variable(columns: list[str]) -> str:
    """Name of the precipitation variable, or the first data variable."""
    data = [c for c in columns if c not in GRID_KEYS]
    for name in data:
        if "precip" in name.lower() or name == "tp":
            return name
    if not data:
        raise ValueError("the grid holds no data variable")
    return data[0]


def grid_mean(
    grid: DataFrame,
    value: str = "rain_mm",
    factor: float = METRES_TO_MM,
    order: str | None = None,
) -> DataFrame:
    """Unweighted mean over all cells per time, in the target unit.

    With `order` given, repeated cells of one time keep their first record. Both steps are
    plain aggregates, so cells are combined on the map side before the shuffle.
    """
    source = grid_variable([c for c in grid.columns if c != order])
    cells = grid
    if order is not None:
        space = [c for c in GRID_KEYS[1:] if c in grid.columns]
        cells = grid.groupBy("time", *space).agg(F.min_by(source, order).alias(source))
    return cells.groupBy("time").agg((F.avg(source) * F.lit(factor)).alias(value))
