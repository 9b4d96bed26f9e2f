"""Distribution tables: bands, histograms, calibration curves, density grids, QQ points.

Groups may be few and large (horizon, model) or many and small (series). Nothing here orders
or collects a group in one task. Per-group statistics are aggregated first, written, and
joined back as a table with one row per group: broadcast after their rows have been counted,
or met in a shuffled join (`ordered.attach`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.normal import normal_density, probit
from seriesloom.operators.ordered import (
    attach,
    ordered_points,
    quantiles_of_ranked,
    ranked_values,
)
from seriesloom.settings import (
    CALIBRATION_BINS,
    DENSITY_CELLS,
    PRICE_BANDS,
    RESIDUAL_BINS,
)
from seriesloom.sources.store import cut_lineage


def residuals(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.select("*", (F.col(y) - F.col(p)).alias("residual"))


def band_number(value: Column, edges: tuple[float, ...]) -> Column:
    """Zero-based band of [edge, next edge); NULL outside all bands."""
    below = sum(
        (F.when(value >= edge, 1).otherwise(0) for edge in edges[1:-1]), F.lit(0)
    )
    return F.when((value >= edges[0]) & (value < edges[-1]), below)


def price_band_counts(
    df: DataFrame,
    columns: list[str],
    keys: list[str] | None = None,
    edges: tuple[float, ...] = PRICE_BANDS,
) -> DataFrame:
    """Rows per band of several columns; empty bands count 0.

    Counting is one conditional aggregate per band, so empty bands need no join.
    """
    by = keys or []
    n = len(edges) - 1
    counts = df.groupBy(*by).agg(
        *[
            F.count_if(band_number(F.col(c), edges) == b).alias(f"{c}_{b}")
            for c in columns
            for b in range(n)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("source"),
                F.lit(b).alias("band"),
                F.lit(float(edges[b])).alias("lo"),
                F.lit(float(edges[b + 1])).alias("hi"),
                F.col(f"{c}_{b}").alias("n"),
            )
            for c in columns
            for b in range(n)
        ]
    )
    return counts.select(*by, F.inline(rows))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin of `bins` equal widths; the top edge belongs to the last bin."""
    width = (high - low) / bins
    return F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(value - low, width)).cast("int"), F.lit(bins - 1))
    )


def histogram(
    df: DataFrame, value: str, keys: list[str], bins: int = RESIDUAL_BINS
) -> DataFrame:
    """Equal-width histogram per group as density; empty bins are present with 0."""
    known = df.where(F.col(value).isNotNull())
    limits = cut_lineage(
        known.groupBy(*keys).agg(
            F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")
        ),
        "limits",
    )
    counts = (
        attach(known, limits, keys)
        .groupBy(*keys, equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    every = limits.select(*keys, "_lo", "_hi", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("lo"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.try_divide(F.coalesce("n", F.lit(0)), F.col("_n") * width).alias("density"),
    )


def value_range(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Joint range of actual and predicted values."""
    return df.groupBy(*keys).agg(
        F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi")
    )


def hexagon(x: Column, y: Column) -> tuple[Column, Column]:
    """Centre of the hexagon that holds a point given in cell widths.

    Hexagon centres are two lattices, the second half a cell off in both directions; rows of
    the first are sqrt(3) widths apart, so y is given in those. The nearer centre of the two
    candidates wins, the second lattice on a tie.
    """
    even, odd = (F.round(x), F.round(y)), (F.floor(x) + 0.5, F.floor(y) + 0.5)
    away = lambda c: (x - c[0]) * (x - c[0]) + 3.0 * (y - c[1]) * (y - c[1])
    nearer = away(even) < away(odd)
    return tuple(F.when(nearer, e.cast("double")).otherwise(o) for e, o in zip(even, odd, strict=True))


def density_grid(
    df: DataFrame,
    keys: list[str],
    y: str = "y_true",
    p: str = "y_pred",
    cells: int = DENSITY_CELLS,
    shape: str = "square",
) -> DataFrame:
    """Log count of (actual, predicted) on a grid of cells; empty cells are absent.

    Square cells have whole numbers, hexagons the place of their centre in cell widths.
    """
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    limits = cut_lineage(
        both.groupBy(*keys).agg(
            F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.min(p).alias("_p0"), F.max(p).alias("_p1")
        ),
        "limits",
    )
    if shape == "hexagon":
        place = lambda c, lo, hi, n: F.coalesce(
            F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)) * n, F.lit(0.0)
        )
        # Regular hexagons on a square plot: rows are sqrt(3) cell widths apart.
        cell_x, cell_y = hexagon(place(y, "_y0", "_y1", cells), place(p, "_p0", "_p1", int(cells / 3**0.5)))
    elif shape == "square":
        cell_x = equal_width_bin(F.col(y), F.col("_y0"), F.col("_y1"), cells)
        cell_y = equal_width_bin(F.col(p), F.col("_p0"), F.col("_p1"), cells)
    else:
        raise ValueError(f"unknown shape of cells: {shape}")
    return (
        attach(both, limits, keys)
        .groupBy(*keys, cell_x.alias("cell_x"), cell_y.alias("cell_y"))
        .agg(F.count(F.lit(1)).alias("n"), F.log10(F.count(F.lit(1))).alias("log_n"))
    )


def calibration_curve(
    df: DataFrame,
    keys: list[str],
    y: str = "y_true",
    p: str = "y_pred",
    bins: int = CALIBRATION_BINS,
) -> DataFrame:
    """Mean prediction and mean actual per quantile bin of the prediction.

    Bins are (lo, hi] with the lowest edge included; equal edges are merged. A group has
    `bins + 1` edges, one row of the edge table.
    """
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    marks = [k * (1.0 / bins) for k in range(bins)] + [1.0]
    edges = cut_lineage(
        quantiles_of_ranked(ranked_values(both, keys, p), keys, p, marks).select(
            *keys, F.array_distinct("quantiles").alias("_edges")
        ),
        "edges",
    )
    placed = attach(both, edges, keys).select(
        *keys,
        F.col(y).alias("_y"),
        F.col(p).alias("_p"),
        "_edges",
        F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(p))), F.lit(1)).alias("bin"),
    )
    return placed.groupBy(*keys, "bin").agg(
        F.max(F.get("_edges", F.col("bin") - 1)).alias("lo"),
        F.max(F.get("_edges", F.col("bin"))).alias("hi"),
        F.avg("_p").alias("mean_pred"),
        F.avg("_y").alias("mean_true"),
        F.count(F.lit(1)).alias("n"),
    )


def residual_normal(
    df: DataFrame,
    keys: list[str],
    value: str = "residual",
    points: int = 100,
    margin: float = 0.05,
) -> DataFrame:
    """Normal density fitted to the residuals, on an even grid a little wider than their range."""
    fit = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    reach = F.col("_hi") - F.col("_lo")
    start = F.col("_lo") - reach * margin
    step = reach * (1 + 2 * margin) / (points - 1)
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).select(
        *keys, "point", "mean", "std", (start + step * F.col("point")).alias("x")
    )
    return grid.select("*", normal_density(F.col("x"), F.col("mean"), F.col("std")).alias("density"))


def plotting_position(place: Column, n: Column) -> Column:
    """Median of the `place`-th of `n` uniform order statistics."""
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    return (
        F.when(place == n, last)
        .when(place == 1, F.lit(1.0) - last)
        .otherwise((place - 0.3175) / (n + 0.365))
    )


def qq_points(df: DataFrame, keys: list[str], value: str = "residual") -> DataFrame:
    """Sorted values against normal order-statistic medians."""
    points = ordered_points(ranked_values(df, keys, value), keys, value)
    return points.select(
        *keys,
        "place",
        probit(plotting_position(F.col("place"), F.col("n_total"))).alias("theoretical"),
        F.col(value).alias("ordered"),
    )


def qq_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares line through the QQ points."""
    return points.groupBy(*keys).agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
    )
