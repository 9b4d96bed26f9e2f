"""Isotonic (never falling) fits of groups of any size.

The fitted values are the slopes of the greatest convex minorant of the cumulated points
(weight, sum), so a fit is a search for the minorant's corners. The points are ordered in
value ranges of bounded size. In each turn the corners of two neighbouring ranges are
reduced to their own lower hull, the pairs being shifted by one range from turn to turn;
then the hull of all ranges' end corners, a few rows a range, takes away what lies above it,
so that one violation over the whole length does not creep from range to range. What is left
is packed into fewer ranges. No task holds more than the corners of two ranges, and the
blocks stay a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.ordered import RANGE_LIMIT, attach, attach_by_value, split_ranges
from seriesloom.sources.store import cut_lineage


def _lower_hull(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places of the corners of the lower hull of points sorted by w."""
    keep: list[int] = []
    ws, ss = w.tolist(), s.tolist()
    for i in range(len(ws)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            # The middle point goes when it is not below the line of its neighbours: its
            # block's mean does not exceed that of the next one otherwise.
            if (ss[b] - ss[a]) * (ws[i] - ws[b]) >= (ss[i] - ss[b]) * (ws[b] - ws[a]):
                keep.pop()
            else:
                break
        keep.append(i)
    return np.array(keep, np.int64)


def _hull_rows(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("_w", kind="stable")
    return part.iloc[_lower_hull(part["_w"].to_numpy(float), part["_s"].to_numpy(float))]


def _chords(part: pd.DataFrame) -> pd.DataFrame:
    """For every range of one key the line of the end corners' hull above or through it."""
    part = part.sort_values("_range", kind="stable")
    w = np.column_stack([part["_w0"], part["_w1"]]).astype(float).ravel()
    s = np.column_stack([part["_s0"], part["_s1"]]).astype(float).ravel()
    first = np.flatnonzero(np.append(True, np.diff(w) > 0))
    w, s = w[first], s[first]
    corner = _lower_hull(w, s)
    w, s = w[corner], s[corner]
    at = np.clip(np.searchsorted(w, part["_w0"].to_numpy(float), side="right") - 1, 0, max(len(w) - 2, 0))
    to = np.minimum(at + 1, len(w) - 1)
    return part.assign(_a=w[at], _b=w[to], _c=s[at], _d=s[to])


def _packed(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, int]:
    """The rows with ranges joined to fewer of at most `limit` rows, and the most of a key."""
    sizes = cut_lineage(rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")), "fit-sizes")
    by = Window.partitionBy(*keys).orderBy("_range")
    below = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket = sizes.select(*keys, "_range", F.floor(below * 2 / limit).alias("_bucket"))
    packed = cut_lineage(
        bucket.select(*keys, "_range", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("_bucket")) - 1).alias("_new")),
        "fit-packing",
    )
    most = packed.agg(F.max("_new")).first()[0]
    joined = attach(rows, packed, [*keys, "_range"])
    return joined.drop("_range").withColumnRenamed("_new", "_range").select(*rows.columns), (most or 0) + 1


def convex_corners(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The corners of the greatest convex minorant of points (`_w`, `_s`) in `_range`s.

    Ends when two turns, one for either pairing of the ranges, have taken nothing away.
    """
    quiet, turn, count = 0, 0, rows.count()
    schema = rows.schema
    while True:
        packed, ranges = _packed(rows, keys, limit)
        group = F.floor((F.col("_range") + turn % 2) / 2)
        hulls = (
            packed.withColumn("_group", group)
            .groupBy(*keys, "_group")
            .applyInPandas(lambda part: _hull_rows(part).drop(columns="_group"), schema)
        )
        rows = cut_lineage(hulls, "fit-corners")
        if ranges == 1:
            return rows
        ends = rows.groupBy(*keys, "_range").agg(
            F.min("_w").alias("_w0"), F.max("_w").alias("_w1"),
            F.min_by("_s", "_w").alias("_s0"), F.max_by("_s", "_w").alias("_s1"),
        )
        lines = cut_lineage(
            ends.groupBy(*keys).applyInPandas(
                lambda part: _chords(part)[[*keys, "_range", "_a", "_b", "_c", "_d"]],
                ", ".join([f"`{k}` {schema[k].dataType.simpleString()}" for k in [*keys, "_range"]]
                          + [f"{c} double" for c in ("_a", "_b", "_c", "_d")]),
            ),
            "fit-lines",
        )
        corner = (F.col("_w") <= F.col("_a")) | (F.col("_w") >= F.col("_b"))
        under = (F.col("_s") - F.col("_c")) * (F.col("_b") - F.col("_a")) < (F.col("_d") - F.col("_c")) * (
            F.col("_w") - F.col("_a")
        )
        rows = cut_lineage(
            attach(rows, lines, [*keys, "_range"]).where(corner | under).select(*[f.name for f in schema]), "fit-corners"
        )
        left = rows.count()
        quiet = quiet + 1 if left == count else 0
        if quiet == 2:
            return rows
        count, turn = left, turn + 1


def isotonic_blocks(df: DataFrame, keys: list[str], x: str, y: str, limit: int = RANGE_LIMIT) -> DataFrame:
    """The least-squares fit of y that never falls with x, as blocks `(keys, lo, hi, level, n)`.

    Rows with a missing x or y are left out; equal x are one point with their mean.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = known.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(
        F.sum(F.col(y).cast("double")).alias("_sum"), F.count(F.lit(1)).alias("_count")
    )
    half = max(1, limit // 2)
    rows, _ = split_ranges(points, keys, "_x", half)
    by = [*keys, "_range"]
    totals = rows.groupBy(*by).agg(F.sum("_sum").alias("_ds"), F.sum("_count").alias("_dw"))
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        totals.select(
            *by, F.coalesce(F.sum("_ds").over(lower), F.lit(0.0)).alias("_s0"),
            F.coalesce(F.sum("_dw").over(lower), F.lit(0)).alias("_w0"),
            F.min("_range").over(Window.partitionBy(*keys)).alias("_first"),
        ),
        "fit-offsets",
    )
    inside = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = attach(rows, offsets, by).select(
        *keys, "_range", "_x",
        (F.col("_w0") + F.sum("_count").over(inside)).cast("double").alias("_w"),
        (F.col("_s0") + F.sum("_sum").over(inside)).alias("_s"),
    )
    origin = offsets.where("_range = _first").select(
        *keys, "_range", F.lit(None).cast("double").alias("_x"), F.lit(0.0).alias("_w"), F.lit(0.0).alias("_s")
    )
    corners = convex_corners(cut_lineage(cumulated.union(origin), "fit-corners"), keys, max(2, limit))
    # Each point belongs to the block that ends at the first corner at or above it.
    marked = rows.join(
        corners.where("_x is not null").select(*keys, "_x", F.col("_x").alias("_end")), [*keys, "_x"], "left"
    )
    upper = Window.partitionBy(*keys).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    following = cut_lineage(
        marked.groupBy(*by).agg(F.min("_end").alias("_low")).select(*by, F.min("_low").over(upper).alias("_later")),
        "fit-following",
    )
    above = Window.partitionBy(*by).orderBy(F.col("_x").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = attach(marked, following, by).select(
        *keys, "_x", "_sum", "_count",
        F.coalesce(F.last("_end", ignorenulls=True).over(above), F.col("_later")).alias("hi"),
    )
    return placed.groupBy(*keys, "hi").agg(
        F.min("_x").alias("lo"), (F.sum("_sum") / F.sum("_count")).alias("level"), F.sum("_count").alias("n")
    ).select(*keys, "lo", "hi", "level", "n")


def recalibrate(
    rows: DataFrame, blocks: DataFrame, keys: list[str], x: str, row_key: list[str],
    name: str = "y_cal", limit: int = RANGE_LIMIT,
) -> DataFrame:
    """Rows with the fitted value of their x: the level of its block, a straight line between
    blocks, the first or last level outside; missing for a missing x or a key without a fit.

    The distinct values meet the blocks in common value ranges: each looks up the next block
    edge below and above in its range, or takes the nearest edge of the ranges beyond.
    """
    value = F.col(x).cast("double")
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, value.alias("_x")).agg(F.count(F.lit(1)).alias("n_tied"))
    knots = blocks.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_x"), "level")
    both = counted.withColumn("level", F.lit(None).cast("double")).unionByName(
        knots.withColumn("n_tied", F.lit(0).cast("long"))
    )
    merged = both.groupBy(*keys, "_x").agg(F.sum("n_tied").alias("n_tied"), F.max("level").alias("level"))
    ranged, _ = split_ranges(merged, keys, "_x", limit)
    by = [*keys, "_range"]
    knot = F.when(F.col("level").isNotNull(), F.struct("_x", "level"))
    ends = ranged.groupBy(*by).agg(F.min(knot).alias("_lowest"), F.max(knot).alias("_highest"))
    order = Window.partitionBy(*keys).orderBy("_range")
    beyond = cut_lineage(
        ends.select(
            *by,
            F.max("_highest").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_under"),
            F.min("_lowest").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_over"),
        ),
        "fit-beyond",
    )
    inside = Window.partitionBy(*by)
    upto = lambda column: inside.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    looked = attach(ranged, beyond, by).select(
        *keys, "_x", "n_tied",
        F.coalesce(F.last(knot, ignorenulls=True).over(upto(F.col("_x").asc())), F.col("_under")).alias("_a"),
        F.coalesce(F.last(knot, ignorenulls=True).over(upto(F.col("_x").desc())), F.col("_over")).alias("_b"),
    )
    share = F.try_divide(F.col("_x") - F.col("_a._x"), F.col("_b._x") - F.col("_a._x"))
    between = F.col("_a.level") + (F.col("_b.level") - F.col("_a.level")) * F.coalesce(share, F.lit(0.0))
    fitted = looked.where("n_tied > 0").select(
        *keys, F.col("_x").alias("_value"), "n_tied", F.coalesce(between, "_a.level", "_b.level").alias(name)
    )
    out = attach_by_value(rows.withColumn("_value", value), fitted, keys, "_value", name, row_key)
    return out.drop("_value")
