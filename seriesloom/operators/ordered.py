"""Exact ranks and quantiles of groups of any size.

A window ordered over a whole group puts that group into one task, and an exact percentile
keeps it in one buffer. Here equal values collapse to one counted row on the map side, and a
group is cut into value ranges until every range has at most `limit` distinct values: ranges
above the limit get splitters from their own sketch and are split again. The number of
ranges follows the data, a group below the limit is a single range, and the result is exact
whatever the splitters are. The running count is taken inside each range and shifted by the
sizes of the ranges below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.sources.store import cut_lineage

#: Distinct values that one task orders.
RANGE_LIMIT = 200_000
#: Parts into which a range above the limit is split.
FANOUT = 64
#: Rows of a helper table (of a few hundred numbers at most each) that may be broadcast.
BROADCAST_ROWS = 1000


def attach(
    rows: DataFrame, helper: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a written helper table with one row per key.

    Few keys mean large groups, and a small helper: it is broadcast after its rows have been
    counted. With more keys both sides meet in a shuffled join, where the adaptive skew join
    splits a key that has very many rows.
    """
    small = helper.count() <= most
    return rows.join(F.broadcast(helper) if small else helper.hint("merge"), keys, how)


def split_ranges(
    values: DataFrame, keys: list[str], value: str, limit: int = RANGE_LIMIT, weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows that are distinct by (keys, value) with `_range`, and the written table of ranges
    `(keys, _range, _n, _weight)`.

    Ranges are numbered in the order of their values, and none has more than `limit` rows.
    Each turn splits only what is above the limit; a turn divides it by about FANOUT, so
    there are as many turns as the logarithm of the size has digits to that base.
    """
    marks = ", ".join(f"{k / FANOUT!r}D" for k in range(1, FANOUT))
    rows = cut_lineage(values.withColumn("_range", F.lit(0).cast("long")), "ranges")
    by = [*keys, "_range"]
    for _ in range(10):
        counts = [F.count(F.lit(1)).alias("_n"), F.sum(weight or F.lit(1)).alias("_weight")]
        sizes = cut_lineage(rows.groupBy(*by).agg(*counts), "range-sizes")
        wide = sizes.where(F.col("_n") > limit).select(*by)
        if wide.isEmpty():
            return rows, sizes
        sketch = F.expr(f"percentile_approx(`{value}`, array({marks}), {16 * FANOUT})").alias("_edges")
        edges = cut_lineage(rows.join(wide, by, "left_semi").groupBy(*by).agg(sketch), "range-edges")
        below = F.size(F.filter("_edges", lambda edge: edge < F.col(value)))
        number = F.col("_range") * FANOUT + F.coalesce(F.when(F.col("_edges").isNotNull(), below), F.lit(0))
        rows = cut_lineage(
            attach(rows, edges, by, "left").select(*values.columns, number.cast("long").alias("_range")), "ranges"
        )
    raise ValueError("values can't be split into ranges of the limit; is the column free of duplicates?")


def range_offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """For every range the weight of the ranges below it (`_offset`) and of its key (`n_total`)."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    lower = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(
        sizes.select(
            *keys, "_range",
            F.coalesce(F.sum("_weight").over(lower), F.lit(0)).alias("_offset"),
            F.sum("_weight").over(whole).alias("n_total"),
        ),
        "range-offsets",
    )


def ranked_values(df: DataFrame, keys: list[str], value: str, limit: int = RANGE_LIMIT) -> DataFrame:
    """Distinct known values per key with `n_tied`, `n_below` and `n_total` row counts.

    Keys may be few and large (columns, horizons, models) or many and small (series).
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_tied"))
    )
    rows, sizes = split_ranges(counted, keys, value, limit, "n_tied")
    placed = attach(rows, range_offsets(sizes, keys), [*keys, "_range"])
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.select(
        *keys,
        value,
        "n_tied",
        (F.col("_offset") + F.coalesce(F.sum("n_tied").over(inside), F.lit(0))).alias("n_below"),
        "n_total",
    )


def quantiles_of_ranked(
    ranked: DataFrame, keys: list[str], value: str, probabilities: list[float]
) -> DataFrame:
    """Exact interpolated quantiles as an array `quantiles` per key.

    Each quantile needs two rows of the ranked table, picked by conditional maxima.
    """
    below, tied, total = F.col("n_below"), F.col("n_tied"), F.col("n_total")
    picks, results = [], []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (total - 1)
        low = F.floor(place)
        high = F.least(low + 1, total - 1)
        for name, position in ((f"_lo{i}", low), (f"_hi{i}", high)):
            hit = (below <= position) & (position < below + tied)
            picks.append(F.max(F.when(hit, F.col(value))).alias(name))
        picks.append(F.max(place - low).alias(f"_part{i}"))
        low_value, high_value, part = (F.col(f"_{x}{i}") for x in ("lo", "hi", "part"))
        gap = high_value - low_value
        # From the nearer end, so that a place next to a row gives that row's value.
        results.append(
            F.when(part < 0.5, low_value + gap * part).otherwise(high_value - gap * (1 - part))
        )
    return ranked.groupBy(*keys).agg(*picks).select(*keys, F.array(*results).alias("quantiles"))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: list[float],
    limit: int = RANGE_LIMIT,
) -> DataFrame:
    return quantiles_of_ranked(
        ranked_values(df, keys, value, limit), keys, value, probabilities
    )


def attach_by_value(
    rows: DataFrame,
    values: DataFrame,
    keys: list[str],
    value: str,
    column: str,
    row_key: list[str],
    hot_share: int = 1000,
) -> DataFrame:
    """Add to every row the `column` of its value; `values` has a row per key and value, with
    the number of its rows as `n_tied`.

    A value that holds more than one in `hot_share` of all rows is looked up in a broadcast
    table: at most `hot_share` values can be that common, whatever the number of keys. All
    other rows join by value. Rows already served are spread over the join's tasks by a salt
    that the other side never has, so no task gets them all.
    """
    values = cut_lineage(values.select(*keys, value, "n_tied", column), "by-value")
    total = values.agg(F.sum("n_tied")).first()[0] or 0
    is_hot = F.col("n_tied") * hot_share > total
    hot = values.where(is_hot).select(*keys, value, F.col(column).alias("_hot"), F.lit(True).alias("_served"))
    cold = values.where(~is_hot).select(*keys, value, F.lit(0).alias("_salt"), column)
    spread = F.lit(1) + F.pmod(F.xxhash64(*row_key), F.lit(997)).cast("int")
    salted = rows.join(F.broadcast(hot), [*keys, value], "left").withColumn(
        "_salt", F.when(F.col("_served"), spread).otherwise(F.lit(0))
    )
    joined = salted.join(cold, [*keys, value, "_salt"], "left")
    return joined.select(*rows.columns, F.coalesce("_hot", column).alias(column))


def attach_rank(
    rows: DataFrame,
    ranked: DataFrame,
    keys: list[str],
    value: str,
    rank: str,
    row_key: list[str],
    hot_share: int = 1000,
) -> DataFrame:
    """Average rank (ties share the mean of their places) of every row."""
    average = F.col("n_below") + (F.col("n_tied") + 1) / 2
    return attach_by_value(rows, ranked.withColumn(rank, average), keys, value, rank, row_key, hot_share)


def random_rank(df: DataFrame, row_key: list[str], seed: int, rank: str, limit: int = RANGE_LIMIT) -> DataFrame:
    """Rows numbered from 0 in a random order that depends on their keys and the seed alone.

    Rows are dealt to parts by the leading bits of a hash, numbered inside each part, and
    moved up by the sizes of the parts below. `row_key` is unique.
    """
    parts = max(1, -(-df.count() // limit))
    hashed = F.xxhash64(*row_key, F.lit(seed))
    # The hash over 2^64, cut into equal pieces: parts follow each other in hash order.
    dealt = df.withColumn("_hash", hashed).withColumn(
        "_part", F.floor((F.shiftright("_hash", 33) + (1 << 30)) * F.lit(parts) / F.lit(1 << 31)).cast("int")
    )
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        sizes.select("_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset")), "random-offsets"
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_hash", *row_key)) - 1
    numbered = attach(dealt.withColumn("_inside", inside), offsets, ["_part"])
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(rank))


def ordered_points(
    ranked: DataFrame, keys: list[str], value: str, chunk: int = 10_000
) -> DataFrame:
    """One row per original row with its place 1..n in value order.

    Ties are unfolded in two steps, chunks and then places, with a shuffle in between: a
    value shared by a third of all rows is unfolded by many tasks.
    """
    pieces = F.sequence(F.lit(0), F.floor((F.col("n_tied") - 1) / chunk).cast("int"))
    chunked = ranked.select("*", F.explode(pieces).alias("_piece")).repartition(
        *keys, value, "_piece"
    )
    first = F.col("n_below") + F.col("_piece") * chunk + 1
    last = F.least(first + chunk - 1, F.col("n_below") + F.col("n_tied"))
    return chunked.select(
        *keys, value, "n_total", F.explode(F.sequence(first, last)).alias("place")
    )
