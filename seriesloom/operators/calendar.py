"""Putting sparse series on the daily calendar, and moving between frequencies.

Inputs have at most one row per (series, date); `tidy.dedupe_first` or an aggregate gives
that. A series then has at most as many rows as the calendar has days, so a window over one
series is bounded however large the panel or however many raw records a series had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.dates import month_number, month_start

CARRY = "carry"
INTERPOLATE = "interpolate"


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def calendar_days(spark: SparkSession, start: str, end: str, date: str = "date") -> DataFrame:
    """Every day of [start, end]."""
    return spark.range(1).select(
        F.explode(F.sequence(day(start), day(end))).alias(date)
    )


def calendar_spine(
    df: DataFrame, start: str, end: str, series: str = "series_id", date: str = "date"
) -> DataFrame:
    """Every day of [start, end] for every series present."""
    return df.select(series).distinct().select(
        series, F.explode(F.sequence(day(start), day(end))).alias(date)
    )


def fill_calendar(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    value: str | list[str],
    how: str | Column = CARRY,
    date: str = "date",
    max_gap: int | None = None,
) -> DataFrame:
    """Expand every series to all days of [start, end].

    Each known row emits the days up to the next known row, which it can fill alone: `lead`
    over the sparse rows gives the next date and value. There is no spine join and no second
    window over the dense table.

    `how` is CARRY (the row's values, NULL included, hold until the next row) or INTERPOLATE
    (linear by day, the last value repeats after the last row), or a column yielding one of
    the two per row. Days before the first row are NULL. `max_gap` leaves only the first
    so many missing days of a gap filled. Two rows of one key and day are an error.
    """
    values = [value] if isinstance(value, str) else list(value)
    mode = F.lit(how) if isinstance(how, str) else how
    first_day, last_day = day(start), day(end)
    by_date = Window.partitionBy(*keys).orderBy(date)

    sparse = df.where(F.col(date) <= last_day).select(
        *keys,
        F.col(date).alias("_from"),
        F.lead(date).over(by_date).alias("_next"),
        F.lag(date).over(by_date).isNull().alias("_first"),
        mode.alias("_mode"),
        *[F.col(v) for v in values],
        *[F.lead(v).over(by_date).alias(f"_next_{v}") for v in values],
    )
    again = F.raise_error(F.lit("two rows of one series and day: remove duplicates first")).cast("date")
    until = F.when(F.col("_next") == F.col("_from"), again).otherwise(F.coalesce(F.date_sub("_next", 1), last_day))
    # Rows that end before the calendar emit nothing; the first row also emits the lead-in.
    since = F.when(F.col("_first"), first_day).otherwise(F.greatest(F.col("_from"), first_day))
    dense = sparse.where(until >= first_day).select(
        "*", F.explode(F.sequence(since, until)).alias(date)
    )

    distance = F.date_diff(date, F.col("_from"))
    known = distance >= 0
    if max_gap is not None:
        known = known & (distance <= max_gap)
    filled = []
    for v in values:
        slope = (F.col(f"_next_{v}") - F.col(v)) / F.date_diff("_next", "_from")
        moved = F.coalesce(F.col(v) + slope * distance, F.col(v))
        chosen = F.when(F.col("_mode") == INTERPOLATE, moved).otherwise(F.col(v))
        filled.append(F.when(known, chosen).alias(v))
    return dense.select(*keys, date, *filled)


def interpolate_daily(
    df: DataFrame,
    start: str,
    end: str,
    value: str = "quote",
    keys: list[str] | None = None,
    date: str = "date",
) -> DataFrame:
    """Daily series by linear interpolation between known rows inside the calendar."""
    inside = df.where(F.col(date).between(day(start), day(end)) & F.col(value).isNotNull())
    return fill_calendar(inside, keys or ["series_id"], start, end, value, INTERPOLATE, date)


def asof_daily(
    df: DataFrame,
    start: str,
    end: str,
    values: list[str],
    keys: list[str] | None = None,
    date: str = "date",
) -> DataFrame:
    """Each day takes the values of the latest row at or before it, NULL values included."""
    return fill_calendar(df, keys or ["series_id"], start, end, values, CARRY, date)


def _series_order(series: str, date: str, descending: bool = False):
    order = F.col(date).desc() if descending else F.col(date).asc()
    return (
        Window.partitionBy(series)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def forward_fill(value: str, series: str = "series_id", date: str = "date") -> Column:
    return F.last(value, ignorenulls=True).over(_series_order(series, date))


def fill_both_ways(value: str, series: str = "series_id", date: str = "date") -> Column:
    """Forward fill, then the first known value for the leading gap."""
    whole = (
        Window.partitionBy(series)
        .orderBy(date)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return F.coalesce(
        forward_fill(value, series, date), F.first(value, ignorenulls=True).over(whole)
    )


def interpolate_columns(
    df: DataFrame,
    columns: list[str],
    max_gap: int | None = None,
    whole_gap_only: bool = False,
    series: str = "series_id",
    date: str = "date",
) -> DataFrame:
    """Linear interpolation of several columns of a dense daily table.

    Only forward: the first `max_gap` missing rows of every gap are filled, long gaps
    included; the trailing gap repeats the last value up to the limit. `whole_gap_only`
    leaves gaps longer than the limit unfilled. All columns share two window passes. The
    next known row is the last known row in reverse date order: a frame that starts at the
    current row and runs to the end would be recomputed for every row.
    """
    before, after = _series_order(series, date), _series_order(series, date, descending=True)
    known = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(date).alias("at"), F.col(c).alias("v")))
        for c in columns
    }
    marked = df.select(
        "*",
        *[F.last(known[c], ignorenulls=True).over(before).alias(f"_prev_{c}") for c in columns],
    ).select(
        "*",
        *[F.last(known[c], ignorenulls=True).over(after).alias(f"_next_{c}") for c in columns],
    )
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(F.col(c))
            continue
        prev, following = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        gone = F.date_diff(F.col(date), prev["at"])
        span = F.date_diff(following["at"], prev["at"])
        moved = F.coalesce(
            prev["v"] + F.try_divide(following["v"] - prev["v"], span) * gone, prev["v"]
        )
        if max_gap is None:
            allowed = F.lit(True)
        elif whole_gap_only:
            allowed = F.coalesce(span - 1 <= max_gap, gone <= max_gap)
        else:
            allowed = gone <= max_gap
        out.append(F.coalesce(F.col(c), F.when(allowed, moved)).alias(c))
    return marked.select(*out)


def monthly_first(
    df: DataFrame, value: str, keys: list[str] | None = None, date: str = "date"
) -> DataFrame:
    """First known value of every month; months in between without one are kept as NULL."""
    by = keys or ["series_id"]
    known = F.when(F.col(value).isNotNull(), F.col(date))
    months = df.groupBy(*by, month_start(F.col(date)).alias("month")).agg(
        F.min_by(value, known).alias(value)
    )
    # Months are one row each, so the gap filler of `lead` works on them as on days.
    following = F.lead("month").over(Window.partitionBy(*by).orderBy("month"))
    stretched = months.select(
        *by, "month", value, F.coalesce(F.add_months(following, -1), F.col("month")).alias("_to")
    ).select(
        *by,
        F.col("month").alias("_at"),
        value,
        F.explode(F.sequence("month", "_to", F.expr("interval 1 month"))).alias("month"),
    )
    return stretched.select(
        *by, "month", F.when(F.col("month") == F.col("_at"), F.col(value)).alias(value)
    )


def monthly_mean(
    df: DataFrame, value: str, keys: list[str] | None = None, date: str = "date"
) -> DataFrame:
    """Mean per month; months without a known value are dropped."""
    by = keys or ["series_id"]
    return (
        df.groupBy(*by, month_start(F.col(date)).alias("month"))
        .agg(F.avg(value).alias(value))
        .dropna(subset=[value])
    )


def publication_lag(
    df: DataFrame,
    columns: list[str],
    months: int = 1,
    series: str = "series_id",
    date: str = "date",
) -> DataFrame:
    """Replace low-frequency columns by what was published `months` months before.

    Every day of a month gets the first known value of the earlier month. On a dense daily
    table that is a range frame over the month number, which moves once per month: no
    monthly table and no join back.
    """
    number = "_month_no"
    earlier = (
        Window.partitionBy(series).orderBy(number).rangeBetween(-months, -months)
    )
    lagged = {
        c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(date))).over(earlier)
        for c in columns
        if c in df.columns
    }
    numbered = df.withColumn(number, month_number(F.col(date)))
    return numbered.select(
        *[lagged[c].alias(c) if c in lagged else F.col(c) for c in df.columns]
    )
