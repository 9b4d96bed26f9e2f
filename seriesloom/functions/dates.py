"""Date parsing and calendar parts as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.settings import MONTH_LABELS


def day_first_date(text: Column) -> Column:
    """`dd/MM/yyyy`, or an ISO date; anything else is NULL."""
    trimmed = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(trimmed, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")),
    ).cast("date")


def quarter_month(period: Column, ordinal: Column) -> Column:
    """Quarter code `YYYYQQ` and the text "No 2º mês" to the first day of that month."""
    within_quarter = F.regexp_extract(ordinal, r"(\d+)º", 1).try_cast("int")
    year = F.substring(period, 1, 4).cast("int")
    quarter = F.substring(period, 5, 2).cast("int")
    month = (quarter - 1) * 3 + F.coalesce(within_quarter, F.lit(1))
    return F.make_date(year, month, F.lit(1))


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM").cast("date")


def month_number(date: Column) -> Column:
    """Months since year zero; consecutive months differ by one."""
    return F.year(date) * 12 + F.month(date)


def month_label(month: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_LABELS])
    return F.element_at(names, month)


def calendar_parts(date: Column) -> dict[str, Column]:
    """Month, quarter, weekday (Monday = 0), day of year and the cyclic month."""
    angle = F.month(date) * F.lit(2 * math.pi / 12)
    return {
        "month": F.month(date),
        "quarter": F.quarter(date),
        "weekday": F.weekday(date),
        "day_of_year": F.dayofyear(date),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }
