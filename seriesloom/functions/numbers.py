"""Number parsing and missing-value rules as column expressions.

Missing is always NULL, never NaN: Spark aggregates skip NULL but propagate NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_LIKE = r"^[\d,.-]+$"


def null_if_nan(value: Column) -> Column:
    """NaN to NULL, for scans of files that another tool wrote with NaN as missing."""
    return F.nanvl(value, F.lit(None).cast("double"))


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def dirty_number(text: Column) -> Column:
    """Text with currency marks to double; comma is a decimal mark. The sign is dropped.

    There is no thousands handling: two separators leave no number, hence NULL.
    """
    kept = F.regexp_replace(F.trim(text), r"[^0-9,.]", "")
    return F.translate(kept, ",", ".").try_cast("double")


def comma_number(text: Column) -> Column:
    """Decimal comma to point, then double; NULL when that is no number."""
    return F.translate(text, ",", ".").try_cast("double")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def is_number_text(text: Column) -> Column:
    """True for text that both looks like a number and is one (a lone "-" is missing)."""
    return F.coalesce(text.rlike(NUMBER_LIKE), F.lit(False)) & comma_number(text).isNotNull()


def within(value: Column, low: float, high: float) -> Column:
    """The value when inside [low, high], else NULL."""
    return F.when(value.between(low, high), value)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient with NULL for a zero or missing denominator."""
    return F.try_divide(top, bottom)
