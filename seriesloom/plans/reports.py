"""Report tables: inspection export, market ratios, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numbers import safe_ratio
from seriesloom.operators.calendar import day, monthly_first, monthly_mean
from seriesloom.operators.features import lag_columns, with_columns
from seriesloom.settings import KG_TO_THOUSAND_TONNES, LAG_DAYS, UNITS_PER_HEAD


def inspection_table(
    prices: DataFrame, index: DataFrame, display_names: dict[str, str], keys: list[str]
) -> DataFrame:
    """Prices with the index of their day, under display names."""
    return prices.join(index, keys, "left").withColumnsRenamed(display_names)


def exchange_ratio(
    df: DataFrame,
    own: str = "price_a",
    other: str = "price_b",
    units: float = UNITS_PER_HEAD,
    series: str = "series_id",
) -> DataFrame:
    """Monthly price per head, price of the other good and their ratio, with its mean.

    Both monthly means come from one aggregate; only months with both remain. The mean over
    a series spans its months, a bounded group.
    """
    monthly = (
        df.groupBy(series, F.trunc("date", "MM").cast("date").alias("month"))
        .agg((F.avg(own) * units).alias("head_price"), F.avg(other).alias("other_price"))
        .dropna(subset=["head_price", "other_price"])
        .withColumn("ratio", safe_ratio(F.col("head_price"), F.col("other_price")))
    )
    mean = F.avg("ratio").over(Window.partitionBy(series))
    return monthly.select("*", mean.alias("mean_ratio")).withColumn(
        "above_mean", F.col("ratio") >= F.col("mean_ratio")
    )


def slaughter_vs_price(
    df: DataFrame,
    weight: str = "weight",
    price: str = "price_a",
    weight_factor: float = KG_TO_THOUSAND_TONNES,
    series: str = "series_id",
) -> DataFrame:
    """Monthly weight in thousand tonnes next to the monthly mean price."""
    weights = monthly_first(df, weight, [series]).dropna(subset=[weight])
    prices = monthly_mean(df, price, [series])
    return weights.join(prices, [series, "month"]).select(
        series, "month", (F.col(weight) / weight_factor).alias("weight_kt"), F.col(price).alias("mean_price")
    )


def daily_sentiment(
    scores: DataFrame,
    start: str,
    end: str,
    lags=LAG_DAYS,
    series: str = "series_id",
) -> DataFrame:
    """Daily mean score, 0 on days without headlines, with the usual lags.

    Scores are averaged per day before anything else, so the calendar step sees one row per
    day and the spine of each series is unfolded from its own partition.
    """
    daily = scores.groupBy(series, F.to_date("ts").alias("date")).agg(
        F.avg("score").alias("sentiment")
    )
    empty = daily.select(series).distinct().select(
        series,
        F.explode(F.sequence(day(start), day(end))).alias("date"),
        F.lit(None).cast("double").alias("sentiment"),
    )
    dense = (
        daily.where(F.col("date").between(day(start), day(end)))
        .unionByName(empty)
        .groupBy(series, "date")
        .agg(F.coalesce(F.max("sentiment"), F.lit(0.0)).alias("sentiment"))
    )
    return with_columns(dense, lag_columns(["sentiment"], lags, series))
