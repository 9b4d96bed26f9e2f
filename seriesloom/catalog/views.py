"""Source views derived from the given business tables.

Orders stand in for price quotes and exchange-rate bulletins, line items for slaughter,
trade, inflation and rain, events for headlines. Each view reads only the columns it needs
and aggregates before anything else, so work grows with the tables while the panel itself
has one row per series and day.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.calendar import INTERPOLATE, interpolate_daily
from seriesloom.operators.folds import baseline_oof
from seriesloom.operators.tidy import dedupe_first, last_known_per_key, price_index
from seriesloom.plans.dataset import (
    CARRY_BOTH_WAYS,
    Source,
    build_dataset,
    daily_panel,
)
from seriesloom.settings import METRES_TO_MM, PRICE_COLUMNS

START = "1995-01-01"
END = "2001-08-01"
BASE_MONTH = "2000-12-01"
CUTOFF = "2001-03-31"
# Money is counted in an odd unit, so that no mean of it falls exactly between two rounded
# values, where engines with another summing order would differ.
UNIT = 997.3021837

# Columns and types of the given tables that the views read: no file is opened to infer them.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_mktsegment string",
    "supplier": "s_suppkey long, s_nationkey int",
    "lineitem": "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, event_type string, value double",
}
PRODUCTS = {"1-URGENT": "price_a", "2-HIGH": "price_b", "3-MEDIUM": "price_c"}
HEAD_LABEL = "Animais abatidos (cabeças)"
WEIGHT_LABEL = "Peso total das carcaças"


class Views:
    """Lazy views over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def segment_orders(self) -> DataFrame:
        """Orders with the market segment as series. One customer row per order key; whether
        the customers are broadcast is left to their size, and a customer with very many
        orders is split by the adaptive skew join."""
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("c_mktsegment").alias("series_id"),
                F.to_date("o_orderdate").alias("date"),
                F.col("o_orderpriority").alias("priority"),
                F.col("o_orderkey").alias("ingest_order"),
                F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
                (F.col("o_totalprice") / UNIT).alias("quote"),
            )
        )

    @cached_property
    def quotes(self) -> DataFrame:
        """Raw quotes of three products, several per series and day."""
        named = F.when(F.lit(False), F.lit(None).cast("string"))
        for priority, product in PRODUCTS.items():
            named = named.when(F.col("priority") == priority, F.lit(product))
        return self.segment_orders.where(F.col("priority").isin(*PRODUCTS)).select(
            "series_id", "date", named.alias("product"), "ingest_order", "quote"
        )

    @cached_property
    def first_quotes(self) -> DataFrame:
        return dedupe_first(self.quotes, ["series_id", "date", "product"], "ingest_order").drop(
            "ingest_order"
        )

    @cached_property
    def sparse_prices(self) -> DataFrame:
        """First quotes with one column per product; days without any quote are absent."""
        return self.quotes.groupBy("series_id", "date").agg(
            *[
                F.min_by("quote", F.when(F.col("product") == p, F.col("ingest_order"))).alias(p)
                for p in PRICE_COLUMNS
            ]
        )

    @cached_property
    def dense_quotes(self) -> DataFrame:
        """Mean quote per series and day. Cents add up exactly in any order."""
        return self.segment_orders.groupBy("series_id", "date").agg(
            (F.sum("cents") / F.count("cents") / 100 / UNIT).alias("quote")
        )

    @cached_property
    def daily_price(self) -> DataFrame:
        """Daily interpolated price per segment as `price_a`."""
        return interpolate_daily(self.dense_quotes, START, END).withColumnRenamed("quote", "price_a")

    @cached_property
    def price_panel(self) -> DataFrame:
        """Three daily interpolated prices per segment."""
        return daily_panel(
            [Source(self.sparse_prices, PRICE_COLUMNS, INTERPOLATE)], START, END
        )

    @cached_property
    def line_months(self) -> DataFrame:
        """Monthly totals of the line items: one scan serves four sources."""
        return self.table("lineitem").groupBy(
            F.trunc(F.to_date("l_shipdate"), "MM").alias("month")
        ).agg(
            F.count(F.lit(1)).cast("double").alias("head_count"),
            F.sum("l_quantity").alias("weight"),
            (F.round(F.sum("l_extendedprice"), 2) / UNIT).alias("trade_value"),
            F.sum("l_quantity").alias("trade_qty"),
            (F.lit(100) * (F.avg("l_discount") - 0.045)).alias("pct"),
        )

    @cached_property
    def trade_records(self) -> DataFrame:
        """Trade per month and heading."""
        return self.table("lineitem").groupBy(
            F.trunc(F.to_date("l_shipdate"), "MM").alias("month"),
            F.col("l_returnflag").alias("heading"),
        ).agg(
            F.round(F.sum("l_extendedprice"), 2).alias("trade_value"),
            F.sum("l_quantity").alias("trade_qty"),
        )

    @cached_property
    def inflation_pct(self) -> DataFrame:
        return self.line_months.select("month", "pct")

    @cached_property
    def precip_grid(self) -> DataFrame:
        """Mean tax per month and supplier nation on a 5 x 5 grid of nations.

        Line items are summed per supplier and month before the join, so a supplier with a
        large share of them reaches the shuffle as a few rows.
        """
        per_supplier = self.table("lineitem").groupBy(
            "l_suppkey", F.trunc(F.to_date("l_shipdate"), "MM").alias("time")
        ).agg(F.sum("l_tax").alias("total"), F.count("l_tax").alias("n"))
        return (
            per_supplier.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("time", "s_nationkey")
            .agg((F.sum("total") / F.sum("n")).alias("tp"))
            .select(
                "time",
                F.floor(F.col("s_nationkey") / 5).cast("int").alias("latitude"),
                F.pmod("s_nationkey", F.lit(5)).cast("int").alias("longitude"),
                "tp",
            )
        )

    @cached_property
    def fx_long(self) -> DataFrame:
        """Exchange-rate bulletins: several per day, in arrival order."""
        return self.table("orders").where(F.col("o_orderstatus") == "F").select(
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderkey").alias("ord"),
            (F.col("o_totalprice") / UNIT).alias("fx"),
        )

    @cached_property
    def fx_bulletins(self) -> DataFrame:
        """Time-stamped bulletins of one month; low values stand for a missing rate."""
        return self.table("events").where(F.col("event_type") == "purchase").select(
            "ts",
            F.col("event_id").alias("ord"),
            F.when(F.col("value") >= 10, F.col("value")).alias("fx"),
        )

    @cached_property
    def headlines(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") == "error").select(
            F.lit("all").alias("series_id"),
            "ts",
            ((F.col("value") - 120) / 490).alias("score"),
        )

    @cached_property
    def sources(self) -> dict[str, Source]:
        months = price_index(
            self.line_months, BASE_MONTH, keep=["head_count", "weight", "trade_value", "trade_qty"]
        ).select("*", F.col("month").alias("date")).drop("month")
        # Indices and means are published with a fixed number of digits.
        months = months.withColumn("price_index", F.round("price_index", 6))
        rain = self.precip_grid.groupBy(F.col("time").alias("date")).agg(
            (F.round(F.avg("tp") * METRES_TO_MM, 8) * (1000 / UNIT)).alias("rain_mm")
        )
        fx = last_known_per_key(self.fx_long, ["date"], "fx", ["ord"])
        monthly = ("head_count", "weight", "trade_value", "trade_qty", "price_index")
        return {
            "prices": Source(self.sparse_prices, PRICE_COLUMNS, INTERPOLATE),
            "months": Source(months, monthly, shared=True),
            "rain": Source(rain, ("rain_mm",), shared=True),
            "fx": Source(fx, ("fx",), CARRY_BOTH_WAYS, shared=True),
        }

    @cached_property
    def dataset(self) -> DataFrame:
        return build_dataset(self.sources, START, END)

    @cached_property
    def oof(self) -> DataFrame:
        """Out-of-fold naive forecasts of the daily price."""
        return baseline_oof(self.daily_price)
