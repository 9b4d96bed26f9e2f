"""From a folder of landed files to the sources of the integrated panel.

    quotes/<series>/<price column>.csv   quote sheets, several of one column allowed
    statistics/*.json                    quarterly statistics: head_count, weight
    trade/*.json                         monthly trade: trade_value, trade_qty
    rates/*.json                         exchange-rate bulletins: fx
    inflation/*.json                     monthly changes in percent: price_index
    rain/*.parquet                       gridded precipitation: rain_mm

Folders that are absent give no source. All files of a folder are read by one scan; where two
records speak of the same day or month, the first by file and place counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.calendar import INTERPOLATE
from seriesloom.operators.combine import long_to_wide, sum_parts
from seriesloom.operators.tidy import dedupe_first, last_known_per_key, price_index
from seriesloom.plans.dataset import CARRY_BOTH_WAYS, Source
from seriesloom.settings import LABEL_KEYWORDS, PRICE_COLUMNS
from seriesloom.sources import grid, payloads, quotes

KINDS = ("quotes", "statistics", "trade", "rates", "inflation", "rain")


def _present(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    config = spark.sparkContext._jsc.hadoopConfiguration()
    places = {k: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{k}") for k in KINDS}
    return [k for k, place in places.items() if place.getFileSystem(config).exists(place)]


def quote_prices(spark: SparkSession, path: str, columns: tuple[str, ...] = PRICE_COLUMNS) -> DataFrame:
    """`(series_id, date, one column per price)` of all sheets below `path`."""
    lines = quotes.read_quote_sheet(spark, f"{path}/*/*.csv", placed=True)
    parts = F.split("source", "/")
    typed = quotes.parse_quotes(lines).select(
        F.url_decode(F.element_at(parts, -2)).alias("series_id"),
        F.regexp_replace(F.element_at(parts, -1), r"(-.*)?\.csv$", "").alias("variable"),
        "date", "quote", F.struct("source", "place").alias("place"),
    )
    first = dedupe_first(typed, ["series_id", "variable", "date"], "place")
    return long_to_wide(first, list(columns), ["series_id", "date"], value="quote")


def load_sources(
    spark: SparkSession,
    folder: str,
    base_month: str,
    include: list[str] | None = None,
    prices: tuple[str, ...] = PRICE_COLUMNS,
) -> dict[str, Source]:
    """The sources found below `folder`, ready for `build_dataset`."""
    root = folder.rstrip("/")
    wanted = [k for k in _present(spark, root) if include is None or k in include]

    def responses(kind: str) -> DataFrame:
        return payloads.read_payloads(spark, f"{root}/{kind}")

    def dated(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("month", "date").where(F.col("date").isNotNull())

    def one_quotes() -> Source:
        return Source(quote_prices(spark, f"{root}/quotes", prices), prices, INTERPOLATE)

    def one_statistics() -> Source:
        names = tuple(LABEL_KEYWORDS)
        return Source(dated(payloads.pivot_quarterly(payloads.parse_quarterly(responses("statistics")), names)), names, shared=True)

    def one_trade() -> Source:
        values = ["trade_value", "trade_qty"]
        months = sum_parts([payloads.parse_trade(responses("trade"))], ["month"], values)
        return Source(dated(months), tuple(values), shared=True)

    def one_rates() -> Source:
        bulletins = payloads.parse_rates(responses("rates")).where(F.col("ts").isNotNull())
        days = bulletins.select(F.to_date("ts").alias("date"), "ts", "fx")
        return Source(last_known_per_key(days, ["date"], "fx", ["ts", "fx"]), ("fx",), CARRY_BOTH_WAYS, shared=True)

    def one_inflation() -> Source:
        # Months asked for twice state the same change; one row a month is needed.
        months = payloads.parse_inflation(responses("inflation")).where(F.col("month").isNotNull())
        once = months.groupBy("month").agg(F.max("pct").alias("pct"))
        return Source(dated(price_index(once, base_month).drop("pct")), ("price_index",), shared=True)

    def one_rain() -> Source:
        cells = spark.read.parquet(f"{root}/rain").withColumn("_file", F.col("_metadata.file_path"))
        days = grid.grid_mean(cells, order="_file").withColumn("date", F.to_date("time"))
        return Source(days.groupBy("date").agg(F.avg("rain_mm").alias("rain_mm")), ("rain_mm",), shared=True)

    makers = dict(zip(KINDS, (one_quotes, one_statistics, one_trade, one_rates, one_inflation, one_rain), strict=True))
    return reduce(lambda found, kind: {**found, kind: makers[kind]()}, wanted, {})
