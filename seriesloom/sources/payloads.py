"""JSON payloads of the statistics, trade, exchange-rate and inflation services.

A payload table has one row per landed response with the text in `payload`. Each parser
flattens it with `from_json` and `explode`, so parsing stays inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.dates import first_of_month, quarter_month
from seriesloom.functions.numbers import comma_number, is_number_text, number_or_zero
from seriesloom.settings import DEFAULT_ORDINAL, LABEL_KEYWORDS

# Field names of the four services.
QUARTERLY_SCHEMA = "array<struct<D3C:string,D4N:string,D2N:string,V:string>>"
TRADE_SCHEMA = (
    "struct<data:struct<list:array<struct<"
    "year:string,monthNumber:string,heading:string,metricFOB:string,metricKG:string>>>>"
)
RATE_SCHEMA = "struct<value:array<struct<cotacaoVenda:double,dataHoraCotacao:string>>>"
INFLATION_SCHEMA = "array<struct<data:string,valor:string>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed response file, with its path as `source`: the order of the files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source")
    )


def _source(payloads: DataFrame):
    """The response's place among the responses; one place for payloads without a source."""
    return (F.col("source") if "source" in payloads.columns else F.lit("")).alias("source")


def quarterly_rows(payloads: DataFrame) -> DataFrame:
    """Raw statistics records `(source, position, period, ordinal, variable, value_text)`.

    The first object of a response is a header, its value is no number, so the number
    filter removes it. A response with no record besides the header is an error.
    """
    records = F.from_json("payload", QUARTERLY_SCHEMA)
    checked = F.when(
        F.coalesce(F.size(records), F.lit(0)) < 2,
        F.raise_error(F.lit("statistics response is empty or invalid")).cast(QUARTERLY_SCHEMA),
    ).otherwise(records)
    return payloads.select(_source(payloads), F.posexplode(checked).alias("position", "r")).select(
        "source",
        "position",
        F.col("r.D3C").alias("period"),
        F.coalesce("r.D4N", F.lit(DEFAULT_ORDINAL)).alias("ordinal"),
        F.col("r.D2N").alias("variable"),
        F.col("r.V").alias("value_text"),
    )


def numeric_rows(rows: DataFrame, text: str = "value_text", value: str = "value") -> DataFrame:
    """Keep the rows whose text is a number and convert it."""
    return (
        rows.where(is_number_text(F.col(text)))
        .withColumn(value, comma_number(F.col(text)))
        .drop(text)
    )


def parse_quarterly(payloads: DataFrame) -> DataFrame:
    """Monthly statistics `(source, position, month, period, ordinal, variable, value)`."""
    return numeric_rows(quarterly_rows(payloads)).select(
        "source",
        "position",
        quarter_month(F.col("period"), F.col("ordinal")).alias("month"),
        "period",
        "ordinal",
        "variable",
        "value",
    )


def canonical_label(label: str = "variable"):
    """Column name that a variable label stands for, found by keyword; else the label."""
    lowered = F.lower(F.col(label))
    named = F
    for name, words in LABEL_KEYWORDS.items():
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        named = named.when(hit, F.lit(name))
    return named.otherwise(F.col(label))


def pivot_quarterly(
    records: DataFrame,
    variables: tuple[str, ...] = tuple(LABEL_KEYWORDS),
    order: tuple[str, ...] = ("source", "position"),
) -> DataFrame:
    """One column per variable and the first value per month, "first" by `order`: by the
    response's file, then by the place in it. Equal places take the smaller value.

    Labels are renamed before the pivot, so two labels with one name share a column. The
    variables are a fixed list: no extra pass to find the pivot values.
    """
    named = records.withColumn("variable", canonical_label())
    firsts = [
        F.min_by("value", F.when(F.col("variable") == v, F.struct(*order, "value"))).alias(v)
        for v in variables
    ]
    return named.where(F.col("variable").isin(*variables)).groupBy("month").agg(*firsts)


def parse_trade(payloads: DataFrame) -> DataFrame:
    """Trade records with metrics as numbers; text that is no number counts as 0."""
    records = F.from_json("payload", TRADE_SCHEMA)
    return payloads.select(F.explode(records["data"]["list"]).alias("r")).select(
        first_of_month(F.col("r.year"), F.col("r.monthNumber")).alias("month"),
        F.col("r.heading").alias("heading"),
        number_or_zero(F.col("r.metricFOB")).alias("trade_value"),
        number_or_zero(F.col("r.metricKG")).alias("trade_qty"),
    )


def parse_rates(payloads: DataFrame, value: str = "fx") -> DataFrame:
    """Bulletins `(ts, value)`; the other fields of a bulletin are not read."""
    records = F.from_json("payload", RATE_SCHEMA)
    return payloads.select(F.explode(records["value"]).alias("r")).select(
        F.try_to_timestamp("r.dataHoraCotacao").alias("ts"),
        F.col("r.cotacaoVenda").alias(value),
    )


def parse_inflation(payloads: DataFrame) -> DataFrame:
    """Monthly change in percent `(month, pct)`."""
    records = F.from_json("payload", INFLATION_SCHEMA)
    return payloads.select(F.explode(records).alias("r")).select(
        F.try_to_timestamp("r.data", F.lit("dd/MM/yyyy")).cast("date").alias("month"),
        F.col("r.valor").try_cast("double").alias("pct"),
    )
