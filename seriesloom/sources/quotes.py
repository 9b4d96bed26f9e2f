"""Quote sheets landed as delimited text: two columns below a preamble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.dates import day_first_date
from seriesloom.functions.numbers import dirty_number

SHEET_SCHEMA = T.StructType(
    [
        T.StructField("date_text", T.StringType()),
        T.StructField("value_text", T.StringType()),
    ]
)


def read_quote_sheet(spark: SparkSession, path: str, separator: str = ";", placed: bool = False) -> DataFrame:
    """Raw first two columns of every sheet below `path`; further columns are not read.

    `placed` adds the sheet's path as `source` and the line's `place` in it, which together
    order duplicates.
    """
    lines = spark.read.schema(SHEET_SCHEMA).option("sep", separator).option("mode", "PERMISSIVE").csv(path)
    if not placed:
        return lines
    # Sheets are read whole or in blocks from their start; ids rise inside a block, and blocks
    # of one file are ordered by where they start.
    return lines.select(
        "date_text", "value_text", F.col("_metadata.file_path").alias("source"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
    )


def parse_quotes(
    lines: DataFrame,
    date_text: str = "date_text",
    value_text: str = "value_text",
    date: str = "date",
    value: str = "quote",
) -> DataFrame:
    """Typed quotes. Preamble, header and blank lines go because they hold no date."""
    others = [c for c in lines.columns if c not in (date_text, value_text)]
    return (
        lines.select(
            *others,
            day_first_date(F.col(date_text)).alias(date),
            dirty_number(F.col(value_text)).alias(value),
        )
        .dropna(subset=[date, value])
    )
