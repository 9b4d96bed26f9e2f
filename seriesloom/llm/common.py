"""Helpers shared by the corpus operators: tables, word columns, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.store import cut_lineage

#: The white space of the word rule.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def spaced(text: Column) -> Column:
    """The text with every white-space character as a plain space; null as the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none. Splitting at one plain character is
    several times faster than at a pattern."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: a lost executor costs one re-read."""
    return cut_lineage(df, label)


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus
