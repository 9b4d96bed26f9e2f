"""Feature relevance: rank correlation, attribution ranking, sampling, medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.normal import correlation_p_value
from seriesloom.operators.ordered import (
    attach_rank,
    exact_quantiles,
    ranked_values,
)
from seriesloom.settings import SIGNIFICANCE
from seriesloom.sources.store import cut_lineage


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact interpolated median of every column over the whole panel."""
    cells = df.select(*columns).unpivot([], columns, "feature", "value")
    return exact_quantiles(cells, ["feature"], "value", [0.5]).select(
        "feature", F.element_at("quantiles", 1).alias("median")
    )


def median_values(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The medians as a dictionary: one number per column, whatever the number of rows."""
    return {r["feature"]: r["median"] for r in column_medians(df, columns).collect()}


def impute_medians(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Replace missing values by the median of `fit_on` (default: of the table itself)."""
    medians = median_values(df if fit_on is None else fit_on, columns)
    return df.select(
        *[
            F.coalesce(c, F.lit(medians[c])).alias(c) if c in medians else F.col(c)
            for c in df.columns
        ]
    )


def spearman(
    df: DataFrame,
    features: list[str],
    target: str,
    row_key: list[str],
    top_n: int = 20,
) -> DataFrame:
    """Spearman correlation of every feature with the target, largest magnitude first.

    Missing feature values take the feature's median. The rows are written once, because
    ranking reads them several times. The target is ranked on the wide rows; the feature
    cells are ranked in long form, all features in one pass, and the correlation is a plain
    aggregate. No feature is ever ordered in a single task.
    """
    valid = cut_lineage(
        df.where(F.col(target).isNotNull()).select(
            *row_key, F.lit(target).alias("_target"), target, *[F.col(f).cast("double") for f in features]
        ),
        "spearman",
    )
    filled = impute_medians(valid, features)
    target_ranks = ranked_values(valid, ["_target"], target)
    ranked_rows = attach_rank(filled, target_ranks, ["_target"], target, "target_rank", row_key)
    cells = filled.unpivot(row_key, features, "feature", "value")
    feature_ranks = ranked_values(cells, ["feature"], "value")
    pairs = attach_rank(
        ranked_rows.unpivot([*row_key, "target_rank"], features, "feature", "value"),
        feature_ranks,
        ["feature"],
        "value",
        "feature_rank",
        row_key,
    )
    rho = pairs.groupBy("feature").agg(
        F.corr("feature_rank", "target_rank").alias("rho"), F.count(F.lit(1)).alias("n")
    )
    p_value = correlation_p_value(F.col("rho"), F.col("n"))
    return (
        rho.select(
            "feature",
            "rho",
            p_value.alias("p_value"),
            F.abs("rho").alias("abs_rho"),
        )
        .withColumn(
            "significant",
            F.when(F.col("p_value") < SIGNIFICANCE, F.lit("Sim")).otherwise(F.lit("Nao")),
        )
        .orderBy(F.desc("abs_rho"), "feature")
        .limit(top_n)
    )


def top_features(
    df: DataFrame, score: str = "importance", n: int = 20, feature: str = "feature"
) -> DataFrame:
    return df.orderBy(F.desc(score), feature).limit(n)


def attribution_rank(df: DataFrame, n: int = 15) -> DataFrame:
    """Mean absolute attribution per feature of a long `(feature, attribution)` table."""
    means = df.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return top_features(means, "mean_abs", n)


def hash_sample(df: DataFrame, row_id: str, n: int = 500, seed: int = 42) -> DataFrame:
    """The same `n` rows on every run and at any partitioning.

    Rows are taken in the order of a multiplicative hash of their id. `limit` after `orderBy`
    keeps `n` rows per task and merges them, it does not sort the table.
    """
    spread = F.pmod(
        F.pmod(F.col(row_id), F.lit(2**31)) * F.lit(2654435761) + F.lit(seed), F.lit(2**32)
    )
    return df.orderBy(spread, row_id).limit(n)
