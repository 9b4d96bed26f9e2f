"""Line removal by site-relative frequency, in DataFrame expressions only.

A line counts once per page. Pages that contain it, divided by all pages of its site, gives
its ratio; lines above the ratio (and on at least `min_pages` pages) are boilerplate of that
site. Counting shuffles one 64-bit value per distinct line of a page, summed on the map side
first, so one line on a third of all pages is a few rows. A site has at most (mean distinct
lines per page) / ratio boilerplate lines, so they travel as one array per site and a page
is rewritten in place without being taken apart again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import same, trimmed

#: A line on more than this share of a site's pages is boilerplate.
RATIO_PERCENT = 10
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, site: str, text: str, percent: int, min_pages: int) -> DataFrame:
    """One row per site with the hashes of its boilerplate lines."""
    cut = F.transform(_lines(F.col(text)), lambda x: trimmed(x))
    own = F.filter(F.array_distinct(cut), lambda x: F.length(x) > 0)
    seen = pages.select(
        F.col(site).alias("_site"), F.explode(F.transform(own, lambda x: F.xxhash64(x))).alias("_line")
    ).groupBy("_site", "_line").agg(F.count("*").alias("_pages"))
    totals = pages.groupBy(F.col(site).alias("_at")).agg(F.count("*").alias("_total"))
    often = seen.where(F.col("_pages") >= min_pages)
    return (
        often.join(totals, same(often["_site"], totals["_at"]))
        .where(100 * F.col("_pages") > percent * F.col("_total"))
        .groupBy("_site")
        .agg(F.collect_set("_line").alias("_drop"))
    )


def drop_lines(
    pages: DataFrame,
    site: str = "source",
    text: str = "text",
    percent: int = RATIO_PERCENT,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """The pages with boilerplate lines removed, and `n_lines`, `n_dropped`.

    Lines are split at line feeds and compared without outer white space; blank lines are
    neither counted nor removed. A page all of whose lines would go is left as it is: whole
    copies belong to near-duplicate removal. Null text stays null with no lines; null sites
    are one site; an empty table gives an empty result; each repeated row is a page of its
    own. Columns of the result's names are replaced, others pass through.
    """
    found = boilerplate(pages, site, text, percent, min_pages)
    joined = pages.join(found, same(F.col(site), F.col("_site")), "left")
    lines = _lines(F.col(text))
    filled = F.filter(lines, lambda x: F.length(trimmed(x)) > 0)

    def rest(all_lines: Column) -> Column:
        return F.filter(
            all_lines,
            lambda x: (F.length(trimmed(x)) == 0) | ~F.array_contains(F.col("_drop"), F.xxhash64(trimmed(x))),
        )

    kept = F.when(F.col("_drop").isNotNull(), rest(lines)).otherwise(lines)
    whole = F.when(F.exists(kept, lambda x: F.length(trimmed(x)) > 0), kept).otherwise(lines)
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(filled)).cast("long")
    staged = joined.withColumns({"_kept": whole, "n_lines": n_lines})
    return staged.withColumns(
        {
            "n_dropped": (F.size(lines) - F.size("_kept")).cast("long"),
            text: F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")),
        }
    ).drop("_site", "_drop", "_kept")
