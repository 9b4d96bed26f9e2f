"""Joins, calendar operators, integration and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.sql import BASE_MONTH, END, START, with_ctes
from seriesloom.functions.dates import calendar_parts, month_start
from seriesloom.operators import calendar, combine, features, tidy
from seriesloom.operators.calendar import INTERPOLATE
from seriesloom.plans.dataset import Source, build_dataset, clean, clean_and_write
from seriesloom.plans.reports import daily_sentiment, exchange_ratio, slaughter_vs_price
from seriesloom.session import scratch_dir
from seriesloom.settings import (
    CHANGE_DAYS,
    FEATURE_COLUMNS,
    HORIZONS,
    LAG_DAYS,
    PRICE_COLUMNS,
    ROLLING_DAYS,
)

BY_DATE = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"


def _product(v, name):
    return v.first_quotes.where(F.col("product") == name).select(
        "series_id", "date", F.col("quote").alias(name)
    )


@query(
    "join_full_sources",
    with_ctes(
        """SELECT series_id, date, a.quote AS price_a, b.quote AS price_b, c.quote AS price_c
           FROM (SELECT * FROM first_quotes WHERE product = 'price_a') a
           FULL JOIN (SELECT * FROM first_quotes WHERE product = 'price_b') b USING (series_id, date)
           FULL JOIN (SELECT * FROM first_quotes WHERE product = 'price_c') c USING (series_id, date)"""
    ),
)
def join_full_sources(v):
    return combine.join_sources([_product(v, p) for p in PRICE_COLUMNS])


@query(
    "concat_series",
    with_ctes("SELECT series_id, date, price_a, price_b, price_c FROM sparse_prices"),
)
def concat_series(v):
    return combine.long_to_wide(
        v.first_quotes, list(PRICE_COLUMNS), name="product", value="quote"
    )


@query(
    "common_months",
    with_ctes(
        """SELECT DISTINCT series_id, CAST(date_trunc('month', date) AS DATE) AS month
           FROM first_quotes WHERE product = 'price_a'
           INTERSECT
           SELECT series_id, CAST(date_trunc('month', date) AS DATE)
           FROM first_quotes WHERE product = 'price_b'"""
    ),
)
def common_months(v):
    def months(name):
        return v.first_quotes.where(F.col("product") == name).select(
            "series_id", month_start(F.col("date")).alias("month")
        )

    return combine.common_keys(months("price_a"), months("price_b"), ["series_id", "month"])


@query(
    "calendar_spine",
    with_ctes("SELECT s.series_id, d.date FROM (SELECT DISTINCT series_id FROM seg) s CROSS JOIN days d"),
)
def calendar_spine(v):
    return calendar.calendar_spine(v.segment_orders, START, END)


@query(
    "asof_daily",
    with_ctes(
        """SELECT s.series_id, d.date, p.price_a, p.price_b, p.price_c
           FROM (SELECT DISTINCT series_id FROM sparse_prices) s CROSS JOIN days d
           ASOF LEFT JOIN sparse_prices p ON p.series_id = s.series_id AND d.date >= p.date"""
    ),
)
def asof_daily(v):
    return calendar.asof_daily(v.sparse_prices, START, END, list(PRICE_COLUMNS))


@query("interpolate_daily", with_ctes("SELECT series_id, date, price_a AS quote FROM daily"))
def interpolate_daily(v):
    return calendar.interpolate_daily(v.dense_quotes, START, END)


@query(
    "interpolate_limited",
    with_ctes(
        """SELECT series_id, date, product,
                  CASE WHEN pd IS NULL OR date_diff('day', pd, date) > 7 THEN NULL
                       WHEN nd IS NULL OR nd = pd THEN pv
                       ELSE pv + (nv - pv) / date_diff('day', pd, nd) * date_diff('day', pd, date)
                  END AS value
           FROM price_days"""
    ),
)
def interpolate_limited(v):
    """Gap-limited filling of a dense daily table in which most days are missing."""
    empty = calendar.calendar_spine(v.segment_orders, START, END)
    dense = combine.join_sources([v.sparse_prices, empty])
    filled = calendar.interpolate_columns(dense, list(PRICE_COLUMNS), max_gap=7)
    return combine.wide_to_long(filled, list(PRICE_COLUMNS), ["series_id", "date"], "product")


@query(
    "ffill_bfill",
    with_ctes("SELECT d.date, f.fx AS raw_fx, x.fx FROM days d LEFT JOIN fx_day f ON f.date = d.date JOIN fx_filled x ON x.date = d.date"),
)
def ffill_bfill(v):
    known = v.sources["fx"].frame.withColumn("series_id", F.lit("all"))
    empty = calendar.calendar_days(v.spark, START, END).withColumn("series_id", F.lit("all"))
    dense = combine.join_sources([known, empty])
    return dense.select("date", F.col("fx").alias("raw_fx"), calendar.fill_both_ways("fx").alias("fx"))


@query(
    "monthly_first",
    with_ctes(
        """SELECT k.series_id, k.month, f.price_b
           FROM (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
                 FROM (SELECT series_id, min(date_trunc('month', date)) AS lo,
                              max(date_trunc('month', date)) AS hi FROM sparse_prices GROUP BY 1) r) k
           LEFT JOIN (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month,
                             arg_min(price_b, date) FILTER (WHERE price_b IS NOT NULL) AS price_b
                      FROM sparse_prices GROUP BY 1, 2) f
             ON f.series_id = k.series_id AND f.month = k.month"""
    ),
)
def monthly_first(v):
    return calendar.monthly_first(v.sparse_prices, "price_b")


@query(
    "monthly_mean",
    with_ctes(
        """SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month,
                  round(avg(price_b), 6) AS price_b
           FROM sparse_prices GROUP BY 1, 2 HAVING avg(price_b) IS NOT NULL"""
    ),
)
def monthly_mean(v):
    return rounded(calendar.monthly_mean(v.sparse_prices, "price_b"), price_b=6)


_LAGGED = ["head_count", "weight", "trade_value", "trade_qty", "price_index", "rain_mm"]


@query("publication_lag", with_ctes(f"SELECT date, {', '.join(_LAGGED)} FROM macro m"))
def publication_lag(v):
    months, rain = v.sources["months"], v.sources["rain"]
    keyed = combine.join_sources([months.frame, rain.frame], ["date"]).withColumn("series_id", F.lit("all"))
    daily = calendar.asof_daily(keyed, START, END, _LAGGED)
    return calendar.publication_lag(daily, _LAGGED).drop("series_id")


@query(
    "price_index",
    with_ctes("SELECT month, round(pct, 9) AS pct, price_index FROM idx"),
)
def price_index(v):
    return rounded(tidy.price_index(v.inflation_pct, BASE_MONTH), pct=9, price_index=6)


@query(
    "deflate_prices",
    with_ctes(
        """SELECT series_id, p.date AS date, price_index,
                  price_a / (price_index / 100) AS price_a, price_b / (price_index / 100) AS price_b,
                  price_a AS price_a_nominal, price_b AS price_b_nominal
           FROM prices p JOIN macro_now m ON m.date = p.date"""
    ),
)
def deflate_prices(v):
    months = v.sources["months"].frame.select(F.lit("").alias("series_id"), "date", "price_index")
    daily_index = calendar.asof_daily(months, START, END, ["price_index"]).drop("series_id")
    panel = combine.share_by_date(v.price_panel.drop("price_c"), daily_index)
    return tidy.deflate(panel, ["price_a", "price_b"])


_NOMINAL = [f"{p}_nominal" for p in PRICE_COLUMNS]
_DATASET = [*PRICE_COLUMNS, *_NOMINAL, *_LAGGED, "fx"]


@query("build_dataset", with_ctes(f"SELECT series_id, date, {', '.join(_DATASET)} FROM dataset"))
def dataset(v):
    return v.dataset


@query("build_dataset_duplicates", with_ctes(f"SELECT series_id, date, {', '.join(_DATASET)} FROM dataset"))
def dataset_of_raw_quotes(v):
    """The same table from raw quotes with several records a day: the first by arrival counts."""
    raw = {
        p: Source(
            v.quotes.where(F.col("product") == p).withColumnRenamed("quote", p), (p,), INTERPOLATE, order="ingest_order"
        )
        for p in PRICE_COLUMNS
    }
    others = {name: source for name, source in v.sources.items() if name != "prices"}
    return build_dataset({**raw, **others}, START, END)


@query(
    "clean_report",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < {lo}) AS n_below,
                       count(*) FILTER (WHERE {c} > {hi}) AS n_above,
                       count(*) FILTER (WHERE {c} IS NULL) AS n_missing_before FROM dataset"""
            for c, (lo, hi) in {"head_count": (700, 800), "weight": (17000, 20000)}.items()
        )
    ),
)
def clean_report(v):
    """What the cleaning step saw, from the pass that writes its rows."""
    bounds = {"head_count": (700.0, 800.0), "weight": (17000.0, 20000.0)}
    path = scratch_dir(v.spark, "cleaned")
    narrow = v.dataset.select("series_id", "date", *bounds)
    report = clean_and_write(narrow, list(bounds), lambda df: df.write.parquet(path), bounds=bounds)
    return report.table(v.spark).select("column_name", "n_below", "n_above", "n_missing_before")


@query(
    "clean_dataset",
    with_ctes(
        """SELECT part, series_id, count(*) AS n_rows, count(price_a) AS n_price_a,
                  count(head_count) AS n_head_count, count(price_index) AS n_price_index
           FROM (SELECT CASE WHEN date <= DATE '2001-03-31' THEN 'train' ELSE 'holdout' END AS part,
                        series_id, price_a, price_index,
                        CASE WHEN head_count >= 700 THEN head_count
                             WHEN date_diff('day', last_ok, date) <= 7 THEN 0 END AS head_count
                 FROM (SELECT *, max(CASE WHEN head_count >= 700 THEN date END)
                                 OVER (PARTITION BY series_id ORDER BY date) AS last_ok
                       FROM dataset) d) t
           GROUP BY part, series_id"""
    ),
)
def clean_dataset(v):
    """Bounds, gap filling and holdout split of the integrated table, summarised."""
    columns = ["price_a", "head_count", "price_index"]
    narrow = v.dataset.select("series_id", "date", *columns)
    train, holdout = clean(
        narrow, columns, cutoff="2001-03-31", bounds={"head_count": (700.0, 1e9)}
    )
    both = train.withColumn("part", F.lit("train")).unionByName(
        holdout.withColumn("part", F.lit("holdout"))
    )
    return both.groupBy("part", "series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in columns]
    )


@query(
    "lag_features",
    with_ctes(
        "SELECT series_id, date, price_a, "
        + ", ".join(f"lag(price_a, {k}) OVER w AS price_a_lag{k}d" for k in LAG_DAYS)
        + f" FROM daily {BY_DATE}"
    ),
)
def lag_features(v):
    return features.with_columns(v.daily_price, features.lag_columns(["price_a"]))


@query(
    "targets",
    with_ctes(
        "SELECT series_id, date, price_a, "
        + ", ".join(f"lead(price_a, {h}) OVER w AS target_h{h}d" for h in HORIZONS)
        + f" FROM daily {BY_DATE}"
    ),
)
def targets(v):
    return features.with_columns(v.daily_price, features.target_columns())


@query(
    "valid_target_rows",
    with_ctes(
        f"""SELECT * FROM (SELECT series_id, date, price_a, lead(price_a, 30) OVER w AS target_h30d
            FROM daily {BY_DATE}) t WHERE target_h30d IS NOT NULL"""
    ),
)
def valid_target_rows(v):
    rows = features.with_columns(v.daily_price, features.target_columns(horizons=(30,)))
    return tidy.complete_rows(rows, ["target_h30d"])


def _rolling_sql(function, suffix):
    return ", ".join(
        f"round({function}(price_a) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 5)"
        f" AS price_a_{suffix}{n}d"
        for n in ROLLING_DAYS
    )


@query("rolling_mean", with_ctes(f"SELECT series_id, date, {_rolling_sql('avg', 'ma')} FROM daily {BY_DATE}"))
def rolling_mean(v):
    columns = features.mean_columns(["price_a"])
    out = features.with_columns(v.daily_price, columns, keep=["series_id", "date"])
    return rounded(out, **{c: 5 for c in columns})


@query(
    "rolling_std",
    with_ctes(f"SELECT series_id, date, {_rolling_sql('stddev_samp', 'std')} FROM daily {BY_DATE}"),
)
def rolling_std(v):
    columns = features.deviation_columns(["price_a"])
    out = features.with_columns(v.daily_price, columns, keep=["series_id", "date"])
    return rounded(out, **{c: 5 for c in columns})


@query(
    "pct_change",
    with_ctes(
        "SELECT series_id, date, "
        + ", ".join(
            f"p / nullif(lag(p, {k}) OVER w, 0) - 1 AS price_b_pct{k}d" for k in CHANGE_DAYS
        )
        + """ FROM (SELECT s.series_id, d.date, p.price_b AS p
                    FROM (SELECT DISTINCT series_id FROM sparse_prices) s CROSS JOIN days d
                    ASOF LEFT JOIN (SELECT * FROM sparse_prices WHERE price_b IS NOT NULL) p
                      ON p.series_id = s.series_id AND d.date >= p.date) t
             WINDOW w AS (PARTITION BY series_id ORDER BY date)"""
    ),
)
def pct_change(v):
    """Changes over gaps: the dense table has a price on few days, the gaps are padded."""
    empty = calendar.calendar_spine(v.segment_orders, START, END)
    dense = combine.join_sources([v.sparse_prices.select("series_id", "date", "price_b"), empty])
    return features.with_columns(
        features.padded(dense, ["price_b"]),
        features.change_columns(["price_b"]),
        keep=["series_id", "date"],
    )


@query(
    "calendar_features",
    with_ctes(
        """SELECT date, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
                  CAST(isodow(date) - 1 AS INTEGER) AS weekday,
                  CAST(dayofyear(date) AS INTEGER) AS day_of_year,
                  round(sin(2 * pi() * month(date) / 12), 9) AS month_sin,
                  round(cos(2 * pi() * month(date) / 12), 9) AS month_cos
           FROM (SELECT DISTINCT date FROM seg) t"""
    ),
)
def calendar_features(v):
    dates = v.segment_orders.select("date").distinct()
    parts = calendar_parts(F.col("date"))
    return rounded(
        features.with_columns(dates, parts), month_sin=9, month_cos=9
    )


@query(
    "ratio_features",
    with_ctes(
        """SELECT series_id, date, price_a / nullif(price_c, 0) AS ratio_a_c,
                  price_a / nullif(price_b, 0) AS ratio_a_b FROM prices"""
    ),
)
def ratio_features(v):
    panel = v.price_panel
    return features.with_columns(
        panel, features.ratio_columns(panel.columns), keep=["series_id", "date"]
    )


def _feature_decimals():
    """Rolling statistics are rounded: engines add up a frame in different orders."""
    out = {"month_sin": 6, "month_cos": 6}
    for c in FEATURE_COLUMNS:
        digits = 4 if c == "trade_value" else 5
        out.update({f"{c}_ma{n}d": digits for n in ROLLING_DAYS})
        out.update({f"{c}_std{n}d": 4 for n in ROLLING_DAYS})
    return out


def _feature_sql():
    d = _feature_decimals()
    parts = ["series_id", "date", *_DATASET]
    for c in FEATURE_COLUMNS:
        parts += [f"lag({c}, {k}) OVER w AS {c}_lag{k}d" for k in LAG_DAYS]
        for n in ROLLING_DAYS:
            frame = f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            parts.append(f"round(avg({c}) {frame}, {d[f'{c}_ma{n}d']}) AS {c}_ma{n}d")
            parts.append(f"round(stddev_samp({c}) {frame}, {d[f'{c}_std{n}d']}) AS {c}_std{n}d")
        parts += [f"{c}_p / nullif(lag({c}_p, {k}) OVER w, 0) - 1 AS {c}_pct{k}d" for k in CHANGE_DAYS]
    parts += [
        "CAST(month(date) AS INTEGER) AS month", "CAST(quarter(date) AS INTEGER) AS quarter",
        "CAST(isodow(date) - 1 AS INTEGER) AS weekday",
        "CAST(dayofyear(date) AS INTEGER) AS day_of_year",
        "round(sin(2 * pi() * month(date) / 12), 6) AS month_sin",
        "round(cos(2 * pi() * month(date) / 12), 6) AS month_cos",
        "price_a / nullif(price_c, 0) AS ratio_a_c", "price_a / nullif(price_b, 0) AS ratio_a_b",
    ]
    parts += [f"lead(price_a, {h}) OVER w AS target_h{h}d" for h in HORIZONS]
    fills = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_p"
        for c in FEATURE_COLUMNS
    )
    return with_ctes(
        f"SELECT {', '.join(parts)} FROM (SELECT *, {fills} FROM dataset {BY_DATE}) x {BY_DATE}"
    )


@query("feature_table", _feature_sql())
def feature_table(v):
    return rounded(features.feature_table(v.dataset), **_feature_decimals())


@query(
    "exchange_ratio",
    with_ctes(
        """SELECT series_id, month, round(head_price, 6) AS head_price,
                  round(other_price, 6) AS other_price, round(ratio, 6) AS ratio,
                  round(mean_ratio, 6) AS mean_ratio, ratio >= mean_ratio AS above_mean
           FROM (SELECT *, avg(ratio) OVER (PARTITION BY series_id) AS mean_ratio
                 FROM (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month,
                              avg(price_a) * 18 AS head_price, avg(price_b) AS other_price,
                              avg(price_a) * 18 / avg(price_b) AS ratio
                       FROM prices GROUP BY 1, 2) m
                 WHERE head_price IS NOT NULL AND other_price IS NOT NULL) r"""
    ),
)
def exchange_ratio_report(v):
    return rounded(
        exchange_ratio(v.price_panel), head_price=6, other_price=6, ratio=6, mean_ratio=6
    )


@query(
    "slaughter_vs_price",
    with_ctes(
        """SELECT w.series_id, w.month, w.weight / 1e6 AS weight_kt, round(p.mean_price, 6) AS mean_price
           FROM (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month,
                        arg_min(weight, date) FILTER (WHERE weight IS NOT NULL) AS weight
                 FROM dataset GROUP BY 1, 2) w
           JOIN (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month,
                        avg(price_a_nominal) AS mean_price
                 FROM dataset GROUP BY 1, 2) p
             ON p.series_id = w.series_id AND p.month = w.month
           WHERE w.weight IS NOT NULL AND p.mean_price IS NOT NULL"""
    ),
)
def slaughter_report(v):
    return rounded(slaughter_vs_price(v.dataset, price="price_a_nominal"), mean_price=6)


_SENTIMENT_LAGS = ", ".join(
    f"round(lag(s, {k}) OVER (ORDER BY date), 9) AS sentiment_lag{k}d" for k in LAG_DAYS
)


@query(
    "daily_sentiment",
    f"""SELECT 'all' AS series_id, date, round(s, 9) AS sentiment, {_SENTIMENT_LAGS}
        FROM (SELECT d.date, coalesce(h.s, 0.0) AS s
              FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-15', DATE '2024-04-30', INTERVAL 1 DAY)) AS DATE) AS date) d
              LEFT JOIN (SELECT CAST(ts AS DATE) AS date, avg((value - 120) / 490) AS s
                         FROM events WHERE event_type = 'error' GROUP BY 1) h ON h.date = d.date) x""",
)
def sentiment(v):
    out = daily_sentiment(v.headlines, "2023-12-15", "2024-04-30")
    return rounded(out, sentiment=9, **{f"sentiment_lag{k}d": 9 for k in LAG_DAYS})
