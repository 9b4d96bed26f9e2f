"""Walk-forward evaluation of naive forecasts, distribution tables and feature relevance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.sql import with_ctes
from seriesloom.catalog.views import UNIT
from seriesloom.functions import normal
from seriesloom.operators import combine, features, folds, metrics, relevance, spread
from seriesloom.plans.forecasting import forecast_vs_actual, shift_to_target_date
from seriesloom.sources import store
from seriesloom.settings import HORIZONS, MONTH_LABELS, PRICE_BANDS, PRICE_COLUMNS

MODELS = {"last": "baseline_last", "ma7": "baseline_ma7"}
SCORES = {"rmse": 6, "mae": 6, "mape": 6}


@query(
    "naive_baselines",
    with_ctes("SELECT series_id, date, baseline_last, round(baseline_ma7, 6) AS baseline_ma7 FROM base"),
)
def naive_baselines(v):
    out = features.with_columns(
        v.daily_price, features.baseline_columns(), keep=["series_id", "date"]
    )
    return rounded(out, baseline_ma7=6)


@query(
    "walk_forward_folds",
    with_ctes(
        """SELECT series_id, date, row_no,
                  CAST(CASE WHEN sz > 0 AND row_no >= 730 AND (row_no - 730) // sz < 5
                            THEN (row_no - 730) // sz + 1 END AS INTEGER) AS fold
           FROM (SELECT series_id, date,
                        CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS INTEGER) AS row_no,
                        (count(*) OVER (PARTITION BY series_id) - 730) // 5 AS sz
                 FROM dense_quotes) t"""
    ),
)
def walk_forward_folds(v):
    return folds.walk_forward_folds(v.dense_quotes.select("series_id", "date"))


@query(
    "fold_boundaries",
    with_ctes(
        """SELECT f.series_id, CAST(f.fold AS INTEGER) AS fold,
                  min(t.date) FILTER (WHERE t.rn < f.lo) AS train_start,
                  max(t.date) FILTER (WHERE t.rn < f.lo) AS train_end,
                  min(t.date) FILTER (WHERE t.rn BETWEEN f.lo AND f.hi) AS test_start,
                  max(t.date) FILTER (WHERE t.rn BETWEEN f.lo AND f.hi) AS test_end,
                  count(*) FILTER (WHERE t.rn BETWEEN f.lo AND f.hi) AS n_test
           FROM (SELECT series_id, fold, 730 + (fold - 1) * sz AS lo, 730 + fold * sz - 1 AS hi
                 FROM (SELECT series_id, (count(*) - 730) // 5 AS sz FROM dense_quotes GROUP BY 1) s
                 CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold) k WHERE sz > 0) f
           JOIN (SELECT series_id, date,
                        row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn
                 FROM dense_quotes) t ON t.series_id = f.series_id
           GROUP BY f.series_id, f.fold"""
    ),
)
def fold_boundaries(v):
    return folds.fold_boundaries(v.dense_quotes)


@query(
    "panel_fold_dates",
    with_ctes(
        """SELECT CAST(k.fold AS INTEGER) AS fold,
                  max(d.date) FILTER (WHERE d.rn < 730 + (k.fold - 1) * sz) AS train_end,
                  min(d.date) FILTER (WHERE d.rn >= 730 + (k.fold - 1) * sz) AS test_start,
                  max(d.date) FILTER (WHERE d.rn < 730 + k.fold * sz) AS test_end
           FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn,
                        (count(*) OVER () - 730) // 5 AS sz
                 FROM (SELECT DISTINCT date FROM seg) u) d
           CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold) k
           WHERE sz > 0 GROUP BY k.fold"""
    ),
)
def panel_fold_dates(v):
    return folds.panel_fold_dates(v.segment_orders)


@query(
    "baseline_oof",
    with_ctes(
        """SELECT series_id, date, horizon, fold, y_true, baseline_last,
                  round(baseline_ma7, 6) AS baseline_ma7,
                  round(CASE WHEN chosen = 'ma7' THEN baseline_ma7 ELSE baseline_last END, 6)
                      AS baseline_chosen
           FROM oof JOIN chosen USING (series_id, horizon, fold)"""
    ),
)
def baseline_oof(v):
    return rounded(folds.oof_with_choice(v.oof), baseline_ma7=6, baseline_chosen=6)


def _score_sql(table):
    return with_ctes(
        f"""SELECT series_id, horizon, fold, chosen, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
                   round(mape, 6) AS mape FROM {table}"""
    )


@query("baseline_choice", _score_sql("chosen"))
def baseline_choice(v):
    return rounded(folds.baseline_choice(v.oof), **SCORES)


@query(
    "baseline_walk_forward",
    with_ctes(
        """SELECT series_id, horizon, fold, round(last_rmse, 6) AS rmse, round(last_mae, 6) AS mae,
                  round(last_mape, 6) AS mape FROM fold_scores"""
    ),
)
def baseline_walk_forward(v):
    """Persistence: the current price as forecast for every horizon."""
    scores = metrics.error_metrics(
        v.oof, "y_true", "baseline_last", ["series_id", "horizon", "fold"]
    )
    return rounded(scores, **SCORES)


@query(
    "align_baseline",
    with_ctes(
        """SELECT series_id, horizon, date, y_true,
                  CASE WHEN fold < 5 THEN baseline_last END AS pred_baseline
           FROM oof"""
    ),
)
def align_baseline(v):
    """Persistence forecasts of four folds aligned with all out-of-fold rows."""
    keys = ["series_id", "horizon", "date"]
    persistence = v.oof.where(F.col("fold") < 5).withColumnRenamed("baseline_last", "pred_baseline")
    return combine.align(v.oof.select(*keys, "y_true"), persistence, keys, ["pred_baseline"])


def _error_rows(v):
    """Forecast errors on raw quotes, where some actuals are zero."""
    zeroed = F.when(F.pmod(F.dayofyear("date"), F.lit(97)) == 0, F.lit(0.0)).otherwise(F.col("y_true"))
    return v.oof.withColumn("y_true", zeroed)


_ERROR_ROWS = """(SELECT horizon, fold, baseline_last AS p,
                        CASE WHEN dayofyear(date) % 97 = 0 THEN 0 ELSE y_true END AS y FROM oof)"""


@query(
    "error_metrics",
    with_ctes(
        f"""SELECT horizon, fold, round(sqrt(avg((y - p) ** 2)), 6) AS rmse,
                   round(avg(abs(y - p)), 6) AS mae,
                   CASE WHEN count(*) FILTER (WHERE y = 0) = 0
                        THEN round(avg(abs((y - p) / nullif(y, 0))) * 100, 6) END AS mape
            FROM {_ERROR_ROWS} t GROUP BY horizon, fold
            UNION ALL
            SELECT horizon, 0, round(sqrt(avg((y_true - baseline_last) ** 2)), 6),
                   round(avg(abs(y_true - baseline_last)), 6),
                   round(avg(abs((y_true - baseline_last) / y_true)) * 100, 6)
            FROM oof GROUP BY horizon"""
    ),
)
def error_metrics(v):
    by_fold = metrics.error_metrics(_error_rows(v), p="baseline_last", keys=["horizon", "fold"])
    overall = metrics.error_metrics(v.oof, p="baseline_last", keys=["horizon"]).withColumn(
        "fold", F.lit(0)
    )
    return rounded(by_fold.unionByName(overall), **SCORES)


@query(
    "error_metrics_skip_zero",
    with_ctes(
        f"""SELECT horizon, fold, round(sqrt(avg((y - p) ** 2)), 6) AS rmse,
                   round(avg(abs(y - p)), 6) AS mae,
                   round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0) * 100, 6) AS mape
            FROM {_ERROR_ROWS} t GROUP BY horizon, fold"""
    ),
)
def error_metrics_skip_zero(v):
    scores = metrics.error_metrics(
        _error_rows(v), p="baseline_last", keys=["horizon", "fold"], skip_zero=True
    )
    return rounded(scores, **SCORES)


def _summary(v):
    return metrics.metrics_summary(v.oof, MODELS, ["series_id", "horizon", "fold"])


@query(
    "metrics_summary",
    with_ctes(
        """SELECT series_id, horizon, fold, model, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
                  round(mape, 6) AS mape FROM summary"""
    ),
)
def metrics_summary(v):
    return rounded(_summary(v), **SCORES)


@query("metrics_mean", with_ctes("SELECT horizon, model, rmse, mae, mape FROM means"))
def metrics_mean(v):
    return metrics.metrics_mean(_summary(v))


@query(
    "best_model",
    with_ctes(
        "SELECT horizon, arg_min(model, mape) AS model, min(mape) AS mape FROM means GROUP BY horizon"
    ),
)
def best_model(v):
    return metrics.best_model(metrics.metrics_mean(_summary(v)))


@query(
    "metrics_crosstab",
    with_ctes(
        """SELECT horizon, round(max(mape) FILTER (WHERE model = 'last'), 2) AS last,
                  round(max(mape) FILTER (WHERE model = 'ma7'), 2) AS ma7,
                  CAST(NULL AS DOUBLE) AS boosted
           FROM means GROUP BY horizon"""
    ),
)
def metrics_crosstab(v):
    return metrics.metrics_crosstab(
        metrics.metrics_mean(_summary(v)), ["last", "ma7", "boosted"]
    )


@query("distinct_horizons", with_ctes("SELECT DISTINCT horizon, model FROM summary ORDER BY 1, 2"))
def distinct_horizons(v):
    return metrics.distinct_sorted(_summary(v), ["horizon", "model"])


_LABELS = ", ".join(f"'{m}'" for m in MONTH_LABELS)


@query(
    "seasonal_error",
    with_ctes(
        f"""SELECT CAST(m.month AS INTEGER) AS month, ([{_LABELS}])[m.month] AS label,
                   round(e.abs_error, 6) AS abs_error, round(e.pct_error, 6) AS pct_error
            FROM (SELECT unnest(generate_series(1, 12)) AS month) m
            LEFT JOIN (SELECT month(date) AS month, avg(abs(y_true - baseline_last)) AS abs_error,
                              avg(abs(y_true - baseline_last) / (abs(y_true) + 1e-8) * 100) AS pct_error
                       FROM oof WHERE horizon = 15 AND date >= DATE '2000-10-01' GROUP BY 1) e
              ON e.month = m.month"""
    ),
)
def seasonal_error(v):
    rows = v.oof.where((F.col("horizon") == 15) & (F.col("date") >= F.lit("2000-10-01").cast("date")))
    return rounded(metrics.seasonal_error(rows, p="baseline_last"), abs_error=6, pct_error=6)


@query(
    "tolerance_status",
    with_ctes(
        """SELECT b.horizon, 'ma7' AS model, round(b.mape, 6) AS mape_before, round(a.mape, 6) AS mape_after,
                  round(a.mape - b.mape, 6) AS delta,
                  CASE WHEN b.horizon IN (1, 7) THEN 2.0::DOUBLE ELSE 5.0::DOUBLE END AS tolerance,
                  CASE WHEN a.mape - b.mape <= CASE WHEN b.horizon IN (1, 7) THEN 2 ELSE 5 END
                       THEN 'ok' ELSE 'degradou' END AS status
           FROM (SELECT horizon, avg(abs((y_true - baseline_last) / y_true)) * 100 AS mape FROM oof GROUP BY 1) b
           JOIN (SELECT horizon, avg(abs((y_true - baseline_ma7) / y_true)) * 100 AS mape FROM oof GROUP BY 1) a
             ON a.horizon = b.horizon"""
    ),
)
def tolerance_status(v):
    """The moving mean in the role of the recalibrated forecast."""
    def scored(column):
        return metrics.error_metrics(v.oof, p=column, keys=["horizon"], skip_zero=True).withColumn(
            "model", F.lit("ma7")
        )

    out = metrics.tolerance_status(scored("baseline_last"), scored("baseline_ma7"))
    return rounded(out, mape_before=6, mape_after=6, delta=6)


@query(
    "residuals",
    with_ctes(
        "SELECT series_id, horizon, date, y_true, baseline_last, y_true - baseline_last AS residual FROM oof"
    ),
)
def residuals(v):
    rows = v.oof.select("series_id", "horizon", "date", "y_true", "baseline_last")
    return spread.residuals(rows, p="baseline_last")


@query(
    "value_range",
    with_ctes(
        """SELECT horizon, round(least(min(y_true), min(baseline_ma7)), 6) AS lo,
                  round(greatest(max(y_true), max(baseline_ma7)), 6) AS hi
           FROM oof GROUP BY horizon"""
    ),
)
def value_range(v):
    return rounded(spread.value_range(v.oof, ["horizon"], p="baseline_ma7"), lo=6, hi=6)


_EDGES = [float(e) for e in PRICE_BANDS]


@query(
    "price_band_counts",
    with_ctes(
        f"""SELECT h.horizon, s.source, CAST(b.band AS INTEGER) AS band, b.lo, b.hi,
                   (SELECT count(*) FROM (
                        SELECT horizon, 'y_true' AS source, y_true AS x FROM oof
                        UNION ALL SELECT horizon, 'baseline_last', baseline_last FROM oof) o
                    WHERE o.horizon = h.horizon AND o.source = s.source
                      AND o.x >= b.lo AND o.x < b.hi) AS n
            FROM (SELECT DISTINCT horizon FROM oof) h
            CROSS JOIN (SELECT unnest(['y_true', 'baseline_last']) AS source) s
            CROSS JOIN (SELECT unnest([{", ".join(str(i) for i in range(len(_EDGES) - 1))}]) AS band,
                               unnest({_EDGES[:-1]}::DOUBLE[]) AS lo, unnest({_EDGES[1:]}::DOUBLE[]) AS hi) b"""
    ),
)
def price_band_counts(v):
    return spread.price_band_counts(v.oof, ["y_true", "baseline_last"], ["horizon"])


_RESIDUALS = "(SELECT horizon, y_true - baseline_last AS residual FROM oof)"


@query(
    "residual_histogram",
    with_ctes(
        f"""SELECT e.horizon, CAST(e.bin AS INTEGER) AS bin,
                   round(e.lo + (e.hi - e.lo) / 30 * e.bin, 6) AS lo,
                   round(e.lo + (e.hi - e.lo) / 30 * (e.bin + 1), 6) AS hi,
                   coalesce(c.n, 0) AS n,
                   round(coalesce(c.n, 0) / (e.n * ((e.hi - e.lo) / 30)), 9) AS density
            FROM (SELECT horizon, min(residual) AS lo, max(residual) AS hi, count(*) AS n,
                         unnest(generate_series(0, 29)) AS bin FROM {_RESIDUALS} r GROUP BY horizon) e
            LEFT JOIN (SELECT r.horizon,
                              least(CAST(floor((residual - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin,
                              count(*) AS n
                       FROM {_RESIDUALS} r
                       JOIN (SELECT horizon, min(residual) AS lo, max(residual) AS hi
                             FROM {_RESIDUALS} q GROUP BY horizon) m ON m.horizon = r.horizon
                       GROUP BY 1, 2) c ON c.horizon = e.horizon AND c.bin = e.bin"""
    ),
)
def residual_histogram(v):
    rows = spread.residuals(v.oof, p="baseline_last")
    return rounded(spread.histogram(rows, "residual", ["horizon"]), lo=6, hi=6, density=9)


@query(
    "density_grid",
    with_ctes(
        """SELECT o.horizon,
                  least(CAST(floor((y_true - y0) / ((y1 - y0) / 40)) AS INTEGER), 39) AS cell_x,
                  least(CAST(floor((baseline_last - p0) / ((p1 - p0) / 40)) AS INTEGER), 39) AS cell_y,
                  count(*) AS n, round(log10(count(*)), 9) AS log_n
           FROM oof o JOIN (SELECT horizon, min(y_true) AS y0, max(y_true) AS y1,
                                   min(baseline_last) AS p0, max(baseline_last) AS p1
                            FROM oof GROUP BY horizon) m ON m.horizon = o.horizon
           GROUP BY 1, 2, 3"""
    ),
)
def density_grid(v):
    return rounded(spread.density_grid(v.oof, ["horizon"], p="baseline_last"), log_n=9)


@query(
    "density_hexagons",
    # Brute force: the nearest of all centres around a point, on both lattices.
    with_ctes(
        """SELECT horizon, cell_x, cell_y, count(*) AS n, round(log10(count(*)), 9) AS log_n
           FROM (SELECT arg_min(cx, far) AS cell_x, arg_min(cy, far) AS cell_y, any_value(horizon) AS horizon
                 FROM (SELECT id, horizon, x, y, floor(x) + i AS cx, floor(y) + j AS cy,
                              (x - floor(x) - i) ** 2 + 3 * (y - floor(y) - j) ** 2 AS far
                       FROM placed
                       CROSS JOIN (SELECT unnest([0, 0, 1, 1, 0.5])::DOUBLE AS i,
                                          unnest([0, 1, 0, 1, 0.5])::DOUBLE AS j) c) f
                 GROUP BY id) h
           GROUP BY horizon, cell_x, cell_y""",
        placed="""
            SELECT row_number() OVER () AS id, o.horizon, (y_true - y0) / (y1 - y0) * 40 AS x,
                   (baseline_last - p0) / (p1 - p0) * 23 AS y
            FROM oof o JOIN (SELECT horizon, min(y_true) AS y0, max(y_true) AS y1,
                                    min(baseline_last) AS p0, max(baseline_last) AS p1
                             FROM oof GROUP BY horizon) m ON m.horizon = o.horizon""",
    ),
)
def density_hexagons(v):
    grid = spread.density_grid(v.oof, ["horizon"], p="baseline_last", shape="hexagon")
    return rounded(grid, log_n=9)


_CUSTOMER_ORDERS = """
    SELECT o_custkey, y_true, y_pred FROM (
        SELECT o_custkey, o_totalprice / 997.3021837::DOUBLE AS y_true,
               lag(o_totalprice / 997.3021837::DOUBLE) OVER (
                   PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS y_pred
        FROM orders) t
    WHERE y_pred IS NOT NULL"""


def _customer_orders(v):
    """Every order of a customer, forecast by the customer's order before it."""
    before = F.lag("y_true").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = v.table("orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", (F.col("o_totalprice") / UNIT).alias("y_true")
    )
    known = orders.select("o_custkey", "y_true", before.alias("y_pred")).where("y_pred is not null")
    return store.cut_lineage(known, "customer-orders")


@query(
    "histogram_by_customer",
    with_ctes(
        """SELECT e.o_custkey, CAST(e.bin AS INTEGER) AS bin, round(e.lo + (e.hi - e.lo) / 8 * e.bin, 6) AS lo,
                  round(e.lo + (e.hi - e.lo) / 8 * (e.bin + 1), 6) AS hi, coalesce(c.n, 0) AS n,
                  CASE WHEN e.hi > e.lo
                       THEN round(coalesce(c.n, 0) / (e.n * ((e.hi - e.lo) / 8)), 9) END AS density
           FROM (SELECT o_custkey, min(y_true - y_pred) AS lo, max(y_true - y_pred) AS hi, count(*) AS n,
                        unnest(generate_series(0, 7)) AS bin FROM per_customer GROUP BY o_custkey) e
           LEFT JOIN (SELECT p.o_custkey,
                             CASE WHEN hi > lo THEN least(CAST(floor((y_true - y_pred - lo) / ((hi - lo) / 8)) AS INTEGER), 7)
                                  ELSE 0 END AS bin, count(*) AS n
                      FROM per_customer p
                      JOIN (SELECT o_custkey, min(y_true - y_pred) AS lo, max(y_true - y_pred) AS hi
                            FROM per_customer GROUP BY o_custkey) m ON m.o_custkey = p.o_custkey
                      GROUP BY 1, 2) c ON c.o_custkey = e.o_custkey AND c.bin = e.bin""",
        per_customer=_CUSTOMER_ORDERS,
    ),
)
def histogram_by_customer(v):
    """A histogram for every customer: as many groups as customers, met in a shuffled join."""
    rows = spread.residuals(_customer_orders(v))
    return rounded(spread.histogram(rows, "residual", ["o_custkey"], 8), lo=6, hi=6, density=9)


_MARKS = [k * (1.0 / 12) for k in range(12)] + [1.0]
_LOW = "sorted[CAST(floor(m * (n - 1)) AS BIGINT) + 1]"
_HIGH = "sorted[CAST(least(floor(m * (n - 1)) + 1, n - 1) AS BIGINT) + 1]"
_PART = "(m * (n - 1) - floor(m * (n - 1)))"
_EDGE = f"""CASE WHEN {_PART} < 0.5 THEN {_LOW} + ({_HIGH} - {_LOW}) * {_PART}
                 ELSE {_HIGH} - ({_HIGH} - {_LOW}) * (1 - {_PART}) END"""


@query(
    "calibration_curve",
    with_ctes(
        f"""SELECT horizon, CAST(bin AS INTEGER) AS bin, round(edges[bin], 6) AS lo,
                  round(edges[bin + 1], 6) AS hi, round(avg(p), 6) AS mean_pred,
                  round(avg(y), 6) AS mean_true, count(*) AS n
           FROM (SELECT o.horizon, o.baseline_last AS p, o.y_true AS y, q.edges,
                        greatest(len(list_filter(q.edges, lambda e: e < o.baseline_last)), 1) AS bin
                 FROM oof o JOIN (
                    SELECT horizon, list_transform({_MARKS}::DOUBLE[], lambda m: {_EDGE}) AS edges
                    FROM (SELECT horizon, list_sort(list(baseline_last)) AS sorted, count(*) AS n
                          FROM oof GROUP BY horizon) s) q ON q.horizon = o.horizon) t
           GROUP BY horizon, bin, edges"""
    ),
)
def calibration_curve(v):
    curve = spread.calibration_curve(v.oof, ["horizon"], p="baseline_last")
    return rounded(curve, lo=6, hi=6, mean_pred=6, mean_true=6)


@query(
    "calibration_by_customer",
    with_ctes(
        f"""SELECT o_custkey, CAST(bin AS INTEGER) AS bin, round(edges[bin], 6) AS lo,
                  round(edges[bin + 1], 6) AS hi, round(avg(p), 6) AS mean_pred,
                  round(avg(y), 6) AS mean_true, count(*) AS n
           FROM (SELECT o.o_custkey, o.y_pred AS p, o.y_true AS y, q.edges,
                        greatest(len(list_filter(q.edges, lambda e: e < o.y_pred)), 1) AS bin
                 FROM per_customer o JOIN (
                    SELECT o_custkey,
                           list_sort(list_distinct(
                               list_transform({[0.0, 0.25, 0.5, 0.75, 1.0]}::DOUBLE[], lambda m: {_EDGE}))) AS edges
                    FROM (SELECT o_custkey, list_sort(list(y_pred)) AS sorted, count(*) AS n
                          FROM per_customer GROUP BY o_custkey) s) q ON q.o_custkey = o.o_custkey) t
           GROUP BY o_custkey, bin, edges""",
        per_customer=_CUSTOMER_ORDERS,
    ),
)
def calibration_by_customer(v):
    """Quartile bins of the forecasts for every customer."""
    curve = spread.calibration_curve(_customer_orders(v), ["o_custkey"], bins=4)
    return rounded(curve, lo=6, hi=6, mean_pred=6, mean_true=6)


@query(
    "residual_normal",
    with_ctes(
        f"""SELECT horizon, CAST(point AS INTEGER) AS point, round(mean, 6) AS mean, round(std, 6) AS std,
                   round(x, 6) AS x,
                   round(exp(-0.5 * ((x - mean) / std) ** 2) / (std * sqrt(2 * pi())), 9) AS density
            FROM (SELECT horizon, mean, std, point,
                         lo - (hi - lo) * 0.05 + (hi - lo) * 1.1 / 99 * point AS x
                  FROM (SELECT horizon, avg(residual) AS mean, stddev_pop(residual) AS std,
                               min(residual) AS lo, max(residual) AS hi,
                               unnest(generate_series(0, 99)) AS point
                        FROM {_RESIDUALS} r GROUP BY horizon) s) g"""
    ),
)
def residual_normal(v):
    rows = spread.residuals(v.oof, p="baseline_last")
    out = spread.residual_normal(rows, ["horizon"])
    return rounded(out, mean=6, std=6, x=6, density=9)


def _poly(x, highest_first):
    text = f"({highest_first[0]!r}::DOUBLE)"
    for factor in highest_first[1:]:
        text = f"({text} * {x} + ({factor!r}::DOUBLE))"
    return text


_TAIL = f"({_poly('d', normal.PROBIT_TAIL_TOP)} / {_poly('d', normal.PROBIT_TAIL_BOTTOM)})"
_CENTRE = f"({_poly('s', normal.PROBIT_CENTRE_TOP)} * (p - 0.5) / {_poly('s', normal.PROBIT_CENTRE_BOTTOM)})"
_QQ = f"""(SELECT horizon, place, ordered,
                  CASE WHEN p < 0.02425 THEN {_TAIL} WHEN p > 0.97575 THEN -{_TAIL} ELSE {_CENTRE} END
                      AS theoretical
           FROM (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS d, (p - 0.5) * (p - 0.5) AS s
                 FROM (SELECT *, CASE WHEN place = n THEN 0.5 ** (1.0::DOUBLE / n)
                                      WHEN place = 1 THEN 1 - 0.5 ** (1.0::DOUBLE / n)
                                      ELSE (place - 0.3175) / (n + 0.365) END AS p
                       FROM (SELECT horizon, residual AS ordered, count(*) OVER (PARTITION BY horizon) AS n,
                                    row_number() OVER (PARTITION BY horizon ORDER BY residual) AS place
                             FROM {_RESIDUALS} r) a) b) c)"""


@query(
    "qq_points",
    with_ctes(
        f"SELECT horizon, place, round(theoretical, 6) AS theoretical, ordered FROM {_QQ} q"
    ),
)
def qq_points(v):
    rows = spread.residuals(v.oof, p="baseline_last")
    return rounded(spread.qq_points(rows, ["horizon"]), theoretical=6)


@query(
    "qq_line",
    with_ctes(
        f"""SELECT horizon, round(regr_slope(ordered, theoretical), 6) AS slope,
                   round(regr_intercept(ordered, theoretical), 6) AS intercept,
                   round(corr(ordered, theoretical), 6) AS r
            FROM {_QQ} q GROUP BY horizon"""
    ),
)
def qq_line(v):
    rows = spread.residuals(v.oof, p="baseline_last")
    line = spread.qq_line(spread.qq_points(rows, ["horizon"]), ["horizon"])
    return rounded(line, slope=6, intercept=6, r=6)


@query(
    "shift_forecasts",
    with_ctes(
        """SELECT series_id, horizon, CAST(date + CAST(horizon AS INTEGER) AS DATE) AS date, baseline_last
           FROM oof"""
    ),
)
def shift_forecasts(v):
    return shift_to_target_date(v.oof.select("series_id", "horizon", "date", "baseline_last"))


@query(
    "forecast_vs_actual",
    with_ctes(
        f"""SELECT series_id, date, max(actual) AS actual,
                   {", ".join(f"max(p) FILTER (WHERE horizon = {h}) AS h{h}" for h in HORIZONS)}
            FROM (SELECT series_id, date, price_a AS actual, NULL AS horizon, NULL::DOUBLE AS p
                  FROM daily WHERE date >= DATE '2001-03-01'
                  UNION ALL
                  SELECT series_id, CAST(date + CAST(horizon AS INTEGER) AS DATE) AS d, NULL, horizon, baseline_last
                  FROM oof
                  WHERE CAST(date + CAST(horizon AS INTEGER) AS DATE) >= DATE '2001-03-01') u
            GROUP BY series_id, date"""
    ),
)
def forecast_vs_actual_report(v):
    return forecast_vs_actual(
        v.daily_price, v.oof, "2001-03-01", list(HORIZONS), prediction="baseline_last"
    )


@query(
    "column_medians",
    with_ctes(
        """SELECT product AS feature, round(quantile_cont(quote, 0.5), 8) AS median
           FROM first_quotes GROUP BY product"""
    ),
)
def column_medians(v):
    return rounded(relevance.column_medians(v.sparse_prices, list(PRICE_COLUMNS)), median=8)


@query(
    "line_medians",
    """SELECT feature, round(quantile_cont(x, 0.5), 8) AS median FROM (
           SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem
           UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
           UNION ALL SELECT 'l_discount', l_discount FROM lineitem) t GROUP BY feature""",
)
def line_medians(v):
    """Medians of raw columns with any number of rows, and with few distinct values."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(relevance.column_medians(v.table("lineitem"), names), median=8)


@query(
    "median_impute",
    with_ctes(
        "SELECT series_id, date, "
        + ", ".join(
            f"""round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM sparse_prices
                                     WHERE date <= DATE '1998-12-31')), 8) AS {c}"""
            for c in PRICE_COLUMNS
        )
        + " FROM sparse_prices"
    ),
)
def median_impute(v):
    """Medians come from the training rows only and fill all rows."""
    train = v.sparse_prices.where(F.col("date") <= F.lit("1998-12-31").cast("date"))
    filled = relevance.impute_medians(v.sparse_prices, list(PRICE_COLUMNS), fit_on=train)
    return rounded(filled, **{c: 8 for c in PRICE_COLUMNS})


_SPEARMAN_FEATURES = ["price_b", "price_c", "price_b_lag7d", "price_c_lag30d", "price_b_ma30d", "month"]
_FILLED = ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM spearman_rows)) AS {c}" for c in _SPEARMAN_FEATURES
)
# The incomplete beta function of (b, 1/2) at 1 - rho^2, as a series from the log gamma function.
_SERIES = """list_sum(list_transform(range(0, 600), lambda k: exp(
    lgamma(b + 0.5 + k) - lgamma(b + 0.5) - lgamma({c} + k) + lgamma({c}) + k * ln({x}))))"""
_FRONT = "exp(b * ln(1 - rho * rho) + ln(abs(rho)) + lgamma(b + 0.5) - lgamma(b) - lgamma(0.5::DOUBLE))"
_TAIL_AREA = f"""CASE WHEN -b * ln(1 - rho * rho) > 40 THEN 0
    WHEN rho * rho > 0.5 THEN {_FRONT} / b * {_SERIES.format(c="(b + 1)", x="(1 - rho * rho)")}
    ELSE greatest(1 - 2 * {_FRONT} * {_SERIES.format(c="(1.5::DOUBLE)", x="(rho * rho)")}, 0) END"""


@query(
    "spearman_rank",
    with_ctes(
        f"""SELECT feature, round(rho, 6) AS rho, round(p_value, 6) AS p_value,
                   round(abs(rho), 6) AS abs_rho,
                   CASE WHEN p_value < 0.05 THEN 'Sim' ELSE 'Nao' END AS significant
            FROM (SELECT feature, rho, {_TAIL_AREA} AS p_value
                  FROM (SELECT feature, corr(rx, ry) AS rho, (count(*) - 2) / 2.0::DOUBLE AS b
                        FROM spearman_ranks GROUP BY feature) a) d
            ORDER BY abs(rho) DESC, feature LIMIT 20""",
        spearman_rows=f"""
            SELECT * FROM (
                SELECT series_id, date, price_b, price_c, CAST(month(date) AS DOUBLE) AS month,
                       lag(price_b, 7) OVER w AS price_b_lag7d, lag(price_c, 30) OVER w AS price_c_lag30d,
                       round(avg(price_b) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS price_b_ma30d,
                       lead(price_a, 7) OVER w AS target_h7d
                FROM prices WINDOW w AS (PARTITION BY series_id ORDER BY date)) t
            WHERE target_h7d IS NOT NULL""",
        spearman_cells=f"""
            SELECT target_h7d, unnest({_SPEARMAN_FEATURES}) AS feature,
                   unnest([{", ".join(_SPEARMAN_FEATURES)}]) AS v
            FROM (SELECT target_h7d, {_FILLED} FROM spearman_rows) f""",
        spearman_ranks="""
            SELECT feature,
                   rank() OVER (PARTITION BY feature ORDER BY v)
                       + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rx,
                   rank() OVER (PARTITION BY feature ORDER BY target_h7d)
                       + (count(*) OVER (PARTITION BY feature, target_h7d) - 1) / 2 AS ry
            FROM spearman_cells""",
    ),
)
def spearman_rank(v):
    panel = v.price_panel
    table = features.with_columns(
        panel,
        features.lag_columns(["price_b"], (7,)),
        features.lag_columns(["price_c"], (30,)),
        features.mean_columns(["price_b"], (30,)),
        {"month": F.month("date").cast("double")},
        features.target_columns(horizons=(7,)),
    )
    out = relevance.spearman(
        rounded(table, price_b_ma30d=6), _SPEARMAN_FEATURES, "target_h7d", ["series_id", "date"]
    )
    return rounded(out, rho=6, p_value=6, abs_rho=6)


_ATTRIBUTIONS = {
    "l_quantity": ("l_quantity", 25.0, 0.01),
    "l_discount": ("l_discount", 0.05, 1.0),
    "l_tax": ("l_tax", 0.04, 2.0),
}
_ATTRIBUTION_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, ({c} - {m}) * {w} AS attribution FROM lineitem"
    for name, (c, m, w) in _ATTRIBUTIONS.items()
)


def _attributions(v):
    """A long table of per-row contributions: centred and weighted columns of the items."""
    return v.table("lineitem").select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("feature"), ((F.col(c) - m) * w).alias("attribution"))
                    for name, (c, m, w) in _ATTRIBUTIONS.items()
                ]
            )
        )
    )


@query(
    "attribution_rank",
    f"""SELECT feature, round(avg(abs(attribution)), 6) AS mean_abs FROM ({_ATTRIBUTION_SQL}) t
        GROUP BY feature ORDER BY avg(abs(attribution)) DESC, feature LIMIT 15""",
)
def attribution_rank(v):
    return rounded(relevance.attribution_rank(_attributions(v)), mean_abs=6)


@query(
    "top_features",
    f"""SELECT feature, round(avg(abs(attribution)), 6) AS importance FROM ({_ATTRIBUTION_SQL}) t
        GROUP BY feature ORDER BY 2 DESC, feature LIMIT 2""",
)
def top_features(v):
    scores = _attributions(v).groupBy("feature").agg(
        F.round(F.avg(F.abs("attribution")), 6).alias("importance")
    )
    return relevance.top_features(scores, n=2)


@query(
    "hash_sample",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY ((o_orderkey % 2147483648) * 2654435761 + 42) % 4294967296, o_orderkey LIMIT 500""",
)
def hash_sample(v):
    return relevance.hash_sample(v.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
