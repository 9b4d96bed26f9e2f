"""Scans, parsing, sinks and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.sql import CUTOFF, END, START, with_ctes
from seriesloom.catalog.views import HEAD_LABEL, WEIGHT_LABEL
from seriesloom.functions.dates import quarter_month
from seriesloom.operators import combine, tidy
from seriesloom.operators.calendar import asof_daily
from seriesloom.operators.features import lag_columns, with_columns
from seriesloom.plans.reports import inspection_table
from seriesloom.session import scratch_dir
from seriesloom.settings import PRICE_COLUMNS
from seriesloom.sources import grid, payloads, quotes, store

ROWS_PER_PAYLOAD = 500


@query(
    "scan_quotes",
    with_ctes("SELECT series_id, product, ingest_order, date, quote FROM quotes"),
)
def scan_quotes(v):
    raw = v.quotes
    lines = raw.select(
        "series_id", "product", "ingest_order",
        F.date_format("date", "dd/MM/yyyy").alias("date_text"),
        F.concat(F.lit("R$ "), F.translate(F.col("quote").cast("string"), ".", ",")).alias("value_text"),
    )
    preamble = raw.select("series_id", "product").distinct().select(
        "series_id", "product", F.lit(None).cast("long").alias("ingest_order"),
        F.inline(
            F.array(
                F.struct(F.lit("INDICADOR DE PREÇO").alias("date_text"), F.lit(None).cast("string").alias("value_text")),
                F.struct(F.lit("Data").alias("date_text"), F.lit("À vista R$").alias("value_text")),
            )
        ),
    )
    return quotes.parse_quotes(lines.unionByName(preamble))


def _quarterly_payloads(v):
    """One response per variable: a header object, then a record per month."""
    months = v.line_months
    records = months.select(
        F.inline(
            F.array(
                F.struct(F.lit(HEAD_LABEL).alias("D2N"), F.col("head_count").alias("value"), "month"),
                F.struct(F.lit(WEIGHT_LABEL).alias("D2N"), F.col("weight").alias("value"), "month"),
            )
        )
    )
    text = F.translate(F.col("value").cast("decimal(20,1)").cast("string"), ".", ",")
    typed = records.select(
        "D2N",
        F.struct(
            F.concat(F.year("month"), F.lpad(F.quarter("month").cast("string"), 2, "0")).alias("D3C"),
            F.concat(F.lit("No "), F.pmod(F.month("month") - 1, F.lit(3)) + 1, F.lit("º mês")).alias("D4N"),
            "D2N",
            F.when(F.month("month") == 2, F.lit("-")).when(F.month("month") == 5, F.lit("...")).otherwise(text).alias("V"),
        ).alias("record"),
    )
    header = F.struct(
        F.lit("Trimestre (Código)").alias("D3C"), F.lit("Referência temporal").alias("D4N"),
        F.lit("Variável").alias("D2N"), F.lit("Valor").alias("V"),
    )
    return typed.groupBy("D2N").agg(F.sort_array(F.collect_list("record")).alias("records")).select(
        F.to_json(F.concat(F.array(header), "records")).alias("payload")
    )


@query(
    "scan_quarterly_json",
    with_ctes(
        """SELECT month, 'head_count' AS variable, head_count AS value FROM line_months
           WHERE month(month) NOT IN (2, 5)
           UNION ALL
           SELECT month, 'weight', weight FROM line_months WHERE month(month) NOT IN (2, 5)"""
    ),
)
def scan_quarterly_json(v):
    return payloads.parse_quarterly(_quarterly_payloads(v)).select(
        "month", payloads.canonical_label().alias("variable"), "value"
    )


@query(
    "pivot_quarterly",
    with_ctes("SELECT month, head_count, weight FROM line_months WHERE month(month) NOT IN (2, 5)"),
)
def pivot_quarterly(v):
    return payloads.pivot_quarterly(payloads.parse_quarterly(_quarterly_payloads(v)))


@query(
    "quarter_to_month",
    with_ctes(
        """SELECT CAST(year(month) AS VARCHAR) || lpad(CAST(quarter(month) AS VARCHAR), 2, '0') AS period,
                  'No ' || CAST((month(month) - 1) % 3 + 1 AS VARCHAR) || 'º mês' AS ordinal, month
           FROM line_months"""
    ),
)
def quarter_to_month(v):
    codes = v.line_months.select(
        F.concat(F.year("month"), F.lpad(F.quarter("month").cast("string"), 2, "0")).alias("period"),
        F.concat(F.lit("No "), F.pmod(F.month("month") - 1, F.lit(3)) + 1, F.lit("º mês")).alias("ordinal"),
    )
    return codes.select(
        "period", "ordinal", quarter_month(F.col("period"), F.col("ordinal")).alias("month")
    )


def _trade_payloads(v):
    """One response per year; metrics are text and one of them is not a number."""
    bad = (F.col("heading") == "N") & (F.month("month") == 3)
    records = v.trade_records.select(
        F.year("month").alias("year"),
        F.struct(
            F.year("month").cast("string").alias("year"),
            F.month("month").cast("string").alias("monthNumber"),
            "heading",
            F.col("trade_value").cast("string").alias("metricFOB"),
            F.when(bad, F.lit("n/d")).otherwise(F.col("trade_qty").cast("string")).alias("metricKG"),
        ).alias("record"),
    )
    return records.groupBy("year").agg(F.collect_list("record").alias("list")).select(
        F.to_json(F.struct(F.struct("list").alias("data"))).alias("payload")
    )


TRADE_QTY = "CASE WHEN heading = 'N' AND month(month) = 3 THEN 0 ELSE trade_qty END"


@query(
    "scan_trade_json",
    with_ctes(f"SELECT month, heading, trade_value, CAST({TRADE_QTY} AS DOUBLE) AS trade_qty FROM trade"),
)
def scan_trade_json(v):
    return payloads.parse_trade(_trade_payloads(v))


@query(
    "trade_monthly",
    with_ctes(
        f"""SELECT month, round(sum(trade_value), 2) AS trade_value, sum({TRADE_QTY}) AS trade_qty
            FROM trade GROUP BY month"""
    ),
)
def trade_monthly(v):
    monthly = payloads.parse_trade(_trade_payloads(v)).groupBy("month").agg(
        F.sum("trade_value").alias("trade_value"), F.sum("trade_qty").alias("trade_qty")
    )
    return rounded(monthly, trade_value=2)


@query(
    "trade_union_sum",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
              round(sum(l_extendedprice), 2) AS trade_value, sum(l_quantity) AS trade_qty
       FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1""",
)
def trade_union_sum(v):
    def part(flag):
        return v.table("lineitem").where(F.col("l_returnflag") == flag).groupBy(
            F.trunc(F.to_date("l_shipdate"), "MM").alias("month")
        ).agg(F.sum("l_extendedprice").alias("trade_value"), F.sum("l_quantity").alias("trade_qty"))

    parts = [part(flag) for flag in ("A", "N", "R")]
    return rounded(combine.sum_parts(parts, ["month"], ["trade_value", "trade_qty"]), trade_value=2)


@query(
    "scan_fx_json",
    with_ctes(
        """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, CAST(ts AS DATE) AS date, fx
           FROM fx_bulletins"""
    ),
)
def scan_fx_json(v):
    """Responses hold at most 500 bulletins each, cut by id, so none grows with the data."""
    responses = v.fx_bulletins.groupBy(F.floor(F.col("ord") / ROWS_PER_PAYLOAD).alias("part")).agg(
        F.collect_list(
            F.struct(
                F.col("fx").alias("cotacaoVenda"),
                F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("dataHoraCotacao"),
            )
        ).alias("value")
    ).select(F.to_json(F.struct("value")).alias("payload"))
    return payloads.parse_rates(responses).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"),
        F.to_date("ts").alias("date"),
        "fx",
    )


@query(
    "fx_last_per_day",
    with_ctes(
        """SELECT CAST(ts AS DATE) AS date, arg_max(fx, ord) FILTER (WHERE fx IS NOT NULL) AS fx
           FROM fx_bulletins GROUP BY 1"""
    ),
)
def fx_last_per_day(v):
    bulletins = v.fx_bulletins.select(F.to_date("ts").alias("date"), "ord", "fx")
    return tidy.last_known_per_key(bulletins, ["date"], "fx", ["ord"])


@query("scan_inflation_json", with_ctes("SELECT month, round(pct, 9) AS pct FROM line_months"))
def scan_inflation_json(v):
    responses = v.inflation_pct.groupBy(F.year("month").alias("year")).agg(
        F.collect_list(
            F.struct(
                F.date_format("month", "dd/MM/yyyy").alias("data"),
                F.col("pct").cast("string").alias("valor"),
            )
        ).alias("rows")
    ).select(F.to_json("rows").alias("payload"))
    return rounded(payloads.parse_inflation(responses), pct=9)


@query("grid_monthly_mean", with_ctes("SELECT time, round(avg(tp) * 1000, 6) AS rain_mm FROM grid GROUP BY time"))
def grid_monthly_mean(v):
    return rounded(grid.grid_mean(v.precip_grid), rain_mm=6)


@query("cache_roundtrip", with_ctes("SELECT series_id, date, price_a, price_b, price_c FROM prices"))
def cache_roundtrip(v):
    path = scratch_dir(v.spark, "panel")
    return store.cached_table(v.spark, path, lambda: v.price_panel)


@query(
    "csv_roundtrip",
    with_ctes("SELECT series_id, date, quote FROM dense_quotes"),
)
def csv_roundtrip(v):
    path = scratch_dir(v.spark, "csv")
    store.write_csv(v.dense_quotes, path)
    schema = T.StructType(
        [
            T.StructField("series_id", T.StringType()),
            T.StructField("date", T.DateType()),
            T.StructField("quote", T.DoubleType()),
        ]
    )
    return store.read_csv(v.spark, path, schema)


DISPLAY = {
    "price_a": "Price A (per unit)",
    "price_b": "Price B (per head)",
    "price_c": "Price C (per sack)",
    "price_index": "Price index",
}


@query(
    "inspection_table",
    with_ctes(
        """SELECT series_id, p.date AS date, p.price_a AS "Price A (per unit)",
                  p.price_b AS "Price B (per head)", p.price_c AS "Price C (per sack)",
                  m.price_index AS "Price index"
           FROM prices p LEFT JOIN macro_now m ON m.date = p.date"""
    ),
)
def inspection(v):
    months = v.sources["months"].frame.select("date", "price_index")
    daily_index = asof_daily(
        months.withColumn("series_id", F.lit("")), START, END, ["price_index"]
    ).drop("series_id")
    return inspection_table(
        v.price_panel, F.broadcast(daily_index), DISPLAY, ["date"]
    )


@query(
    "describe_series",
    with_ctes(
        """SELECT series_id, variable, count(v) AS n, round(avg(v), 2) AS mean,
                  round(stddev_samp(v), 2) AS std, round(min(v), 2) AS min,
                  round(quantile_cont(v, 0.25), 2) AS q25, round(quantile_cont(v, 0.5), 2) AS q50,
                  round(quantile_cont(v, 0.75), 2) AS q75, round(max(v), 2) AS max
           FROM (SELECT series_id, product AS variable, v FROM price_values) t GROUP BY 1, 2"""
    ),
)
def describe_series(v):
    return tidy.describe_series(v.price_panel, list(PRICE_COLUMNS))


@query(
    "price_stats",
    with_ctes(
        """SELECT series_id, product AS variable, min(v) AS min_value, max(v) AS max_value,
                  round(avg(v), 6) AS mean_value, count(*) FILTER (WHERE v IS NULL) AS n_missing
           FROM price_values GROUP BY 1, 2"""
    ),
)
def price_stats(v):
    return rounded(tidy.price_stats(v.price_panel, list(PRICE_COLUMNS)), mean_value=6)


@query(
    "numeric_filter",
    "SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_orderkey % 7 NOT IN (0, 1)",
)
def numeric_filter(v):
    """Price text with decimal commas, and two kinds of missing markers among the rows."""
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    kind = F.pmod("o_orderkey", F.lit(7))
    raw = v.table("orders").select(
        "o_orderkey",
        F.when(kind == 0, F.lit("-"))
        .when(kind == 1, F.lit("..."))
        .when(kind == 2, F.translate(price, ".", ","))
        .otherwise(price)
        .alias("value_text"),
    )
    return payloads.numeric_rows(raw)


@query(
    "dedupe_first",
    with_ctes(
        """SELECT series_id, date, product, arg_min(quote, ingest_order) AS quote,
                  min(ingest_order) AS ingest_order
           FROM quotes GROUP BY series_id, date, product"""
    ),
)
def dedupe_first(v):
    return tidy.dedupe_first(v.quotes, ["series_id", "date", "product"], "ingest_order")


@query(
    "duplicate_count",
    with_ctes(
        """SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_kept,
                  CAST(sum(n) - count(*) AS BIGINT) AS rows_removed
           FROM (SELECT count(*) AS n FROM quotes GROUP BY series_id, date, product) t"""
    ),
)
def duplicate_count(v):
    return tidy.duplicate_count(v.quotes, ["series_id", "date", "product"])


@query(
    "date_slice",
    with_ctes(
        """SELECT series_id, date, quote FROM dense_quotes
           WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"""
    ),
)
def date_slice(v):
    return tidy.date_slice(v.dense_quotes, "1996-01-01", "1997-06-30")


BOUNDS = {"price_a": (50.0, 450.0), "price_b": (20.0, 480.0), "rain_mm": (39.0, 41.0)}


@query(
    "domain_bounds",
    with_ctes(
        """SELECT p.series_id, p.date,
                  CASE WHEN price_a BETWEEN 50 AND 450 THEN price_a END AS price_a,
                  CASE WHEN price_b BETWEEN 20 AND 480 THEN price_b END AS price_b, price_c
           FROM sparse_prices p"""
    ),
)
def domain_bounds(v):
    return tidy.domain_bounds(v.sparse_prices, BOUNDS)


@query(
    "bound_violations",
    with_ctes(
        """SELECT 'price_a' AS column_name, count(*) FILTER (WHERE price_a < 50) AS below,
                  count(*) FILTER (WHERE price_a > 450) AS above FROM sparse_prices
           UNION ALL
           SELECT 'price_b', count(*) FILTER (WHERE price_b < 20),
                  count(*) FILTER (WHERE price_b > 480) FROM sparse_prices"""
    ),
)
def bound_violations(v):
    return tidy.bound_violations(v.sparse_prices, BOUNDS)


@query(
    "holdout_split",
    with_ctes(
        f"""SELECT part, series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
            FROM (SELECT CASE WHEN date <= DATE '{CUTOFF}' THEN 'train' ELSE 'holdout' END AS part,
                         series_id, date FROM prices) t
            GROUP BY part, series_id"""
    ),
)
def holdout_split(v):
    train, holdout = tidy.holdout_split(v.price_panel, CUTOFF)
    both = train.withColumn("part", F.lit("train")).unionByName(
        holdout.withColumn("part", F.lit("holdout"))
    )
    return both.groupBy("part", "series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "cutoff_guard",
    f"""SELECT CAST(max(o_orderdate) AS DATE) AS max_date,
               count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '{CUTOFF}') AS rows_past_cutoff
        FROM orders""",
)
def cutoff_guard(v):
    return tidy.cutoff_guard(v.table("orders").select(F.to_date("o_orderdate").alias("date")), CUTOFF)


@query(
    "missing_report",
    with_ctes(
        """SELECT column_name, count(*) FILTER (WHERE x IS NULL) AS n_missing,
                  round(count(*) FILTER (WHERE x IS NULL) / count(*) * 100, 2) AS pct_missing
           FROM (SELECT unnest(['price_a', 'price_b', 'price_c']) AS column_name,
                        unnest([price_a, price_b, price_c]) AS x FROM sparse_prices) t
           GROUP BY column_name"""
    ),
)
def missing_report(v):
    return tidy.missing_report(v.sparse_prices, list(PRICE_COLUMNS))


LAGS = (1, 7, 14, 21, 30, 60, 90)
_LAG_NAMES = [f"{c}_lag{k}d" for c in PRICE_COLUMNS for k in LAGS]
_LAG_SQL = ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_lag{k}d" for c in PRICE_COLUMNS for k in LAGS
)


@query(
    "most_missing_columns",
    with_ctes(
        f"""SELECT column_name, count(*) FILTER (WHERE x IS NULL) AS n_missing
            FROM (SELECT unnest([{", ".join(f"'{n}'" for n in _LAG_NAMES)}]) AS column_name,
                         unnest([{", ".join(_LAG_NAMES)}]) AS x
                  FROM (SELECT {_LAG_SQL} FROM prices
                        WINDOW w AS (PARTITION BY series_id ORDER BY date)) l) t
            GROUP BY column_name ORDER BY n_missing DESC, column_name LIMIT 15"""
    ),
)
def most_missing_columns(v):
    lagged = with_columns(v.price_panel, lag_columns(list(PRICE_COLUMNS)))
    return tidy.most_missing(lagged, _LAG_NAMES)


@query(
    "dataset_extent",
    with_ctes(
        """SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows,
                  count(DISTINCT series_id) AS n_series, CAST(5 AS INTEGER) AS n_columns
           FROM sparse_prices"""
    ),
)
def dataset_extent(v):
    return tidy.dataset_extent(v.sparse_prices)


@query(
    "preview_rows",
    with_ctes(
        """SELECT series_id, date, price_a, price_b, price_c FROM sparse_prices
           ORDER BY series_id, date LIMIT 10"""
    ),
)
def preview_rows(v):
    return tidy.preview(v.sparse_prices)


@query(
    "latest_complete_row",
    with_ctes(
        """SELECT a.series_id, a.as_of_date, c.date AS feature_date, c.price_a, c.price_b, c.price_c
           FROM (SELECT series_id, max(date) AS as_of_date FROM sparse_prices GROUP BY 1) a
           JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn
                 FROM sparse_prices
                 WHERE price_a IS NOT NULL AND price_b IS NOT NULL AND price_c IS NOT NULL) c
             ON c.series_id = a.series_id AND c.rn = 1"""
    ),
)
def latest_complete_row(v):
    return tidy.latest_complete_row(v.sparse_prices, list(PRICE_COLUMNS))
