"""SQL for the same views, as named common table expressions.

The checking engine runs these on the same Parquet files. They are written independently of
the Spark plans: as-of joins instead of `lead`, full joins instead of union and aggregate,
list functions instead of ranges.
"""

from __future__ import annotations

import re

START, END, BASE_MONTH, CUTOFF = "1995-01-01", "2001-08-01", "2000-12-01", "2001-03-31"

CTES: dict[str, str] = {
    "seg": """
        SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS date,
               o_orderpriority AS priority, o_orderkey AS ingest_order,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               o_totalprice / 997.3021837::DOUBLE AS quote
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "quotes": """
        SELECT series_id, date, ingest_order, quote,
               CASE priority WHEN '1-URGENT' THEN 'price_a' WHEN '2-HIGH' THEN 'price_b'
                             ELSE 'price_c' END AS product
        FROM seg WHERE priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "first_quotes": """
        SELECT series_id, date, product, arg_min(quote, ingest_order) AS quote
        FROM quotes GROUP BY series_id, date, product""",
    "sparse_prices": """
        SELECT series_id, date,
               max(CASE WHEN product = 'price_a' THEN quote END) AS price_a,
               max(CASE WHEN product = 'price_b' THEN quote END) AS price_b,
               max(CASE WHEN product = 'price_c' THEN quote END) AS price_c
        FROM first_quotes GROUP BY series_id, date""",
    "dense_quotes": """
        SELECT series_id, date, sum(cents)::DOUBLE / count(*) / 100 / 997.3021837::DOUBLE AS quote
        FROM seg GROUP BY series_id, date""",
    "days": f"""
        SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS date""",
    "price_days": """
        SELECT k.series_id, k.product, d.date,
               p.quote AS pv, p.date AS pd, n.quote AS nv, n.date AS nd
        FROM (SELECT DISTINCT series_id, product FROM first_quotes) k CROSS JOIN days d
        ASOF LEFT JOIN first_quotes p
          ON p.series_id = k.series_id AND p.product = k.product AND d.date >= p.date
        ASOF LEFT JOIN first_quotes n
          ON n.series_id = k.series_id AND n.product = k.product AND d.date <= n.date""",
    "price_values": """
        SELECT series_id, product, date,
               CASE WHEN pd IS NULL THEN NULL WHEN nd IS NULL OR nd = pd THEN pv
                    ELSE pv + (nv - pv) / date_diff('day', pd, nd) * date_diff('day', pd, date)
               END AS v
        FROM price_days""",
    "prices": """
        SELECT series_id, date,
               max(CASE WHEN product = 'price_a' THEN v END) AS price_a,
               max(CASE WHEN product = 'price_b' THEN v END) AS price_b,
               max(CASE WHEN product = 'price_c' THEN v END) AS price_c
        FROM price_values GROUP BY series_id, date""",
    "daily_days": """
        SELECT k.series_id, d.date, p.quote AS pv, p.date AS pd, n.quote AS nv, n.date AS nd
        FROM (SELECT DISTINCT series_id FROM dense_quotes) k CROSS JOIN days d
        ASOF LEFT JOIN dense_quotes p ON p.series_id = k.series_id AND d.date >= p.date
        ASOF LEFT JOIN dense_quotes n ON n.series_id = k.series_id AND d.date <= n.date""",
    "daily": """
        SELECT series_id, date,
               CASE WHEN pd IS NULL THEN NULL WHEN nd IS NULL OR nd = pd THEN pv
                    ELSE pv + (nv - pv) / date_diff('day', pd, nd) * date_diff('day', pd, date)
               END AS price_a
        FROM daily_days""",
    "line_months": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
               CAST(count(*) AS DOUBLE) AS head_count, sum(l_quantity) AS weight,
               round(sum(l_extendedprice), 2) / 997.3021837::DOUBLE AS trade_value, sum(l_quantity) AS trade_qty,
               100 * (avg(l_discount) - 0.045) AS pct
        FROM lineitem GROUP BY 1""",
    "trade": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag AS heading,
               round(sum(l_extendedprice), 2) AS trade_value, sum(l_quantity) AS trade_qty
        FROM lineitem GROUP BY 1, 2""",
    "chain": """
        SELECT month, pct, exp(sum(ln(1 + pct / 100)) OVER (ORDER BY month)) AS c
        FROM line_months""",
    "idx": f"""
        SELECT month, pct,
               round(c / (SELECT b.c FROM chain b WHERE b.month = DATE '{BASE_MONTH}') * 100, 6)
                   AS price_index
        FROM chain""",
    "grid": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
               CAST(s_nationkey // 5 AS INTEGER) AS latitude,
               CAST(s_nationkey % 5 AS INTEGER) AS longitude, avg(l_tax) AS tp
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, s_nationkey""",
    "rain": "SELECT time, round(avg(tp) * 1000, 8) * (1000 / 997.3021837::DOUBLE) AS rain_mm FROM grid GROUP BY time",
    "fx_long": """
        SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS ord, o_totalprice / 997.3021837::DOUBLE AS fx
        FROM orders WHERE o_orderstatus = 'F'""",
    "fx_day": """
        SELECT date, arg_max(fx, ord) FILTER (WHERE fx IS NOT NULL) AS fx
        FROM fx_long GROUP BY date""",
    "fx_bulletins": """
        SELECT ts, event_id AS ord, CASE WHEN value >= 10 THEN value END AS fx
        FROM events WHERE event_type = 'purchase'""",
    "fx_filled": """
        SELECT d.date, coalesce(f.fx, (SELECT arg_min(fx, date) FROM fx_day)) AS fx
        FROM days d ASOF LEFT JOIN fx_day f ON d.date >= f.date""",
    "macro_now": """
        SELECT d.date, m.head_count, m.weight, m.trade_value, m.trade_qty, i.price_index, r.rain_mm
        FROM days d
        ASOF LEFT JOIN line_months m ON d.date >= m.month
        ASOF LEFT JOIN idx i ON d.date >= i.month
        ASOF LEFT JOIN rain r ON d.date >= r.time""",
    "macro_month": """
        SELECT CAST(date_trunc('month', date) AS DATE) AS month,
               arg_min(head_count, date) FILTER (WHERE head_count IS NOT NULL) AS head_count,
               arg_min(weight, date) FILTER (WHERE weight IS NOT NULL) AS weight,
               arg_min(trade_value, date) FILTER (WHERE trade_value IS NOT NULL) AS trade_value,
               arg_min(trade_qty, date) FILTER (WHERE trade_qty IS NOT NULL) AS trade_qty,
               arg_min(price_index, date) FILTER (WHERE price_index IS NOT NULL) AS price_index,
               arg_min(rain_mm, date) FILTER (WHERE rain_mm IS NOT NULL) AS rain_mm
        FROM macro_now GROUP BY 1""",
    "macro": """
        SELECT d.date, m.head_count, m.weight, m.trade_value, m.trade_qty, m.price_index,
               m.rain_mm, f.fx, n.price_index AS deflator
        FROM days d
        JOIN fx_filled f ON f.date = d.date
        JOIN macro_now n ON n.date = d.date
        LEFT JOIN macro_month m
          ON m.month = CAST(date_trunc('month', d.date) - INTERVAL 1 MONTH AS DATE)""",
    "dataset": """
        SELECT p.series_id, p.date,
               p.price_a / (deflator / 100) AS price_a, p.price_b / (deflator / 100) AS price_b,
               p.price_c / (deflator / 100) AS price_c,
               p.price_a AS price_a_nominal, p.price_b AS price_b_nominal,
               p.price_c AS price_c_nominal,
               head_count, weight, trade_value, trade_qty, price_index, rain_mm, fx
        FROM prices p JOIN macro m ON m.date = p.date""",
    "base": """
        SELECT series_id, date, price_a AS baseline_last,
               avg(price_a) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS baseline_ma7,
               lead(price_a, 1) OVER w AS t1, lead(price_a, 7) OVER w AS t7,
               lead(price_a, 15) OVER w AS t15, lead(price_a, 30) OVER w AS t30,
               lead(price_a, 60) OVER w AS t60
        FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)""",
    "hz": """
        SELECT series_id, date, baseline_last, baseline_ma7, horizon, y_true FROM (
            SELECT series_id, date, baseline_last, baseline_ma7,
                   unnest([1, 7, 15, 30, 60]) AS horizon, unnest([t1, t7, t15, t30, t60]) AS y_true
            FROM base) WHERE y_true IS NOT NULL""",
    "hz_numbered": """
        SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY date) - 1 AS rn,
               (count(*) OVER (PARTITION BY series_id, horizon) - 730) // 5 AS sz
        FROM hz""",
    "oof": """
        SELECT series_id, date, CAST(horizon AS INTEGER) AS horizon, y_true, baseline_last,
               baseline_ma7, CAST((rn - 730) // sz + 1 AS INTEGER) AS fold
        FROM hz_numbered WHERE sz > 0 AND rn >= 730 AND (rn - 730) // sz < 5""",
    "fold_scores": """
        SELECT series_id, horizon, fold,
               sqrt(avg((y_true - baseline_last) ** 2)) AS last_rmse,
               avg(abs(y_true - baseline_last)) AS last_mae,
               CASE WHEN count(*) FILTER (WHERE y_true = 0) = 0
                    THEN avg(abs((y_true - baseline_last) / nullif(y_true, 0))) * 100 END AS last_mape,
               sqrt(avg((y_true - baseline_ma7) ** 2)) AS ma7_rmse,
               avg(abs(y_true - baseline_ma7)) AS ma7_mae,
               CASE WHEN count(*) FILTER (WHERE y_true = 0) = 0
                    THEN avg(abs((y_true - baseline_ma7) / nullif(y_true, 0))) * 100 END AS ma7_mape
        FROM oof GROUP BY 1, 2, 3""",
    "summary": """
        SELECT series_id, horizon, fold, 'last' AS model,
               last_rmse AS rmse, last_mae AS mae, last_mape AS mape FROM fold_scores
        UNION ALL
        SELECT series_id, horizon, fold, 'ma7', ma7_rmse, ma7_mae, ma7_mape FROM fold_scores""",
    "means": """
        SELECT horizon, model, round(avg(rmse), 4) AS rmse, round(avg(mae), 4) AS mae,
               round(avg(mape), 4) AS mape
        FROM summary GROUP BY horizon, model""",
    "chosen": """
        SELECT series_id, horizon, fold,
               CASE WHEN ma7_mape <= last_mape THEN 'ma7' ELSE 'last' END AS chosen,
               CASE WHEN ma7_mape <= last_mape THEN ma7_rmse ELSE last_rmse END AS rmse,
               CASE WHEN ma7_mape <= last_mape THEN ma7_mae ELSE last_mae END AS mae,
               CASE WHEN ma7_mape <= last_mape THEN ma7_mape ELSE last_mape END AS mape
        FROM fold_scores""",
}


def with_ctes(body: str, **extra: str) -> str:
    """The statement with the common table expressions it uses, in dependency order.

    `extra` adds expressions of one query; they may use the shared ones.
    """
    known = {**CTES, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS ({known[n].strip()})" for n in needed)
    return f"WITH {parts}\n{body.strip()}"
