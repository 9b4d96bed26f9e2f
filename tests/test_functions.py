import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import dates, normal, numbers


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_dirty_number(spark):
    texts = ["R$ 123,45", " 26.67 ", "-5", "abc", "", None, "1.234,5", "10"]
    got = column(spark, texts, "string", numbers.dirty_number)
    assert got == [123.45, 26.67, 5.0, None, None, None, None, 10.0]


def test_number_text(spark):
    texts = ["-", "...", "1,5", "12", "-3", "x1", None, "1,2,3"]
    assert column(spark, texts, "string", numbers.is_number_text) == [
        False, False, True, True, True, False, False, False,
    ]


def test_number_or_zero_and_bounds(spark):
    assert column(spark, ["7.5", "n/d", None], "string", numbers.number_or_zero) == [7.5, 0.0, 0.0]
    got = column(spark, [0.5, 1.0, 3.0, 3.1, None], "double", lambda c: numbers.within(c, 1.0, 3.0))
    assert got == [None, 1.0, 3.0, None, None]
    assert column(spark, [float("nan"), 2.0], "double", numbers.null_if_nan) == [None, 2.0]


def test_safe_ratio_has_no_infinity(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25, None]


def test_day_first_date(spark):
    got = column(spark, ["31/12/2020", "2020-02-01", "Data", None, "02/03/2021"], "string", dates.day_first_date)
    assert got == [dt.date(2020, 12, 31), dt.date(2020, 2, 1), None, None, dt.date(2021, 3, 2)]


def test_quarter_month(spark):
    df = spark.createDataFrame(
        [("201001", "No 1º mês"), ("201002", "No 3º mês"), ("201004", "Total"), ("201003", None)],
        "p string, o string",
    )
    got = [r[0] for r in df.select(dates.quarter_month(F.col("p"), F.col("o"))).collect()]
    assert got == [dt.date(2010, 1, 1), dt.date(2010, 6, 1), dt.date(2010, 10, 1), dt.date(2010, 7, 1)]


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2023, 1, 1),)], "d date")
    parts = dates.calendar_parts(F.col("d"))
    rows = df.select(*[e.alias(n) for n, e in parts.items()]).collect()
    assert (rows[0]["month"], rows[0]["quarter"], rows[0]["weekday"], rows[0]["day_of_year"]) == (2, 1, 3, 60)
    assert rows[1]["weekday"] == 6
    assert abs(rows[0]["month_sin"] ** 2 + rows[0]["month_cos"] ** 2 - 1) < 1e-12


def test_month_label(spark):
    assert column(spark, [1, 2, 12], "int", dates.month_label) == ["Jan", "Fev", "Dez"]


def test_probit_and_tail(spark):
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.99999]
    exact = NormalDist()
    got = column(spark, ps, "double", normal.probit)
    assert all(abs(g - exact.inv_cdf(p)) < 1e-7 for g, p in zip(got, ps))
    zs = [0.0, 0.5, -1.96, 3.0, 6.0]
    tails = column(spark, zs, "double", normal.two_sided_tail)
    for z, t in zip(zs, tails):
        assert t == pytest.approx(2 * exact.cdf(-abs(z)), rel=1e-6)


def student_tail(rho, n):
    """Two-sided tail of the t distribution by the midpoint rule over the angle: with
    t = sqrt(v) tan(u) the density is cos(u)^(v - 1)."""
    v = n - 2
    edge = math.atan(abs(rho) / math.sqrt(1 - rho * rho))
    width = min(math.pi / 2, 12 / math.sqrt(v))

    def area(low, high, steps=200_000):
        u = low + (np.arange(steps) + 0.5) * (high - low) / steps
        return np.exp((v - 1) * np.log(np.cos(u))).sum() * (high - low) / steps

    if edge >= width:
        return 0.0
    return area(edge, width) / area(0.0, width)


def test_correlation_p_value(spark):
    rows = [(0.0, 10), (0.5, 3), (-0.999, 3), (0.1, 4), (0.9, 4), (0.3, 12), (0.7, 30), (0.72, 30), (-0.2, 100),
            (0.05, 1000), (0.02, 100_000), (0.003, 1_000_000), (0.9, 1_000_000), (0.5, 57), (0.7072, 40)]
    df = spark.createDataFrame(rows, "r double, n long")
    got = [r[0] for r in df.select(normal.correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got == pytest.approx([student_tail(*r) for r in rows], abs=1e-9)
    # Closed forms of one and two degrees of freedom.
    assert got[1] == pytest.approx(1 - 2 / math.pi * math.atan(0.5 / math.sqrt(0.75)), abs=1e-12)
    assert got[3] == pytest.approx(1 - 0.1, abs=1e-12)
    edge = spark.createDataFrame([(1.0, 5), (-1.0, 9), (0.4, 2), (None, 9)], "r double, n long")
    assert [r[0] for r in edge.select(normal.correlation_p_value(F.col("r"), F.col("n"))).collect()] == [0.0, 0.0, None, None]
    # Values of published tables.
    known = spark.createDataFrame([(0.1, 400), (0.0, 100), (0.3, 30)], "r double, n int")
    got = [r[0] for r in known.select(normal.correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got == pytest.approx([0.04556, 1.0, 0.1073], abs=2e-4)
