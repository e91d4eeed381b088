"""Portfolio metrics on small hand-made frames."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import portfolio

DAY0 = dt.datetime(2024, 1, 1)


def closes(spark, **series):
    rows = [(s, DAY0 + dt.timedelta(days=i), p) for s, ps in series.items() for i, p in enumerate(ps) if p is not None]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")


def positions(spark, *rows):
    return spark.createDataFrame(list(rows), "portfolio_id long, symbol string, quantity double")


def test_metrics_match_plain_python(spark):
    prices = [100.0, 110.0, 99.0, 120.0, 90.0, 95.0, 130.0]
    got = portfolio.portfolio_metrics(positions(spark, (1, "A", 2.0)), closes(spark, A=prices)).first()
    r = [b / a - 1 for a, b in zip(prices, prices[1:])]
    total = prices[-1] / prices[0] - 1
    annual = (1 + total) ** (365 / 6) - 1
    vol = statistics.stdev(r) * math.sqrt(365)
    down = statistics.stdev([x for x in r if x < 0]) * math.sqrt(365)
    assert got["period_days"] == 6 and got["total_return"] == pytest.approx(total)
    assert got["annualized_return"] == pytest.approx(annual) and got["volatility"] == pytest.approx(vol)
    assert got["sharpe_ratio"] == pytest.approx(annual / vol) and got["sortino_ratio"] == pytest.approx(annual / down)
    assert got["max_drawdown"] == pytest.approx((90 - 120) / 120) and got["var_95"] == pytest.approx(min(r))
    assert got["concentration_index"] == pytest.approx(1.0) and got["num_assets"] == 1


def test_no_negative_return_and_too_few_values(spark):
    c = closes(spark, UP=[1.0, 2.0, 3.0, 4.0], TWO=[1.0, 2.0])
    got = {r["portfolio_id"]: r for r in portfolio.portfolio_metrics(
        positions(spark, (1, "UP", 1.0), (2, "TWO", 1.0)), c).collect()}
    assert set(got) == {1}
    assert got[1]["sortino_ratio"] is None and got[1]["max_drawdown"] == 0.0


def test_missing_symbol_and_zero_price(spark):
    c = closes(spark, A=[10.0, 11.0, 12.0], Z=[1.0, 1.0, 0.0])
    row = portfolio.portfolio_metrics(positions(spark, (1, "A", 1.0), (1, "Z", 5.0), (1, "NONE", 9.0)), c).first()
    assert row["num_assets"] == 3 and row["concentration_index"] == pytest.approx(1.0)


def test_non_positive_days_are_dropped(spark):
    c = closes(spark, A=[1.0, 0.0, 2.0, 3.0])
    values = portfolio.portfolio_values(positions(spark, (1, "A", 1.0)), c)
    assert values.count() == 3
    short = positions(spark, (1, "A", -1.0))
    assert portfolio.portfolio_metrics(short, c).count() == 0
    assert portfolio.concentration(short, c).first()["concentration_index"] is None


@pytest.mark.parametrize("n", [1, 20, 21, 22, 40, 41])
def test_var_rank(spark, n):
    rng = np.random.default_rng(n)
    values = np.cumprod(1 + rng.normal(0, 0.05, n + 1))
    got = portfolio.value_metrics(spark.createDataFrame(
        [(1, DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "portfolio_id long, ts timestamp, value double"),
        min_values=2).first()
    r = sorted(values[1:] / values[:-1] - 1)
    assert got["var_95"] == pytest.approx(r[math.floor(0.05 * (n - 1))])


def test_ordinal_alignment_differs_from_time(spark):
    c = closes(spark, A=[1.0, 2.0, 3.0, 4.0], B=[None, 10.0, 20.0, None])
    p = positions(spark, (1, "A", 1.0), (1, "B", 1.0))
    by_time = [r["value"] for r in portfolio.portfolio_values(p, c).orderBy("ts").collect()]
    by_row = [r["value"] for r in portfolio.portfolio_values_ordinal(p, c).orderBy("ts").collect()]
    assert by_time == [1.0, 12.0, 23.0, 4.0] and by_row == [11.0, 22.0, 3.0, 4.0]


def test_detail_pages_keep_every_position(spark):
    books = spark.createDataFrame([(1, "a"), (2, "empty")], "portfolio_id long, name string")
    p = spark.range(2500).select(F.lit(1).cast("long").alias("portfolio_id"), F.format_string("S%05d", "id").alias("symbol"),
                                 F.lit(1.0).alias("quantity"))
    got = portfolio.portfolio_detail(books, p, page_rows=1000).orderBy("portfolio_id", "page").collect()
    assert [(r["portfolio_id"], r["page"], len(r["positions"])) for r in got] == [(1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 0, 0)]
    names = [x["symbol"] for r in got for x in r["positions"]]
    assert names == sorted(names)
