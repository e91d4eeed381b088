"""Portfolio value series and risk metrics for all portfolios in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.math import safe_divide
from tickloom.functions.times import seconds_interval
from tickloom.operators.blocks import prefix_for, time_block, with_position

#: Bars of one symbol in a block: the calendar bounds them.
YEAR = 365 * 86400


def portfolio_values(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """sum(quantity * close) per portfolio and time; non-positive totals dropped.

    Aligned by timestamp. A symbol held by very many portfolios skews only the
    join, which AQE splits; the sum combines on the map side.
    """
    return (
        positions.join(closes, "symbol")
        .groupBy("portfolio_id", "ts")
        .agg(F.sum(F.col("quantity") * F.col("close")).alias("value"))
        .where(F.col("value") > 0)
    )


def portfolio_values_ordinal(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Value series aligned by row position instead of time (compatibility mode).

    The first symbol of a portfolio (by name) that has prices sets the length
    and the timestamps. It is the smallest symbol at position 0, and a position
    belongs to the series exactly while it is still the smallest one there.
    """
    placed = with_position(closes, ["symbol"], ["ts"], time_block("ts", YEAR))
    rows = positions.join(placed, "symbol").groupBy("portfolio_id", "pos").agg(
        F.sum(F.col("quantity") * F.col("close")).alias("value"),
        F.min("symbol").alias("lead"),
        F.min_by("ts", "symbol").alias("ts"),
    )
    reference = F.min(F.when(F.col("pos") == 0, F.col("lead"))).over(Window.partitionBy("portfolio_id"))
    return (
        rows.withColumn("reference", reference)
        .where((F.col("lead") == F.col("reference")) & (F.col("value") > 0))
        .select("portfolio_id", "ts", "value")
    )


def with_returns(values: DataFrame) -> DataFrame:
    """Adds simple return, running peak and drawdown.

    A value series has one row per portfolio and bar, so its length is bounded
    by the calendar whatever the portfolio holds: one window per portfolio.
    """
    w = Window.partitionBy("portfolio_id").orderBy("ts")
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumns({
        "ret": safe_divide("value", F.lag("value").over(w)) - 1.0,
        "peak": peak,
        "drawdown": (F.col("value") - peak) / peak,
    })


def value_metrics(values: DataFrame, var_level: float = 0.05, year: float = 365.0, min_values: int = 3) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown and VaR per portfolio.

    VaR is the ascending return at index floor(level * (n - 1)), picked by rank:
    the rank window shares the clustering of the return window and no array is
    collected.
    """
    by_return = Window.partitionBy("portfolio_id").orderBy(F.asc_nulls_last("ret"))
    whole = Window.partitionBy("portfolio_id")
    df = with_returns(values).withColumns({
        "_rank": F.row_number().over(by_return) - 1,
        "_pick": F.floor(F.lit(var_level) * (F.count("ret").over(whole) - 1)),
    })
    negative = F.when(F.col("ret") < 0, F.col("ret"))
    stats = df.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", "ts").alias("first"),
        F.max_by("value", "ts").alias("last"),
        F.stddev_samp("ret").alias("std"),
        F.when(F.count(negative) >= 2, F.stddev_samp(negative)).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
        F.max(F.when(F.col("_rank") == F.col("_pick"), F.col("ret"))).alias("var_95"),
    ).where(F.col("n") >= min_values)
    total = F.col("last") / F.col("first") - 1.0
    days = F.col("n") - 1
    out = stats.select(
        "portfolio_id",
        days.alias("period_days"),
        total.alias("total_return"),
        (F.pow(1.0 + total, F.lit(year) / days) - 1.0).alias("annualized_return"),
        (F.col("std") * F.sqrt(F.lit(year))).alias("volatility"),
        (F.col("down") * F.sqrt(F.lit(year))).alias("down_vol"),
        "max_drawdown", "var_95",
    )
    return out.select(
        "portfolio_id", "period_days", "total_return", "annualized_return", "volatility",
        F.when(F.col("volatility") > 0, F.col("annualized_return") / F.col("volatility")).alias("sharpe_ratio"),
        F.when(F.col("down_vol") > 0, F.col("annualized_return") / F.col("down_vol")).alias("sortino_ratio"),
        "max_drawdown", "var_95",
    )


def concentration(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Sum of squared last-price weights and number of positions.

    Positions without a price, or with price 0, have no weight but count as
    assets; a total that is not positive gives NULL.
    """
    last = closes.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    value = F.when(F.col("last_close") != 0, F.col("quantity") * F.col("last_close"))
    total = F.sum(value)
    return positions.join(last, "symbol", "left").groupBy("portfolio_id").agg(
        F.when(total > 0, F.sum(value * value) / (total * total)).alias("concentration_index"),
        F.count(F.lit(1)).alias("num_assets"),
    )


def portfolio_metrics(positions: DataFrame, closes: DataFrame, align: str = "time", **kw) -> DataFrame:
    values = {"time": portfolio_values, "ordinal": portfolio_values_ordinal}[align](positions, closes)
    return value_metrics(values, **kw).join(concentration(positions, closes), "portfolio_id")


def portfolio_detail(portfolios: DataFrame, positions: DataFrame, page_rows: int = 1000, prefix: int | None = None) -> DataFrame:
    """Portfolio rows with their positions nested, ordered by symbol.

    A portfolio gets one row per `page_rows` positions, so no array grows
    without bound; portfolios without positions keep one row and an empty array.
    Leading letters of the symbol cut a large portfolio into blocks, as many as
    the counts ask for unless `prefix` says.
    """
    letters = prefix_for(positions, ["portfolio_id"], "symbol") if prefix is None else prefix
    placed = with_position(positions, ["portfolio_id"], ["symbol"], F.substring("symbol", 1, letters))
    pages = placed.groupBy("portfolio_id", F.floor(F.col("pos") / page_rows).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("symbol", "quantity"))).alias("positions"))
    return portfolios.join(pages, "portfolio_id", "left").withColumns({
        "page": F.coalesce("page", F.lit(0).cast("long")),
        "positions": F.coalesce("positions", F.array().cast("array<struct<symbol:string,quantity:double>>")),
    })


def recent(df: DataFrame, ts: str, as_of, seconds: int, strict: bool = False) -> DataFrame:
    """Rows of the trailing interval before `as_of`."""
    edge = as_of.cast("timestamp") - seconds_interval(seconds)
    return df.where(F.col(ts) > edge if strict else F.col(ts) >= edge)
