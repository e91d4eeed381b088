"""Market tables derived from the star-schema test tables, as Spark DataFrames.

Every registered query starts from these, so its work grows with the tables.
The matching DuckDB text is in `oracle.py`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.times import seconds_interval
from tickloom.operators.candles import candles_from_trades, pair_spread
from tickloom.operators.tokens import token_live
from tickloom.session import prepare

PAIR = ("CLICK", "VIEW")
SYMBOLS = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")
LEGS = {"leg2": "VIEW", "leg1": "CLICK"}
DAY = 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def trades_from(events: DataFrame) -> DataFrame:
    size = F.lit(1) + F.col("user_id") % 10
    return events.select(
        F.col("event_id").alias("trade_id"),
        F.upper("event_type").alias("symbol"),
        F.col("ts").alias("trade_time"),
        (F.col("value") + 1.0).alias("price"),
        size.cast("double").alias("quantity"),
        ((F.col("value") + 1.0) * size * 100.0).alias("notional_usd"),
        F.when(F.col("event_id") % 2 == 1, "SELL").otherwise("BUY").alias("side"),
        "user_id",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from(events(spark, sf_dir))


def trade_place() -> Column:
    """Trades of one time go by their number."""
    return F.struct("trade_time", "trade_id")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_trades(trades(spark, sf_dir), F.date_trunc("hour", F.col("trade_time")), "1h", order=trade_place())


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_spread(candles(spark, sf_dir), [PAIR], "1h")


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of symbols, the first in the alphabet over the second."""
    return pair_spread(candles(spark, sf_dir), list(combinations(SYMBOLS, 2)), "1h")


def wallet_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).where(F.col("symbol") == "PURCHASE").select(
        F.col("trade_time").alias("tx_time"), F.col("user_id").alias("wallet_id"), "notional_usd")


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    price = F.col("value") + 1.0
    return e.select(
        F.col("user_id").alias("token_id"),
        F.col("event_id").alias("metric_id"),
        F.col("ts").alias("metric_time"),
        price.alias("price"),
        (price * (F.lit(1) + F.col("event_id") % 7) * 1000.0).alias("liquidity"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("volume"),
        ((F.col("event_id") % 100) / 100.0).alias("pump_probability"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("token_id"), F.col("c_name").alias("mint"), F.col("c_mktsegment").alias("symbol"))


def as_of(df: DataFrame, column: str) -> Column:
    """Newest instant of a table as a scalar subquery; stands in for the clock."""
    return df.agg(F.max(column)).scalar()


def live(spark: SparkSession, sf_dir: str, back_seconds: int = 0) -> DataFrame:
    """Latest state per token, `back_seconds` before the newest instant. Sparse events: 1 and 7 days stand for 5 min and 1 h."""
    metrics = token_metrics(spark, sf_dir)
    now = as_of(metrics, "metric_time")
    if back_seconds:
        now = now - seconds_interval(back_seconds)
        metrics = metrics.where(F.col("metric_time") <= now)
    return token_live(metrics, now, short_seconds=DAY, long_seconds=7 * DAY)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy((F.col("user_id") % 20).alias("portfolio_id"), F.upper("event_type").alias("symbol")).agg(
        F.sum(F.lit(1) + F.col("user_id") % 3).cast("double").alias("quantity"))


def daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_trades(trades(spark, sf_dir), F.date_trunc("day", F.col("trade_time")), "1d", order=trade_place()) \
        .select("symbol", F.col("open_time").alias("ts"), "close")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx_id"), F.col("o_orderpriority").alias("chain"),
        F.col("o_custkey").alias("wallet_from"), F.col("o_totalprice").alias("amount_usd"),
        F.col("o_orderdate").cast("timestamp").alias("ts"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.when(F.col("role") == "user", 1.0).otherwise(2.0).alias("weight"))
