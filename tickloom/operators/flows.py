"""Hourly order flow and wallet activity, and their lookup onto a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import hour_bucket


def hourly_flow(trades: DataFrame, time: str = "trade_time") -> DataFrame:
    """Notional per hour, symbol and side."""
    return trades.groupBy(hour_bucket(time).alias("ts_hour"), "symbol", "side") \
        .agg(F.sum("notional_usd").alias("notional"))


def flow_pivot(trades: DataFrame, legs: dict[str, str], time: str = "trade_time") -> DataFrame:
    """Long/short notional per hour for the named symbols, in one aggregation.

    `legs` maps an output prefix to a symbol. Anything not BUY is short; hours
    that only hold other symbols still give a row of zeros.
    """
    is_buy = F.upper("side") == "BUY"
    aggs = []
    for prefix, symbol in legs.items():
        mine = F.col("symbol") == symbol
        for side, cond in (("long", mine & is_buy), ("short", mine & ~is_buy)):
            aggs.append(F.coalesce(F.sum(F.when(cond, F.col("notional_usd"))), F.lit(0.0)).alias(f"{prefix}_{side}"))
    return trades.groupBy(hour_bucket(time).alias("ts_hour")).agg(*aggs)


def hourly_activity(activity: DataFrame, time: str = "tx_time") -> DataFrame:
    return activity.groupBy(hour_bucket(time).alias("ts_hour")).agg(
        F.count(F.lit(1)).alias("wallet_tx_count"),
        F.coalesce(F.sum("notional_usd"), F.lit(0.0)).alias("wallet_notional"),
    )


def lookup_zero(timeline: DataFrame, hourly: DataFrame, values: list[str], ts: str = "ts") -> DataFrame:
    """Left lookup by exact hour; hours without a match get 0."""
    right = hourly.withColumnRenamed("ts_hour", ts)
    joined = timeline.join(right, ts, "left")
    return joined.withColumns({v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values})


def leg_flows(spread: DataFrame, trades: DataFrame, time: str = "trade_time") -> DataFrame:
    """The spread rows with `leg1_long`, `leg1_short`, `leg2_long`, `leg2_short`: the notional of both legs of each row's pair.

    Legs are the two symbols in the pair's name. Trades are aggregated per hour and symbol once for all
    pairs; an hour without trades of a leg gets 0.
    """
    is_buy = F.upper("side") == "BUY"
    hourly = trades.groupBy(hour_bucket(time).alias("ts_hour"), "symbol").agg(
        F.sum(F.when(is_buy, F.col("notional_usd"))).alias("long"), F.sum(F.when(~is_buy, F.col("notional_usd"))).alias("short"))
    out = spread
    for n, leg in ((1, "leg1"), (2, "leg2")):
        own = hourly.select(F.col("ts_hour").alias("ts"), F.col("symbol").alias("_leg"), F.col("long").alias(f"{leg}_long"),
                            F.col("short").alias(f"{leg}_short"))
        out = out.withColumn("_leg", F.split_part("pair", F.lit("/"), F.lit(n))).join(own, ["ts", "_leg"], "left").drop("_leg")
    names = [f"{leg}_{side}" for leg in ("leg1", "leg2") for side in ("long", "short")]
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
