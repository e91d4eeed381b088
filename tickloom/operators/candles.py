"""Candles from trades, pair spreads, inventory and resume points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.math import log_ratio

CANDLE_KEY = ["exchange", "symbol", "interval_code", "open_time"]


def candles_from_trades(trades: DataFrame, bucket: Column, interval_code: str, exchange: str = "synthetic",
                        order: str | Column = "trade_time") -> DataFrame:
    """OHLCV per (symbol, bucket). Partial aggregation carries first/last price.

    `order` should be unique per symbol (a trade number, or a struct of time and
    number), so that first and last do not depend on the task layout.
    """
    return (
        trades.groupBy("symbol", bucket.alias("open_time"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"),
            F.count(F.lit(1)).alias("trades_count"),
        )
        .select(F.lit(exchange).alias("exchange"), "symbol", F.lit(interval_code).alias("interval_code"),
                "open_time", "open", "high", "low", "close", "volume", "trades_count")
    )


def pair_spread(candles: DataFrame, pairs: Sequence[tuple[str, str]], interval_code: str) -> DataFrame:
    """Log price ratio of two legs at equal (exchange, interval, open time).

    The candle key is unique, so both legs of a bucket meet in one grouped
    aggregation: one scan and one shuffle on a key with at most two rows per
    pair, where a self-join would scan and shuffle the table twice.
    """
    legs = F.array(*[
        F.struct(F.lit(f"{a}/{b}").alias("pair"), F.lit(leg).alias("symbol"), F.lit(side).alias("side"))
        for a, b in pairs for side, leg in ((1, a), (2, b))
    ])
    wanted = sorted({leg for pair in pairs for leg in pair})
    tagged = (
        candles.where((F.col("interval_code") == interval_code) & F.col("symbol").isin(wanted))
        .withColumn("leg", F.explode(F.filter(legs, lambda x: x["symbol"] == F.col("symbol"))))
    )

    def of(side: int, value: str) -> Column:
        return F.max(F.when(F.col("leg.side") == side, F.col(value)))

    both = (F.count_if(F.col("leg.side") == 1) > 0) & (F.count_if(F.col("leg.side") == 2) > 0)
    return (
        tagged.groupBy("exchange", F.col("leg.pair").alias("pair"), F.col("open_time").alias("ts"))
        .agg(of(1, "close").alias("c1"), of(2, "close").alias("c2"),
             of(1, "volume").cast("double").alias("leg1_volume"),
             of(2, "volume").cast("double").alias("leg2_volume"),
             both.alias("both"))
        .where("both")
        .select("exchange", "pair", "ts", log_ratio("c1", "c2").alias("spread_log"), "leg1_volume", "leg2_volume")
    )


def prefer_source(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `primary`; `fallback` fills the keys the primary lacks."""
    feed = primary.withColumn("_rank", F.lit(0)).withColumn("source", F.lit("primary")).unionByName(
        fallback.withColumn("_rank", F.lit(1)).withColumn("source", F.lit("fallback")))
    rest = [c for c in feed.columns if c not in keys and c != "_rank"]
    best = feed.groupBy(*keys).agg(F.min(F.struct("_rank", *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def inventory(candles: DataFrame) -> DataFrame:
    """Row counts by symbol and interval."""
    return candles.groupBy("symbol", "interval_code").agg(F.count(F.lit(1)).alias("cnt")) \
        .orderBy("symbol", "interval_code")


def unexpected_members(counts: DataFrame, interval_code: str, allowed: Sequence[str]) -> DataFrame:
    """Inventory rows of one interval whose symbol is outside the allowed set."""
    return counts.where((F.col("interval_code") == interval_code) & ~F.col("symbol").isin(list(allowed)))


def resume_points(candles: DataFrame, wanted: DataFrame, default_start: str = "2019-01-01 00:00:00") -> DataFrame:
    """Next start per (symbol, interval): latest stored open time, else the listing date.

    `wanted` holds (symbol, interval_code) and optionally `listed_at`.
    """
    latest = candles.groupBy("symbol", "interval_code").agg(F.max("open_time").alias("last_open"))
    listed = F.col("listed_at") if "listed_at" in wanted.columns else F.lit(None).cast("timestamp")
    return (
        wanted.join(latest, ["symbol", "interval_code"], "left")
        .select("symbol", "interval_code", "last_open",
                F.unix_millis("last_open").alias("last_open_ms"),
                F.coalesce("last_open", listed, F.lit(default_start).cast("timestamp")).alias("start_at"),
                F.col("last_open").isNotNull().alias("resumed"))
    )
