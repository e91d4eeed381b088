"""Momentum, sentiment and change signals per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scores
from tickloom.functions.math import clamp, safe_divide
from tickloom.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, text_sentiment
from tickloom.operators.blocks import newest_rows



def price_momentum(candles: DataFrame, keys: Sequence[str] = ("symbol",), lookback: int = 50,
                   cap: float = 0.1) -> DataFrame:
    """Last candle and its capped distance to the `lookback`-row mean, per symbol.

    Only the newest lookback + 1 rows of a series are kept before the final
    aggregation. Series with fewer rows have momentum 0.
    """
    tail = newest_rows(candles, keys, ["open_time"], lookback + 1)
    in_mean = F.col("age") < lookback
    agg = tail.groupBy(*keys).agg(
        F.max("open_time").alias("open_time"),
        *[F.min_by(c, "age").alias(c) for c in ("close", "high", "low")],
        F.avg(F.when(in_mean, F.col("close"))).alias("sma"),
        F.count(F.lit(1)).alias("rows_seen"),
    )
    ratio = clamp(safe_divide(F.col("close") - F.col("sma"), "sma"), -cap, cap) / F.lit(cap)
    return agg.withColumn("momentum", F.when(F.col("rows_seen") < lookback + 1, F.lit(0.0)).otherwise(ratio)) \
        .drop("rows_seen")


def momentum_signals(candles: DataFrame, sentiment: Column, on_chain: Column | None = None,
                     config: scores.SignalConfig = scores.SignalConfig(), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Alpha blend of momentum, sentiment and on-chain score with levels."""
    m = price_momentum(candles, keys, config.lookback, config.cap)
    m = m.withColumn("sentiment_score", sentiment) \
        .withColumn("on_chain_score", F.lit(0.5) if on_chain is None else on_chain)
    m = m.withColumn("alpha_score", scores.alpha_blend(F.col("momentum"), F.col("sentiment_score"),
                                                       F.col("on_chain_score"), config.weights))
    m = m.withColumn("direction", scores.alpha_direction("alpha_score", config.directions)) \
        .withColumn("confidence", scores.alpha_confidence("alpha_score"))
    levels = scores.price_levels(F.col("direction"), F.col("close"), F.col("high"), F.col("low"), config.levels)
    return m.select(*keys, "open_time", "momentum", "sentiment_score", "on_chain_score", "alpha_score", "direction",
                    "confidence", *[c.alias(n) for n, c in levels.items()])


def change_signals(candles: DataFrame, rule: scores.ChangeRule = scores.ChangeRule(), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Signal from the relative change of the last candle."""
    tail = newest_rows(candles, keys, ["open_time"], 2)
    pair = tail.groupBy(*keys).agg(
        F.min_by("close", "age").alias("entry_price"), F.max_by("close", "age").alias("before"),
        F.count(F.lit(1)).alias("rows_seen"),
    ).where(F.col("rows_seen") == 2)
    df = pair.withColumn("change", safe_divide(F.col("entry_price") - F.col("before"), "before"))
    df = df.withColumn("direction", scores.change_direction(F.col("change"), rule))
    levels = scores.change_levels(F.col("direction"), F.col("entry_price"), rule)
    return df.select(*keys, "entry_price", "change", "direction",
                     F.least(F.lit(1.0), F.abs("change") * rule.confidence_scale).alias("confidence"),
                     *[c.alias(n) for n, c in levels.items()])


def weighted_sentiment(messages: DataFrame, keys: Sequence[str] = (), positive: Sequence[str] = POSITIVE_WORDS,
                       negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """Weighted mean sentiment per key; weight defaults to 1, no weight gives 0.5."""
    weight = F.coalesce("weight", F.lit(1.0))
    scored = messages.select(*keys, text_sentiment("text", positive, negative).alias("s"), weight.alias("w"))
    mean = safe_divide(F.sum(F.col("s") * F.col("w")), F.sum("w"))
    return scored.groupBy(*keys).agg(F.coalesce(mean, F.lit(0.5)).alias("sentiment"),
                                     F.count(F.lit(1)).alias("messages"))
