"""Trade, transfer and summary reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.math import fixed_text


def large_trades(trades: DataFrame, threshold: float = 10_000, strict: bool = True) -> DataFrame:
    """Strict on reports, inclusive on ingest."""
    size = F.col("notional_usd")
    return trades.where(size > threshold if strict else size >= threshold)


def whale_transfers(transfers: DataFrame, threshold: float = 250_000) -> DataFrame:
    return transfers.where(F.col("amount_usd") >= threshold)


def newest(df: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), F.desc(tie)).limit(limit)


def oldest_first(df: DataFrame, ts: str, tie: str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.asc(ts), F.asc(tie))
    return out if limit is None else out.limit(limit)


def summary_cards(trades: DataFrame, wallets: DataFrame, spread: DataFrame, as_of: Column,
                  names: Sequence[str] = ("Leg 1", "Leg 2")) -> DataFrame:
    """(title, value) rows: three small aggregates unioned, no cross join."""
    day = F.expr("INTERVAL 24 HOURS")
    recent = spread.where(F.col("ts") > as_of.cast("timestamp") - day)
    big = large_trades(trades).agg(F.count(F.lit(1)).cast("string").alias("value"))
    active = wallets.where("is_active").agg(F.count(F.lit(1)).cast("string").alias("value"))
    out = big.select(F.lit("Big Futures Trades").alias("title"), "value") \
        .unionByName(active.select(F.lit("Active Wallets").alias("title"), "value"))
    for leg, name in zip(("leg1_volume", "leg2_volume"), names, strict=True):
        total = recent.agg(fixed_text(F.coalesce(F.sum(leg), F.lit(0.0)), 0).alias("value"))
        out = out.unionByName(total.select(F.lit(f"{name} Volume 24h").alias("title"), "value"))
    return out
