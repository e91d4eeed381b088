"""Rising edges and change detection on keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import attach_carries, block_seconds_for, in_block, previous, time_block


def rising_edges(df: DataFrame, key: str, ts: str, tie: str, high: Column, ttl_seconds: int | None = None,
                 block_seconds: int | None = None) -> DataFrame:
    """Rows where `high` turns true for a key: true now, not true one row earlier.

    With `ttl_seconds` an earlier row older than that no longer counts. The
    earlier row crosses time blocks by a carry, so hot keys split by time; the
    blocks are as wide as the densest hour of a key allows, unless given.
    """
    flagged = df.withColumn("_high", F.coalesce(high, F.lit(False)))
    state = F.struct(F.col("_high").alias("high"), F.unix_micros(F.col(ts)).alias("at"))
    seconds = block_seconds or block_seconds_for(df, [key], ts)
    carried = attach_carries(flagged, [key], time_block(ts, seconds), {
        "_before": (F.max_by(state, F.struct(ts, tie)), previous)})
    placed = carried.withColumn("_last", F.coalesce(F.lag(state).over(in_block([key], [ts, tie])), F.col("_before")))
    was_high = F.coalesce(F.col("_last.high"), F.lit(False))
    if ttl_seconds is not None:
        was_high = was_high & (F.unix_micros(F.col(ts)) - F.col("_last.at") <= ttl_seconds * 1_000_000)
    return placed.where(F.col("_high") & ~was_high).drop("_tb", "_before", "_last", "_high")


def payload_hash(fields: Sequence[str | Column]) -> Column:
    """Fingerprint of the compared fields; processing times are not among them."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
