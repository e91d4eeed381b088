"""Spike alerts and their cooldown: after an accepted alert a key is silent for a while."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.asof import first_at_or_after
from tickloom.operators.blocks import SeriesBlocks, block_seconds_for, time_block, with_position
from tickloom.session import cut_lineage


def spikes(metrics: DataFrame, key: str = "token_id", ts: str = "metric_time", tie: str = "metric_id", back: int = 20,
           min_price_rise: float = 0.25, min_volume_ratio: float = 3.0) -> DataFrame:
    """Rows whose price rose by `min_price_rise` since the key's row before, or whose volume is at least
    `min_volume_ratio` times the mean of up to `back` rows before; with `price_rise` and `volume_ratio`.

    A first row, and one after a price or mean volume of 0, has no ratio and is no spike by it.
    """
    s = SeriesBlocks((key,), (ts, tie), time_block(ts, block_seconds_for(metrics, [key], ts)), back=back)
    opened = s.open(metrics)
    earlier = F.avg("volume").over(s.rows(-back, -1))
    rated = s.close(opened.withColumns({
        "price_rise": F.try_divide(F.col("price"), F.lag("price").over(s.row_window())) - 1.0,
        "volume_ratio": F.try_divide(F.col("volume"), earlier)})).drop("pos", "n_rows")
    return rated.where((F.col("price_rise") >= min_price_rise) | (F.col("volume_ratio") >= min_volume_ratio))


def _exits(nexts: np.ndarray, start: int) -> np.ndarray:
    """Where the walk from each row of a block leaves it: jumps are doubled until all lie outside."""
    size = len(nexts)
    out = nexts.copy()
    while True:
        inside = (out >= 0) & (out < start + size)
        if not inside.any():
            return out
        out[inside] = out[out[inside] - start]


def thin(alerts: DataFrame, cooldown_seconds: int, keys: Sequence[str] = ("token_id",), ts: str = "metric_time",
         tie: str = "metric_id", block_rows: int = 65_536) -> DataFrame:
    """The alerts that are accepted: a key's first one, then always the first at or after the last accepted plus the cooldown.

    Equal times go by `tie`, which is unique within a key. Every alert points to the one that would follow
    it. Inside blocks of `block_rows` alerts the pointers are doubled until they leave the block; of what
    can enter a block from outside only the way through it remains, and these ways are doubled again until
    they cover the series. So a key with any number of alerts is spread over its blocks. Keys are not
    NULL; alerts without a time cannot be placed and are left out.
    """
    if cooldown_seconds <= 0:
        raise ValueError("the cooldown must be longer than nothing")
    keys = list(keys)
    dated = alerts.where(F.col(ts).isNotNull())
    wide = block_seconds_for(dated, keys, ts)
    placed = cut_lineage(with_position(dated, keys, [ts, tie], time_block(ts, wide)).drop("n_rows"))
    until = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + cooldown_seconds * 1_000_000)
    pointed = first_at_or_after(placed.select(*keys, ts, "pos"), placed, keys, until, ts, tie, ["pos"], "_follow", wide).select(
        *keys, "pos", F.floor(F.col("pos") / F.lit(block_rows)).cast("long").alias("_blk"), F.coalesce("_follow.pos", F.lit(-1)).alias("_next"))

    def with_exits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        return part.assign(_exit=_exits(part["_next"].to_numpy(), int(part["pos"].iloc[0])))

    pointed = cut_lineage(pointed.groupBy(*keys, "_blk").applyInPandas(with_exits, StructType([*pointed.schema.fields]).add("_exit", "long")))
    entries = reached_entries(pointed, keys)

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        nexts, start = part["_next"].to_numpy(), int(part["pos"].iloc[0])
        at, kept = int(part["_entry"].iloc[0]), []
        while start <= at < start + len(part):
            kept.append(at - start)
            at = int(nexts[at - start])
        return part.iloc[kept][[*keys, "pos"]]

    accepted = pointed.join(entries, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(
        walked, StructType([f for f in pointed.schema.fields if f.name in (*keys, "pos")]))
    return placed.join(accepted, [*keys, "pos"], "left_semi").select(*alerts.columns)


def reached_entries(pointed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _blk, _entry: the rows at which the walk from a key's first row enters blocks."""
    cross = pointed.select(*keys, F.col("_exit").alias("pos")).where("pos >= 0").distinct()
    at = pointed.select(*keys, "pos", "_blk", "_exit")
    jumps = cut_lineage(at.join(cross, [*keys, "pos"], "left_semi").unionByName(at.where("pos = 0")))
    reached = jumps.where("pos = 0").select(*keys, "pos", "_blk")
    places = jumps.select(*keys, "pos", "_blk")
    ways = jumps.where("_exit >= 0").select(*keys, "pos", F.col("_exit").alias("to"))
    while ways.limit(1).count():
        more = reached.join(ways, [*keys, "pos"]).select(*keys, F.col("to").alias("pos"))
        reached = cut_lineage(reached.unionByName(more.join(places, [*keys, "pos"])))
        second = ways.select(*keys, F.col("pos").alias("to"), F.col("to").alias("_to"))
        ways = cut_lineage(ways.join(second, [*keys, "to"]).select(*keys, "pos", F.col("_to").alias("to")))
    return reached.select(*keys, "_blk", F.col("pos").alias("_entry"))
