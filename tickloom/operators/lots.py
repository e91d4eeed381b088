"""Copy trades: leader signals under a follower's settings, executions first in first out, and their analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import attach_carries, before, block_seconds_for, in_block, time_block

#: Trades that a block of the quantity axis holds, on average.
BLOCK_TRADES = 65_536


def copy_signals(leader: DataFrame, settings: DataFrame) -> DataFrame:
    """Leader signals (signal_id, wallet_id, asset, direction, confidence, price, quantity, ts) that a follower copies.

    A setting holds for a wallet and an asset (NULL: every asset) while it is active; signals below its
    min_confidence are left out, and quantity is cut down to whole units worth max_notional_usd (NULL: no
    limit); what comes to nothing is left out. A signal meets every setting of its wallet. Adds follower.
    """
    named = settings.where("active").select(
        F.col("id").alias("follower"), "wallet_id", F.col("asset").alias("_asset"), "min_confidence", "max_notional_usd")
    fits = F.col("_asset").isNull() | (F.col("_asset") == F.col("asset"))
    units = F.floor(F.try_divide(F.col("max_notional_usd"), F.col("price")))
    limit = F.when(F.col("max_notional_usd").isNotNull(), units)
    met = leader.join(named, "wallet_id").where(fits & (F.col("confidence") >= F.col("min_confidence")))
    return met.withColumn("quantity", F.least(F.col("quantity"), limit)).where("quantity > 0").select("follower", *leader.columns)


def _running(trades: DataFrame, keys: Sequence[str], ts: str, tie: str, quantity: str, seconds: int) -> DataFrame:
    """Adds `_end`: the quantity traded on the same side of the key up to and with the row."""
    side = [*keys, "side"]
    carried = attach_carries(trades, side, time_block(ts, seconds), {
        "_before": (F.sum(quantity), lambda c, w: F.coalesce(before(F.sum)(c, w), F.lit(0)))})
    inside = F.sum(quantity).over(in_block(side, [ts, tie]).rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn("_end", (F.col("_before") + inside).cast("decimal(38,8)")).drop("_tb", "_before")


def match_lots(trades: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str = "trade_id", quantity: str = "quantity",
               price: str = "price", block_trades: int = BLOCK_TRADES) -> DataFrame:
    """Executions: the n-th unit bought of a key closes, or is closed by, the n-th unit sold.

    `trades` have side BUY or SELL, ties of time go by `tie`. On the axis of traded quantity every buy and
    every sale covers an interval; between two neighbouring ends lies one piece of one buy and one sale.
    That is first in first out, for long and short positions alike. Columns: keys, buy_id, sell_id, side of
    the position (LONG or SHORT, by what came first), quantity, entry_price, exit_price, opened_at,
    closed_at, pnl, roi. Quantities are exact decimals of eight places; units without a counterpart stay
    open and give no row. Trades without a time, quantity or price, and those of 0 or less, take no part.

    The axis of a key is cut into blocks by its number of trades; a block takes the first later buy and
    sale, and the last end before it, from its neighbours.
    """
    keys = list(keys)
    valid = trades.where(F.col(ts).isNotNull() & (F.col(quantity) > 0) & F.col(price).isNotNull() & F.col("side").isin("BUY", "SELL"))
    valid = valid.select(*keys, "side", F.col(ts).cast("timestamp").alias("_ts"), F.col(tie).alias("_id"),
                         F.col(quantity).cast("decimal(28,8)").alias("_q"), F.col(price).cast("double").alias("_price"))
    ended = _running(valid, keys, "_ts", "_id", "_q", block_seconds_for(valid, [*keys, "side"], "_ts"))
    # Nothing beyond the smaller total of the two sides can be matched.
    totals = valid.groupBy(*keys).agg(
        F.least(F.coalesce(F.sum(F.when(F.col("side") == "BUY", F.col("_q"))), F.lit(0)),
                F.coalesce(F.sum(F.when(F.col("side") == "SELL", F.col("_q"))), F.lit(0))).alias("_both"),
        F.ceil(F.count(F.lit(1)) / block_trades).alias("_blocks")).where("_both > 0")
    ends = ended.join(totals, keys).where(F.col("_end") - F.col("_q") < F.col("_both"))
    width = F.col("_both").cast("double") / F.col("_blocks")
    lot = F.struct(F.col("_end").alias("end"), F.col("_ts").alias("ts"), F.col("_id").alias("id"), F.col("_price").alias("price"))
    ends = ends.select(*keys, "side", F.least("_end", "_both").alias("_end"), lot.alias("_lot"),
                       F.floor(F.least("_end", "_both").cast("double") / width).cast("long").alias("_block"))
    own = {side: F.when(F.col("side") == side, F.col("_lot")) for side in ("BUY", "SELL")}
    later = Window.partitionBy(*keys).orderBy(F.desc("_tb")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carried = attach_carries(ends, keys, F.col("_block"), {
        **{f"_next_{s}": (F.min(own[s]), lambda c, w: F.last(c, ignorenulls=True).over(later)) for s in own},
        "_last": (F.max("_end"), lambda c, w: F.max(c).over(earlier))})
    # Among equal ends the buy stands before the sale; pieces of no length go.
    up = in_block(keys, ["_end", "side"])
    down = in_block(keys, [F.desc("_end"), F.desc("side")]).rowsBetween(Window.unboundedPreceding, 0)
    pieces = carried.withColumns({
        **{s: F.coalesce(F.last(own[s], ignorenulls=True).over(down), F.col(f"_next_{s}")) for s in own},
        "_from": F.coalesce(F.lag("_end").over(up), F.col("_last"), F.lit(0).cast("decimal(38,8)"))})
    pieces = pieces.where(F.col("_end") > F.col("_from"))
    # Of two trades at one instant the one with the smaller id came first.
    long = F.struct("BUY.ts", "BUY.id") <= F.struct("SELL.ts", "SELL.id")
    opened, closed = (F.when(long, F.col(a)).otherwise(F.col(b)) for a, b in (("BUY", "SELL"), ("SELL", "BUY")))
    size = (F.col("_end") - F.col("_from")).cast("double")
    pnl = (F.col("SELL.price") - F.col("BUY.price")) * size
    return pieces.select(
        *keys, F.col("BUY.id").alias("buy_id"), F.col("SELL.id").alias("sell_id"), F.when(long, "LONG").otherwise("SHORT").alias("side"),
        size.alias("quantity"), opened["price"].alias("entry_price"), closed["price"].alias("exit_price"),
        opened["ts"].alias("opened_at"), closed["ts"].alias("closed_at"), pnl.alias("pnl"),
        F.try_divide(pnl, opened["price"] * size).alias("roi"))


def trade_analytics(executions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Closed trades, win rate (pnl above 0), total pnl and its percentage of the money put in."""
    put_in = F.sum(F.col("entry_price") * F.col("quantity"))
    return executions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("closed_trades"),
        F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"),
        (F.try_divide(F.sum("pnl"), put_in) * 100).alias("pnl_pct"),
        F.max("roi").alias("best_roi"), F.min("roi").alias("worst_roi"))
