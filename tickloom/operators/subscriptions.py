"""Signals meet the subscriptions they satisfy: equality on user, asset and timeframe, and a least confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

#: Subscriptions and signals of a tile, on average; a task joins whole tiles.
TILE_SUBSCRIPTIONS, TILE_SIGNALS = 4096, 65_536


def _group(keys: Sequence[str], any_value: Sequence[Column]) -> Column:
    """One value per group of a subscription: each key's value, NULL where it takes any."""
    return F.struct(*[F.when(~wild, F.col(k)).alias(k) for k, wild in zip(keys, any_value, strict=True)])


def match_subscriptions(signals: DataFrame, subscriptions: DataFrame, keys: Sequence[str] = ("asset", "timeframe"),
                        confidence: str = "confidence", least: str = "min_confidence", subscription: str = "subscription_id",
                        signal: str = "signal_id", tile_subscriptions: int = TILE_SUBSCRIPTIONS,
                        tile_signals: int = TILE_SIGNALS) -> DataFrame:
    """(signal, subscription) for every active subscription that a signal satisfies.

    A subscription's NULL key takes any value of the signal, NULL included; otherwise keys are equal
    (a NULL of the signal equals none). The signal's confidence is at least the subscription's; a NULL
    confidence or threshold matches nothing. Repeated rows match as often as they occur.

    The subscriptions of a group (one choice of keys) are put in order of their threshold and cut into
    buckets by counts per threshold (one threshold with very many is dealt by hash as well). A signal goes
    only to buckets that begin at or below its confidence. The signals of a large group are dealt into
    chunks, to which its buckets are copied, so a task has a bounded tile whichever side is hot.
    """
    keys = list(keys)
    active = subscriptions.where(F.col("is_active") & F.col(least).isNotNull())
    held = active.select(_group(keys, [F.col(k).isNull() for k in keys]).alias("_g"), F.col(least).alias("_least"),
                         F.col(subscription).alias("_sub"))
    # Every way to leave keys open that some subscription uses: at most 2 ** keys rows.
    ways = [r[0] for r in held.select(F.concat_ws("", *[F.when(F.col(f"_g.{k}").isNull(), "1").otherwise("0") for k in keys])).distinct().collect()]
    empty = signals.select(F.col(signal), F.lit(None).cast(active.schema[subscription].dataType).alias(subscription)).limit(0)
    if not ways:
        return empty
    asked = signals.where(F.col(confidence).isNotNull()).select(
        F.col(signal).alias("_sig"), F.col(confidence).alias("_conf"),
        F.explode(F.array(*[F.struct(
            F.lit(way).alias("way"), _group(keys, [F.lit(c == "1") for c in way]).alias("g")) for way in sorted(ways)])).alias("_w"), *keys)
    closed = [(F.substring("_w.way", i + 1, 1) == "1") | F.col(k).isNotNull() for i, k in enumerate(keys)]
    for rule in closed:
        asked = asked.where(rule)
    asked = asked.select("_sig", "_conf", F.to_json("_w.g", {"ignoreNullFields": "false"}).alias("_g"))
    held = held.select(F.to_json("_g", {"ignoreNullFields": "false"}).alias("_g"), "_least", "_sub")

    # Counts per group and threshold give each threshold its bucket and its number of hash parts.
    counts = held.groupBy("_g", "_least").count()
    before = Window.partitionBy("_g").orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut_lineage(counts.select(
        "_g", "_least", F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / tile_subscriptions).alias("_bucket"),
        F.ceil(F.col("count") / tile_subscriptions).cast("int").alias("_parts")))
    chunks = asked.groupBy("_g").count().select("_g", F.ceil(F.col("count") / tile_signals).cast("int").alias("_chunks"))
    buckets = cells.groupBy("_g", "_bucket").agg(F.min("_least").alias("_from"), F.max("_parts").alias("_parts")).join(chunks, "_g")

    left = held.join(cells.drop("_parts"), ["_g", "_least"]).join(buckets.select("_g", "_bucket", "_parts", "_chunks"), ["_g", "_bucket"])
    left = left.withColumn("_part", F.pmod(F.xxhash64("_sub"), F.col("_parts"))).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select("_g", "_bucket", "_part", "_chunk", "_least", "_sub")
    # A group's buckets travel as one list, in order, to the signals of the group.
    lists = buckets.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_bucket", "_from", "_parts"))).alias("_buckets"),
                                      F.max("_chunks").alias("_chunks"))
    right = asked.join(lists, "_g").select(
        "_g", "_sig", "_conf", F.pmod(F.xxhash64("_sig"), F.col("_chunks")).cast("int").alias("_chunk"),
        F.explode(F.filter("_buckets", lambda b: b["_from"] <= F.col("_conf"))).alias("_b"))
    right = right.select("_g", "_sig", "_conf", "_chunk", F.col("_b._bucket").alias("_bucket"),
                         F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_b._parts") - 1).cast("long"))).alias("_part"))
    met = right.join(left, ["_g", "_bucket", "_part", "_chunk"]).where(F.col("_conf") >= F.col("_least"))
    return met.select(F.col("_sig").alias(signal), F.col("_sub").alias(subscription))
