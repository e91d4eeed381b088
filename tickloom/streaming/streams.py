"""Streaming jobs: stateless parsing, windowed flow, upserts and keyed alerts.

Every `start_*` takes a streaming DataFrame, an output folder and a checkpoint
folder and returns the running query. Restarting with the same folders resumes;
replayed micro-batches give the same tables. State per key is kept by Spark, in
the state store of the checkpoint: see `keyed.py` for edges and changes; the
live snapshot is an update-mode aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions import scores
from tickloom.functions.math import number
from tickloom.operators import tables
from tickloom.operators.tokens import alerts, latest_per_key
from tickloom.sources.payloads import read_agg_trades, read_kline_stream
from tickloom.streaming.keyed import changed_rows, rising_edge_rows
from tickloom.streaming.state import drop_batch, ensure_table, newest_of_batches, read_batch, save_batch


def _start(writer, trigger: str | None) -> StreamingQuery:
    """`trigger` is a processing time such as "5 seconds"; None drains what is there."""
    timed = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return timed.start()


def start_keyed(writer, spark: SparkSession, trigger: str | None) -> StreamingQuery:
    """Start a query whose keys have timers by the machine's clock.

    Under a trigger a micro-batch without rows looks after the timers. A query that only drains what is
    there would go on with such batches for ever, so it runs without them; timers are looked after by the
    batches with rows.
    """
    if trigger:
        return _start(writer, trigger)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return _start(writer, None)  # a query keeps the settings with which it starts
    finally:
        spark.conf.set(setting, before)


def _each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                trigger: str | None, mode: str = "append", keyed: bool = False) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        if keyed:
            handle(batch, batch_id)
            return
        # Read once, used by several writes; lost blocks are read again from the source.
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
    return start_keyed(writer, stream.sparkSession, trigger) if keyed else _start(writer, trigger)


def start_large_trades(messages: DataFrame, out: str, checkpoint: str, min_notional: float = 10_000,
                       trigger: str | None = None) -> StreamingQuery:
    """Trade envelopes to large trades, appended as Parquet."""
    rows = read_agg_trades(messages, min_notional=min_notional)
    return _start(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), trigger)


def hourly_flow(trades: DataFrame, delay: str = "1 hour", time: str = "trade_time") -> DataFrame:
    """Hourly notional per symbol and side with a watermark."""
    return (
        trades.withWatermark(time, delay)
        .groupBy(F.window(time, "1 hour"), "symbol", "side")
        .agg(F.sum("notional_usd").alias("notional"))
        .select(F.col("window.start").alias("ts_hour"), "symbol", "side", "notional")
    )


def start_hourly_flow(trades: DataFrame, out: str, checkpoint: str, delay: str = "1 hour",
                      trigger: str | None = None) -> StreamingQuery:
    """Closed hours are appended once; hours newer than the watermark stay open."""
    writer = hourly_flow(trades, delay).writeStream.outputMode("append").format("parquet")
    return _start(writer.option("path", out).option("checkpointLocation", checkpoint), trigger)


CANDLE_KEY = ["exchange", "symbol", "interval_code", "open_time"]


def start_candle_upsert(messages: DataFrame, out: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Candle updates upserted by key; the last update by arrival wins, late ones included.

    `messages` holds payload, arrived_at and arrival_id. The table is
    partitioned by day; it keeps the arrival of the winning update, so a
    replayed or late batch cannot put an older update over a newer one.
    """
    updates = read_kline_stream(messages).withColumn("day", F.to_date("open_time"))
    ensure_table(messages.sparkSession, out, updates.schema, ["day"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = tables.cut_lineage(batch)
        stored = tables.touched_rows(batch.sparkSession, out, batch, ["day"])
        merged = latest_per_key(stored.unionByName(batch), CANDLE_KEY, ["arrived_at", "arrival_id"])
        tables.write_partitions(tables.cut_lineage(merged), out, ["day"])

    return _each_batch(updates, handle, checkpoint, trigger)


def start_rising_edges(ticks: DataFrame, out: str, checkpoint: str, high: Column, ttl_seconds: int | None = 1800,
                       key: str = "token_id", ts: str = "metric_time", tie: str = "metric_id",
                       trigger: str | None = None) -> StreamingQuery:
    """Event mode: a row fires when its key was not high one row earlier; see `keyed.rising_edge_rows`."""
    fired = rising_edge_rows(ticks, high, ttl_seconds, key, ts, tie)
    writer = fired.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return start_keyed(writer, ticks.sparkSession, trigger)


def start_snapshot_edges(ticks: DataFrame, out: str, checkpoint: str, high: Column, key: str = "token_id",
                         order: Sequence[str] = ("metric_time", "metric_id"), trigger: str | None = None) -> StreamingQuery:
    """Snapshot mode: each micro-batch is one snapshot (latest row per key).

    A key that is missing from a snapshot loses its state at once and fires again when it comes back
    high. So all there is to know is which keys were high in the snapshot before: that micro-batch's
    own table, of which the last two are kept.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, f"{out}_high"
        now = save_batch(latest_per_key(batch, [key], order).where(F.coalesce(high, F.lit(False))), seen, batch_id)
        before = read_batch(spark, seen, batch_id - 1, now.schema).select(key)
        save_batch(tables.join_null_safe(now, before, [key], "left_anti"), out, batch_id)
        drop_batch(spark, seen, batch_id - 2)

    return _each_batch(ticks, handle, checkpoint, trigger)


def start_changes(ticks: DataFrame, out: str, checkpoint: str, compared: Sequence[str | Column], passes: Column | None = None,
                  shape: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "token_id",
                  order: Sequence[str] = ("metric_time", "metric_id"), ttl_seconds: int | None = None,
                  trigger: str | None = None) -> StreamingQuery:
    """Rows of the newest snapshot that differ from the last emitted ones; see `keyed.changed_rows`.

    Emitted rows are shaped and written in a folder per micro-batch.
    """
    changed = changed_rows(ticks, compared, passes, key, order, ttl_seconds)
    return _each_batch(changed, lambda batch, batch_id: save_batch(shape(batch), out, batch_id), checkpoint, trigger, keyed=True)


ALERT_FIELDS = ["price", "marketcap", "buys_5m", "volume_5m", "price_change_1h", "pump_probability"]


def start_changed_alerts(live: DataFrame, out: str, checkpoint: str, rule: scores.AlertRule = scores.AlertRule(),
                         trigger: str | None = None, **kw) -> StreamingQuery:
    """Alerts of the rule, emitted per token when the alert payload changed."""
    payload = [F.col("price").cast("double").alias("price"), *[number(c).alias(c) for c in ALERT_FIELDS[1:]]]
    return start_changes(live, out, checkpoint, payload, scores.meets_alert_rule(rule), lambda df: alerts(df, rule),
                         trigger=trigger, **kw)


#: Micro-batches of a live snapshot after which its folders are merged into one.
MERGE_EVERY = 64


def start_live_snapshot(ticks: DataFrame, out: str, checkpoint: str, key: str = "token_id",
                        order: Sequence[str] = ("metric_time", "metric_id"), merge_every: int = MERGE_EVERY,
                        trigger: str | None = "5 seconds") -> StreamingQuery:
    """Latest row per key, kept as a table that `latest_snapshot` reads at any time.

    Spark's state holds the newest row of every key, combined before the shuffle; a micro-batch writes
    only the keys that it holds, in a folder of its own. Every `merge_every` batches a folder gets the
    rows of all keys; folders before the merge before last go, so a reader has that long to finish.
    """
    rest = [c for c in ticks.columns if c != key and c not in order]
    newest = ticks.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(
        *[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in ticks.columns])

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not batch_id or batch_id % merge_every:
            save_batch(batch, out, batch_id)
            return
        fresh = save_batch(batch, f"{out}_fresh", batch_id)  # what comes out of Spark's state is computed once
        stored = newest_of_batches(spark, out, batch.schema, key, batch_id - 1)
        save_batch(fresh.unionByName(tables.join_null_safe(stored, fresh.select(key), [key], "left_anti")), out, batch_id)
        drop_batch(spark, f"{out}_fresh", batch_id)
        for old in range(max(0, batch_id - 2 * merge_every), batch_id - merge_every):
            drop_batch(spark, out, old)

    return _each_batch(newest, handle, checkpoint, trigger, mode="update", keyed=True)


def latest_snapshot(spark, out: str, schema, query: StreamingQuery, key: str = "token_id") -> DataFrame:
    """Last complete snapshot of a `start_live_snapshot` query (for late subscribers)."""
    progress = query.lastProgress
    return newest_of_batches(spark, out, schema, key, -1 if progress is None else progress["batchId"])
