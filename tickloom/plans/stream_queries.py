"""Streaming jobs run over the event table as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import scores
from tickloom.functions.math import rounded
from tickloom.operators.tokens import alerts
from tickloom.plans import views
from tickloom.plans.oracle import sql
from tickloom.plans.table_queries import TRADE_SQL, kline_messages, trade_messages
from tickloom.session import prepare, shared_dir
from tickloom.streaming import streams
from tickloom.streaming.keyed import changed_rows
from tickloom.streaming.state import read_output

SLICES = 3  # equal ranges of time


def _folders(spark):
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def event_stream(spark, d):
    """The event table as a file stream."""
    schema = prepare(spark).read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _feed_slices(spark, d, start):
    """Land the events in time order, a range at a time; `start(stream)` drains each landing as one micro-batch.

    The query is stopped and resumed from its checkpoint between landings. Events without a time land first.
    """
    e = views.events(spark, d)
    root = f"{shared_dir(spark)}/landing/{uuid.uuid4().hex}"
    first, last = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    width = ((last or 0) - (first or 0)) // SLICES + 1
    part = F.coalesce(F.floor((F.unix_micros("ts") - F.lit(first or 0)) / width), F.lit(0))
    query = None
    for i in range(SLICES):
        e.where(part == i).write.mode("append").parquet(root)
        query = _drain(start(spark.readStream.schema(e.schema).parquet(root)))
    return query


def ticks(events):
    """Token ticks of an event stream."""
    price = F.col("value") + 1.0
    return events.select(
        F.col("user_id").alias("token_id"), F.col("event_id").alias("metric_id"), F.col("ts").alias("metric_time"),
        price.alias("price"), (F.col("event_id") % 30).alias("buys_5m"), F.col("value").alias("volume_5m"),
        ((F.col("event_id") % 100) / 100.0).alias("pump_probability"), (price * 100).alias("marketcap"),
        (F.col("event_id") % 8).cast("double").alias("price_change_1h"), F.col("ts").alias("updated_at"))


def _drain(query):
    query.awaitTermination()
    return query


def stream_hourly_flow(spark, d):
    out, check = _folders(spark)
    _drain(streams.start_hourly_flow(views.trades_from(event_stream(spark, d)), out, check))
    back = spark.read.schema("ts_hour timestamp, symbol string, side string, notional double").parquet(out)
    return back.select("ts_hour", "symbol", "side", rounded("notional", 3).alias("notional"))


def stream_large_trades(spark, d):
    out, check = _folders(spark)
    messages = trade_messages(views.trades_from(event_stream(spark, d)).where(F.col("trade_id") % 13 != 0))
    _drain(streams.start_large_trades(messages, out, check))
    back = spark.read.schema("symbol string, tx_time timestamp, side string, price double, quantity double,"
                             " notional_usd double, success_rate double").parquet(out)
    return back.select("symbol", "tx_time", "side", *[rounded(c).alias(c) for c in ("price", "quantity", "notional_usd")])


def stream_candle_upsert(spark, d):
    out, check = _folders(spark)
    _feed_slices(spark, d, lambda e: streams.start_candle_upsert(kline_messages(views.trades_from(e)), out, check))
    return spark.read.parquet(out).select("exchange", "symbol", "open_time", "arrival_id", "is_closed",
                                          rounded("close").alias("close"), rounded("volume").alias("volume"))


HIGH = 0.85


def _is_high():
    return F.col("pump_probability") >= HIGH


def stream_rising_edges(spark, d):
    out, check = _folders(spark)
    _feed_slices(spark, d, lambda e: streams.start_rising_edges(ticks(e), out, check, _is_high(), ttl_seconds=4 * 86400))
    return spark.read.schema(ticks(views.events(spark, d)).schema).parquet(out) \
        .select("token_id", "metric_id", "metric_time", "pump_probability")


def stream_snapshot_edges(spark, d):
    out, check = _folders(spark)
    _feed_slices(spark, d, lambda e: streams.start_snapshot_edges(ticks(e), out, check, _is_high()))
    return read_output(spark, out, ticks(views.events(spark, d)).schema) \
        .select("batch_id", "token_id", "metric_id", "pump_probability")


RULE = scores.AlertRule(min_buys=20, min_change=5, min_probability=0.6, min_marketcap=3000, min_volume=50)


def stream_changed_alerts(spark, d):
    out, check = _folders(spark)
    _feed_slices(spark, d, lambda e: streams.start_changed_alerts(ticks(e), out, check, RULE))
    emitted = alerts(ticks(views.events(spark, d)), RULE)
    return read_output(spark, out, emitted.schema).select(
        "batch_id", "token_id", "updated_at", *[rounded(c).alias(c) for c in ("price", "marketcap", "pump_probability")])


SNAPSHOT_FIELDS = ["token_id", "price", "pump_probability", "marketcap"]


def _coarse(events):
    t = ticks(events).withColumn("price", F.round(F.col("price") / 50))
    return t.withColumns({"marketcap": F.col("price") * 2, "pump_probability": F.round("pump_probability")})


def stream_keyed_changes(spark, d):
    """Snapshot changes appended by the sink itself; an idle key is forgotten after a day."""
    out, check = _folders(spark)

    def start(e):
        changed = changed_rows(_coarse(e), SNAPSHOT_FIELDS, ttl_seconds=86400)
        writer = changed.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        return streams.start_keyed(writer, spark, None)

    _feed_slices(spark, d, start)
    back = spark.read.schema(_coarse(views.events(spark, d)).schema).parquet(out)
    return back.select("token_id", "metric_id", "price", "pump_probability")


def stream_snapshot_changes(spark, d):
    out, check = _folders(spark)
    _feed_slices(spark, d, lambda e: streams.start_changes(_coarse(e), out, check, SNAPSHOT_FIELDS))
    return read_output(spark, out, _coarse(views.events(spark, d)).schema) \
        .select("batch_id", "token_id", "metric_id", "price", "pump_probability")


def stream_live_snapshot(spark, d):
    out, check = _folders(spark)
    query = _feed_slices(spark, d, lambda e: streams.start_live_snapshot(ticks(e), out, check, trigger=None))
    live = streams.latest_snapshot(spark, out, ticks(views.events(spark, d)).schema, query)
    return live.orderBy(F.desc_nulls_last("pump_probability"), F.desc("marketcap"), "token_id") \
        .select("token_id", "metric_id", "updated_at", rounded("price").alias("price"), "pump_probability")


TICKS = """
    SELECT user_id AS token_id, event_id AS metric_id, ts AS metric_time, value + 1.0 AS price, event_id % 30 AS buys_5m,
           value AS volume_5m, (event_id % 100) / 100.0 AS pump_probability, (value + 1.0) * 100 AS marketcap,
           event_id % 8 AS price_change_1h, (epoch_us(ts) - min(epoch_us(ts)) OVER ())
             // ((max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) // 3 + 1) AS batch_id FROM events"""
SNAPSHOT = """
    SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY token_id, batch_id ORDER BY metric_time DESC) = 1"""
SNAP_CTES = {"ticks": TICKS, "snap": SNAPSHOT}

CHANGED = """token_id, metric_id, a AS price, b AS pump_probability FROM (
    SELECT *, lag((a, b)) OVER (PARTITION BY token_id ORDER BY batch_id) AS q FROM (
        SELECT *, round(price / 50) AS a, round(pump_probability) AS b FROM snap)) WHERE q IS NULL OR (a, b) <> q"""

QUERIES = {
    "stream_hourly_flow": (stream_hourly_flow, sql(
        "SELECT ts_hour, symbol, side, round(n, 3) + 0.0 AS notional FROM (SELECT date_trunc('hour', trade_time) AS ts_hour,"
        " symbol, side, sum(notional_usd) AS n FROM trades GROUP BY ALL) WHERE ts_hour + INTERVAL 1 HOUR <="
        " (SELECT max(trade_time) FROM trades) - INTERVAL 1 HOUR", "trades")),
    "stream_large_trades": (stream_large_trades, sql(
        "SELECT symbol, tx_time, side, round(price, 6) + 0.0 AS price, round(quantity, 6) + 0.0 AS quantity,"
        " round(notional_usd, 6) + 0.0 AS notional_usd FROM t WHERE tx_time < TIMESTAMP '2030-01-01'", "trades",
        ctes={"t": TRADE_SQL})),
    "stream_candle_upsert": (stream_candle_upsert, sql(
        "SELECT 'binance' AS exchange, symbol, date_trunc('hour', trade_time) AS open_time, trade_id AS arrival_id,"
        " side = 'SELL' AS is_closed, round(price, 6) + 0.0 AS close, round(quantity, 6) + 0.0 AS volume FROM trades"
        " WHERE trade_id % 10 <> 9 QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('hour', trade_time)"
        " ORDER BY trade_time DESC) = 1", "trades")),
    "stream_rising_edges": (stream_rising_edges, sql(
        f"SELECT token_id, metric_id, metric_time, pump_probability FROM (SELECT *, lag(pump_probability >= {HIGH}, 1, false)"
        " OVER w AS was, lag(metric_time) OVER w AS seen_at FROM ticks WINDOW w AS (PARTITION BY token_id ORDER BY metric_time))"
        f" WHERE pump_probability >= {HIGH} AND NOT (was AND metric_time - seen_at <= INTERVAL 4 DAY)", ctes={"ticks": TICKS})),
    "stream_snapshot_edges": (stream_snapshot_edges, sql(
        "SELECT CAST(a.batch_id AS BIGINT) AS batch_id, a.token_id, a.metric_id, a.pump_probability FROM snap a"
        f" WHERE a.pump_probability >= {HIGH} AND NOT EXISTS (SELECT 1 FROM snap b WHERE b.token_id = a.token_id"
        f" AND b.batch_id = a.batch_id - 1 AND b.pump_probability >= {HIGH})", ctes=SNAP_CTES)),
    "stream_changed_alerts": (stream_changed_alerts, sql(
        "SELECT CAST(batch_id AS BIGINT) AS batch_id, token_id, metric_time AS updated_at, round(price, 6) + 0.0 AS price,"
        " round(marketcap, 6) + 0.0 AS marketcap, round(pump_probability, 6) + 0.0 AS pump_probability FROM ("
        "SELECT *, (price, marketcap, buys_5m, volume_5m, price_change_1h, pump_probability) AS p,"
        " lag((price, marketcap, buys_5m, volume_5m, price_change_1h, pump_probability)) OVER"
        " (PARTITION BY token_id ORDER BY batch_id) AS q FROM snap WHERE (buys_5m >= 20 OR price_change_1h >= 5"
        " OR pump_probability >= 0.6) AND marketcap >= 3000 AND volume_5m >= 50) WHERE q IS NULL OR p <> q", ctes=SNAP_CTES)),
    "stream_snapshot_changes": (stream_snapshot_changes, sql(f"SELECT CAST(batch_id AS BIGINT) AS batch_id, {CHANGED}",
                                                             ctes=SNAP_CTES)),
    "stream_keyed_changes": (stream_keyed_changes, sql(f"SELECT {CHANGED}", ctes=SNAP_CTES)),
    "stream_live_snapshot": (stream_live_snapshot, sql(
        "SELECT token_id, metric_id, metric_time AS updated_at, round(price, 6) + 0.0 AS price, pump_probability FROM ticks"
        " QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY metric_time DESC) = 1", ctes={"ticks": TICKS})),
}
