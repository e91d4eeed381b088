"""Payload readers, table maintenance and fetch planning over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom import contracts
from tickloom.functions.math import rounded
from tickloom.functions.text import base_asset, quote_asset
from tickloom.functions.times import interval_minutes
from tickloom.operators import candles as candle_ops
from tickloom.operators import tables
from tickloom.plans import views
from tickloom.plans.oracle import sql
from tickloom.session import shared_dir
from tickloom.sources import payloads
from tickloom.sources import tables as table_sources

DAY = 86400
OHLCV = ["open", "high", "low", "close", "volume"]


def _r(columns, digits=6):
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


def _same(names):
    return {n: n for n in names}


def _rounded(df, keep, names, digits=6):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in names])


def _path(spark, name):
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


# ---- payload readers: the JSON text is built by Spark from the candles and trades ----

def kline_payloads(spark, d):
    """One landed payload per symbol and day (at most 24 bars), some bars damaged on purpose."""
    c = views.candles(spark, d)
    ms = F.unix_millis("open_time")
    text = lambda x: F.col(x).cast("string")
    bad_number = F.col("trades_count") % 7 == 3
    close = F.when(bad_number, F.lit("n/a")).otherwise(text("close"))
    cells = F.array(ms.cast("string"), text("open"), text("high"), text("low"), close, text("volume"),
                    (ms + 3599999).cast("string"), (F.col("volume") * 2).cast("string"), text("trades_count"),
                    (F.col("volume") / 4).cast("string"), (F.col("volume") / 2).cast("string"))
    short = F.col("trades_count") % 11 == 5
    bar = F.when(short, F.slice(cells, 1, 10)).otherwise(cells)
    return c.groupBy(F.upper("exchange").alias("exchange"), F.lower("symbol").alias("symbol"), "interval_code",
                     F.to_date("open_time").alias("day")) \
        .agg(F.to_json(F.sort_array(F.collect_list(bar))).alias("payload"))


def parse_klines(spark, d):
    good = payloads.accepted(payloads.read_klines(kline_payloads(spark, d)))
    return _rounded(contracts.check(good, "market_candles"),
                    ["exchange", "symbol", "interval_code", "open_time", "close_time", "trades_count", "is_closed"],
                    OHLCV + ["quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume"])


def quarantine(spark, d):
    bad = payloads.quarantined(payloads.read_klines(kline_payloads(spark, d)))
    return bad.groupBy("exchange", "symbol").agg(
        F.count(F.lit(1)).alias("rejected"),
        F.count_if(F.contains("raw", F.lit("n/a"))).alias("bad_number"))


def _alt_payloads(spark, d):
    c = views.candles(spark, d)
    text = [F.col(c).cast("string") for c in ("low", "high", "open", "close", "volume")]
    cells = F.array(F.unix_seconds("open_time").cast("string"), *text)
    return c.groupBy("exchange", "symbol", "interval_code", F.to_date("open_time").alias("day")) \
        .agg(F.to_json(F.sort_array(F.collect_list(cells), asc=False)).alias("payload"))


def parse_candles_alt(spark, d):
    """Descending second-coded bars, newest 200 per symbol."""
    return _rounded(payloads.read_candles_alt(_alt_payloads(spark, d), last=200), ["exchange", "symbol", "open_time"], OHLCV)


def prefer_source(spark, d):
    """Primary source lacks every seventh hour; the fallback has all bars at doubled volume."""
    c = views.candles(spark, d)
    primary = c.where(F.hour("open_time") % 7 != 0)
    fallback = c.withColumn("volume", F.col("volume") * 2)
    best = candle_ops.prefer_source(primary, fallback, candle_ops.CANDLE_KEY)
    return _rounded(best, ["symbol", "open_time", "source"], ["close", "volume"])


def kline_messages(trades):
    """One stream envelope per trade: the running candle as of that trade."""
    hour = F.date_trunc("hour", "trade_time")
    k = F.struct(
        F.lower("symbol").alias("s"), F.lit("1h").alias("i"), F.unix_millis(hour).alias("t"),
        (F.unix_millis(hour) + 3599999).alias("T"), F.col("price").cast("string").alias("o"),
        F.col("price").cast("string").alias("h"), F.col("price").cast("string").alias("l"),
        F.col("price").cast("string").alias("c"), F.col("quantity").cast("string").alias("v"),
        F.lit("0").alias("q"), F.lit(1).alias("n"), F.lit("0").alias("V"), F.lit("0").alias("Q"),
        (F.col("side") == "SELL").alias("x"))
    kind = F.when(F.col("trade_id") % 10 == 9, "trade").otherwise("kline")
    payload = F.to_json(F.struct(F.lit("s").alias("stream"), F.struct(kind.alias("e"), k.alias("k")).alias("data")))
    return trades.select(payload.alias("payload"), F.col("trade_time").alias("arrived_at"),
                         F.col("trade_id").alias("arrival_id"))


def parse_kline_stream(spark, d):
    rows = payloads.read_kline_stream(kline_messages(views.trades(spark, d)))
    return _rounded(rows, ["arrival_id", "symbol", "interval_code", "open_time", "close_time", "is_closed", "trades_count"],
                    ["close", "volume"])


def trade_messages(trades):
    """Trade envelopes; every 13th has no time and every 17th no price."""
    data = F.struct(
        F.col("symbol").alias("s"),
        F.when(F.col("trade_id") % 17 != 0, F.col("price").cast("string")).alias("p"),
        (F.col("quantity") * 100).cast("string").alias("q"), (F.col("side") == "SELL").alias("m"),
        F.when(F.col("trade_id") % 13 != 0, F.unix_millis("trade_time")).alias("T"))
    return trades.select(F.to_json(F.struct(data.alias("data"))).alias("payload"))


def parse_agg_trades(spark, d):
    clock = F.lit("2030-01-01 00:00:00").cast("timestamp")
    rows = payloads.read_agg_trades(trade_messages(views.trades(spark, d)), clock=clock)
    return _rounded(rows, ["symbol", "tx_time", "side"], ["price", "quantity", "notional_usd"])


TRADE_SQL = """
    SELECT symbol, CASE WHEN trade_id % 13 <> 0 THEN date_trunc('millisecond', trade_time)
                        ELSE TIMESTAMP '2030-01-01 00:00:00' END AS tx_time, side, price, quantity * 100 AS quantity,
           price * (quantity * 100) AS notional_usd FROM trades WHERE trade_id % 17 <> 0 AND price * (quantity * 100) >= 10000"""


def parse_mempool(spark, d):
    """Orders as unconfirmed transactions; some without inputs or value."""
    o = views.table(spark, d, "orders")
    vin = F.when(F.col("o_orderkey") % 5 != 0, F.array(F.struct(F.struct(
        F.concat(F.lit("bc1-"), "o_custkey").alias("scriptpubkey_address")).alias("prevout"))))
    vout = F.array(F.struct(F.concat(F.lit("bc1-"), F.col("o_custkey") + 1).alias("scriptpubkey_address")))
    value = F.when(F.col("o_orderkey") % 9 != 0, F.round(F.col("o_totalprice") * 10000).cast("long"))
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("txid"), value.alias("value"),
                              vin.alias("vin"), vout.alias("vout")))
    rows = payloads.read_mempool(o.select(text.alias("payload"))).where(F.col("amount_usd") >= 250_000)
    return _rounded(rows, ["chain", "wallet_from", "wallet_to", "asset", "direction", "tx_hash"], ["amount", "amount_usd"])


CONTRACTS = {f"0xc{i}": f"TOK{i}" for i in range(4)}


def parse_token_transfers(spark, d):
    """One landed answer per order day with at most the day's transfers, five contracts, four of them known."""
    o = views.table(spark, d, "orders")
    contract = F.concat(F.lit("0xC"), F.col("o_custkey") % 5)
    item = F.struct(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_custkey").cast("string").alias("from"),
                    (F.col("o_custkey") + 1).cast("string").alias("to"),
                    F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"),
                    (F.lit(2) + F.col("o_orderkey") % 3).cast("string").alias("tokenDecimal"),
                    F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string").alias("timeStamp"),
                    contract.alias("contractAddress"))
    landed = o.select(F.to_json(F.struct(F.array(item).alias("result"))).alias("payload"))
    rows = payloads.read_token_transfers(landed, contracts=CONTRACTS)
    return _rounded(rows, ["contract", "token", "wallet_from", "wallet_to", "ts", "tx_hash"], ["amount", "amount_usd"])


def _customer_payload(spark, d, *items):
    return views.table(spark, d, "customer").select(F.col("c_name").alias("symbol"), "c_custkey", "c_acctbal", *items)


def parse_dex_pairs(spark, d):
    """Search answers: every tenth without pairs, missing numbers here and there."""
    key, bal = F.col("c_custkey"), F.abs("c_acctbal")
    pair = F.struct(
        bal.alias("fdv"), F.when(key % 3 != 0, F.struct((bal / 10).alias("usd"))).alias("liquidity"),
        F.struct((bal * 2).alias("h24")).alias("volume"),
        F.struct(F.struct((key % 50).alias("buys"), (key % 20).alias("sells")).alias("h24"),
                 F.struct((key % 9).alias("buys")).alias("m5")).alias("txns"), (key * 60).alias("age"))
    pairs = F.when(key % 10 == 0, F.array().cast(f"array<{'string'}>"))
    payload = F.when(pairs.isNotNull(), F.lit('{"pairs":[]}')).otherwise(F.to_json(F.struct(F.array(pair, pair).alias("pairs"))))
    rows = payloads.read_dex_pairs(_customer_payload(spark, d, payload.alias("payload")))
    return _rounded(rows, ["symbol", "base_token"], ["marketcap", "liquidityusd", "volumeusd", "tradecount", "buys_5m",
                                                     "sells_5m", "age_seconds", "dex_score"])


def parse_trending(spark, d):
    """Three payload shapes by customer: wrapped list, bare list, nested result."""
    key, bal = F.col("c_custkey"), F.abs("c_acctbal")
    ticker = F.struct(F.lit("").alias("ticker"), F.concat(F.lit("S"), key).alias("symbol"), bal.alias("score"))
    token = F.struct(F.concat(F.lit("S"), key).alias("token"), (key % 100).alias("holders"), (key * 10).alias("age_seconds"))
    nested = F.struct(F.concat(F.lit("S"), key).alias("symbol"), (key % 7).alias("holders"), bal.alias("marketCapUsd"))
    payload = F.when(key % 3 == 0, F.to_json(F.struct(F.array(ticker).alias("trending")))) \
        .when(key % 3 == 1, F.to_json(F.array(token))) \
        .otherwise(F.to_json(F.struct(F.struct(F.struct(F.array(nested).alias("json")).alias("data")).alias("result"))))
    rows = payloads.read_trending(_customer_payload(spark, d, payload.alias("payload")))
    return _rounded(rows, ["symbol"], ["holders", "pumpfun_score", "age_seconds", "marketcap"])


def parse_hot_pairs(spark, d):
    key, bal = F.col("c_custkey"), F.abs("c_acctbal")
    hot = F.struct(F.concat(F.lit("H"), key).alias("symbol"), bal.alias("marketCap"),
                   F.when(key % 4 != 0, bal / 2).alias("liquidity"), (bal * 3).alias("volume24h"))
    rows = payloads.read_hot_pairs(_customer_payload(spark, d, F.to_json(F.struct(F.array(hot).alias("data"))).alias("payload")))
    return _rounded(rows, ["symbol"], ["marketcap", "liquidityusd", "volumeusd", "dex_score"])


def parse_pool(spark, d):
    key, bal = F.col("c_custkey"), F.abs("c_acctbal")
    pool = F.to_json(F.struct(F.when(key % 5 != 0, bal).alias("price"), (bal * 4).alias("volume24h")))
    rows = payloads.read_pool(_customer_payload(spark, d, pool.alias("payload")))
    return _rounded(rows, ["symbol"], ["price", "volumeusd", "liquidityusd"])


def parse_fundamentals(spark, d):
    """Market, holders and three trade rows per customer; some answers lack trades."""
    key, bal = F.col("c_custkey"), F.abs("c_acctbal")
    trade = lambda i: F.struct((key % 10 + i).alias("count"), (bal * i).alias("tradeAmount"))
    body = F.struct(F.array(F.struct(bal.alias("marketCap"), (bal / 3).alias("price"))).alias("TokenMarket"),
                    F.array(F.struct((key % 500).alias("addressCount"))).alias("TokenHolderStats"),
                    F.when(key % 6 != 0, F.array(trade(1), trade(2), trade(3))).alias("DEXTrade"))
    payload = F.to_json(F.struct(F.struct(body.alias("Solana")).alias("data")))
    rows = payloads.read_fundamentals(_customer_payload(spark, d, payload.alias("payload")))
    return _rounded(rows, ["symbol"], ["marketcap", "liquidityusd", "price", "holders", "tradecount", "trade_amount"])


def training_table(spark, d):
    """Training rows written as CSV with a header and read back with the fixed schema."""
    p = views.table(spark, d, "part")
    rows = contracts.align(p.select(
        (F.col("p_size") / 50.0 - 0.5).alias("alpha_target"), F.exp(-F.col("p_size") / 10.0).alias("recency"),
        F.lit(0.5).alias("social_score"), (F.col("p_retailprice") * 1000).alias("marketCap"),
        (F.col("p_retailprice") * 10).alias("liquidityUSD"), (F.col("p_retailprice") * 20).alias("volumeUSD"),
        F.col("p_size").alias("holders"), (F.col("p_partkey") % 100).alias("tradeCount")), "training_rows")
    path = _path(spark, "training")
    rows.write.option("header", True).csv(path)
    back = contracts.check(table_sources.training_rows(spark, path), "training_rows")
    return back.select(*[rounded(c).alias(c) for c in ("alpha_target", "recency", "marketCap", "volumeUSD", "holders", "tradeCount")],
                    F.col("velocity").isNull().alias("velocity_missing"))


# ---- table maintenance ----

def _candle_batches(spark, d):
    """Stored bars of the first 20 days, and a batch of later bars with some bars twice."""
    cols = [*candle_ops.CANDLE_KEY, *OHLCV, "trades_count"]
    trades = views.trades(spark, d)
    hour = F.date_trunc("hour", F.col("trade_time"))
    stored = candle_ops.candles_from_trades(trades, hour, "1h").select(*cols) \
        .where(F.dayofmonth("open_time") <= 20).withColumn("day", F.to_date("open_time"))

    def version(rows, arrival):
        c = candle_ops.candles_from_trades(rows.withColumn("price", F.col("price") * 2), hour, "1h", "SYNTHETIC")
        return c.select(*cols).withColumns({"exchange": F.lower("exchange"), "day": F.to_date("open_time"),
                                            "arrival": F.lit(arrival)}).where(F.dayofmonth("open_time") >= 10)

    batch = version(trades, 2).unionByName(version(trades.where(F.col("side") == "BUY"), 1))
    return stored, batch


def _upserted(spark, d, ignore_existing):
    stored, batch = _candle_batches(spark, d)
    path = _path(spark, "candles")
    tables.write_table(stored, path, ["day"])
    for _ in range(2):  # a repeated batch must not change the table
        tables.upsert_table(spark, path, batch, candle_ops.CANDLE_KEY, ["day"], ["arrival"], ignore_existing)
    back = spark.read.schema(stored.schema).parquet(path)
    return _rounded(back, ["exchange", "symbol", "open_time", "trades_count"], OHLCV)


def upsert_candles(spark, d):
    return _upserted(spark, d, False)


def insert_ignore(spark, d):
    return _upserted(spark, d, True)


def _wallets(spark, d):
    c = views.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("chain"), F.col("c_name").alias("address"),
                    F.concat(F.lit("w"), "c_nationkey").alias("label"), (F.col("c_acctbal") > 0).alias("is_active"))


def followed_wallets(spark, d):
    """Wallet upsert: labels replaced, matched wallets active again, new wallets inserted, one flag toggled."""
    stored = _wallets(spark, d).where(F.col("id") % 3 != 0)
    batch = _wallets(spark, d).where(F.col("id") % 2 == 0).select(
        "chain", "address", F.concat(F.lit("new-"), "label").alias("label"), "id")
    merged = tables.merge_columns(stored, batch, contracts.KEYS["followed_wallets"], ["label"], {"is_active": F.lit(True)})
    return tables.toggle(merged, "is_active", F.col("id") == 5)


def _daily(trades, name, scale):
    return trades.groupBy("symbol", F.date_trunc("day", "trade_time").alias("ts")).agg(
        (F.max_by("price", "trade_time") * scale).alias("close")).select(
        "symbol", F.lit(name).alias("source"), F.lit("1d").alias("timeframe"), "ts", "close")


SLICE = ["source", "timeframe", "symbol"]


def replace_slice(spark, d):
    """Daily bars of two symbols replaced in a stored table; other slices keep their rows."""
    trades = views.trades(spark, d)
    stored = _daily(trades, "a", 1.0).unionByName(_daily(trades, "b", 2.0))
    path = _path(spark, "daily")
    tables.write_table(stored, path, SLICE)
    fresh = _daily(trades, "a", 3.0).where(F.col("symbol").isin("CLICK", "VIEW") & (F.dayofmonth("ts") > 15))
    tables.write_partitions(fresh, path, SLICE)
    back = spark.read.schema(stored.schema).parquet(path)
    return _rounded(back, ["symbol", "source", "timeframe", "ts"], ["close"])


def replace_slice_merge(spark, d):
    """The same replacement as a DataFrame merge."""
    trades = views.trades(spark, d)
    stored = _daily(trades, "a", 1.0).unionByName(_daily(trades, "b", 2.0))
    fresh = _daily(trades, "a", 3.0).where(F.col("symbol").isin("CLICK", "VIEW") & (F.dayofmonth("ts") > 15))
    return _rounded(tables.replace_slices(stored, fresh, SLICE), ["symbol", "source", "timeframe", "ts"], ["close"])


def rebuild_spread(spark, d):
    """Spread table rebuilt from the candles, then appended with the other pair."""
    path = _path(spark, "spread")
    candles = views.candles(spark, d)
    both = candle_ops.pair_spread(candles, [("CLICK", "VIEW"), ("SIGNUP", "VIEW"), ("VIEW", "ERROR")], "1h")
    tables.write_table(both.where(F.col("pair") != "CLICK/VIEW"), path)
    tables.write_table(contracts.check(both.where(F.col("pair") != "VIEW/ERROR"), "pair_spread"), path)
    tables.append_table(both.where(F.col("pair") == "VIEW/ERROR"), path)
    back = table_sources.scan(spark, path, contract="pair_spread")
    return _rounded(back, ["exchange", "pair", "ts"], ["spread_log", "leg1_volume", "leg2_volume"])


def replace_positions(spark, d):
    """Positions of every third portfolio replaced; rows without quantity are skipped."""
    stored = views.positions(spark, d)
    fresh = stored.where(F.col("portfolio_id") % 3 == 0).withColumn(
        "quantity", F.when(F.col("symbol") == "ERROR", 0.0).otherwise(F.col("quantity") * 2)) \
        .where(F.col("symbol") != "VIEW")
    return _rounded(tables.replace_children(stored, fresh), ["portfolio_id", "symbol"], ["quantity"])


def retention(spark, d):
    m = views.token_metrics(spark, d)
    return tables.retain(m, "metric_time", views.as_of(m, "metric_time"), 14).select("metric_id", "metric_time")


def get_or_create(spark, d):
    """Asset keys for all part names; a third of the assets exist already."""
    p = views.table(spark, d, "part")
    names = p.select(F.upper(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))).alias("symbol"), "p_partkey")
    stored = names.where(F.col("p_partkey") % 3 == 0).select(F.col("p_partkey").alias("id"), "symbol")
    full = tables.get_or_create(stored, names.select("symbol"))
    return full.select("id", "symbol", base_asset("symbol").alias("base_asset"), quote_asset("symbol").alias("quote_asset"))


def seed_timeframes(spark, d):
    """Timeframe seeds from the interval codes in use: labels updated, new codes inserted."""
    codes = views.trades(spark, d).select(F.concat((F.hour("trade_time") % 5 + 1).cast("string"),
                                                   F.when(F.hour("trade_time") < 12, "m").otherwise("h")).alias("code")).distinct()
    seeds = codes.select("code", interval_minutes("code").alias("granularity_minutes"), F.concat(F.lit("every "), "code").alias("label"))
    stored = seeds.where(F.col("granularity_minutes") % 2 == 0).withColumn("label", F.lit("old"))
    return tables.merge_latest(stored, seeds, contracts.KEYS["timeframes"], [])


def append_signals(spark, d):
    """Signal rows appended with missing fields as NULL, after the domain check."""
    t = views.live(spark, d)
    rows = t.select(F.col("token_id").cast("string").alias("symbol"),
                    F.when(F.col("price_change_1h") > 0, "BUY").when(F.col("price_change_1h") < 0, "SELL")
                    .otherwise("WAIT").alias("direction"),
                    F.col("pump_probability").alias("confidence"), F.col("marketcap"), F.col("updated_at").alias("created_at"))
    good, bad = contracts.split_valid(rows, contracts.signal_is_valid())
    path = _path(spark, "signals")
    tables.append_table(contracts.align(good, "token_signals"), path)
    tables.append_table(contracts.align(bad.withColumn("direction", F.lit("HOLD")), "token_signals"), path)
    back = table_sources.scan(spark, path, contract="token_signals")
    return back.select("symbol", "direction", "created_at", *[rounded(c).alias(c) for c in ("confidence", "marketcap")],
                       F.col("alpha").isNull().alias("alpha_missing"))


# ---- fetch planning ----

def resume_points(spark, d):
    """Stored hours end early for one symbol; two listed symbols are not stored at all."""
    c = views.candles(spark, d)
    wanted = c.select("symbol", "interval_code").distinct().withColumn("listed_at", F.lit(None).cast("timestamp")) \
        .unionByName(views.table(spark, d, "nation").select(
            F.upper("n_name").alias("symbol"), F.lit("1h").alias("interval_code"),
            F.when(F.col("n_nationkey") % 2 == 0, F.lit("2023-06-01").cast("timestamp")).alias("listed_at")))
    return candle_ops.resume_points(c, wanted).select("symbol", "interval_code", "start_at", "resumed",
                                                      F.coalesce("last_open_ms", F.lit(-1)).alias("last_open_ms"))


def fetch_slices(spark, d):
    """Pages of 100 hours between each symbol's first and last candle."""
    c = views.candles(spark, d)
    span = c.groupBy("symbol", "interval_code").agg(F.min("open_time").alias("start_at"), F.max("open_time").alias("end_at"))
    return table_sources.fetch_slices(span, 100)


BAD = "(trades_count % 7 = 3 OR trades_count % 11 = 5)"
BATCH_CTES = {
    "base": "SELECT * FROM trades",
    "stored": "SELECT exchange, symbol, open_time, trades_count, open, high, low, close, volume FROM candles WHERE day(open_time) <= 20",
    "versions": " UNION ALL ".join(
        "SELECT 'synthetic' AS exchange, symbol, date_trunc('hour', trade_time) AS open_time, count(*) AS trades_count,"
        " 2 * arg_min(price, trade_time) AS open, 2 * max(price) AS high, 2 * min(price) AS low,"
        f" 2 * arg_max(price, trade_time) AS close, sum(quantity) AS volume, {a} AS arrival FROM trades"
        f" WHERE day(trade_time) >= 10 {w} GROUP BY ALL" for a, w in ((2, ""), (1, "AND side = 'BUY'"))),
}
CANDLE_OUT = "exchange, symbol, open_time, trades_count, " + _r(_same(OHLCV))
DAILY_SQL = " UNION ALL ".join(
    f"SELECT symbol, '{n}' AS source, '1d' AS timeframe, date_trunc('day', trade_time) AS ts,"
    f" {k} * arg_max(price, trade_time) AS close FROM trades GROUP BY ALL" for n, k in (("a", 1.0), ("b", 2.0)))
SLICE_SQL = sql(
    "SELECT symbol, source, timeframe, ts, round(close, 6) + 0.0 AS close FROM stored"
    " WHERE NOT (source = 'a' AND symbol IN ('CLICK', 'VIEW')) UNION ALL SELECT symbol, source, timeframe, ts,"
    " round(close * 3, 6) + 0.0 FROM stored WHERE source = 'a' AND symbol IN ('CLICK', 'VIEW') AND day(ts) > 15",
    "trades", ctes={"stored": DAILY_SQL})

QUERIES = {
    "parse_klines": (parse_klines, sql(
        "SELECT 'synthetic' AS exchange, symbol, interval_code, open_time, open_time + INTERVAL 3599999 MILLISECOND AS close_time,"
        " CAST(trades_count AS INT) AS trades_count, true AS is_closed, " + _r({
            **_same(OHLCV), "quote_volume": "volume * 2", "taker_buy_base_volume": "volume / 4",
            "taker_buy_quote_volume": "volume / 2"}) + f" FROM candles WHERE NOT {BAD}", "candles")),
    "quarantine": (quarantine, sql(
        "SELECT exchange, symbol, count(*) AS rejected, count(*) FILTER (WHERE trades_count % 7 = 3) AS bad_number"
        f" FROM candles WHERE {BAD} GROUP BY ALL", "candles")),
    "parse_candles_alt": (parse_candles_alt, sql(
        "SELECT exchange, symbol, open_time, " + _r(_same(OHLCV)) + " FROM (SELECT *, row_number() OVER"
        " (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM candles) WHERE rn <= 200", "candles")),
    "prefer_source": (prefer_source, sql(
        "SELECT symbol, open_time, CASE WHEN hour(open_time) % 7 <> 0 THEN 'primary' ELSE 'fallback' END AS source, "
        + _r({"close": "close", "volume": "CASE WHEN hour(open_time) % 7 <> 0 THEN volume ELSE volume * 2 END"})
        + " FROM candles", "candles")),
    "parse_kline_stream": (parse_kline_stream, sql(
        "SELECT trade_id AS arrival_id, symbol, '1h' AS interval_code, date_trunc('hour', trade_time) AS open_time,"
        " date_trunc('hour', trade_time) + INTERVAL 3599999 MILLISECOND AS close_time, side = 'SELL' AS is_closed,"
        " CAST(1 AS INT) AS trades_count, " + _r({"close": "price", "volume": "quantity"})
        + " FROM trades WHERE trade_id % 10 <> 9", "trades")),
    "parse_agg_trades": (parse_agg_trades, sql(
        "SELECT symbol, tx_time, side, " + _r(_same(["price", "quantity", "notional_usd"])) + " FROM t", "trades",
        ctes={"t": TRADE_SQL})),
    "parse_mempool": (parse_mempool, sql(
        "SELECT 'btc' AS chain, CASE WHEN o_orderkey % 5 <> 0 THEN 'bc1-' || o_custkey ELSE '' END AS wallet_from,"
        " 'bc1-' || (o_custkey + 1) AS wallet_to, 'BTC' AS asset, 'unknown' AS direction,"
        " CAST(o_orderkey AS VARCHAR) AS tx_hash, " + _r({"amount": "v", "amount_usd": "v * 40000"})
        + " FROM (SELECT *, CAST(round(o_totalprice * 10000) AS BIGINT) / 1e8 AS v FROM orders WHERE o_orderkey % 9 <> 0)"
          " WHERE v * 40000 >= 250000")),
    "parse_token_transfers": (parse_token_transfers, sql(
        "SELECT '0xc' || (o_custkey % 5) AS contract, 'TOK' || (o_custkey % 5) AS token, CAST(o_custkey AS VARCHAR) AS wallet_from,"
        " CAST(o_custkey + 1 AS VARCHAR) AS wallet_to, o_orderdate AS ts, CAST(o_orderkey AS VARCHAR) AS tx_hash, "
        + _r({"amount": "v", "amount_usd": "v"}) + " FROM (SELECT *, round(o_totalprice * 100) / power(10, 2 + o_orderkey % 3) AS v,"
        " row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn"
        " FROM orders WHERE o_custkey % 5 < 4) WHERE rn <= 5")),
    "parse_dex_pairs": (parse_dex_pairs, sql(
        "SELECT c_name AS symbol, c_name AS base_token, " + _r({
            "marketcap": "abs(c_acctbal)", "liquidityusd": "CASE WHEN c_custkey % 3 <> 0 THEN abs(c_acctbal) / 10 ELSE 0 END",
            "volumeusd": "abs(c_acctbal) * 2", "tradecount": "(c_custkey % 50 + c_custkey % 20)::DOUBLE",
            "buys_5m": "(c_custkey % 9)::DOUBLE", "sells_5m": "0::DOUBLE", "age_seconds": "(c_custkey * 60)::DOUBLE",
            "dex_score": "0::DOUBLE"}) + " FROM customer WHERE c_custkey % 10 <> 0")),
    "parse_trending": (parse_trending, sql(
        "SELECT 'S' || c_custkey AS symbol, " + _r({
            "holders": "(CASE c_custkey % 3 WHEN 1 THEN c_custkey % 100 WHEN 2 THEN c_custkey % 7 ELSE 0 END)::DOUBLE",
            "pumpfun_score": "CASE WHEN c_custkey % 3 = 0 THEN abs(c_acctbal) ELSE 0 END",
            "age_seconds": "(CASE WHEN c_custkey % 3 = 1 THEN c_custkey * 10 ELSE 0 END)::DOUBLE",
            "marketcap": "CASE WHEN c_custkey % 3 = 2 THEN abs(c_acctbal) ELSE 0 END"}) + " FROM customer")),
    "parse_hot_pairs": (parse_hot_pairs, sql(
        "SELECT 'H' || c_custkey AS symbol, " + _r({
            "marketcap": "abs(c_acctbal)", "liquidityusd": "CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal) / 2 ELSE 0 END",
            "volumeusd": "abs(c_acctbal) * 3", "dex_score": "0::DOUBLE"}) + " FROM customer")),
    "parse_pool": (parse_pool, sql(
        "SELECT c_name AS symbol, " + _r({
            "price": "CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) ELSE 0 END", "volumeusd": "abs(c_acctbal) * 4",
            "liquidityusd": "0::DOUBLE"}) + " FROM customer")),
    "parse_fundamentals": (parse_fundamentals, sql(
        "SELECT c_name AS symbol, " + _r({
            "marketcap": "abs(c_acctbal)", "liquidityusd": "0::DOUBLE", "price": "abs(c_acctbal) / 3",
            "holders": "(c_custkey % 500)::DOUBLE",
            "tradecount": "(CASE WHEN c_custkey % 6 <> 0 THEN 3 * (c_custkey % 10) + 6 ELSE 0 END)::DOUBLE",
            "trade_amount": "CASE WHEN c_custkey % 6 <> 0 THEN abs(c_acctbal) * 6 ELSE 0 END"}) + " FROM customer")),
    "training_table": (training_table, sql(
        "SELECT " + _r({
            "alpha_target": "p_size / 50.0 - 0.5", "recency": "exp(-p_size / 10.0)", "marketCap": "p_retailprice * 1000",
            "volumeUSD": "p_retailprice * 20", "holders": "p_size::DOUBLE", "tradeCount": "(p_partkey % 100)::DOUBLE"})
        + ", true AS velocity_missing FROM part")),
    "upsert_candles": (upsert_candles, sql(
        f"SELECT {CANDLE_OUT} FROM (SELECT * FROM versions UNION ALL SELECT *, 0 FROM (SELECT exchange, symbol, open_time,"
        " trades_count, open, high, low, close, volume FROM stored))"
        " QUALIFY row_number() OVER (PARTITION BY exchange, symbol, open_time ORDER BY arrival DESC) = 1",
        "candles", ctes=BATCH_CTES)),
    "insert_ignore": (insert_ignore, sql(
        f"SELECT {CANDLE_OUT} FROM (SELECT * FROM versions UNION ALL SELECT *, 0 FROM (SELECT exchange, symbol, open_time,"
        " trades_count, open, high, low, close, volume FROM stored))"
        " QUALIFY row_number() OVER (PARTITION BY exchange, symbol, open_time ORDER BY arrival) = 1",
        "candles", ctes=BATCH_CTES)),
    "followed_wallets": (followed_wallets, sql(
        "SELECT c_custkey AS id, c_mktsegment AS chain, c_name AS address,"
        " CASE WHEN c_custkey % 2 = 0 THEN 'new-w' || c_nationkey ELSE 'w' || c_nationkey END AS label,"
        " CASE WHEN c_custkey = 5 THEN NOT (c_acctbal > 0) ELSE c_custkey % 2 = 0 OR c_acctbal > 0 END AS is_active"
        " FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")),
    "replace_slice": (replace_slice, SLICE_SQL),
    "replace_slice_merge": (replace_slice_merge, SLICE_SQL),
    "rebuild_spread": (rebuild_spread, sql(
        "SELECT a.exchange, a.symbol || '/' || b.symbol AS pair, a.open_time AS ts, " + _r({
            "spread_log": "ln(a.close / b.close)", "leg1_volume": "a.volume", "leg2_volume": "b.volume"})
        + " FROM candles a JOIN candles b ON a.open_time = b.open_time WHERE (a.symbol, b.symbol) IN"
          " (('CLICK', 'VIEW'), ('SIGNUP', 'VIEW'), ('VIEW', 'ERROR'))", "candles")),
    "replace_positions": (replace_positions, sql(
        "SELECT portfolio_id, symbol, round(CASE WHEN portfolio_id % 3 = 0 THEN quantity * 2 ELSE quantity END, 6) + 0.0"
        " AS quantity FROM positions WHERE portfolio_id % 3 <> 0 OR symbol NOT IN ('ERROR', 'VIEW')", "positions")),
    "retention": (retention, sql(
        "SELECT metric_id, metric_time FROM token_metrics WHERE metric_time >="
        " (SELECT max(metric_time) FROM token_metrics) - INTERVAL 14 DAY", "token_metrics")),
    "get_or_create": (get_or_create, sql(
        "SELECT id, symbol, left(symbol, length(symbol) - 4) AS base_asset, right(symbol, 4) AS quote_asset FROM ("
        "SELECT p_partkey AS id, symbol FROM names WHERE p_partkey % 3 = 0 UNION ALL"
        " SELECT (SELECT max(p_partkey) FROM names WHERE p_partkey % 3 = 0) + row_number() OVER (ORDER BY left(md5(symbol), 3), symbol),"
        " symbol"
        " FROM names WHERE p_partkey % 3 <> 0)",
        ctes={"names": "SELECT upper(p_brand || '-' || p_partkey) AS symbol, p_partkey FROM part"})),
    "seed_timeframes": (seed_timeframes, sql(
        "SELECT DISTINCT n || u AS code, CAST(CASE u WHEN 'm' THEN n ELSE n * 60 END AS INT) AS granularity_minutes,"
        " 'every ' || n || u AS label FROM (SELECT hour(trade_time) % 5 + 1 AS n,"
        " CASE WHEN hour(trade_time) < 12 THEN 'm' ELSE 'h' END AS u FROM trades)", "trades")),
    "append_signals": (append_signals, sql(
        "SELECT CAST(token_id AS VARCHAR) AS symbol, CASE WHEN price_change_1h > 0 THEN 'BUY' WHEN price_change_1h < 0 THEN 'SELL'"
        " ELSE 'HOLD' END AS direction, updated_at AS created_at, " + _r({
            "confidence": "pump_probability", "marketcap": "marketcap"}) + ", true AS alpha_missing FROM token_live", "token_live")),
    "resume_points": (resume_points, sql(
        "SELECT w.symbol, w.interval_code, coalesce(l.t, w.listed_at, TIMESTAMP '2019-01-01') AS start_at,"
        " l.t IS NOT NULL AS resumed, coalesce(epoch_ms(l.t), -1) AS last_open_ms FROM (SELECT DISTINCT symbol, interval_code, NULL::TIMESTAMP AS listed_at FROM candles"
        " UNION ALL SELECT upper(n_name), '1h', CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2023-06-01' END FROM nation) w"
        " LEFT JOIN (SELECT symbol, interval_code, max(open_time) AS t FROM candles GROUP BY ALL) l USING (symbol, interval_code)",
        "candles")),
    "fetch_slices": (fetch_slices, sql(
        "SELECT symbol, interval_code, t AS slice_start, least(t + INTERVAL 99 HOUR, hi) AS slice_end FROM ("
        "SELECT symbol, interval_code, hi, unnest(generate_series(lo, hi, INTERVAL 100 HOUR)) AS t FROM ("
        "SELECT symbol, interval_code, min(open_time) AS lo, max(open_time) AS hi FROM candles GROUP BY ALL))", "candles")),
}
