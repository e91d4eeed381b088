"""Landed JSON payloads to typed rows.

Each reader takes a DataFrame with a JSON text column and gives typed columns.
Parsing is `from_json` with explicit schemas and `try_cast`, so a bad field
becomes NULL instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.math import number, satoshi_to_coin, token_units
from tickloom.functions.text import first_text
from tickloom.functions.times import millis_to_timestamp
from tickloom.operators.blocks import newest_rows

# Positions of the fields in array-coded candles.
KLINE_POSITIONS = {
    "open_ms": 0, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "close_ms": 6, "quote_volume": 7,
    "trades_count": 8, "taker_buy_base_volume": 9, "taker_buy_quote_volume": 10,
}
ALT_POSITIONS = {"open_s": 0, "low": 1, "high": 2, "open": 3, "close": 4, "volume": 5}
KLINE_FIELDS = 11

# Short field names of the stream envelopes.
# The candle is a map: its keys differ by case only (t/T, v/V, q/Q).
KLINE_STREAM_SCHEMA = "struct<data:struct<e:string,k:map<string,string>>>"
TRADE_STREAM_SCHEMA = "struct<data:struct<s:string,p:string,q:string,m:boolean,T:bigint>>"
MEMPOOL_SCHEMA = """struct<txid:string,value:string,vin:array<struct<prevout:struct<scriptpubkey_address:string>>>,
    vout:array<struct<scriptpubkey_address:string>>>"""
TRANSFER_SCHEMA = """struct<result:array<struct<hash:string,`from`:string,`to`:string,value:string,tokenDecimal:string,
    timeStamp:string,contractAddress:string>>>"""
DEX_SCHEMA = """struct<pairs:array<struct<fdv:string,age:string,score:string,priceUsd:string,dexId:string,
    baseToken:struct<symbol:string>,liquidity:struct<usd:string>,volume:struct<h24:string>,
    txns:struct<h24:struct<buys:string,sells:string>,h1:struct<buys:string>,m5:struct<buys:string,sells:string>>>>>"""
TRENDING_ITEM = """struct<ticker:string,symbol:string,token:string,name:string,holders:string,holder_count:string,
    score:string,age_seconds:string,age:string,market_cap:string,marketCapUsd:string,liquidity_usd:string,
    volume_usd_24h:string,volumeUsd:string>"""
HOT_SCHEMA = "struct<data:array<struct<symbol:string,marketCap:string,liquidity:string,volume24h:string,score:string>>>"
POOL_SCHEMA = "struct<price:string,volume24h:string,liquidity:string>"
FUNDAMENTALS_SCHEMA = """struct<data:struct<Solana:struct<
    TokenMarket:array<struct<marketCap:string,liquidityUSD:string,volumeUSD:string,price:string>>,
    TokenHolderStats:array<struct<addressCount:string>>,
    DEXTrade:array<struct<count:string,tradeAmount:string>>>>>"""

# Token contracts and their symbols.
TOKEN_CONTRACTS = {
    "0x3449fc1cd036255ba1eb19d65ff4baa2a6ea0c54": "ONDO",
    "0xefd6c9fb2108c48c59a386680f3c75e0b43b37f0": "PYUSD",
    "0xaeaee2e6eb474d4bf4a6a2f8e8ad3a4d8f23d5a9": "POLYX",
    "0x4d5c9048ba2f2eea5fb8c0d24dd47cebbf2b5e83": "USDM",
    "0x8dd8b094a548df29359f6f8f6f792c42f04238b4": "EURC",
}


def _typed(item: Column, positions: Mapping[str, int], ints: Sequence[str]) -> dict[str, Column]:
    return {n: F.get(item, F.lit(i)).try_cast("long" if n in ints else "double") for n, i in positions.items()}


def read_klines(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Array-coded candles: one row per array item, with `valid` and the raw item.

    `df` carries exchange, symbol and interval_code beside the payload. A row is
    valid with at least 11 fields that all cast.
    """
    items = df.withColumn("_k", F.explode(F.from_json(payload, "array<array<string>>")))
    cells = _typed(F.col("_k"), KLINE_POSITIONS, ("open_ms", "close_ms", "trades_count"))
    whole = (F.size("_k") >= KLINE_FIELDS)
    for c in cells.values():
        whole = whole & c.isNotNull()
    return items.select(
        F.lower("exchange").alias("exchange"), F.upper("symbol").alias("symbol"), "interval_code",
        millis_to_timestamp(cells["open_ms"]).alias("open_time"),
        millis_to_timestamp(cells["close_ms"]).alias("close_time"),
        *[cells[n].alias(n) for n in ("open", "high", "low", "close", "volume", "quote_volume")],
        cells["trades_count"].cast("int").alias("trades_count"),
        cells["taker_buy_base_volume"].alias("taker_buy_base_volume"),
        cells["taker_buy_quote_volume"].alias("taker_buy_quote_volume"),
        F.lit(True).alias("is_closed"), whole.alias("valid"), F.to_json("_k").alias("raw"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("valid").drop("valid", "raw")


def quarantined(rows: DataFrame, keep: Sequence[str] = ("exchange", "symbol", "interval_code")) -> DataFrame:
    return rows.where(~F.col("valid")).select(*keep, "raw")


def read_candles_alt(df: DataFrame, payload: str = "payload", last: int | None = None) -> DataFrame:
    """Candles coded (seconds, low, high, open, close, volume); newest `last` per symbol."""
    items = df.withColumn("_k", F.explode(F.from_json(payload, "array<array<string>>")))
    cells = _typed(F.col("_k"), ALT_POSITIONS, ("open_s",))
    at = millis_to_timestamp(cells["open_s"] * 1000)
    rows = items.select("exchange", "symbol", "interval_code", at.alias("open_time"), at.alias("close_time"),
                        *[cells[n].alias(n) for n in ("open", "high", "low", "close", "volume")])
    if last is None:
        return rows
    keys = ["exchange", "symbol", "interval_code"]
    return newest_rows(rows, keys, ["open_time"], last).drop("age")


def read_kline_stream(df: DataFrame, payload: str = "payload", exchange: str = "binance") -> DataFrame:
    """Candle updates of a stream envelope; other event kinds are skipped. Works on streams."""
    e = df.withColumn("_e", F.from_json(payload, KLINE_STREAM_SCHEMA)["data"]).where(F.col("_e.e") == "kline")
    k = F.col("_e.k")
    names = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "quote_volume": "q"}
    return e.select(
        F.lit(exchange).alias("exchange"), F.upper(k["s"]).alias("symbol"), k["i"].alias("interval_code"),
        millis_to_timestamp(k["t"]).alias("open_time"), millis_to_timestamp(k["T"]).alias("close_time"),
        *[k[s].try_cast("double").alias(n) for n, s in names.items()],
        k["n"].try_cast("int").alias("trades_count"),
        k["V"].try_cast("double").alias("taker_buy_base_volume"),
        k["Q"].try_cast("double").alias("taker_buy_quote_volume"),
        k["x"].try_cast("boolean").alias("is_closed"),
        *[c for c in ("arrived_at", "arrival_id") if c in df.columns],
    )


def read_agg_trades(df: DataFrame, payload: str = "payload", min_notional: float = 10_000,
                    clock: Column | None = None) -> DataFrame:
    """Trades of a stream envelope with notional at least `min_notional`.

    Price and size default to 0; a buyer-maker trade is a SELL; a missing time
    is the clock's. Works on streams.
    """
    e = df.withColumn("_t", F.from_json(payload, TRADE_STREAM_SCHEMA)["data"]).where(F.col("_t").isNotNull())
    t = F.col("_t")
    price, size = number(t["p"]), number(t["q"])
    at = F.when(t["T"] != 0, F.timestamp_millis(t["T"]))
    return e.select(
        t["s"].alias("symbol"),
        F.coalesce(at, F.current_timestamp() if clock is None else clock).alias("tx_time"),
        F.when(t["m"], "SELL").otherwise("BUY").alias("side"),
        price.alias("price"), size.alias("quantity"), (price * size).alias("notional_usd"),
        F.lit(None).cast("double").alias("success_rate"),
    ).where(F.col("notional_usd") >= min_notional)


def read_mempool(df: DataFrame, payload: str = "payload", usd_price: float | Column = 40_000.0, chain: str = "btc",
                 asset: str = "BTC") -> DataFrame:
    """Unconfirmed transactions: satoshi value, first input and output address."""
    t = F.from_json(payload, MEMPOOL_SCHEMA)
    price = usd_price if isinstance(usd_price, Column) else F.lit(float(usd_price))
    e = df.withColumn("_t", t)
    amount = satoshi_to_coin(number(F.col("_t.value")))
    return e.select(
        F.lit(chain).alias("chain"),
        F.coalesce(F.get(F.col("_t.vin"), F.lit(0))["prevout"]["scriptpubkey_address"], F.lit("")).alias("wallet_from"),
        F.coalesce(F.get(F.col("_t.vout"), F.lit(0))["scriptpubkey_address"], F.lit("")).alias("wallet_to"),
        F.lit(asset).alias("asset"), amount.alias("amount"), (amount * price).alias("amount_usd"),
        F.lit("unknown").alias("direction"), F.col("_t.txid").alias("tx_hash"),
    )


def contract_symbol(contract: Column, contracts: Mapping[str, str] = TOKEN_CONTRACTS) -> Column:
    """Symbol of a contract by a small constant map; unknown contracts give NULL."""
    pairs = [F.lit(x) for kv in contracts.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(contract))


def read_token_transfers(df: DataFrame, payload: str = "payload", newest: int = 5,
                         contracts: Mapping[str, str] | None = TOKEN_CONTRACTS, usd_price: float = 1.0) -> DataFrame:
    """Newest transfers per contract with amounts in token units.

    Contracts outside the map are skipped; `contracts=None` keeps every
    contract under its own address.
    """
    t = df.select(F.explode(F.from_json(payload, TRANSFER_SCHEMA)["result"]).alias("t"))
    amount = token_units("t.value", "t.tokenDecimal")
    contract = F.lower("t.contractAddress")
    rows = t.select(
        contract.alias("contract"),
        (contract if contracts is None else contract_symbol(F.col("t.contractAddress"), contracts)).alias("token"),
        F.col("t.from").alias("wallet_from"), F.col("t.to").alias("wallet_to"), amount.alias("amount"),
        (amount * usd_price).alias("amount_usd"), F.timestamp_seconds(F.col("t.timeStamp").try_cast("long")).alias("ts"),
        F.col("t.hash").alias("tx_hash"),
    ).where(F.col("token").isNotNull() & F.col("contract").isNotNull())
    return newest_rows(rows, ["contract"], ["ts", "tx_hash"], newest).drop("age")


def read_dex_pairs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """First pair of a search answer; missing numbers are 0, no pairs means no row."""
    e = df.withColumn("_p", F.get(F.from_json(payload, DEX_SCHEMA)["pairs"], F.lit(0))).where(F.col("_p").isNotNull())
    p = F.col("_p")
    return e.select(
        "symbol",
        number(p["fdv"]).alias("marketcap"), number(p["liquidity"]["usd"]).alias("liquidityusd"),
        number(p["volume"]["h24"]).alias("volumeusd"),
        (number(p["txns"]["h24"]["buys"]) + number(p["txns"]["h24"]["sells"])).alias("tradecount"),
        number(p["txns"]["m5"]["buys"]).alias("buys_5m"), number(p["txns"]["m5"]["sells"]).alias("sells_5m"),
        number(p["age"]).alias("age_seconds"), number(p["score"]).alias("dex_score"),
        number(p["priceUsd"]).alias("price"), F.coalesce(p["baseToken"]["symbol"], "symbol").alias("base_token"),
        p["dexId"].alias("dex"),
    )


def read_dex_trending(df: DataFrame, payload: str = "payload") -> DataFrame:
    """All pairs of a trending answer, one row each."""
    p = F.col("_p")
    return df.select(F.explode(F.from_json(payload, DEX_SCHEMA)["pairs"]).alias("_p")).select(
        p["baseToken"]["symbol"].alias("symbol"), number(p["fdv"]).alias("marketcap"),
        number(p["liquidity"]["usd"]).alias("liquidityusd"), number(p["volume"]["h24"]).alias("volumeusd"),
        number(p["txns"]["h1"]["buys"]).alias("bitquery_score"))


def read_trending(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Trending lists under `trending`, `tokens`, `result.data.json` or the root.

    The symbol is the first non-empty of ticker, symbol, token; missing numbers are 0.
    """
    wrapped = F.from_json(payload, f"""struct<trending:array<{TRENDING_ITEM}>,tokens:array<{TRENDING_ITEM}>,
        result:struct<data:struct<json:array<{TRENDING_ITEM}>>>>""")
    root = F.from_json(payload, f"array<{TRENDING_ITEM}>")
    is_list = F.substring(F.ltrim(payload), 1, 1) == "["
    e = df.withColumn("_w", wrapped).withColumn("_c", F.explode(
        F.when(is_list, root).otherwise(F.coalesce("_w.trending", "_w.tokens", "_w.result.data.json"))))
    c = F.col("_c")
    return e.select(
        first_text(c["ticker"], c["symbol"], c["token"]).alias("symbol"), c["name"].alias("name"),
        number(F.coalesce(c["holders"], c["holder_count"])).alias("holders"), number(c["score"]).alias("pumpfun_score"),
        number(F.coalesce(c["age_seconds"], c["age"])).alias("age_seconds"),
        number(F.coalesce(c["market_cap"], c["marketCapUsd"])).alias("marketcap"),
        number(c["liquidity_usd"]).alias("liquidityusd"),
        number(F.coalesce(c["volume_usd_24h"], c["volumeUsd"])).alias("volumeusd"))


def read_hot_pairs(df: DataFrame, payload: str = "payload") -> DataFrame:
    h = F.col("_h")
    return df.select(F.explode(F.from_json(payload, HOT_SCHEMA)["data"]).alias("_h")).select(
        h["symbol"].alias("symbol"), number(h["marketCap"]).alias("marketcap"), number(h["liquidity"]).alias("liquidityusd"),
        number(h["volume24h"]).alias("volumeusd"), number(h["score"]).alias("dex_score"))


def read_pool(df: DataFrame, payload: str = "payload") -> DataFrame:
    p = F.from_json(payload, POOL_SCHEMA)
    return df.withColumn("_p", p).select(
        "symbol", number("_p.price").alias("price"), number("_p.volume24h").alias("volumeusd"),
        number("_p.liquidity").alias("liquidityusd"))


def read_fundamentals(df: DataFrame, payload: str = "payload") -> DataFrame:
    """First market row, holder count and summed trades; everything defaults to 0."""
    e = df.withColumn("_s", F.from_json(payload, FUNDAMENTALS_SCHEMA)["data"]["Solana"])
    market, holders = F.get(F.col("_s.TokenMarket"), F.lit(0)), F.get(F.col("_s.TokenHolderStats"), F.lit(0))

    def total(field: str) -> Column:
        return F.coalesce(F.aggregate("_s.DEXTrade", F.lit(0.0), lambda a, t: a + number(t[field])), F.lit(0.0))

    return e.select(
        "symbol", number(market["marketCap"]).alias("marketcap"), number(market["liquidityUSD"]).alias("liquidityusd"),
        number(market["volumeUSD"]).alias("volumeusd"), number(market["price"]).alias("price"),
        number(holders["addressCount"]).alias("holders"), total("count").alias("tradecount"),
        total("tradeAmount").alias("trade_amount"))
