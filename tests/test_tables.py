"""Upserts, inserts, retention and keys; payload readers on damaged input."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tickloom.operators import candles, tables
from tickloom.operators.blocks import block_seconds_for, time_block, with_position
from tickloom.operators.tokens import merge_feeds
from tickloom.sources import payloads
from tickloom.sources import tables as table_sources

T0 = dt.datetime(2024, 1, 1)
KEY = ["exchange", "symbol"]


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_merge_latest_and_first(spark):
    ddl = "exchange string, symbol string, close double"
    old = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0)], ddl)
    batch = spark.createDataFrame([("x", "b", 5.0, 1), ("x", "b", 6.0, 2), ("x", "c", 7.0, 1), ("x", "c", None, 0)], ddl + ", n int")
    latest = tables.merge_latest(old, batch, KEY, ["n"])
    assert rows(latest, "symbol", "close") == {("a", 1.0), ("b", 6.0), ("c", 7.0)}
    assert rows(tables.merge_latest(latest, batch, KEY, ["n"]), "symbol", "close") == rows(latest, "symbol", "close")
    first = tables.merge_first(old, batch, KEY, ["n"])
    assert rows(first, "symbol", "close") == {("a", 1.0), ("b", 2.0), ("c", None)}
    assert rows(tables.merge_first(first, batch, KEY, ["n"]), "symbol", "close") == rows(first, "symbol", "close")


def test_upsert_table_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "symbol string, close double, day string"
    tables.write_table(spark.createDataFrame([("a", 1.0, "d1"), ("b", 2.0, "d2")], ddl), path, ["day"])
    before = sorted(p.name for p in (tmp_path / "t" / "day=d1").iterdir())
    batch = spark.createDataFrame([("b", 9.0, "d2"), ("c", 3.0, "d3")], ddl)
    for _ in range(2):
        tables.upsert_table(spark, path, batch, ["symbol", "day"], ["day"])
    got = spark.read.schema(ddl).parquet(path)
    assert rows(got, "symbol", "close") == {("a", 1.0), ("b", 9.0), ("c", 3.0)} and got.count() == 3
    assert sorted(p.name for p in (tmp_path / "t" / "day=d1").iterdir()) == before


def test_upsert_keeps_null_partitions_and_null_keys(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "symbol string, close double, day string"
    tables.write_table(spark.createDataFrame([("a", 1.0, None), ("b", 2.0, "d2"), ("d", 4.0, "d1"), (None, 5.0, None)], ddl), path, ["day"])
    batch = spark.createDataFrame([("c", 3.0, None), ("b", 9.0, "d2"), (None, 6.0, None)], ddl)
    for _ in range(2):
        tables.upsert_table(spark, path, batch, ["symbol", "day"], ["day"])
    got = spark.read.schema(ddl).parquet(path)
    want = {("a", 1.0, None), ("b", 9.0, "d2"), ("c", 3.0, None), ("d", 4.0, "d1"), (None, 6.0, None)}
    assert rows(got, "symbol", "close", "day") == want and got.count() == 5


def test_insert_or_ignore_appends_only_new_rows(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "symbol string, close double, day string"
    tables.write_table(spark.createDataFrame([("a", 1.0, "d1"), (None, 2.0, None)], ddl), path, ["day"])
    before = sorted(str(p) for p in (tmp_path / "t").rglob("*.parquet"))
    batch = spark.createDataFrame([("a", 7.0, "d1"), (None, 8.0, None), ("e", 3.0, "d1"), ("f", 4.0, None)], ddl)
    for _ in range(2):
        tables.upsert_table(spark, path, batch, ["symbol", "day"], ["day"], ignore_existing=True)
    got = spark.read.schema(ddl).parquet(path)
    assert rows(got, "symbol", "close") == {("a", 1.0), (None, 2.0), ("e", 3.0), ("f", 4.0)} and got.count() == 4
    assert set(before) <= {str(p) for p in (tmp_path / "t").rglob("*.parquet")}


def test_selective_merge(spark):
    old = spark.createDataFrame([(1, "eth", "0x1", "old", False), (2, "eth", "0x2", "keep", True)],
                                "id long, chain string, address string, label string, is_active boolean")
    batch = spark.createDataFrame([("eth", "0x1", None, 9), ("sol", "0x3", "new", 10)], "chain string, address string, label string, id long")
    got = tables.merge_columns(old, batch, ["chain", "address"], ["label"], {"is_active": F.lit(True)})
    assert rows(got, "id", "address", "label", "is_active") == {
        (1, "0x1", None, True), (2, "0x2", "keep", True), (10, "0x3", "new", True)}
    assert rows(tables.toggle(got, "is_active", F.col("id") == 2), "id", "is_active") == {(1, True), (2, False), (10, True)}


def test_children_slices_retention(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0)], "portfolio_id long, symbol string, quantity double")
    new = spark.createDataFrame([(1, "z", 2.0), (1, "", 5.0), (1, "q", 0.0), (1, None, 1.0), (3, "", 1.0)], old.schema)
    assert rows(tables.replace_children(old, new), "portfolio_id", "symbol") == {(1, "z"), (2, "c")}
    assert rows(tables.replace_slices(old, new.where("portfolio_id = 3"), ["portfolio_id"]), "portfolio_id", "symbol") \
        == {(1, "a"), (1, "b"), (2, "c"), (3, "")}
    ts = spark.createDataFrame([(T0,), (T0 - dt.timedelta(days=14),), (T0 - dt.timedelta(days=14, seconds=1),)], "ts timestamp")
    assert tables.retain(ts, "ts", F.lit(T0)).count() == 2


def test_get_or_create(spark):
    dim = spark.createDataFrame([(7, "B")], "id long, symbol string")
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("A",), ("",), ("AB",)], "symbol string")
    got = tables.get_or_create(dim, names)
    keys = dict(rows(got, "symbol", "id"))
    assert keys["B"] == 7 and sorted(keys.values()) == [7, 8, 9, 10] and set(keys) == {"A", "AB", "B", "C"}
    assert rows(tables.get_or_create(got, names), "id", "symbol") == rows(got, "id", "symbol")
    empty = tables.get_or_create(dim.where("false"), names.where("symbol = 'C'"))
    assert rows(empty, "id", "symbol") == {(1, "C")}


def test_pair_spread_needs_both_legs_of_one_exchange(spark):
    c = spark.createDataFrame(
        [("x", "A", "1h", T0, 2.0, 1.0), ("x", "B", "1h", T0, 1.0, 3.0), ("y", "A", "1h", T0, 5.0, 1.0),
         ("x", "A", "15m", T0, 5.0, 1.0), ("x", "A", "1h", T0 + dt.timedelta(hours=1), 5.0, 1.0)],
        "exchange string, symbol string, interval_code string, open_time timestamp, close double, volume double")
    got = candles.pair_spread(c, [("A", "B"), ("B", "A")], "1h").collect()
    assert {(r["exchange"], r["pair"], round(r["spread_log"], 6), r["leg1_volume"], r["leg2_volume"]) for r in got} == {
        ("x", "A/B", 0.693147, 1.0, 3.0), ("x", "B/A", -0.693147, 3.0, 1.0)}


def kline(close="1.5", n=11):
    return ["1704067200000", "1", "2", "0.5", close, "10", "1704070799999", "15", "7", "4", "6"][:n]


def test_damaged_klines(spark):
    body = [json.dumps([kline(), kline("text"), kline(n=10), [*kline(), "ignored"]]), None, "[]", "not json"]
    df = spark.createDataFrame([("BINANCE", "btcusdt", "1h", b) for b in body], "exchange string, symbol string, interval_code string, payload string")
    parsed = payloads.read_klines(df)
    good = payloads.accepted(parsed).collect()
    assert len(good) == 2 and {(r["exchange"], r["symbol"], r["close"], r["trades_count"]) for r in good} == {("binance", "BTCUSDT", 1.5, 7)}
    assert payloads.quarantined(parsed).count() == 2
    # one spelling of the exchange, so the natural key removes the copy
    assert tables.merge_first(payloads.accepted(parsed).where("false"), payloads.accepted(parsed), candles.CANDLE_KEY, []).count() == 1


def test_kline_stream_keeps_case_apart(spark):
    k = {"s": "btcusdt", "i": "1h", "t": 1704067200000, "T": 1704070799999, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10",
         "q": "15", "n": 7, "V": "4", "Q": "6", "x": False}
    bodies = [{"data": {"e": "kline", "k": k}}, {"data": {"e": "trade", "k": k}}, {"result": None}]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "payload string")
    (r,) = payloads.read_kline_stream(df).collect()
    assert (r["symbol"], r["volume"], r["taker_buy_base_volume"], r["quote_volume"], r["taker_buy_quote_volume"]) == ("BTCUSDT", 10, 4, 15, 6)
    assert r["close_time"] - r["open_time"] == dt.timedelta(milliseconds=3599999) and r["is_closed"] is False


def test_agg_trade_rules(spark):
    bodies = [{"data": {"s": "A", "p": "100", "q": "100", "m": True, "T": 1704067200000}},
              {"data": {"s": "B", "p": "99.99", "q": "100", "m": True, "T": 1}}, {"data": {"s": "C", "q": "100"}},
              {"data": {"s": "D", "p": "1000", "q": "100"}}, {"data": None}]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "payload string")
    got = payloads.read_agg_trades(df, clock=F.lit(T0)).orderBy("symbol").collect()
    assert [(r["symbol"], r["side"], r["notional_usd"]) for r in got] == [("A", "SELL", 10000.0), ("D", "BUY", 100000.0)]
    assert got[1]["tx_time"] == T0


def test_transfers_unknown_contract(spark):
    txs = [{"hash": f"h{i}", "from": "a", "to": "b", "value": "2500000", "tokenDecimal": "6", "timeStamp": str(1704067200 + i),
            "contractAddress": c} for i in range(7) for c in (list(payloads.TOKEN_CONTRACTS)[0].upper().replace("0X", "0x"), "0xother")]
    df = spark.createDataFrame([(json.dumps({"result": txs}),)], "payload string")
    got = payloads.read_token_transfers(df).collect()
    assert {r["tx_hash"] for r in got} == {f"h{i}" for i in range(2, 7)} and {(r["token"], r["amount"]) for r in got} == {("ONDO", 2.5)}
    assert payloads.read_token_transfers(df, contracts=None).count() == 10


def test_empty_dex_answers(spark):
    df = spark.createDataFrame([("a", "{}"), ("b", '{"pairs":[]}'), ("c", '{"pairs":[{"fdv":"12"}]}'), ("d", None)], "symbol string, payload string")
    (r,) = payloads.read_dex_pairs(df).collect()
    assert (r["symbol"], r["marketcap"], r["liquidityusd"], r["base_token"]) == ("c", 12.0, 0.0, "c")


def test_trending_feeds_merge(spark):
    one = spark.createDataFrame([('{"tokens":[{"symbol":"A","market_cap":5,"holder_count":3,"score":1}]}',)], "payload string")
    two = spark.createDataFrame([('{"data":[{"symbol":"A","marketCap":7,"score":2},{"symbol":"","score":2}]}',)], "payload string")
    three = spark.createDataFrame([('{"pairs":[{"baseToken":{"symbol":"B"},"fdv":9,"txns":{"h1":{"buys":4}}}]}',)], "payload string")
    merged = merge_feeds([
        payloads.read_trending(one).select("symbol", "marketcap", "liquidityusd", "volumeusd", "holders", "pumpfun_score"),
        payloads.read_hot_pairs(two), payloads.read_dex_trending(three)])
    got = {r["symbol"]: r.asDict() for r in merged.collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["marketcap"], got["A"]["holders"], got["A"]["dex_score"], got["A"]["bitquery_score"]) == (7, 3, 2, None)
    assert (got["B"]["marketcap"], got["B"]["holders"], got["B"]["bitquery_score"]) == (9, None, 4)


def test_rows_without_time_come_first(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", T0, 2), ("a", T0 + dt.timedelta(days=3), 3)], "k string, ts timestamp, n int")
    got = with_position(df, ["k"], ["ts"], time_block("ts", 86400))
    assert rows(got, "n", "pos", "n_rows") == {(1, 0, 3), (2, 1, 3), (3, 2, 3)}


def test_block_width_follows_the_densest_hour(spark):
    df = spark.range(7200).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    assert block_seconds_for(df, ["k"], "ts", target_rows=36_000) == 36_000
    assert block_seconds_for(df, ["k"], "ts", target_rows=1) == 60


def test_slices_cover_the_span(spark):
    w = spark.createDataFrame([("A", "15m", T0, T0 + dt.timedelta(minutes=15 * 2500)), ("B", "15m", T0, T0 - dt.timedelta(minutes=1)),
                               ("C", "1h", T0, T0)], "symbol string, interval_code string, start_at timestamp, end_at timestamp")
    got = table_sources.fetch_slices(w).orderBy("symbol", "slice_start").collect()
    a = [r for r in got if r["symbol"] == "A"]
    assert len(a) == 3 and a[0]["slice_end"] + dt.timedelta(minutes=15) == a[1]["slice_start"]
    assert a[-1]["slice_end"] == T0 + dt.timedelta(minutes=15 * 2500)
    assert [r["symbol"] for r in got if r["symbol"] != "A"] == ["C"]
