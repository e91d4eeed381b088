"""Indicators, cooldown, subscriptions, copy trades, outcomes, regimes and stored retention against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import cooldown, indicators, lots, outcomes, regimes, subscriptions, tables, text_index, trending
from tickloom.operators.asof import first_at_or_after

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- forward as-of ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_seconds", [None, 60, 600])
def test_first_row_at_or_after(spark, block_seconds):
    rng = random.Random(3)
    prices = [(k, at(rng.randrange(0, 300)), i, float(i)) for i, k in enumerate(["a"] * 60 + ["b"] * 3)] + [("a", None, 900, 1.0)]
    probes = [(k, at(rng.randrange(-50, 350)), i) for i, k in enumerate(["a"] * 50 + ["b"] * 20 + ["c"])] + [("a", None, 901)]
    got = first_at_or_after(spark.createDataFrame(probes, "k string, t timestamp, n int").repartition(3),
                            spark.createDataFrame(prices, "k string, ts timestamp, id int, price double").repartition(3),
                            ["k"], F.col("t"), "ts", "id", ["id", "price"], block_seconds=block_seconds)
    want = []
    for k, t, n in probes:
        later = [(ts, i, p) for key, ts, i, p in prices if key == k and t and ts and ts >= t]
        want.append((k, t, n, None if not later else (min(later)[1], min(later)[2])))
    got = [(r["k"], r["t"], r["n"], None if r["found"] is None else tuple(r["found"])) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- cooldown -----------------------------------------------------------------------------------------------

def thinned(alerts, minutes):
    last, out = {}, []
    for key, t, i in sorted((a for a in alerts if a[1] is not None), key=lambda a: (a[0], a[1], a[2])):
        if key not in last or t >= last[key] + dt.timedelta(minutes=minutes):
            last[key] = t
            out.append((key, t, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [1, 7, 65_536])
def test_cooldown_is_the_greedy_loop(spark, block_rows):
    rng = random.Random(block_rows)
    alerts = [(1, at(rng.randrange(0, 900)), i) for i in range(400)]  # a hot key, many ties
    alerts += [(2, at(10 * i), 1000 + i) for i in range(40)]  # exactly one cooldown apart
    alerts += [(3, at(5), 2000), (4, None, 2001), (3, None, 2002)] + [(5, at(7), 3000 + i) for i in range(30)]
    df = spark.createDataFrame(alerts, "token_id long, metric_time timestamp, metric_id long").repartition(4)
    got = rows(cooldown.thin(df, 600, block_rows=block_rows).select("token_id", "metric_time", "metric_id"))
    assert got == thinned(alerts, 10)
    assert len([r for r in got if r[0] == 2]) == 40 and len([r for r in got if r[0] == 5]) == 1


def test_cooldown_of_nothing(spark):
    empty = spark.createDataFrame([], "token_id long, metric_time timestamp, metric_id long")
    assert rows(cooldown.thin(empty, 600)) == []
    with pytest.raises(ValueError, match="cooldown"):
        cooldown.thin(empty, 0)


def test_spikes_at_their_limits(spark):
    ticks = [(1, at(i), i, p, v) for i, (p, v) in enumerate([(1.0, 1.0), (1.25, 1.0), (1.5, 3.0), (1.5, 5.0), (0.0, 1.0), (2.0, 0.0)])]
    ticks += [(2, at(i), 10 + i, p, v) for i, (p, v) in enumerate([(1.0, None), (1.0, 9.0), (None, 9.0), (4.0, 26.9), (5.0, 1.0)])]
    df = spark.createDataFrame(ticks, "token_id long, metric_time timestamp, metric_id long, price double, volume double")
    got = {r["metric_id"]: (r["price_rise"], r["volume_ratio"]) for r in cooldown.spikes(df).collect()}
    # 1.25 is a rise of a quarter; 3.0 is three times the mean of 1 and 1; 14 rises by a quarter from 4.
    assert set(got) == {1, 2, 3, 14} and got[1][0] == 0.25 and got[2][1] == 3.0
    assert got[3] == (0.0, 3.0) and got[14][0] == 0.25


# ---- subscriptions ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("tiles", [(4096, 65_536), (3, 4)])
def test_subscriptions_meet_their_signals(spark, tiles):
    rng = random.Random(8)
    signals = [(f"s{i}", rng.choice(["BTC", "BTC", "BTC", "ETH", None]), rng.choice(["1h", "4h", None]),
                rng.choice([None, 0.5, 0.7, round(rng.random(), 4)])) for i in range(120)]
    subs = [(i, rng.choice(["BTC", "BTC", "ETH", "XRP", None]), rng.choice(["1h", "4h", None]),
             rng.choice([0.7, 0.7, 0.7, None, round(rng.random(), 4)]), rng.random() < 0.9) for i in range(90)]
    signals.append(signals[0])  # a signal that comes twice
    got = subscriptions.match_subscriptions(
        spark.createDataFrame(signals, "signal_id string, asset string, timeframe string, confidence double").repartition(3),
        spark.createDataFrame(subs, "subscription_id long, asset string, timeframe string, min_confidence double, is_active boolean"),
        tile_subscriptions=tiles[0], tile_signals=tiles[1])
    want = [(s[0], u[0]) for s in signals for u in subs if u[4] and u[3] is not None and s[3] is not None and s[3] >= u[3]
            and (u[1] is None or u[1] == s[1]) and (u[2] is None or u[2] == s[2])]
    assert rows(got) == sorted(want, key=repr) and len(want) > 400


def test_a_hot_asset_is_dealt_into_tiles(spark):
    """All signals and subscriptions on one asset and one threshold: no key of the join holds more than its tile."""
    signals = spark.range(2000).select(F.col("id").alias("signal_id"), F.lit("BTC").alias("asset"), F.lit("1h").alias("timeframe"),
                                       F.lit(0.9).alias("confidence"))
    subs = spark.range(300).select(F.col("id").alias("subscription_id"), F.lit("BTC").alias("asset"), F.lit("1h").alias("timeframe"),
                                   F.lit(0.7).alias("min_confidence"), F.lit(True).alias("is_active"))
    met = subscriptions.match_subscriptions(signals, subs, tile_subscriptions=50, tile_signals=200)
    assert met.count() == 600_000 and met.distinct().count() == 600_000
    none = subs.where("false")
    assert subscriptions.match_subscriptions(signals, none).count() == 0 == subscriptions.match_subscriptions(signals.where("false"), subs).count()


# ---- copy trades --------------------------------------------------------------------------------------------

def fifo(trades):
    """Queues of open lots per key; quantities in whole hundred-millionths."""
    out, queues = [], {}
    for key, side, t, i, q, p in sorted(trades, key=lambda x: (x[0], x[2], x[3])):
        left, queue = round(q * 10**8), queues.setdefault(key, [])
        while left and queue and queue[0][0] != side:
            other = queue[0]
            n = min(left, other[1])
            buy, sale = ((i, p, t), (other[3], other[4], other[2])) if side == "BUY" else ((other[3], other[4], other[2]), (i, p, t))
            out.append((key, buy[0], sale[0], "SHORT" if side == "BUY" else "LONG", n / 1e8, other[4], p, other[2], t,
                        round((sale[1] - buy[1]) * n / 1e8, 9), round((sale[1] - buy[1]) / other[4], 9)))
            left -= n
            other[1] -= n
            if not other[1]:
                queue.pop(0)
        if left:
            queue.append([side, left, t, i, p])
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_trades", [1, 5, 65_536])
def test_lots_are_matched_first_in_first_out(spark, block_trades):
    rng = random.Random(block_trades)
    trades = [("hot", rng.choice(["BUY", "SELL"]), at(rng.randrange(500)), i, rng.choice([1.0, 2.5, 0.1, 0.3]), rng.choice([10.0, 11.5, 9.0]))
              for i in range(200)]
    trades += [("even", "BUY", at(1), 300, 2.0, 5.0), ("even", "SELL", at(2), 301, 2.0, 6.0), ("even", "BUY", at(3), 302, 1.0, 6.0)]
    trades += [("short", "SELL", at(1), 400, 3.0, 8.0), ("short", "BUY", at(2), 401, 1.0, 7.0), ("short", "BUY", at(2), 402, 9.0, 9.0)]
    trades += [("open", "BUY", at(1), 500, 3.0, 8.0)]
    odd = [("even", "BUY", None, 600, 1.0, 1.0), ("even", "SELL", at(0), 601, 0.0, 1.0), ("even", "SELL", at(0), 602, None, 1.0),
           ("even", "HOLD", at(0), 603, 1.0, 1.0), ("even", "SELL", at(0), 604, 1.0, None)]
    df = spark.createDataFrame(trades + odd, "wallet string, side string, ts timestamp, trade_id long, quantity double, price double")
    got = lots.match_lots(df.repartition(4), ["wallet"], block_trades=block_trades)
    shown = [(r["wallet"], r["buy_id"], r["sell_id"], r["side"], r["quantity"], r["entry_price"], r["exit_price"], r["opened_at"],
              r["closed_at"], round(r["pnl"], 9), round(r["roi"], 9)) for r in got.collect()]
    assert sorted(shown, key=repr) == fifo(trades)
    stats = {r["wallet"]: r for r in lots.trade_analytics(got, ["wallet"]).collect()}
    assert stats["even"]["win_rate"] == 1.0 and stats["even"]["total_pnl"] == 2.0 and stats["even"]["pnl_pct"] == pytest.approx(20.0)
    assert stats["short"]["closed_trades"] == 2 and stats["short"]["total_pnl"] == pytest.approx(1.0 - 2.0)


def test_copies_follow_their_settings(spark):
    leader = spark.createDataFrame(
        [(1, "w", "BTC", "BUY", 0.7, 10.0, 5, T0), (2, "w", "ETH", "BUY", 0.9, 10.0, 5, T0), (3, "w", "BTC", "SELL", None, 10.0, 5, T0),
         (4, "v", "BTC", "BUY", 0.9, 10.0, 5, T0)],
        "signal_id long, wallet_id string, asset string, direction string, confidence double, price double, quantity long, ts timestamp")
    settings = spark.createDataFrame(
        [(10, "w", None, 0.7, None, True), (11, "w", "BTC", 0.5, 39.0, True), (12, "w", "BTC", 0.5, 9.0, True), (13, "w", None, 0.1, None, False),
         (14, "w", "BTC", None, None, True)],
        "id long, wallet_id string, asset string, min_confidence double, max_notional_usd double, active boolean")
    got = lots.copy_signals(leader, settings).select("follower", "signal_id", "quantity")
    assert rows(got) == [(10, 1, 5), (10, 2, 5), (11, 1, 3)]


# ---- outcomes -----------------------------------------------------------------------------------------------

def test_outcomes_of_predictions(spark):
    ticks = [(1, at(0), 1, 10.0, 0.9), (1, at(59), 2, 12.0, 0.9), (1, at(60), 3, 15.0, 0.1), (1, at(60), 4, 99.0, 0.5), (1, at(200), 5, 3.0, 0.95),
             (2, at(0), 6, 0.0, 0.9), (2, at(61), 7, 5.0, None)]
    df = spark.createDataFrame(ticks, "token_id long, metric_time timestamp, metric_id long, price double, pump_probability double")
    judged = outcomes.prediction_outcomes(df, df, 3600)
    got = {r["metric_id"]: (r["future_price"], r["future_return"]) for r in judged.collect()}
    assert got[1] == (15.0, 0.5) and got[2] == (3.0, 3.0 / 12 - 1) and got[5] == (None, None) and got[6] == (5.0, None)
    one, = outcomes.prediction_performance(judged, F.lit(at(0))).collect()
    assert tuple(one)[:2] == (7, 4) and one["high_conf_count"] == 4 and one["high_conf_pump_rate"] == 0.5
    assert outcomes.prediction_performance(judged, F.lit(at(61))).first()["total_predictions"] == 2


# ---- indicators ---------------------------------------------------------------------------------------------

def by_hand(closes, highs, lows, p):
    """All indicators in one loop over the rows."""
    out, s = [], {}
    gains, losses, trues, ups, downs, indexes = ([] for _ in range(6))
    for i, (c, h, low) in enumerate(zip(closes, highs, lows, strict=True)):
        if i == 0:
            s = {"fast": c, "slow": c, "sig": 0.0}
        else:
            s["fast"] += 2 / (p.fast + 1) * (c - s["fast"])
            s["slow"] += 2 / (p.slow + 1) * (c - s["slow"])
            s["sig"] += 2 / (p.signal + 1) * (s["fast"] - s["slow"] - s["sig"])
            d, up, down = c - closes[i - 1], h - highs[i - 1], lows[i - 1] - low
            for values, x in ((gains, max(d, 0)), (losses, max(-d, 0)), (ups, up if up > down and up > 0 else 0),
                              (downs, down if down > up and down > 0 else 0),
                              (trues, max(h - low, abs(h - closes[i - 1]), abs(low - closes[i - 1])))):
                values.append(x)

        def mean(name, values, n):
            if len(values) == n:
                s[name] = sum(values) / n
            elif len(values) > n:
                s[name] = (s[name] * (n - 1) + values[-1]) / n
            return s.get(name)

        g, lo = mean("g", gains, p.rsi), mean("l", losses, p.rsi)
        tr, pd, md = mean("tr", trues, p.adx), mean("p", ups, p.adx), mean("m", downs, p.adx)
        atr = mean("atr", trues, p.atr)
        plus = minus = adx = rsi = fu = fl = trend = None
        if g is not None:
            rsi = 100 * g / (g + lo) if g + lo > 0 else 50.0
        if tr is not None:
            plus, minus = (100 * x / tr if tr > 0 else 0.0 for x in (pd, md))
            indexes.append(100 * abs(plus - minus) / (plus + minus) if plus + minus > 0 else 0.0)
            adx = mean("adx", indexes, p.adx)
        if atr is not None:
            bu, bl = (h + low) / 2 + p.width * atr, (h + low) / 2 - p.width * atr
            first = "fu" not in s
            s["fu"] = bu if first or bu < s["fu"] or closes[i - 1] > s["fu"] else s["fu"]
            s["fl"] = bl if first or bl > s["fl"] or closes[i - 1] < s["fl"] else s["fl"]
            s["trend"] = 1.0 if c > s["fu"] else -1.0 if c < s["fl"] else s.get("trend", 1.0)
            fu, fl, trend = s["fu"], s["fl"], s["trend"]
        macd = s["fast"] - s["slow"]
        out.append([rsi, macd, s["sig"], macd - s["sig"], plus, minus, adx, atr, fu, fl, trend,
                    None if trend is None else fl if trend > 0 else fu])
    return out


SMALL = indicators.Periods(rsi=5, fast=3, slow=7, signal=4, adx=6, atr=4, width=1.0)


@pytest.mark.parametrize("periods,block_rows", [(SMALL, 16), (SMALL, 65_536), (indicators.Periods(), 64)])
def test_indicators_equal_the_loop(spark, periods, block_rows):
    rng = np.random.default_rng(block_rows)
    series = {}
    for name, n in (("hot", 700), ("one", 1), ("two", 2), ("seed", 7), ("short", 30), ("flat", 80), ("jumps", 300)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        if name == "flat":
            close[:] = 7.0
        if name == "jumps":
            close = np.round(rng.choice([10.0, 11.0, 12.0, 20.0], n) + np.repeat(rng.normal(0, 5, n // 10), 10), 1) + 30
        spread = 0.0 if name == "flat" else rng.random(n) * 2
        series[name] = (close, close + spread, close - spread)
    data = [(k, at(15 * i), float(c), float(h), float(low)) for k, (cs, hs, ls) in series.items()
            for i, (c, h, low) in enumerate(zip(cs, hs, ls, strict=True))] + [("hot", at(-15), None, 1.0, 1.0), ("hot", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "symbol string, open_time timestamp, close double, high double, low double").repartition(4)
    got = {}
    for r in indicators.recursive_indicators(df, ["symbol"], periods=periods, block_rows=block_rows).orderBy("open_time").collect():
        got.setdefault(r["symbol"], []).append(r)
    for name, (cs, hs, ls) in series.items():
        want = by_hand(cs.tolist(), hs.tolist(), ls.tolist(), periods)
        assert len(got[name]) == len(want)
        for i, (r, w) in enumerate(zip(got[name], want, strict=True)):
            for column, x in zip(indicators.INDICATORS, w, strict=True):
                y = r[column]
                assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (name, i, column, x, y)
    assert {r["trend"] for r in got["jumps"]} == {None, 1.0, -1.0}


def test_band_functions_equal_the_rows():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randint(1, 12)
        basic, close = ([float(rng.randint(0, 12)) for _ in range(n)] for _ in range(2))
        before = float(rng.randint(0, 12))
        text = indicators.BandFunction(basic, close, before).text()
        for x in np.arange(-1, 14, 0.5).tolist():
            band, stood, last = x, -1, before
            for i, (b, c) in enumerate(zip(basic, close, strict=True)):
                band = b if b < band or last > band else band
                stood = i if c > band else stood
                last = c
            assert indicators.BandFunction.apply(text, x) == (band, stood)


# ---- regimes ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_rows", [256, 65_536])
def test_ranks_and_labels_equal_the_loop(spark, block_rows):
    rng = np.random.default_rng(9)
    data, want = [], {}
    regime = regimes.Regime(("low", "medium", "high"), 0.3, 0.7, 0.1)
    for name, n in (("hot", 1200), ("short", 3), ("ties", 300)):
        values = [None if rng.random() < 0.05 else float(rng.integers(0, 4) if name == "ties" else rng.normal() + math.sin(i / 40) * 2)
                  for i in range(n)]
        label = 1
        for i, v in enumerate(values):
            window = [x for x in values[max(0, i - 49):i + 1] if x is not None]
            rank = sum(x <= v for x in window) / len(window) if v is not None and len(window) >= 5 else None
            if rank is not None:
                if rank >= 0.7 + 0.1:
                    label = 2
                elif rank <= 0.3 - 0.1:
                    label = 0
                elif (label == 0 and rank >= 0.3 + 0.1) or (label == 2 and rank <= 0.7 - 0.1):
                    label = 1
            want[name, i] = (rank, regime.labels[label])
            data.append((name, at(i), i, v))
    df = spark.createDataFrame(data, "k string, ts timestamp, i int, v double").repartition(4)
    ranked = regimes.trailing_ranks(df, ["k"], "ts", ["v"], n=50, least=5, block_rows=block_rows)
    got = regimes.with_regimes(ranked, ["k"], "ts", {"label": ("v_rank", regime)}, block_rows=100)
    got = {(r["k"], r["i"]): (r["v_rank"], r["label"]) for r in got.collect()}
    assert got == want
    assert {x for _, x in want.values()} == {"low", "medium", "high"}
    with pytest.raises(ValueError, match="margins"):
        regimes.Regime(("a", "b", "c"), 0.4, 0.5, 0.2)


# ---- stored retention ---------------------------------------------------------------------------------------

def test_retention_touches_only_the_boundary(spark, tmp_path):
    path = str(tmp_path / "stored")
    data = [(i, at(60 * 6 * i)) for i in range(40)] + [(100, None)]
    df = spark.createDataFrame(data, "id long, ts timestamp").withColumn("day", F.to_date("ts"))
    tables.write_table(df, path, ["day"])

    def files():
        return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "stored").rglob("*.parquet")}

    before = files()
    assert tables.retain_table(spark, path, "ts", F.lit("2024-01-04 07:00:00")) == {"dropped": 3, "rewritten": 1}
    after = files()
    kept = {f for f in before if f.split("/")[0] > "day=2024-01-04"}  # `day=__HIVE...` of the row without a time is among them
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any(f.split("/")[0] < "day=2024-01-04" for f in after)
    left = spark.read.parquet(path)
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(40) if at(360 * i) >= dt.datetime(2024, 1, 4, 7)] + [100]
    now = files()
    assert tables.retain_table(spark, path, "ts", F.lit("2024-01-04 07:00:00")) == {"dropped": 0, "rewritten": 0} and files() == now
    # A boundary day without a row left goes as a folder; a cutoff of NULL deletes nothing.
    assert tables.retain_table(spark, path, "ts", F.lit("2024-01-05 23:30:00")) == {"dropped": 2, "rewritten": 0}
    assert tables.retain_table(spark, path, "ts", F.lit(None)) == {"dropped": 0, "rewritten": 0}


# ---- token search -------------------------------------------------------------------------------------------

def names_holding(rows_, question):
    low = question.lower()
    return sorted(r[0] for r in rows_ if any(x is not None and low in x.lower() for x in r[1:]))


def test_search_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BUCKETS", 4)
    path, fields = str(tmp_path / "index"), ["mint", "name"]
    stored = [(1, "So11Pump", "Dog Wif Hat"), (2, "So12", None), (3, None, None), (4, "", "A"), (5, "aaaa", "Straße 日本"), (6, "xpumpx", "dog"),
              (7, "Pu", "mp")]
    df = spark.createDataFrame(stored, "token_id long, mint string, name string")
    text_index.build_index(df, path, "token_id", fields)
    batch = [(1, "So11Pump", "Cat"), (4, None, None), (6, "xpumpx", "dog"), (8, "fresh", "Dogs dogs")]
    new = {r[0]: r for r in stored} | {r[0]: r for r in batch}
    changed = spark.createDataFrame(batch, "token_id long, mint string, name string")
    now = spark.createDataFrame(list(new.values()), "token_id long, mint string, name string")
    for turn in range(3):
        rows_, tokens = (stored, df) if turn == 0 else (list(new.values()), now)
        for question in ("pump", "DOG", "so1", "a", "aa", "aaa", "aaaaa", "日本", "straße", "%", "dog wif", "p_mp", ""):
            got = text_index.search_tokens(spark, path, tokens, question, "token_id", fields)
            assert sorted(r["token_id"] for r in got.collect()) == names_holding(rows_, question), (turn, question)
        if turn < 2:  # the second time changes nothing
            text_index.update_index(spark, path, df, changed, "token_id", fields)
    # The index holds exactly the postings of the new rows, and a question reads only its folders.
    held = spark.read.schema("gram string, token_id long, bucket int").parquet(path).where("token_id IS NOT NULL")
    assert rows(held) == rows(text_index.postings(now, "token_id", fields).select("gram", "token_id", "bucket"))
    plan = text_index.matching_keys(spark, path, "pump", "token_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(gram, [pum,ump])" in plan


def test_postings_of_a_small_file_are_made_in_many_tasks(spark):
    df = spark.range(400).select(F.col("id").alias("token_id"), F.concat(F.lit("Token "), F.col("id")).alias("mint")).coalesce(1)
    made = text_index.postings(df, "token_id", ["mint"])
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert made.select("token_id").distinct().count() == 400 and made.count() == made.distinct().count()


# ---- trending terms -----------------------------------------------------------------------------------------

def test_summaries_keep_what_is_frequent():
    rng = random.Random(4)
    items = ["hot"] * 400 + ["warm"] * 150 + [f"rare{i}" for i in range(450)]
    rng.shuffle(items)
    whole, parts = trending.Summary(9), [trending.Summary(9) for _ in range(4)]
    for i, item in enumerate(items):
        whole.add(item)
        parts[i % 4].add(item)
    for part in parts[1:]:
        parts[0].merge(part)
    for summary in (whole, parts[0]):  # more than 1000 / 10 of 1000
        assert {"hot", "warm"} <= set(summary.counts) and len(summary.counts) <= 9
        assert all(n <= items.count(item) for item, n in summary.counts.items())


def test_trending_terms_are_counted_exactly(spark):
    rng = random.Random(11)
    messages = [(w, " ".join(rng.choice(["#Moon", "moon", "the", "a_b", "$SOL", f"x{rng.randrange(400)}"]) for _ in range(30)))
                for w in rng.choices([1, 2, None], k=120)] + [(1, None), (2, ""), (3, "...")]
    df = spark.createDataFrame(messages, "w int, text string").repartition(5)
    for share, best in ((0.05, 20), (0.001, 7)):
        want = []
        for w in (1, 2, None, 3):
            terms = [t for m, text in messages if m == w for t in (text or "").lower().replace("...", "").split()]
            counts = sorted(((-terms.count(t), t) for t in set(terms) if terms.count(t) / len(terms) >= share))[:best]
            want += [(None if w is None else str(w), t, -n, -n / len(terms), i + 1) for i, (n, t) in enumerate(counts)]
        assert rows(trending.trending_terms(df, F.col("w"), share=share, best=best)) == sorted(want, key=repr)
    found = {r["term"] for r in trending.candidates(df.select(F.col("w").cast("string").alias("window"), trending.term_list(F.col("text")).alias(
        "terms")), 0.05).collect()}
    assert {"#moon", "moon", "the", "a_b", "$sol"} <= found and len(found) <= 5 * 3 * 20


def test_sentiment_spread(spark):
    df = spark.createDataFrame([(1, "moon", False), (1, "dump", True), (1, None, None), (2, "pump", True)], "g int, text string, reply boolean")
    got = {r["g"]: r for r in trending.sentiment_spread(df, ["g"], F.col("reply")).collect()}
    assert got[1]["messages"] == 3 and got[1]["engagement_rate"] == 0.5 and got[1]["sentiment"] == pytest.approx(0.5)
    assert got[2]["engagement_rate"] is None and got[2]["sentiment_volatility"] is None
