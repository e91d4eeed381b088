"""Edge rules: thresholds at equality, NULL defaults, clamps, units."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom import contracts
from tickloom.functions import math as m
from tickloom.functions import scores, text, times
from tickloom.operators import datasets, models, reports, signals, tokens


LIVE = """token_id long, buys_5m double, price_change_1h double, pump_probability double, marketcap double,
    volume_5m double, price double, updated_at timestamp"""


def test_alert_rule_edges(spark):
    rows = [
        (1, 20.0, 0.0, 0.0, 3000.0, 50.0),  # buys at the threshold
        (2, 19.0, 0.0, 0.0, 3000.0, 50.0),
        (3, 0.0, 5.0, 0.0, 3000.0, 50.0),  # change at the threshold
        (4, 0.0, 4.99, 0.59, 3000.0, 50.0),
        (5, 0.0, 0.0, 0.6, 3000.0, 50.0),  # probability at the threshold
        (6, 20.0, 0.0, 0.0, 2999.9, 50.0),
        (7, 20.0, 0.0, 0.0, 3000.0, 49.9),
        (8, None, None, None, None, None),
        (9, 20.0, None, None, 3000.0, 50.0),  # NULL counts as 0
    ]
    df = spark.createDataFrame([(*r, 1.0, None) for r in rows], LIVE)
    got = {r["token_id"] for r in tokens.alerts(df).collect()}
    assert got == {1, 3, 5, 9}
    assert tokens.alerts(df, stamp=F.current_timestamp()).columns[-1] == "alerted_at"


def test_radar_null_rules(spark):
    df = spark.createDataFrame([(1, 5.0, None, 0.5, 10.0, 1.0, 1.0, None), (2, 5.0, 0.2, 0.5, 10.0, 1.0, 1.0, None)], LIVE) \
        .withColumn("buys_1h", F.lit(3))
    assert [r["token_id"] for r in tokens.radar(df).collect()] == [2]
    assert {r["token_id"] for r in tokens.radar_null_safe(df, 0, 0, 0, 0).collect()} == {1, 2}
    assert [r["token_id"] for r in tokens.radar_null_safe(df, 0, 0, 0, 20).collect()] == [2]


def test_null_placement(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "token_id long, marketcap double")
    assert [r[0] for r in tokens.ranked(df, ["marketcap"]).collect()] == [3, 2, 1]
    assert [r[0] for r in tokens.ranked(df, ["marketcap"], nulls="first").collect()] == [1, 3, 2]


def test_dashboard_units_and_aliases(spark):
    df = spark.createDataFrame(
        [(1, "7.5", "100", 1.0, 2.0, 3.0, "4", 0.5, 0.25, 0.0, 120.0), (2, "x", None, None, None, None, None, None, 12.0, 600.0, 5.0)],
        """token_id long, price string, marketcap string, volume_5m double, buys_5m double, sells_5m double, buys1h string,
           pump_probability double, price_change_1h double, age_seconds double, age_minutes double""")
    rows = {r["token_id"]: r for r in tokens.dashboard(df).collect()}
    assert (rows[1]["price"], rows[1]["buys_1h"], rows[1]["change_pct"], rows[1]["age_minutes"]) == (7.5, 4.0, 25.0, 120.0)
    assert (rows[2]["price"], rows[2]["change_pct"], rows[2]["age_minutes"]) == (0.0, 12.0, 10.0)
    assert tokens.dashboard(df, percent_above=None).where("token_id = 2").first()["change_pct"] == 1200.0
    assert [r["token_id"] for r in tokens.dashboard(df, scored_only=True).collect()] == [1]
    assert [r["token_id"] for r in tokens.dashboard(df, max_age_days=0.01).collect()] == [2]


def test_confidence_filter_keeps_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.49)], "symbol string, confidence double") \
        .withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r["symbol"] for r in tokens.confident_signals(df, 0.5).collect()} == {"a", "b"}


def test_large_trade_boundaries(spark):
    df = spark.createDataFrame([(10_000.0,), (10_000.01,)], "notional_usd double")
    assert reports.large_trades(df).count() == 1
    assert reports.large_trades(df, strict=False).count() == 2


@pytest.mark.parametrize("body, want", [
    (None, 0.5), ("", 0.5), ("nothing here", 0.5), ("BULLISH moon pump uptrend buy green", 1.0),
    ("buy and sell", 0.5), ("a math class", 0.6), ("buy buy buy", 0.6),
    ("bearish dump crash sell rekt panic rug", 0.0),
])
def test_sentiment(spark, body, want):
    df = spark.createDataFrame([(body,)], "t string")
    assert df.select(text.text_sentiment("t")).first()[0] == pytest.approx(want)


def test_weighted_sentiment_defaults(spark):
    df = spark.createDataFrame([("a", "buy", None), ("a", "sell", 3.0), ("b", "buy", 0.0)], "k string, text string, weight double")
    got = {r["k"]: r["sentiment"] for r in signals.weighted_sentiment(df, ["k"]).collect()}
    assert got["a"] == pytest.approx((0.6 + 3 * 0.4) / 4) and got["b"] == 0.5
    assert signals.weighted_sentiment(df.where("false")).first()["sentiment"] == 0.5


def test_score_functions(spark):
    row = spark.createDataFrame([(0.0, 0.0, None, 3_000_000.0)], "b double, s double, n double, big double").select(
        scores.trade_imbalance("b", "s").alias("flat"), scores.trade_imbalance(F.lit(3), F.lit(1)).alias("skewed"),
        m.normalise("n", 10).alias("null"), m.normalise(F.lit(-1.0), 10).alias("negative"), m.normalise("big", 10).alias("capped"),
        scores.marketcap_score("big").alias("mc"), scores.liquidity_score(F.lit(5000.0)).alias("l1"),
        scores.liquidity_score(F.lit(15000.0)).alias("l2"), scores.liquidity_score(F.lit(25000.0)).alias("l3"),
        scores.turnover_score(F.lit(10.0), "b").alias("t0"), scores.turnover_score(F.lit(100.0), F.lit(4.0)).alias("t1"),
        scores.recency(F.lit(3600.0)).alias("rec"), scores.existence_score("n").alias("gone"),
    ).first()
    assert (row["flat"], row["skewed"], row["null"], row["negative"], row["capped"], row["mc"]) == (0, 0.5, 0, 0, 1, 0)
    assert (row["l1"], row["l2"], row["l3"], row["t0"], row["t1"], row["gone"]) == (0.1, 0.4, 0.5, 0, 0.5, 0.1)
    assert row["rec"] == pytest.approx(math.exp(-1))


@pytest.mark.parametrize("alpha, core, token, confidence", [
    (0.6, "BUY", "HOLD", 0.2), (0.46, "HOLD", "HOLD", 0.08), (0.45, "SELL", "HOLD", 0.1), (0.65, "BUY", "BUY", 0.3),
    (0.35, "SELL", "SELL", 0.3), (float("nan"), None, "HOLD", None),
])
def test_directions(spark, alpha, core, token, confidence):
    row = spark.createDataFrame([(alpha,)], "a double").select(
        scores.alpha_direction("a").alias("core"), scores.token_direction("a").alias("token"),
        scores.alpha_confidence("a").alias("conf")).first()
    assert row["token"] == token
    if core is not None:
        assert row["core"] == core and row["conf"] == pytest.approx(confidence)


def test_blend_levels_and_change_rule(spark):
    row = spark.range(1).select(
        scores.alpha_blend(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("top"),
        scores.alpha_blend(F.lit(-1.0), F.lit(0.0), F.lit(0.0)).alias("low"),
        *[c.alias(f"buy_{n}") for n, c in scores.price_levels(F.lit("BUY"), F.lit(100.0), F.lit(104.0), F.lit(100.0)).items()],
        *[c.alias(f"flat_{n}") for n, c in scores.price_levels(F.lit("HOLD"), F.lit(100.0), F.lit(1.0), F.lit(1.0)).items()],
        scores.change_direction(F.lit(0.002)).alias("edge"), scores.change_direction(F.lit(-0.0021)).alias("sell"),
        scores.change_label(F.lit(0.05)).alias("none"), scores.change_label(F.lit(None).cast("double")).alias("null"),
    ).first()
    assert (row["top"], row["low"]) == (1.0, 0.0)
    assert (row["buy_stop_loss"], row["buy_take_profit"]) == (94.0, 112.0)
    assert (row["flat_stop_loss"], row["flat_take_profit"]) == (100.75, 98.5)
    assert (row["edge"], row["sell"], row["none"], row["null"]) == ("HOLD", "SELL", "", "")


def test_momentum_needs_51_rows(spark):
    def candles(n):
        return spark.range(n).select(
            F.lit(f"s{n}").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("open_time"),
            (F.col("id") + 100.0).alias("close"), (F.col("id") + 101.0).alias("high"), (F.col("id") + 99.0).alias("low"))

    df = candles(50).unionByName(candles(51)).unionByName(candles(300))
    got = {r["symbol"]: r for r in signals.price_momentum(df).collect()}
    assert got["s50"]["momentum"] == 0.0
    assert got["s51"]["momentum"] == 1.0  # far above the mean, capped
    sma = sum(range(350, 400)) / 50
    assert got["s300"]["momentum"] == pytest.approx(min(0.1, (399 - sma) / sma) / 0.1)
    change = {r["symbol"]: r["change"] for r in signals.change_signals(df).collect()}
    assert change["s300"] == pytest.approx(1 / 398)


def test_prediction_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, -20.0, 1.0), (-1.0, 0.0, -1.0)], "mu double, log_sigma double, logit double")
    rows = models.decode_predictions(df).orderBy("logit").collect()
    assert [r["direction"] for r in rows] == ["down", "neutral", "up"]
    assert rows[1]["confidence"] == 0.5 and rows[2]["prob_heuristic"] == pytest.approx(0.9)
    assert rows[0]["prob_heuristic"] == pytest.approx(0.25)
    soft = spark.range(1).select(m.two_class_softmax(F.lit(50.0))).first()[0]
    assert soft == 0.999


def test_losses(spark):
    df = spark.createDataFrame([("1h", 1.0, 5.0, 2.0, 0.5, 1)], "horizon string, mu double, log_sigma double, logit double, y double, dir int")
    row = datasets.loss_metrics(df).where("horizon = 'all'").first()
    assert row["nll"] == pytest.approx(0.25 / (math.exp(6) + 1e-6) + 6)
    assert row["nll_unclamped"] == pytest.approx(0.25 / (math.exp(10) + 1e-8) + 10)
    assert row["direction_loss"] == pytest.approx(-math.log(1 / (1 + math.exp(-2))))
    assert row["loss"] == pytest.approx(row["nll"] + 0.7 * row["direction_loss"])


def test_text_and_time_functions(spark):
    row = spark.range(1).select(
        text.dashed_product(F.lit("BTCUSDT")).alias("a"), text.dashed_product(F.lit("ETHUSD")).alias("b"),
        text.dashed_product(F.lit("EUR")).alias("c"), text.base_asset(F.lit("BTCUSDT")).alias("d"),
        text.quote_asset(F.lit("BTCUSDT")).alias("e"), text.base_asset(F.lit("BT")).alias("f"),
        text.short_id(F.lit("abcdefghijklmnop")).alias("g"), text.first_text(F.lit(""), F.lit(None), F.lit("z")).alias("h"),
        times.interval_seconds(F.lit("15m")).alias("i"), times.interval_minutes(F.lit("2d")).alias("j"),
        times.interval_seconds(F.lit("9w")).alias("k"), m.fixed_text(F.lit(1234.5), 1).alias("l"),
        m.percent_text(F.lit(0.256)).alias("n"), m.fixed_text(F.lit("abc")).alias("o"),
        m.number(F.lit("nope")).alias("p"), m.token_units(F.lit("1500000"), F.lit("6")).alias("q"),
        m.log_ratio(F.lit(0), F.lit(2)).alias("r"), text.same_symbol(F.lit("a"), F.lit("A")).alias("s"),
    ).first().asDict()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"]) == ("BTC-USDT", "ETH-USD", "EUR", "BTC", "USDT", "")
    assert (row["g"], row["h"], row["i"], row["j"], row["k"]) == ("abcd…mnop", "z", 900, 2880, 900)
    assert (row["l"], row["n"], row["o"], row["p"], row["q"], row["r"], row["s"]) == ("1234.5", "25.6%", "-", 0.0, 1.5, None, True)


def test_feed_merge_order(spark):
    a = spark.createDataFrame([("x", 1.0, 5), ("", 1.0, 1)], "symbol string, marketcap double, holders int")
    b = spark.createDataFrame([("x", 0.0), ("y", 3.0)], "symbol string, marketcap double")
    got = {r["symbol"]: (r["marketcap"], r["holders"]) for r in tokens.merge_feeds([a, b]).collect()}
    assert got == {"x": (0.0, 5), "y": (3.0, None)}


def test_contract_checks(spark):
    df = spark.createDataFrame([("a", "BUY", 0.5), ("b", "UP", 0.5), ("c", "SELL", 1.5), ("d", "HOLD", None)],
                               "symbol string, direction string, confidence double")
    good, bad = contracts.split_valid(df, contracts.signal_is_valid())
    assert {r["symbol"] for r in good.collect()} == {"a", "d"} and {r["symbol"] for r in bad.collect()} == {"b", "c"}
    full = contracts.align(df, "token_signals")
    assert contracts.check(full, "token_signals") is full
    with pytest.raises(ValueError, match="missing"):
        contracts.check(df, "token_signals")
    assert contracts.drift(full.withColumn("alpha", F.lit(1)), "token_signals") == ["alpha: int instead of double"]
