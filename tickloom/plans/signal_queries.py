"""Signals, portfolio risk, reports, datasets and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scores
from tickloom.functions.math import exponent_text, fixed_text, percent_text, rounded, safe_divide
from tickloom.functions.text import base_asset, dashed_product, quote_asset
from tickloom.functions.times import interval_minutes, interval_seconds, iso_text, timestamp_to_millis
from tickloom.operators import datasets, models, portfolio, reports, signals
from tickloom.operators import features as feature_ops
from tickloom.operators import timeseries as ts_ops
from tickloom.operators.tokens import latest_per_key
from tickloom.plans import views
from tickloom.plans.oracle import sql
from tickloom.plans.spread_queries import BOLLINGER_CTES, FEATURE_SQL, LABEL_SQL, features
from tickloom.plans.token_queries import enriched
from tickloom.session import cut_lineage

DAY = 86400
POSITIVE, NEGATIVE = ("that", "have", "buy"), ("with", "from", "sell")
SENTIMENT_SQL = (
    "CASE WHEN coalesce(length(text), 0) = 0 THEN 0.5 ELSE (greatest(-5, least(5, "
    + " + ".join(f"contains(lower(text), '{w}')::INT" for w in POSITIVE) + " - "
    + " - ".join(f"contains(lower(text), '{w}')::INT" for w in NEGATIVE) + ")) + 5) / 10.0 END")


def _r(columns, digits=6):
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


def _same(names):
    return {n: n for n in names}


def significant(column, digits=9):
    """Rounding to significant digits, for ratios of any size."""
    return F.format_string(f"%.{digits}e", F.col(column)).cast("double") + F.lit(0.0)


def _rounded(df, keep, names, digits=6):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in names])


def sentiment_by_conversation(spark, d):
    df = signals.weighted_sentiment(views.messages(spark, d), ["conv_id"], POSITIVE, NEGATIVE)
    return _rounded(df, ["conv_id", "messages"], ["sentiment"])


MOMENTUM = ["momentum", "sentiment_score", "on_chain_score", "alpha_score", "confidence", "entry_price", "stop_loss",
            "take_profit"]


def momentum_alpha_signal(spark, d):
    mood = signals.weighted_sentiment(views.messages(spark, d), (), POSITIVE, NEGATIVE).select("sentiment").scalar()
    config = scores.SignalConfig(levels=scores.LevelRule(digits=6))
    return _rounded(signals.momentum_signals(views.candles(spark, d), mood, config=config),
                    ["symbol", "open_time", "direction"], MOMENTUM)


def change_signal(spark, d):
    return _rounded(signals.change_signals(views.candles(spark, d)), ["symbol", "direction"],
                    ["entry_price", "change", "confidence", "stop_loss", "take_profit"])


RISK = ["total_return", "volatility", "max_drawdown", "var_95", "concentration_index"]
RATIOS = ["annualized_return", "sharpe_ratio", "sortino_ratio"]


def portfolio_values(spark, d):
    df = portfolio.with_returns(portfolio.portfolio_values(views.positions(spark, d), views.daily_closes(spark, d)))
    return _rounded(df, ["portfolio_id", "ts"], ["value", "ret", "peak", "drawdown"], 5)


def _risk(metrics):
    return metrics.select("portfolio_id", "period_days", "num_assets", *[rounded(c).alias(c) for c in RISK],
                          *[significant(c).alias(c) for c in RATIOS])


def _metrics(spark, d, align):
    return portfolio.portfolio_metrics(views.positions(spark, d), views.daily_closes(spark, d), align)


def portfolio_metrics(spark, d):
    return _risk(_metrics(spark, d, "time"))


def portfolio_metrics_ordinal(spark, d):
    """Closes with gaps (every symbol misses its days with few trades), aligned by row position."""
    trades = views.trades(spark, d)
    closes = trades.groupBy("symbol", F.date_trunc("day", "trade_time").alias("ts")).agg(
        F.max_by("price", "trade_time").alias("close"), F.max("trade_id").alias("last_id"))
    gappy = closes.where(F.col("last_id") % 3 != 0).drop("last_id")
    return _risk(portfolio.portfolio_metrics(views.positions(spark, d), gappy, "ordinal"))


def _portfolios(spark, d):
    e = views.events(spark, d)
    return e.groupBy((F.col("user_id") % 25).alias("portfolio_id")).agg(F.min("ts").alias("created_at")) \
        .withColumn("name", F.concat(F.lit("book-"), F.col("portfolio_id")))


def portfolio_detail(spark, d):
    df = portfolio.portfolio_detail(_portfolios(spark, d), views.positions(spark, d))
    text = F.transform("positions", lambda p: F.concat(p["symbol"], F.lit(":"), p["quantity"].cast("long").cast("string")))
    return df.select("portfolio_id", "name", "created_at", "page", F.array_join(text, ",").alias("positions"))


def _snapshots(spark, d):
    """One metric snapshot per portfolio and day: the drawdown path."""
    df = portfolio.with_returns(portfolio.portfolio_values(views.positions(spark, d), views.daily_closes(spark, d)))
    return df.select("portfolio_id", F.col("ts").alias("snapshot_ts"), "value", "drawdown")


def portfolio_latest(spark, d):
    return _rounded(latest_per_key(_snapshots(spark, d), ["portfolio_id"], ["snapshot_ts"]),
                    ["portfolio_id", "snapshot_ts"], ["value", "drawdown"], 5)


def portfolio_history(spark, d):
    snaps = _snapshots(spark, d)
    recent = portfolio.recent(snaps, "snapshot_ts", views.as_of(views.daily_closes(spark, d), "ts"), 10 * DAY)
    return _rounded(reports.oldest_first(recent, "snapshot_ts", "portfolio_id"), ["portfolio_id", "snapshot_ts"],
                    ["value", "drawdown"], 5)


def whale_transfers(spark, d):
    return reports.whale_transfers(views.transfers(spark, d))


def large_trades(spark, d):
    df = reports.newest(reports.large_trades(views.trades(spark, d)), "trade_time", "trade_id", 200)
    return df.select("trade_id", "symbol", "trade_time", "side", rounded("price").alias("price"), "quantity",
                     rounded("notional_usd", 3).alias("notional_usd"))


def recent_activity(spark, d):
    m = views.token_metrics(spark, d)
    hour = portfolio.recent(m, "metric_time", views.as_of(m, "metric_time"), 3600)
    return reports.oldest_first(hour, "metric_time", "metric_id", 1000).select("metric_id", "token_id", "metric_time")


def summary_cards(spark, d):
    wallets = views.table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("is_active"))
    spread = views.spread(spark, d)
    return reports.summary_cards(views.trades(spark, d), wallets, spread, views.as_of(spread, "ts"))


def symbol_formats(spark, d):
    """Product naming, base/quote split, interval codes, number and time formats."""
    c = views.candles(spark, d)
    product = F.concat("symbol", F.when(F.length("symbol") % 2 == 0, "USDT").otherwise("USD"))
    code = F.concat((F.hour("open_time") + 1).cast("string"), F.when(F.hour("open_time") < 8, "m")
                    .when(F.hour("open_time") < 16, "h").when(F.hour("open_time") < 22, "d").otherwise("x"))
    return c.select(
        "symbol", "open_time", dashed_product(product).alias("product"), base_asset(product).alias("base"),
        quote_asset(product).alias("quote"), interval_seconds(code).alias("seconds"),
        interval_minutes(code).alias("minutes"), timestamp_to_millis("open_time").alias("open_ms"),
        iso_text("open_time").alias("open_iso"), fixed_text("volume", 0).alias("volume_text"),
        percent_text(F.col("trades_count") / 4, 0).alias("share_text"),
        exponent_text("trades_count", 1).alias("count_exp"))


def latest_window(spark, d):
    return _rounded(datasets.latest_window(views.spread(spark, d)), ["ts"], ["spread_log", "leg1_z", "leg2_z"])


def _spread_labels(spark, d):
    s = feature_ops.spread_blocks(back=1, ahead=24)
    df = s.open(views.spread(spark, d).withColumnRenamed("spread_log", "spread"))
    df = df.withColumns({"spread_ret": ts_ops.difference(s, "spread"),
                         **ts_ops.targets(s, "spread", feature_ops.HORIZONS)})
    return s.close(df)


def window_dataset(spark, d):
    ds = datasets.window_dataset(_spread_labels(spark, d), ["spread", "spread_ret", "leg1_volume"],
                                 ["y_1h", "y_24h", "dir_4h"])

    def window_sum(c):
        return F.aggregate("window", F.lit(0.0), lambda a, x: a + x[c])

    total = {c: window_sum(c) for c in ("spread", "spread_ret", "leg1_volume")}
    return ds.select("ts", "dir_4h", F.size("window").alias("steps"),
                     rounded(F.element_at("window", 1)["spread"]).alias("first_spread"),
                     rounded(F.element_at("window", -1)["spread"]).alias("last_spread"),
                     *[rounded(t, 5).alias(f"sum_{c}") for c, t in total.items()],
                     rounded("y_1h").alias("y_1h"), rounded("y_24h").alias("y_24h"))


def flat_windows(spark, d):
    ds = datasets.flat_windows(views.spread(spark, d))
    part = lambda i: F.aggregate(F.slice("features", 168 * i + 1, 168), F.lit(0.0), lambda a, x: a + x)
    return ds.select("ts", F.size("features").alias("width"),
                     *[rounded(part(i), 5).alias(f"sum_{i}") for i in range(3)],
                     *[rounded(f"y_{h}").alias(f"y_{h}") for h in feature_ops.HORIZONS])


def time_split(spark, d):
    s = feature_ops.spread_blocks()
    df = datasets.time_split(s.close(s.open(views.spread(spark, d))))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


def _model_outputs(spark, d):
    """Stand-in model outputs computed from features, long by horizon, with labels."""
    m = features(spark, d, min_history=1)
    out = m.select("ts", "pos", *[c for h in feature_ops.HORIZONS for c in (
        (F.col(f"mom_{h}") * 0.1).alias(f"mu_{h}"), F.log("roll_std").alias(f"log_sigma_{h}"),
        F.col("bb_z").alias(f"logit_{h}"), f"y_{h}", f"dir_{h}")])
    rows = models.prediction_rows(out, ["ts", "pos"] + [f"{p}_{h}" for p in ("y", "dir") for h in feature_ops.HORIZONS],
                                  list(feature_ops.HORIZONS))
    pick = lambda p: F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"{p}_{h}")) for h in feature_ops.HORIZONS])
    return rows.select("ts", "pos", "horizon", "mu", "log_sigma", "logit", pick("y").alias("y"), pick("dir").alias("dir"))


DECODED = ["mu", "sigma", "p_up", "p_down", "confidence", "prob_softmax", "prob_heuristic"]


def prediction_decode(spark, d):
    return _rounded(models.decode_predictions(_model_outputs(spark, d)), ["ts", "horizon", "direction"], DECODED, 5)


def loss_metrics(spark, d):
    return _rounded(datasets.loss_metrics(_model_outputs(spark, d)), ["horizon", "samples"],
                    ["nll", "nll_unclamped", "direction_loss", "loss"], 5)


def model_fallback(spark, d):
    s = feature_ops.spread_blocks()
    base = s.close(s.open(views.spread(spark, d)))
    v1 = base.select("pair", "ts", F.col("spread_log").alias("prediction"))
    v2 = base.where(F.col("pos") >= 168).select("pair", "ts", (F.col("spread_log") * 2).alias("prediction"))
    return _rounded(models.fall_back(v2, v1, ["pair", "ts"]), ["pair", "ts", "model"], ["prediction"])


def model_registry(spark, d):
    """Registry rows (one per symbol and day) with appended entries, newest 50."""
    daily = views.trades(spark, d).groupBy("symbol", F.date_trunc("day", "trade_time").alias("created_at")) \
        .agg(F.count(F.lit(1)).alias("trained_on_rows"))
    old = daily.select(F.col("symbol").alias("name"), F.date_format("created_at", "yyyyMMdd").alias("version_tag"),
                       "trained_on_rows", "created_at", F.lit("batch").alias("notes"))
    new = daily.groupBy(F.lit("ensemble").alias("name"), "created_at").agg(F.sum("trained_on_rows").alias("trained_on_rows")) \
        .withColumn("version_tag", F.date_format("created_at", "yyyyMMdd"))
    return models.newest_models(models.register_models(old, new)) \
        .select("name", "version_tag", "trained_on_rows", "created_at", "notes")


def gbt_scores(spark, d):
    """Boosted trees per horizon on flat window vectors, trained on the first 80 % of each series, scored on the rest.

    Training stops as many rows before the rest as the longest label looks ahead.
    Where no series is long enough for a training window of 168 rows, windows are shorter.
    """
    spread = views.spread(spark, d)
    gap = max(feature_ops.HORIZONS.values())
    longest = spread.groupBy("exchange", "pair").count().agg(F.max("count")).first()[0] or 0
    usable = int(longest * 0.8) - gap
    rows = 168 if usable >= 168 else max(1, usable // 2)
    # The fit passes over the training rows once per round; a reliable
    # checkpoint keeps those passes off the feature plan.
    split = cut_lineage(datasets.time_split(datasets.flat_windows(spread, rows, labelled=False)))
    train = split.where((F.col("split") == "train") & (F.col("pos") < F.floor(F.col("n_rows") * 0.8) - gap))
    fitted = models.train_horizons(train, list(feature_ops.HORIZONS))
    return models.score_horizons(split.where(F.col("split") == "test"), fitted).select(
        "pair", "ts", *[rounded(f"mu_{h}").alias(f"mu_{h}") for h in feature_ops.HORIZONS])


def token_alpha(spark, d):
    """Token model: trained on tokens as they were a week ago, with the price change since as the label, scored on live tokens."""
    def inputs(back):
        return enriched(spark, d, back).withColumn("buys_vs_sells_ratio", F.col("velocity"))

    def price(back, name):
        return views.live(spark, d, back).join(views.tokens(spark, d), "token_id").select(
            F.col("mint").alias("symbol"), F.col("price").alias(name))

    before = inputs(7 * DAY).join(price(7 * DAY, "price_then"), "symbol").join(price(0, "price_now"), "symbol")
    train = before.withColumn("alpha_target", safe_divide("price_now", "price_then") - 1.0).where("alpha_target IS NOT NULL")
    model = models.train_tokens(cut_lineage(train), "alpha_target")
    return models.score_tokens(cut_lineage(inputs(0)), model).select("symbol", rounded("alpha").alias("alpha"))


WEIGHTED = f"sum(({SENTIMENT_SQL}) * weight) / nullif(sum(weight), 0)"
VALUE_CTES = {
    "val": """
        SELECT p.portfolio_id, c.ts, sum(p.quantity * c.close) AS value FROM positions p JOIN closes c USING (symbol)
        GROUP BY ALL HAVING sum(p.quantity * c.close) > 0""",
    "ret": """
        SELECT *, value / lag(value) OVER w - 1 AS ret, max(value) OVER w AS peak,
               (value - max(value) OVER w) / max(value) OVER w AS drawdown
        FROM val WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts)""",
    "agg": """
        SELECT portfolio_id, count(*) - 1 AS period_days, arg_max(value, ts) / arg_min(value, ts) - 1 AS total_return,
               stddev_samp(ret) * sqrt(365) AS volatility,
               CASE WHEN count(*) FILTER (WHERE ret < 0) >= 2
                    THEN stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt(365) END AS down,
               min(drawdown) AS max_drawdown,
               list_sort(list(ret) FILTER (WHERE ret IS NOT NULL))[1 + floor(0.05 * (count(ret) - 1))::INT] AS var_95
        FROM ret GROUP BY portfolio_id HAVING count(*) >= 3""",
    "conc": """
        SELECT portfolio_id, sum(v * v) / nullif(sum(v), 0) / nullif(sum(v), 0) AS concentration_index, count(*) AS num_assets
        FROM (SELECT p.portfolio_id, p.quantity * nullif(l.close, 0) AS v FROM positions p
              LEFT JOIN (SELECT symbol, arg_max(close, ts) AS close FROM closes GROUP BY symbol) l USING (symbol))
        GROUP BY portfolio_id""",
}
METRICS_SQL = "SELECT portfolio_id, period_days, num_assets, " + _r({
    "total_return": "total_return", "volatility": "volatility", "max_drawdown": "max_drawdown", "var_95": "var_95",
    "concentration_index": "concentration_index"}) + "".join(
    f", CAST(printf('%.9e', {e}) AS DOUBLE) + 0.0 AS {n}" for n, e in {
        "annualized_return": "ann", "sharpe_ratio": "CASE WHEN volatility > 0 THEN ann / volatility END",
        "sortino_ratio": "CASE WHEN down > 0 THEN ann / down END"}.items()) + (
    " FROM (SELECT *, power(1 + total_return, 365.0 / period_days) - 1 AS ann FROM agg) JOIN conc USING (portfolio_id)")
OUT_CTES = {**BOLLINGER_CTES, "base": f"""
    SELECT *, {FEATURE_SQL['roll_std']} AS roll_std, {FEATURE_SQL['bb_z']} AS bb_z, {
    ', '.join(f"{FEATURE_SQL[c]} AS {c}" for h in feature_ops.HORIZONS for c in (f"mom_{h}", f"y_{h}"))}, {
    ', '.join(f"{LABEL_SQL[f'dir_{h}']} AS dir_{h}" for h in feature_ops.HORIZONS)} FROM bands""",
    "outputs": " UNION ALL ".join(
        f"SELECT ts, pos, '{h}' AS horizon, mom_{h} * 0.1 AS mu, ln(roll_std) AS log_sigma, bb_z AS logit, y_{h} AS y,"
        f" dir_{h} AS dir, 1 / (1 + exp(-bb_z)) AS p FROM base" for h in feature_ops.HORIZONS)}
NLL = "power(mu - y, 2) / (power(exp({s}), 2) + {e}) + 2 * {s}"
CLAMPED = "greatest(-3, least(3, log_sigma))"

QUERIES = {
    "sentiment_by_conversation": (sentiment_by_conversation, sql(
        f"SELECT conv_id, count(*) AS messages, round(coalesce({WEIGHTED}, 0.5), 6) + 0.0 AS sentiment FROM messages"
        " GROUP BY conv_id", "messages")),
    "momentum_alpha_signal": (momentum_alpha_signal, sql(
        "SELECT symbol, open_time, direction, " + _r({
            **_same(["momentum", "sentiment_score", "on_chain_score", "alpha_score"]),
            "confidence": "greatest(0, least(1, abs(alpha_score - 0.5) * 2))", "entry_price": "close",
            "stop_loss": "CASE WHEN direction = 'BUY' THEN close - 1.5 * span ELSE close + 1.5 * span END",
            "take_profit": "CASE WHEN direction = 'BUY' THEN close + 3 * span ELSE close - 3 * span END"})
        + " FROM (SELECT *, CASE WHEN alpha_score >= 0.6 THEN 'BUY' WHEN alpha_score > 0.45 THEN 'HOLD' ELSE 'SELL' END"
          " AS direction, CASE WHEN high - low <> 0 THEN high - low ELSE close * 0.005 END AS span FROM ("
          "SELECT *, greatest(0, least(1, 0.4 * ((momentum + 1) / 2) + 0.4 * sentiment_score + 0.2 * on_chain_score))"
          " AS alpha_score FROM scored))", "candles", "messages", ctes={"scored": f"""
            SELECT symbol, open_time, close, high, low, 0.5 AS on_chain_score,
                   (SELECT coalesce({WEIGHTED}, 0.5) FROM messages) AS sentiment_score,
                   CASE WHEN n < 51 THEN 0 ELSE greatest(-0.1, least(0.1, (close - sma) / sma)) / 0.1 END AS momentum
            FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS 49 PRECEDING) AS sma,
                         count(*) OVER (PARTITION BY symbol) AS n,
                         row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM candles) WHERE rn = 1"""})),
    "change_signal": (change_signal, sql(
        "SELECT symbol, direction, " + _r({
            "entry_price": "close", "change": "change", "confidence": "least(1, abs(change) * 200)",
            "stop_loss": "CASE WHEN direction = 'BUY' THEN close * 0.98 ELSE close * 1.02 END",
            "take_profit": "CASE WHEN direction = 'BUY' THEN close * 1.02 ELSE close * 0.98 END"})
        + " FROM (SELECT *, CASE WHEN change > 0.002 THEN 'BUY' WHEN change < -0.002 THEN 'SELL' ELSE 'HOLD' END AS direction"
          " FROM (SELECT symbol, close, (close - prev) / prev AS change FROM (SELECT *, lag(close) OVER w AS prev,"
          " row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM candles"
          " WINDOW w AS (PARTITION BY symbol ORDER BY open_time)) WHERE rn = 1 AND prev IS NOT NULL))", "candles")),
    "portfolio_values": (portfolio_values, sql(
        "SELECT portfolio_id, ts, " + _r(_same(["value", "ret", "peak", "drawdown"]), 5) + " FROM ret",
        "positions", "daily_closes", ctes={"closes": "SELECT * FROM daily_closes", **VALUE_CTES})),
    "portfolio_metrics": (portfolio_metrics, sql(
        METRICS_SQL, "positions", "daily_closes", ctes={"closes": "SELECT * FROM daily_closes", **VALUE_CTES})),
    "portfolio_metrics_ordinal": (portfolio_metrics_ordinal, sql(
        METRICS_SQL, "positions", "trades", ctes={
            "closes": "SELECT symbol, ts, close FROM (SELECT symbol, date_trunc('day', trade_time) AS ts,"
                      " arg_max(price, trade_time) AS close, max(trade_id) AS last_id FROM trades GROUP BY ALL)"
                      " WHERE last_id % 3 <> 0",
            "placed": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM closes",
            "refs": "SELECT portfolio_id, min(symbol) AS ref FROM positions"
                    " WHERE symbol IN (SELECT symbol FROM closes) GROUP BY 1",
            **VALUE_CTES,
            "val": "SELECT p.portfolio_id, t.ts, sum(p.quantity * c.close) AS value FROM refs r"
                   " JOIN placed t ON t.symbol = r.ref JOIN positions p ON p.portfolio_id = r.portfolio_id"
                   " JOIN placed c ON c.symbol = p.symbol AND c.i = t.i GROUP BY ALL HAVING sum(p.quantity * c.close) > 0"})),
    "portfolio_detail": (portfolio_detail, sql(
        "SELECT b.portfolio_id, 'book-' || b.portfolio_id AS name, b.created_at, CAST(0 AS BIGINT) AS page,"
        " coalesce(string_agg(p.symbol || ':' || CAST(p.quantity AS BIGINT), ',' ORDER BY p.symbol), '') AS positions"
        " FROM (SELECT user_id % 25 AS portfolio_id, min(ts) AS created_at FROM events GROUP BY 1) b"
        " LEFT JOIN positions p USING (portfolio_id) GROUP BY ALL", "positions")),
    "portfolio_latest": (portfolio_latest, sql(
        "SELECT portfolio_id, ts AS snapshot_ts, " + _r(_same(["value", "drawdown"]), 5)
        + " FROM ret QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY ts DESC) = 1",
        "positions", "daily_closes", ctes={"closes": "SELECT * FROM daily_closes", **VALUE_CTES})),
    "portfolio_history": (portfolio_history, sql(
        "SELECT portfolio_id, ts AS snapshot_ts, " + _r(_same(["value", "drawdown"]), 5)
        + " FROM ret WHERE ts >= (SELECT max(ts) FROM daily_closes) - INTERVAL 10 DAY",
        "positions", "daily_closes", ctes={"closes": "SELECT * FROM daily_closes", **VALUE_CTES})),
    "whale_transfers": (whale_transfers, sql("SELECT * FROM transfers WHERE amount_usd >= 250000", "transfers")),
    "large_trades": (large_trades, sql(
        "SELECT trade_id, symbol, trade_time, side, round(price, 6) + 0.0 AS price, quantity,"
        " round(notional_usd, 3) + 0.0 AS notional_usd FROM trades t WHERE t.notional_usd > 10000"
        " ORDER BY trade_time DESC, trade_id DESC LIMIT 200", "trades")),
    "recent_activity": (recent_activity, sql(
        "SELECT metric_id, token_id, metric_time FROM token_metrics WHERE metric_time >="
        " (SELECT max(metric_time) FROM token_metrics) - INTERVAL 1 HOUR ORDER BY metric_time, metric_id LIMIT 1000",
        "token_metrics")),
    "summary_cards": (summary_cards, sql(
        "SELECT 'Big Futures Trades' AS title, CAST(count(*) AS VARCHAR) AS value FROM trades WHERE notional_usd > 10000"
        " UNION ALL SELECT 'Active Wallets', CAST(count(*) AS VARCHAR) FROM customer WHERE c_acctbal > 0"
        " UNION ALL SELECT 'Leg 1 Volume 24h', printf('%.0f', coalesce(sum(leg1_volume), 0)) FROM pair_spread"
        " WHERE ts > (SELECT max(ts) FROM pair_spread) - INTERVAL 24 HOUR"
        " UNION ALL SELECT 'Leg 2 Volume 24h', printf('%.0f', coalesce(sum(leg2_volume), 0)) FROM pair_spread"
        " WHERE ts > (SELECT max(ts) FROM pair_spread) - INTERVAL 24 HOUR", "pair_spread")),
    "symbol_formats": (symbol_formats, sql(
        "SELECT symbol, open_time, symbol || CASE WHEN length(symbol) % 2 = 0 THEN '-USDT' ELSE '-USD' END AS product,"
        " left(p, length(p) - 4) AS base, right(p, 4) AS quote,"
        " CAST(CASE WHEN h < 8 THEN (h + 1) * 60 WHEN h < 16 THEN (h + 1) * 3600 WHEN h < 22 THEN (h + 1) * 86400"
        " ELSE 900 END AS BIGINT) AS seconds, CAST(CASE WHEN h < 8 THEN h + 1 WHEN h < 16 THEN (h + 1) * 60"
        " WHEN h < 22 THEN (h + 1) * 1440 ELSE 15 END AS INT) AS minutes, epoch_ms(open_time) AS open_ms,"
        " strftime(open_time, '%Y-%m-%dT%H:%M:%S.000Z') AS open_iso, printf('%.0f', volume) AS volume_text,"
        " printf('%.0f', trades_count * 25.0::DOUBLE) || '%' AS share_text,"
        " printf('%.1e', trades_count::DOUBLE) AS count_exp FROM (SELECT *, hour(open_time) AS h,"
        " symbol || CASE WHEN length(symbol) % 2 = 0 THEN 'USDT' ELSE 'USD' END AS p FROM candles)", "candles")),
    "latest_window": (latest_window, sql(
        "SELECT ts, " + _r({
            "spread_log": "spread",
            "leg1_z": "(leg1_volume - avg(leg1_volume) OVER ()) / (stddev_pop(leg1_volume) OVER () + 1e-8)",
            "leg2_z": "(leg2_volume - avg(leg2_volume) OVER ()) / (stddev_pop(leg2_volume) OVER () + 1e-8)"})
        + " FROM spread WHERE pos >= n_rows - 168", "spread")),
    "window_dataset": (window_dataset, sql(
        "SELECT ts, dir_4h, CAST(168 AS INT) AS steps, " + _r({"first_spread": "f", "last_spread": "l"}) + ", "
        + _r({"sum_spread": "ss", "sum_spread_ret": "sr", "sum_leg1_volume": "sv"}, 5) + ", "
        + _r({"y_1h": "y_1h", "y_24h": "y_24h"}) + " FROM w WHERE pos >= 168 AND pos < n_rows - 24", "spread",
        ctes={"w": "SELECT ts, pos, n_rows, sum(spread) OVER f AS ss, sum(ret) OVER f AS sr, sum(leg1_volume) OVER f AS sv,"
                   " first(spread) OVER f AS f, last(spread) OVER f AS l, "
                   + ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in ("y_1h", "y_24h"))
                   + f", {LABEL_SQL['dir_4h']} AS dir_4h FROM spread"
                     " WINDOW f AS (ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"})),
    "flat_windows": (flat_windows, sql(
        "SELECT ts, CAST(504 AS INT) AS width, " + _r({
            "sum_0": "s0", "sum_1": "s1", "sum_2": "s2"}, 5) + ", " + _r(_same([f"y_{h}" for h in feature_ops.HORIZONS]))
        + " FROM w WHERE pos >= 167 AND pos < n_rows - 24", "spread", ctes={
            "z": "SELECT *, (leg1_volume - avg(leg1_volume) OVER ()) / (stddev_pop(leg1_volume) OVER () + 1e-8) AS z1,"
                 " (leg2_volume - avg(leg2_volume) OVER ()) / (stddev_pop(leg2_volume) OVER () + 1e-8) AS z2 FROM spread",
            "w": "SELECT ts, pos, n_rows, sum(spread) OVER f AS s0, sum(z1) OVER f AS s1, sum(z2) OVER f AS s2, "
                 + ", ".join(f"{FEATURE_SQL[f'y_{h}']} AS y_{h}" for h in feature_ops.HORIZONS)
                 + " FROM z WINDOW f AS (ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"})),
    "time_split": (time_split, sql(
        "SELECT CASE WHEN pos < floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS n,"
        " min(ts) AS from_ts, max(ts) AS to_ts FROM spread GROUP BY 1", "spread")),
    "prediction_decode": (prediction_decode, sql(
        "SELECT ts, horizon, CASE WHEN p > 0.55 THEN 'up' WHEN 1 - p > 0.55 THEN 'down' ELSE 'neutral' END AS direction, "
        + _r({"mu": "mu", "sigma": "exp(log_sigma)", "p_up": "p", "p_down": "1 - p", "confidence": "greatest(p, 1 - p)",
              "prob_softmax": "greatest(0.001, least(0.999, p))",
              "prob_heuristic": "0.5 + greatest(-0.4, least(0.4, mu / (4 * CASE WHEN exp(log_sigma) > 1e-8"
                                " THEN exp(log_sigma) ELSE 1e-3 END)))"}, 5) + " FROM outputs", "spread", ctes=OUT_CTES)),
    "loss_metrics": (loss_metrics, sql(
        "SELECT horizon, samples, " + _r({**_same(["nll", "nll_unclamped", "direction_loss"]),
                                          "loss": "nll + 0.7 * direction_loss"}, 5)
        + " FROM (SELECT coalesce(horizon, 'all') AS horizon, count(*) AS samples, avg("
        + NLL.format(s=CLAMPED, e="1e-6") + ") AS nll, avg(" + NLL.format(s="log_sigma", e="1e-8")
        + ") AS nll_unclamped, avg(CASE WHEN dir = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS direction_loss"
          " FROM outputs GROUP BY GROUPING SETS ((horizon), ()))", "spread", ctes=OUT_CTES)),
    "model_fallback": (model_fallback, sql(
        "SELECT pair, ts, CASE WHEN pos >= 168 THEN 'v2' ELSE 'v1' END AS model,"
        " round(CASE WHEN pos >= 168 THEN spread * 2 ELSE spread END, 6) + 0.0 AS prediction FROM spread", "spread")),
    "model_registry": (model_registry, sql(
        "SELECT * FROM (SELECT name, strftime(created_at, '%Y%m%d') AS version_tag, CAST(n AS BIGINT) AS trained_on_rows,"
        " created_at, notes FROM (SELECT symbol AS name, date_trunc('day', trade_time) AS created_at, count(*) AS n,"
        " 'batch' AS notes FROM trades GROUP BY ALL UNION ALL SELECT 'ensemble', date_trunc('day', trade_time), count(*), NULL"
        " FROM trades GROUP BY ALL)) ORDER BY created_at DESC, name, version_tag LIMIT 50", "trades")),
    "gbt_scores": (gbt_scores, None),
    "token_alpha": (token_alpha, None),
}
