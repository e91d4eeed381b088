"""Recursive indicators, spike alerts with a cooldown, subscriptions, copy trades and outcomes of predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions.math import rounded
from tickloom.functions.times import seconds_interval
from tickloom.operators import cooldown, indicators, lots, outcomes, regimes, subscriptions, tables, text_index, trending
from tickloom.operators.blocks import SeriesBlocks, block_seconds_for, time_block
from tickloom.operators.timeseries import full_window
from tickloom.plans import views
from tickloom.plans.oracle import sql
from tickloom.session import shared_dir

HOUR, DAY = 3600, 86400


def recursive_indicators(spark, d):
    """Over the hourly candles of every symbol."""
    out = indicators.recursive_indicators(views.candles(spark, d), ["symbol"])
    return out.select("symbol", "open_time", *[rounded(c).alias(c) for c in indicators.INDICATORS])


REGIMES = {"volatility_regime": ("vol_rank", regimes.VOLATILITY), "liquidity_regime": ("volume_rank", regimes.LIQUIDITY),
           "trend_regime": ("drift", regimes.TREND)}


def regime_labels(spark, d):
    """Volatility and liquidity by their rank among the last week of hours, trend by two moving averages."""
    c = views.candles(spark, d)
    s = SeriesBlocks(("symbol",), ("open_time",), time_block("open_time", block_seconds_for(c, ["symbol"], "open_time")), back=50)
    opened = s.open(c.select("symbol", "open_time", "close", "volume")).withColumn("ret", F.col("close") / F.lag("close").over(s.row_window()) - 1)
    shaped = s.close(opened.withColumns({
        "vol": F.when(F.col("pos") >= 20, F.stddev_samp("ret").over(s.rows(-19, 0))),
        "drift": (full_window(F.avg("close").over(s.rows(-19, 0)), 50) - full_window(F.avg("close").over(s.rows(-49, 0)), 50)) / F.col("close")}))
    ranked = regimes.trailing_ranks(shaped.drop("pos", "n_rows", "ret"), ["symbol"], "open_time", ["vol", "volume"])
    out = regimes.with_regimes(ranked, ["symbol"], "open_time", REGIMES)
    return out.select("symbol", "open_time", *[rounded(c).alias(c) for c in ("vol_rank", "volume_rank")], *REGIMES)


COOLDOWN = 48 * HOUR  # events are sparse: hours stand for minutes
SPIKE = dict(min_price_rise=0.25, min_volume_ratio=3.0)


def spike_alerts(spark, d):
    found = cooldown.spikes(views.token_metrics(spark, d), **SPIKE)
    return found.select("token_id", "metric_id", "metric_time", *[rounded(c).alias(c) for c in ("price_rise", "volume_ratio")])


def alert_cooldown(spark, d):
    found = cooldown.spikes(views.token_metrics(spark, d), **SPIKE)
    return cooldown.thin(found, COOLDOWN).select("token_id", "metric_id", "metric_time")


def copy_settings(spark, d):
    """A follower per customer: a wallet, an asset or all, a least confidence and a limit or none."""
    c = views.table(spark, d, "customer")
    assets = F.array(*[F.lit(s) for s in ("CLICK", "VIEW", "PURCHASE", "SIGNUP", "ERROR")])
    return c.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 1500).alias("wallet_id"),
        F.get(assets, (F.col("c_nationkey") % 6).cast("int")).alias("asset"),
        ((F.col("c_custkey") % 5 + 1) / 10.0).alias("min_confidence"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).alias("max_notional_usd"),
        (F.col("c_custkey") % 9 != 0).alias("active"))


def leader_signals(spark, d):
    t = views.trades(spark, d)
    return t.select(
        F.col("trade_id").alias("signal_id"), F.col("user_id").alias("wallet_id"), F.col("symbol").alias("asset"),
        F.col("side").alias("direction"), ((F.col("trade_id") % 100) / 100.0).alias("confidence"), "price",
        (F.lit(1) + F.col("trade_id") % 7).alias("quantity"), F.col("trade_time").alias("ts"))


def _executions(spark, d):
    copied = lots.copy_signals(leader_signals(spark, d), copy_settings(spark, d))
    trades = copied.withColumnsRenamed({"direction": "side", "signal_id": "trade_id"})
    return lots.match_lots(trades, ["follower", "asset"])


def copy_executions(spark, d):
    return _executions(spark, d).select(
        "follower", "asset", "buy_id", "sell_id", "side", "opened_at", "closed_at",
        *[rounded(c).alias(c) for c in ("quantity", "entry_price", "exit_price", "pnl", "roi")])


def trade_analytics(spark, d):
    out = lots.trade_analytics(_executions(spark, d), ["follower"])
    return out.select("follower", "closed_trades", *[rounded(c, 5).alias(c) for c in
                                                     ("win_rate", "total_pnl", "pnl_pct", "best_roi", "worst_roi")])


def subscription_matches(spark, d):
    """Signals are hourly candles, as confident as their close is high in their range; every customer subscribes."""
    c = views.candles(spark, d)
    span = F.col("high") - F.col("low")
    signals = c.select(
        F.concat_ws("/", "symbol", F.date_format("open_time", "yyyyMMddHH")).alias("signal_id"), F.col("symbol").alias("asset"),
        F.when(F.col("trades_count") % 3 > 0, F.concat((F.col("trades_count") % 3).cast("string"), F.lit("h"))).alias("timeframe"),
        F.when(span > 0, F.round((F.col("close") - F.col("low")) / span, 4)).alias("confidence"))
    s = views.table(spark, d, "customer")
    assets = F.array(*[F.lit(x) for x in ("CLICK", "VIEW", "PURCHASE", "SIGNUP", "ERROR")])
    subscribed = s.select(
        F.col("c_custkey").alias("subscription_id"), F.get(assets, (F.col("c_nationkey") % 6).cast("int")).alias("asset"),
        F.when(F.col("c_custkey") % 4 > 0, F.concat((F.col("c_custkey") % 4).cast("string"), F.lit("h"))).alias("timeframe"),
        (F.lit(1.0) - (F.col("c_custkey") % 97) / 2000.0).alias("min_confidence"), (F.col("c_custkey") % 7 != 0).alias("is_active"))
    return subscriptions.match_subscriptions(signals, subscribed)


HORIZON = 6 * HOUR


def prediction_performance(spark, d):
    """Per token, of the predictions of the last seven days."""
    m = views.token_metrics(spark, d)
    judged = outcomes.prediction_outcomes(m, m, HORIZON)
    since = views.as_of(m, "metric_time") - seconds_interval(7 * DAY)
    out = outcomes.prediction_performance(judged, since, ["token_id"])
    return out.select("token_id", "total_predictions", "with_outcome", "high_conf_count",
                      *[rounded(c).alias(c) for c in ("avg_future_return", "high_conf_pump_rate")])


def prediction_outcomes(spark, d):
    m = views.token_metrics(spark, d)
    out = outcomes.prediction_outcomes(m, m, HORIZON)
    return out.select("token_id", "metric_id", "future_time", *[rounded(c).alias(c) for c in ("future_price", "future_return")])


def retention_stored(spark, d):
    """The metrics stored by day, trimmed to 14 days before the newest instant and read back."""
    path = f"{shared_dir(spark)}/retention/{uuid.uuid4().hex}"
    m = views.token_metrics(spark, d).withColumn("day", F.to_date("metric_time"))
    tables.write_table(m, path, ["day"])
    newest = spark.read.schema(m.schema).parquet(path).agg(F.max("metric_time").cast("string")).first()[0]
    tables.retain_table(spark, path, "metric_time", F.lit(newest).cast("timestamp") - seconds_interval(14 * DAY))
    return spark.read.schema(m.schema).parquet(path).select("metric_id", "metric_time", "token_id", rounded("price").alias("price"))


QUESTIONS = ("0012", "uild", "#", "er#00000005", "Ma", "gone")
FIELDS = ["mint", "symbol", "name"]


def _named(spark, d):
    return views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("token_id"), F.col("c_name").alias("mint"), F.col("c_mktsegment").alias("symbol"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Märkte "), F.col("c_nationkey").cast("string"))).alias("name"))


def token_search(spark, d):
    """An index over all tokens, brought up to date with renamed tokens, answers each question."""
    path = f"{shared_dir(spark)}/token-index/{uuid.uuid4().hex}"
    stored = _named(spark, d)
    text_index.build_index(stored, path, "token_id", FIELDS)
    renamed = F.col("token_id") % 5 == 0
    tokens = stored.withColumn("name", F.when(renamed, F.concat(F.lit("GONE "), F.col("symbol"))).otherwise(F.col("name")))
    text_index.update_index(spark, path, stored, tokens.where(renamed), "token_id", FIELDS)
    parts = [text_index.search_tokens(spark, path, tokens, q, "token_id", FIELDS).select(F.lit(q).alias("question"), "token_id", "mint", "name")
             for q in QUESTIONS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trending_terms(spark, d):
    """The terms that make up one in two hundred of all terms of their turn."""
    out = trending.trending_terms(views.messages(spark, d), F.col("turn"), share=0.005, best=50)
    return out.select("window", "term", "n", rounded("share").alias("share"), "rank")


def sentiment_spread(spark, d):
    """Per turn, with words that the texts do hold; the assistant's messages are the answers."""
    out = trending.sentiment_spread(views.messages(spark, d), ["turn"], F.col("weight") > 1, positive=("the", "que"), negative=("and", "ein"))
    return out.select("turn", "messages", *[rounded(c).alias(c) for c in ("sentiment", "sentiment_volatility", "engagement_rate")])


def _rounded(names, digits=6):
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _wilder(state: str, x: str, seed: str, n: int) -> str:
    return f"CASE WHEN i.pos < {n} THEN NULL WHEN i.pos = {n} THEN i.{seed} ELSE (r.{state} * {n - 1} + i.{x}) / {n} END"


def _seed(x: str, n: int) -> str:
    return f"avg({x}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


INDICATOR_CTES = {
    "c": """
        SELECT symbol, open_time, close, high, low, (high + low) / 2 AS mid, row_number() OVER w - 1 AS pos,
               lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1
        FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time)""",
    "x": """
        SELECT *, greatest(close - c1, 0) AS gain, greatest(c1 - close, 0) AS loss,
               greatest(high - low, abs(high - c1), abs(low - c1)) AS tr,
               CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END AS pdm,
               CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0 END AS mdm FROM c""",
    "i": f"""
        SELECT *, {_seed('gain', 14)} AS gain0, {_seed('loss', 14)} AS loss0, {_seed('tr', 14)} AS tr0, {_seed('pdm', 14)} AS pdm0,
               {_seed('mdm', 14)} AS mdm0, {_seed('tr', 10)} AS atr0 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY pos)""",
    "r": f"""
        SELECT symbol, open_time, pos, close, NULL::DOUBLE AS up, NULL::DOUBLE AS down, NULL::DOUBLE AS tr, NULL::DOUBLE AS pdm,
               NULL::DOUBLE AS mdm, NULL::DOUBLE AS atr, close AS fast, close AS slow, 0.0::DOUBLE AS sig, NULL::DOUBLE AS dx,
               0.0::DOUBLE AS dxs, NULL::DOUBLE AS adx, NULL::DOUBLE AS fu, NULL::DOUBLE AS fl, NULL::DOUBLE AS trend
        FROM i WHERE pos = 0
        UNION ALL
        SELECT symbol, open_time, pos, close, up, down, tr, pdm, mdm, atr, fast, slow, sig, dx, dxs,
               CASE WHEN pos < 27 THEN NULL WHEN pos = 27 THEN dxs / 14 ELSE (adx0 * 13 + dx) / 14 END,
               fu, fl, CASE WHEN close > fu THEN 1.0 WHEN close < fl THEN -1.0 WHEN fu IS NULL THEN NULL ELSE coalesce(trend0, 1.0) END
        FROM (
            SELECT *, sig0 + 0.2 * (fast - slow - sig0) AS sig, dxs0 + CASE WHEN pos BETWEEN 14 AND 27 THEN dx ELSE 0 END AS dxs,
                   CASE WHEN fu0 IS NULL OR mid + 3 * atr < fu0 OR c1 > fu0 THEN mid + 3 * atr ELSE fu0 END AS fu,
                   CASE WHEN fl0 IS NULL OR mid - 3 * atr > fl0 OR c1 < fl0 THEN mid - 3 * atr ELSE fl0 END AS fl
            FROM (
                SELECT *, CASE WHEN tr IS NULL THEN NULL WHEN pdm + mdm > 0 AND tr > 0 THEN 100 * abs(pdm - mdm) / (pdm + mdm) ELSE 0 END AS dx
                FROM (
                    SELECT i.symbol, i.open_time, i.pos, i.close, i.mid, i.c1, r.sig AS sig0, r.dxs AS dxs0, r.adx AS adx0, r.fu AS fu0,
                           r.fl AS fl0, r.trend AS trend0,
                           {_wilder('up', 'gain', 'gain0', 14)} AS up, {_wilder('down', 'loss', 'loss0', 14)} AS down,
                           {_wilder('tr', 'tr', 'tr0', 14)} AS tr, {_wilder('pdm', 'pdm', 'pdm0', 14)} AS pdm,
                           {_wilder('mdm', 'mdm', 'mdm0', 14)} AS mdm, {_wilder('atr', 'tr', 'atr0', 10)} AS atr,
                           r.fast + 2.0 / 13 * (i.close - r.fast) AS fast, r.slow + 2.0 / 27 * (i.close - r.slow) AS slow
                    FROM r JOIN i ON i.symbol = r.symbol AND i.pos = r.pos + 1)))""",
    "named": """
        SELECT symbol, open_time, CASE WHEN up + down > 0 THEN 100 * up / (up + down) WHEN up IS NOT NULL THEN 50 END AS rsi,
               fast - slow AS macd, sig AS macd_signal, fast - slow - sig AS macd_hist,
               CASE WHEN tr > 0 THEN 100 * pdm / tr WHEN tr = 0 THEN 0 END AS plus_di,
               CASE WHEN tr > 0 THEN 100 * mdm / tr WHEN tr = 0 THEN 0 END AS minus_di, adx, atr, fu AS final_upper, fl AS final_lower,
               trend, CASE WHEN trend > 0 THEN fl ELSE fu END AS supertrend FROM r""",
}

def _hysteresis(name: str, value: str, regime: regimes.Regime) -> str:
    first, middle, last = regime.labels
    low, high, m = regime.low, regime.high, regime.margin
    return (f"CASE WHEN i.{value} >= {high + m!r}::DOUBLE THEN '{last}' WHEN i.{value} <= {low - m!r}::DOUBLE THEN '{first}'"
            f" WHEN r.{name} = '{first}' AND i.{value} >= {low + m!r}::DOUBLE THEN '{middle}'"
            f" WHEN r.{name} = '{last}' AND i.{value} <= {high - m!r}::DOUBLE THEN '{middle}' ELSE r.{name} END AS {name}")


def _trailing(value: str) -> str:
    return (f"CASE WHEN {value} IS NOT NULL AND len(list_filter(l_{value}, lambda v: v IS NOT NULL)) >= 24 THEN"
            f" len(list_filter(l_{value}, lambda v: v <= {value})) / len(list_filter(l_{value}, lambda v: v IS NOT NULL)) END AS {value}_rank")


REGIME_CTES = {
    "c": """
        SELECT *, close / lag(close) OVER w - 1 AS ret, row_number() OVER w AS n FROM candles
        WINDOW w AS (PARTITION BY symbol ORDER BY open_time)""",
    "v": """
        SELECT *, CASE WHEN n > 20 THEN stddev_samp(ret) OVER (w ROWS 19 PRECEDING) END AS vol,
               CASE WHEN n >= 50 THEN (avg(close) OVER (w ROWS 19 PRECEDING) - avg(close) OVER (w ROWS 49 PRECEDING)) / close END AS drift
        FROM c WINDOW w AS (PARTITION BY symbol ORDER BY n)""",
    "l": """
        SELECT *, list(vol) OVER w AS l_vol, list(volume) OVER w AS l_volume FROM v
        WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS 167 PRECEDING)""",
    "i": f"SELECT symbol, open_time, n, drift, {_trailing('vol')}, {_trailing('volume')} FROM l",
    "r": f"""
        SELECT symbol, NULL::TIMESTAMP AS open_time, 0::BIGINT AS n, NULL::DOUBLE AS vol_rank, NULL::DOUBLE AS volume_rank,
               'medium' AS volatility_regime, 'normal' AS liquidity_regime, 'range' AS trend_regime FROM (SELECT DISTINCT symbol FROM i)
        UNION ALL
        SELECT i.symbol, i.open_time, i.n, i.vol_rank, i.volume_rank, {', '.join(_hysteresis(n, v, g) for n, (v, g) in REGIMES.items())}
        FROM r JOIN i ON i.symbol = r.symbol AND i.n = r.n + 1""",
}

SPIKES = """
    SELECT * FROM (
        SELECT token_id, metric_id, metric_time, price / nullif(lag(price) OVER w, 0) - 1 AS price_rise,
               volume / nullif(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS volume_ratio
        FROM token_metrics WINDOW w AS (PARTITION BY token_id ORDER BY metric_time, metric_id))
    WHERE price_rise >= 0.25 OR volume_ratio >= 3"""

SETTINGS = """
    SELECT c_custkey AS follower, c_custkey % 1500 AS wallet_id,
           ['CLICK', 'VIEW', 'PURCHASE', 'SIGNUP', 'ERROR'][c_nationkey % 6 + 1] AS only_asset, (c_custkey % 5 + 1) / 10.0 AS min_confidence,
           CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS most FROM customer WHERE c_custkey % 9 <> 0"""
COPY_CTES = {
    "settings": SETTINGS,
    "copied": """
        SELECT follower, symbol AS asset, side, trade_id AS id, trade_time AS ts, price,
               least(1 + trade_id % 7, CASE WHEN most IS NOT NULL THEN floor(most / price) END) AS q
        FROM trades JOIN settings ON wallet_id = user_id AND (only_asset IS NULL OR only_asset = symbol)
        WHERE (trade_id % 100) / 100.0 >= min_confidence""",
    "lots": """
        SELECT *, sum(q) OVER (PARTITION BY follower, asset, side ORDER BY ts, id) AS hi,
               sum(q) OVER (PARTITION BY follower, asset, side ORDER BY ts, id) - q AS lo FROM copied WHERE q > 0""",
    "met": """
        SELECT b.follower, b.asset, b.id AS buy_id, s.id AS sell_id, (b.ts, b.id) <= (s.ts, s.id) AS is_long,
               CAST(least(b.hi, s.hi) - greatest(b.lo, s.lo) AS DOUBLE) AS quantity, b.price AS bp, s.price AS sp, b.ts AS bt, s.ts AS st
        FROM lots b JOIN lots s ON b.follower = s.follower AND b.asset = s.asset AND b.side = 'BUY' AND s.side = 'SELL'
             AND b.lo < s.hi AND s.lo < b.hi""",
    "executed": """
        SELECT follower, asset, buy_id, sell_id, CASE WHEN is_long THEN 'LONG' ELSE 'SHORT' END AS side,
               CASE WHEN is_long THEN bt ELSE st END AS opened_at, CASE WHEN is_long THEN st ELSE bt END AS closed_at, quantity,
               CASE WHEN is_long THEN bp ELSE sp END AS entry_price, CASE WHEN is_long THEN sp ELSE bp END AS exit_price,
               (sp - bp) * quantity AS pnl, (sp - bp) * quantity / (CASE WHEN is_long THEN bp ELSE sp END * quantity) AS roi FROM met""",
}

OUTCOMES = """
    SELECT p.token_id, p.metric_id, p.metric_time, p.pump_probability, f.metric_time AS future_time, f.price AS future_price,
           f.price / p.price - 1 AS future_return
    FROM (SELECT *, metric_time + INTERVAL 6 HOUR AS until FROM token_metrics) p
    ASOF LEFT JOIN token_metrics f ON p.token_id = f.token_id AND p.until <= f.metric_time"""


TURN_TERMS = r"""
    SELECT CAST(turn AS VARCHAR) AS "window", unnest(regexp_extract_all(lower(coalesce(text, '')), '[#$]?[\p{L}\p{N}_]+')) AS term FROM messages"""

SENTIMENT = """
    SELECT turn, weight > 1 AS answer, CASE WHEN coalesce(text, '') = '' THEN 0.5 ELSE (contains(lower(text), 'the')::INT
           + contains(lower(text), 'que')::INT - contains(lower(text), 'and')::INT - contains(lower(text), 'ein')::INT + 5.0) / 10.0 END AS s
    FROM messages"""

NAMED = """
    SELECT c_custkey AS token_id, c_name AS mint, c_mktsegment AS symbol, CASE WHEN c_custkey % 5 = 0 THEN 'GONE ' || c_mktsegment
           WHEN c_acctbal > 0 THEN 'Märkte ' || c_nationkey END AS name FROM customer"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "recursive_indicators": (recursive_indicators, _recursive(sql(
        f"SELECT symbol, open_time, {_rounded(indicators.INDICATORS)} FROM named", "candles", ctes=INDICATOR_CTES))),
    "regime_labels": (regime_labels, _recursive(sql(
        f"SELECT symbol, open_time, {_rounded(['vol_rank', 'volume_rank'])}, {', '.join(REGIMES)} FROM r WHERE n > 0", "candles",
        ctes=REGIME_CTES))),
    "spike_alerts": (spike_alerts, sql(
        f"SELECT token_id, metric_id, metric_time, {_rounded(['price_rise', 'volume_ratio'])} FROM ({SPIKES})", "token_metrics")),
    "alert_cooldown": (alert_cooldown, _recursive(sql(
        "SELECT token_id, metric_id, metric_time FROM accepted", "token_metrics", ctes={
            "spikes": SPIKES,
            "ranked": "SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY metric_time, metric_id) AS n FROM spikes",
            "followed": "SELECT a.token_id, a.n, min(b.n) AS m FROM ranked a JOIN ranked b ON a.token_id = b.token_id"
                        " AND b.metric_time >= a.metric_time + INTERVAL 48 HOUR GROUP BY ALL",
            "walk": "SELECT token_id, n FROM ranked WHERE n = 1 UNION ALL SELECT f.token_id, f.m FROM walk w JOIN followed f"
                    " ON f.token_id = w.token_id AND f.n = w.n",
            "accepted": "SELECT r.* FROM ranked r JOIN walk USING (token_id, n)"}))),
    "subscription_matches": (subscription_matches, sql(
        "SELECT signal_id, subscription_id FROM signals s JOIN subs u ON (u.asset IS NULL OR u.asset = s.asset)"
        " AND (u.timeframe IS NULL OR u.timeframe = s.timeframe) AND s.confidence >= u.least", "candles", ctes={
            "signals": "SELECT symbol || '/' || strftime(open_time, '%Y%m%d%H') AS signal_id, symbol AS asset,"
                       " CASE WHEN trades_count % 3 > 0 THEN (trades_count % 3) || 'h' END AS timeframe,"
                       " CASE WHEN high > low THEN round((close - low) / (high - low), 4) END AS confidence FROM candles",
            "subs": "SELECT c_custkey AS subscription_id, ['CLICK', 'VIEW', 'PURCHASE', 'SIGNUP', 'ERROR'][c_nationkey % 6 + 1] AS asset,"
                    " CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 4) || 'h' END AS timeframe,"
                    " 1.0::DOUBLE - (c_custkey % 97) / 2000.0::DOUBLE AS least FROM customer WHERE c_custkey % 7 <> 0"})),
    "copy_executions": (copy_executions, sql(
        "SELECT follower, asset, buy_id, sell_id, side, opened_at, closed_at,"
        f" {_rounded(['quantity', 'entry_price', 'exit_price', 'pnl', 'roi'])} FROM executed", "trades", ctes=COPY_CTES)),
    "trade_analytics": (trade_analytics, sql(
        f"SELECT follower, closed_trades, {_rounded(['win_rate', 'total_pnl', 'pnl_pct', 'best_roi', 'worst_roi'], 5)} FROM ("
        "SELECT follower, count(*) AS closed_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(pnl) AS total_pnl,"
        " 100 * sum(pnl) / sum(entry_price * quantity) AS pnl_pct, max(roi) AS best_roi, min(roi) AS worst_roi"
        " FROM executed GROUP BY follower)", "trades", ctes=COPY_CTES)),
    "prediction_outcomes": (prediction_outcomes, sql(
        f"SELECT token_id, metric_id, future_time, {_rounded(['future_price', 'future_return'])} FROM ({OUTCOMES})", "token_metrics")),
    "prediction_performance": (prediction_performance, sql(
        "SELECT token_id, count(*) AS total_predictions, count(future_return) AS with_outcome,"
        " count(*) FILTER (WHERE pump_probability >= 0.85) AS high_conf_count, round(avg(future_return), 6) + 0.0 AS avg_future_return,"
        " round(avg(CASE WHEN future_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE pump_probability >= 0.85 AND future_return IS NOT NULL), 6)"
        f" + 0.0 AS high_conf_pump_rate FROM ({OUTCOMES}) WHERE metric_time >= (SELECT max(metric_time) FROM token_metrics) - INTERVAL 7 DAY"
        " GROUP BY token_id", "token_metrics")),
    "token_search": (token_search, sql(
        "SELECT q AS question, token_id, mint, name FROM named, unnest([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]) t(q)"
        " WHERE concat_ws(chr(10), mint, symbol, name) ILIKE '%' || q || '%'", ctes={"named": NAMED})),
    "trending_terms": (trending_terms, sql(
        'SELECT "window", term, n, round(share, 6) + 0.0 AS share, CAST(rank AS INT) AS rank FROM ('
        'SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY n DESC, term) AS rank FROM ('
        'SELECT *, n / sum(n) OVER (PARTITION BY "window") AS share FROM (SELECT "window", term, count(*) AS n FROM terms GROUP BY ALL))'
        " WHERE share >= 0.005) WHERE rank <= 50", "messages", ctes={"terms": TURN_TERMS})),
    "sentiment_spread": (sentiment_spread, sql(
        "SELECT turn, count(*) AS messages, round(avg(s), 6) + 0.0 AS sentiment, round(stddev_samp(s), 6) + 0.0 AS sentiment_volatility,"
        " round(count(*) FILTER (WHERE answer) / nullif(count(*) FILTER (WHERE NOT answer), 0), 6) + 0.0 AS engagement_rate"
        " FROM scored GROUP BY turn", "messages", ctes={"scored": SENTIMENT})),
    "retention_stored": (retention_stored, sql(
        "SELECT metric_id, metric_time, token_id, round(price, 6) + 0.0 AS price FROM token_metrics WHERE metric_time >="
        " (SELECT max(metric_time) FROM token_metrics) - INTERVAL 14 DAY", "token_metrics")),
}
