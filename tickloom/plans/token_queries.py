"""Token radar, ranking, enrichment and alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scores
from tickloom.functions.math import rounded
from tickloom.functions.text import short_id
from tickloom.operators import edges, reports
from tickloom.operators import tokens as ops
from tickloom.plans import views
from tickloom.plans.oracle import live_sql, sql

DAY = 86400
LIVE = ["price", "marketcap", "volume_5m", "price_change_1h", "pump_probability", "age_seconds"]
COUNTS = ["buys_5m", "sells_5m", "buys_1h", "sells_1h"]
RULE = scores.AlertRule(min_buys=3, min_change=5, min_probability=0.6, min_marketcap=3000, min_volume=20)


def _r(columns, digits=6):
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


def _same(names):
    return {n: n for n in names}


def token_live(spark, d):
    return views.live(spark, d).select("token_id", *COUNTS, "updated_at", *[rounded(c).alias(c) for c in LIVE])


def gainers(spark, d):
    df = ops.gainers(views.token_metrics(spark, d), views.tokens(spark, d))
    return df.select("token_id", "mint", "symbol", "metric_id",
                     *[rounded(c).alias(c) for c in ("price", "price_before", "pct_gain")])


def liquidity_risk(spark, d):
    df = ops.liquidity_risk(views.token_metrics(spark, d), views.tokens(spark, d))
    return df.withColumn("risk_score", rounded("risk_score"))


RADAR = dict(min_probability=0.3, min_marketcap=50_000, min_buys=3, min_change=-0.5)


def radar(spark, d):
    return ops.radar(views.live(spark, d), **RADAR).select(
        "token_id", "buys_1h", *[rounded(c).alias(c) for c in ("pump_probability", "marketcap", "price_change_1h")])


def radar_null_safe(spark, d):
    df = ops.radar_null_safe(views.live(spark, d), 0.3, 50_000, 3, -50.0)
    return df.select("token_id", "buys_1h", *[rounded(c).alias(c) for c in ("pump_probability", "marketcap")])


def ranked_nulls(spark, d):
    """Change-ranked tokens, NULL changes first (a plain DESC of the source system), top 200."""
    return ops.ranked(views.live(spark, d), ["price_change_1h"], limit=200, nulls="first") \
        .select("token_id", rounded("price_change_1h").alias("price_change_1h"))


def _dashboard(spark, d):
    return ops.dashboard(views.live(spark, d), min_marketcap=20_000, min_buys=1, min_change_pct=-90, max_age_days=60,
                         scored_only=True)


def dashboard(spark, d):
    return ops.dashboard_order(_dashboard(spark, d)).select(
        "token_id", *[rounded(c, 5).alias(c) for c in
                      ("price", "marketcap", "volume_5m", "buys_5m", "buys_1h", "pump_probability", "change_pct",
                       "age_minutes", "age_days")])


def trend_top20(spark, d):
    return ops.top_trending(_dashboard(spark, d)).select("token_id", rounded("trend_score", 5).alias("trend_score"))


def alert_rules(spark, d):
    return ops.alerts(views.live(spark, d), RULE).select(
        "token_id", "updated_at", *[rounded(c).alias(c) for c in
                                    ("price", "marketcap", "buys_5m", "volume_5m", "price_change_1h", "pump_probability")])


def change_labels(spark, d):
    return views.live(spark, d).select(
        "token_id", scores.change_label("price_change_1h").alias("signal"),
        F.coalesce("pump_probability", F.lit(0.0)).alias("p"))


def token_trends(spark, d):
    metrics = views.token_metrics(spark, d)
    live = ops.token_live(metrics, views.as_of(metrics, "metric_time"), DAY, 6 * 3600)
    return ops.token_trends(live).select("token_id", rounded("score", 5).alias("score"))


def token_hourly(spark, d):
    """Hourly token candles (price per token and hour)."""
    m = views.token_metrics(spark, d)
    at = F.struct("metric_time", "metric_id")
    return m.groupBy("token_id", F.date_trunc("hour", F.col("metric_time")).alias("hour_bucket")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")) \
        .select("token_id", "hour_bucket", *[rounded(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


def token_history(spark, d):
    """History of one token, oldest first; the token is the one with the newest row."""
    m = views.token_metrics(spark, d)
    wanted = m.agg(F.max_by("token_id", "metric_time")).scalar()
    return reports.oldest_first(m.where(F.col("token_id") == wanted), "metric_time", "metric_id") \
        .select("metric_time", "price", "pump_probability")


def _market(spark, d, back_seconds=0):
    """Market data per symbol: from live tokens joined to their dimension name."""
    live = views.live(spark, d, back_seconds).join(views.tokens(spark, d), "token_id")
    return live.select(
        F.col("mint").alias("symbol"), "marketcap", (F.col("marketcap") * 0.1).alias("liquidityusd"),
        (F.col("volume_5m") * 100).alias("volumeusd"), (F.col("buys_1h") + F.col("sells_1h")).alias("tradecount"),
        "buys_5m", "sells_5m", (F.col("pump_probability") * 10).alias("dex_score"))


def _trending(spark, d):
    c = views.table(spark, d, "customer")
    return c.select(F.col("c_name").alias("symbol"), (F.col("c_custkey") % 3000).alias("holders"),
                    (F.abs("c_acctbal") * 10).alias("age_seconds"),
                    (F.col("c_custkey") % 11).cast("double").alias("pumpfun_score"))


def _social(spark, d):
    o = views.table(spark, d, "orders")
    s = o.groupBy("o_custkey").agg((F.count(F.lit(1)) / 100.0).alias("social_score"))
    return views.tokens(spark, d).join(s, F.col("token_id") == F.col("o_custkey")) \
        .select(F.col("mint").alias("symbol"), "social_score")


def _known(spark, d):
    return views.table(spark, d, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_name").alias("symbol"))


MARKET_CTES = {
    "market": """
        SELECT t.mint AS symbol, l.marketcap, l.marketcap * 0.1 AS liquidityusd, l.volume_5m * 100 AS volumeusd,
               l.buys_1h + l.sells_1h AS tradecount, l.buys_5m, l.sells_5m, l.pump_probability * 10 AS dex_score
        FROM token_live l JOIN tokens t USING (token_id)""",
    "trending": """
        SELECT c_name AS symbol, c_custkey % 3000 AS holders, abs(c_acctbal) * 10 AS age_seconds,
               CAST(c_custkey % 11 AS DOUBLE) AS pumpfun_score, c_acctbal FROM customer""",
    "social": """
        SELECT t.mint AS symbol, count(*) / 100.0 AS social_score
        FROM orders o JOIN tokens t ON t.token_id = o.o_custkey GROUP BY t.mint""",
    "enriched": """
        SELECT m.*, g.holders, g.age_seconds, g.pumpfun_score, coalesce(s.social_score, 0.5) AS social_score,
               CASE WHEN g.c_acctbal > 0 THEN 0.7 ELSE 0.1 END AS bitquery_score,
               exp(-g.age_seconds / 3600) AS recency,
               CASE WHEN buys_5m + sells_5m = 0 THEN 0.0
                    ELSE (buys_5m - sells_5m) / CAST(buys_5m + sells_5m AS DOUBLE) END AS velocity
        FROM market m JOIN trending g USING (symbol) LEFT JOIN social s USING (symbol)""",
}


def enriched(spark, d, back_seconds=0):
    return ops.enrich_tokens(_trending(spark, d), _market(spark, d, back_seconds), _social(spark, d), _known(spark, d))


def token_enrich(spark, d):
    return enriched(spark, d).select("symbol", *[rounded(c).alias(c) for c in (
        "social_score", "bitquery_score", "recency", "velocity", "holders", "marketcap")])


SCORES = ["marketcap_score", "liquidity_score", "volume_score", "holders_score", "trade_count_score", "turnover_score"]


def token_scores(spark, d):
    return ops.token_scores(enriched(spark, d)).select("symbol", *[rounded(c).alias(c) for c in SCORES])


def _signals(spark, d):
    alpha = F.col("dex_score") / 10.0
    return ops.token_signals(enriched(spark, d).withColumn("alpha", alpha))


def token_signals(spark, d):
    return _signals(spark, d).select("symbol", "direction", *[rounded(c).alias(c) for c in ("alpha", "confidence")])


def latest_signals(spark, d):
    """Newest 200 signal rows with confidence at least 0.5 or unknown."""
    m = views.token_metrics(spark, d)
    rows = m.select("metric_id", F.col("metric_time").alias("created_at"),
                    F.when(F.col("metric_id") % 10 != 0, F.abs(F.col("pump_probability") - 0.5) * 2).alias("confidence"))
    return ops.confident_signals(rows, 0.5, 200, tie="metric_id") \
        .withColumn("confidence", rounded("confidence"))


def _feeds(spark, d):
    """Three feeds with different columns and overlapping symbols."""
    c, s, p = (views.table(spark, d, t) for t in ("customer", "supplier", "part"))
    named = F.when(F.col("c_custkey") % 97 != 0, F.concat(F.lit("T"), F.col("c_custkey"))).otherwise("")
    a = c.select(named.alias("symbol"), F.col("c_acctbal").alias("marketcap"), F.col("c_nationkey").cast("double").alias("holders"))
    b = s.select(F.concat(F.lit("T"), F.col("s_suppkey") * 2).alias("symbol"), F.col("s_acctbal").alias("marketcap"),
                 F.lit(0.0).alias("dex_score"))
    e = p.select(F.concat(F.lit("T"), F.col("p_partkey") * 3).alias("symbol"), F.col("p_retailprice").alias("volumeusd"),
                 F.col("p_size").cast("double").alias("dex_score"))
    return [a, b, e]


def token_merge(spark, d):
    return ops.merge_feeds(_feeds(spark, d)).select("symbol", "marketcap", "holders", "dex_score", "volumeusd")


def token_lookup(spark, d):
    """First feed row per symbol with defaults: 0 holders, NULL venue."""
    tokens = views.tokens(spark, d).select(F.col("token_id"))
    feed = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("token_id"), F.col("o_orderkey"), F.col("o_totalprice").alias("marketcap"),
        F.col("o_orderpriority").alias("venue"))
    return ops.lookup_first(tokens, feed, {"marketcap": 0.0, "venue": None}, key="token_id", order=["o_orderkey"])


def symbol_membership(spark, d):
    """Tokens whose symbol is a known segment, compared without case."""
    known = views.table(spark, d, "customer").select(F.upper("c_mktsegment").alias("u")).distinct() \
        .where(F.col("u") != "MACHINERY")
    t = views.tokens(spark, d)
    return t.join(known, F.upper(t["symbol"]) == known["u"], "left_semi") \
        .select("token_id", F.lower("symbol").alias("symbol"), short_id("mint").alias("short_mint"))


def rising_edges(spark, d):
    m = views.token_metrics(spark, d)
    return edges.rising_edges(m, "token_id", "metric_time", "metric_id", F.col("pump_probability") >= 0.85) \
        .select("token_id", "metric_id", "metric_time", "pump_probability")


CHANGE_PCT = ("CASE WHEN coalesce(price_change_1h, 0) > 2 THEN coalesce(price_change_1h, 0)"
              " ELSE coalesce(price_change_1h, 0) * 100 END")
DASH_CTES = {"dash": f"""
    SELECT *, {CHANGE_PCT} AS change_pct FROM token_live WHERE marketcap >= 20000 AND buys_1h >= 1
       AND age_seconds / 86400 <= 60 AND pump_probability > 0 AND {CHANGE_PCT} >= -90"""}

QUERIES = {
    "token_live": (token_live, sql(
        f"SELECT token_id, {', '.join(COUNTS)}, updated_at, {_r(_same(LIVE))} FROM token_live", "token_live")),
    "gainers": (gainers, sql(
        "SELECT token_id, mint, symbol, metric_id, " + _r({
            "price": "price", "price_before": "price_before", "pct_gain": "pct_gain"})
        + " FROM (SELECT t.*, r.metric_id, r.price, r.price_before, (r.price - r.price_before) / r.price_before AS pct_gain"
          " FROM (SELECT *, lag(price, 3) OVER (PARTITION BY token_id ORDER BY metric_time, metric_id) AS price_before"
          " FROM token_metrics) r JOIN tokens t USING (token_id) WHERE r.price_before IS NOT NULL)"
          " ORDER BY pct_gain DESC NULLS FIRST, token_id, metric_id LIMIT 30", "token_metrics", "tokens")),
    "liquidity_risk": (liquidity_risk, sql(
        "SELECT * REPLACE (round(risk_score, 6) + 0.0 AS risk_score) FROM (SELECT t.token_id, t.mint, t.symbol,"
        " stddev_samp(m.liquidity) / nullif(avg(m.liquidity), 0) AS risk_score,"
        " count(*) AS samples FROM token_metrics m JOIN tokens t USING (token_id) WHERE m.liquidity IS NOT NULL"
        " GROUP BY ALL HAVING count(*) > 10 ORDER BY risk_score DESC NULLS FIRST, token_id LIMIT 50)",
        "token_metrics", "tokens")),
    "radar": (radar, sql(
        "SELECT token_id, buys_1h, " + _r(_same(["pump_probability", "marketcap", "price_change_1h"]))
        + " FROM token_live WHERE pump_probability >= 0.3 AND marketcap >= 50000 AND buys_1h >= 3"
          " AND price_change_1h >= -0.5", "token_live")),
    "radar_null_safe": (radar_null_safe, sql(
        "SELECT token_id, buys_1h, " + _r(_same(["pump_probability", "marketcap"]))
        + " FROM token_live WHERE coalesce(pump_probability, 0) >= 0.3 AND coalesce(marketcap, 0) >= 50000"
          " AND coalesce(buys_1h, 0) >= 3 AND coalesce(price_change_1h, 0) * 100 >= -50", "token_live")),
    "ranked_nulls": (ranked_nulls, sql(
        "SELECT token_id, round(price_change_1h, 6) + 0.0 AS price_change_1h FROM token_live"
        " ORDER BY token_live.price_change_1h DESC NULLS FIRST, token_id LIMIT 200", "token_live")),
    "dashboard": (dashboard, sql("SELECT token_id, " + _r({
        **_same(["price", "marketcap", "volume_5m", "buys_5m", "buys_1h", "pump_probability", "change_pct"]),
        "age_minutes": "age_seconds / 60", "age_days": "age_seconds / 86400"}, 5) + " FROM dash",
        "token_live", ctes=DASH_CTES)),
    "trend_top20": (trend_top20, sql(
        "SELECT token_id, round(s, 5) + 0.0 AS trend_score FROM (SELECT *, pump_probability * 100 + change_pct * 0.5"
        " + (buys_5m - sells_5m) * 0.5 + volume_5m / 1000 AS s FROM dash) ORDER BY s DESC, token_id LIMIT 20",
        "token_live", ctes=DASH_CTES)),
    "alert_rules": (alert_rules, sql(
        "SELECT token_id, updated_at, " + _r({
            "price": "price", "marketcap": "marketcap", "buys_5m": "buys_5m", "volume_5m": "volume_5m",
            "price_change_1h": "coalesce(price_change_1h, 0)", "pump_probability": "coalesce(pump_probability, 0)"})
        + " FROM token_live WHERE (buys_5m >= 3 OR coalesce(price_change_1h, 0) >= 5 OR coalesce(pump_probability, 0) >= 0.6)"
          " AND coalesce(marketcap, 0) >= 3000 AND coalesce(volume_5m, 0) >= 20", "token_live")),
    "change_labels": (change_labels, sql(
        "SELECT token_id, CASE WHEN price_change_1h > 0.05 THEN 'BUY' WHEN price_change_1h < -0.05 THEN 'SELL' ELSE '' END"
        " AS signal, coalesce(pump_probability, 0) AS p FROM token_live", "token_live")),
    "token_trends": (token_trends, sql(
        "SELECT token_id, round(s, 5) + 0.0 AS score FROM (SELECT token_id, pump_probability * 100"
        " + coalesce(price_change_1h, 0) * 50 + (buys_5m - sells_5m) * 0.5 + volume_5m / 1000 AS s FROM trend_live)"
        " ORDER BY s DESC NULLS FIRST, token_id LIMIT 200", "token_metrics", ctes={"trend_live": live_sql("6 HOUR")})),
    "token_hourly": (token_hourly, sql(
        "SELECT token_id, date_trunc('hour', metric_time) AS hour_bucket, " + _r({
            "open": "arg_min(price, metric_time)", "high": "max(price)", "low": "min(price)",
            "close": "arg_max(price, metric_time)", "volume": "sum(volume)"})
        + " FROM token_metrics GROUP BY ALL", "token_metrics")),
    "token_history": (token_history, sql(
        "SELECT metric_time, price, pump_probability FROM token_metrics"
        " WHERE token_id = (SELECT arg_max(token_id, metric_time) FROM token_metrics)", "token_metrics")),
    "token_enrich": (token_enrich, sql(
        "SELECT symbol, " + _r(_same(["social_score", "bitquery_score", "recency", "velocity", "holders", "marketcap"]))
        + " FROM enriched", "token_live", "tokens", ctes=MARKET_CTES)),
    "token_scores": (token_scores, sql(
        "SELECT symbol, " + _r({
            "marketcap_score": "1 - greatest(0, least(1, marketcap / 2000000))",
            "liquidity_score": "CASE WHEN liquidityusd <= 5000 THEN 0.1 WHEN liquidityusd <= 15000 THEN 0.4"
                               " ELSE least(1, liquidityusd / 50000) END",
            "volume_score": "greatest(0, least(1, volumeusd / 500000))",
            "holders_score": "greatest(0, least(1, holders / 2000.0))",
            "trade_count_score": "greatest(0, least(1, tradecount / 20000.0))",
            "turnover_score": "CASE WHEN liquidityusd = 0 THEN 0 ELSE"
                              " greatest(0, least(1, volumeusd / liquidityusd / 50)) END"})
        + " FROM enriched", "token_live", "tokens", ctes=MARKET_CTES)),
    "token_signals": (token_signals, sql(
        "SELECT symbol, CASE WHEN a >= 0.65 THEN 'BUY' ELSE 'SELL' END AS direction, round(a, 6) + 0.0 AS alpha,"
        " round(least(1, abs(a - 0.5) * 2), 6) + 0.0 AS confidence FROM (SELECT symbol, dex_score / 10 AS a FROM enriched)"
        " WHERE (a >= 0.65 OR a <= 0.35) AND least(1, abs(a - 0.5) * 2) >= 0.6",
        "token_live", "tokens", ctes=MARKET_CTES)),
    "latest_signals": (latest_signals, sql(
        "SELECT metric_id, created_at, round(c, 6) + 0.0 AS confidence FROM (SELECT metric_id, metric_time AS created_at,"
        " CASE WHEN metric_id % 10 <> 0 THEN abs(pump_probability - 0.5) * 2 END AS c FROM token_metrics)"
        " WHERE c IS NULL OR c >= 0.5 ORDER BY created_at DESC NULLS LAST, metric_id LIMIT 200", "token_metrics")),
    "token_merge": (token_merge, sql(
        "SELECT symbol, coalesce(b.marketcap, a.marketcap) AS marketcap, a.holders,"
        " coalesce(e.dex_score, b.dex_score) AS dex_score, e.volumeusd"
        " FROM a FULL JOIN b USING (symbol) FULL JOIN e USING (symbol)",
        ctes={"a": "SELECT 'T' || c_custkey AS symbol, c_acctbal AS marketcap, c_nationkey::DOUBLE AS holders FROM customer WHERE c_custkey % 97 <> 0",
              "b": "SELECT 'T' || (s_suppkey * 2) AS symbol, s_acctbal AS marketcap, 0.0::DOUBLE AS dex_score FROM supplier",
              "e": "SELECT 'T' || (p_partkey * 3) AS symbol, p_retailprice AS volumeusd, p_size::DOUBLE AS dex_score"
                   " FROM part"})),
    "token_lookup": (token_lookup, sql(
        "SELECT token_id, coalesce(f.marketcap, 0) AS marketcap, f.venue FROM tokens LEFT JOIN (SELECT o_custkey AS token_id,"
        " arg_min(o_totalprice, o_orderkey) AS marketcap, arg_min(o_orderpriority, o_orderkey) AS venue FROM orders"
        " GROUP BY 1) f USING (token_id)", "tokens")),
    "symbol_membership": (symbol_membership, sql(
        "SELECT token_id, lower(symbol) AS symbol, left(mint, 4) || '…' || right(mint, 4) AS short_mint FROM tokens"
        " WHERE upper(symbol) <> 'MACHINERY' AND symbol IS NOT NULL", "tokens")),
    "rising_edges": (rising_edges, sql(
        "SELECT token_id, metric_id, metric_time, pump_probability FROM (SELECT *, lag(pump_probability >= 0.85, 1, false)"
        " OVER (PARTITION BY token_id ORDER BY metric_time, metric_id) AS was FROM token_metrics)"
        " WHERE pump_probability >= 0.85 AND NOT was", "token_metrics")),
}
