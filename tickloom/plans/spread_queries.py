"""Candles, pair spread, features, labels and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.math import eps_divide, rounded, zscore
from tickloom.functions.times import cyclic_time
from tickloom.operators import candles as candle_ops
from tickloom.operators import features as feature_ops
from tickloom.operators import flows
from tickloom.operators import timeseries as ts_ops
from tickloom.operators.blocks import first_rows, time_block
from tickloom.plans import views
from tickloom.plans.oracle import sql


def _select(df, keep, numbers, digits=6):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in numbers])


def _r(columns, digits=6):
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


def candles_hourly(spark, d):
    return _select(views.candles(spark, d), ["exchange", "symbol", "interval_code", "open_time", "trades_count"],
                   ["open", "high", "low", "close", "volume"])


def pair_spread_features(spark, d):
    s = feature_ops.spread_blocks(back=24)
    df = s.open(views.spread(spark, d))
    df = df.withColumns({
        "spread_ret": ts_ops.difference(s, "spread_log"),
        "roll_mean": ts_ops.expanding_mean(s, "spread_log", 24),
        "roll_std": ts_ops.expanding_std(s, "spread_log", 24),
    })
    return _select(s.close(df), ["exchange", "pair", "ts"],
                   ["spread_log", "spread_ret", "roll_mean", "roll_std", "leg1_volume", "leg2_volume"])


def flow_hourly(spark, d):
    return _select(flows.hourly_flow(views.trades(spark, d)), ["ts_hour", "symbol", "side"], ["notional"], 3)


FLOW_COLUMNS = ["leg2_long", "leg2_short", "leg1_long", "leg1_short"]


def flow_hourly_pivot(spark, d):
    trades = views.trades(spark, d)
    line = flows.lookup_zero(views.spread(spark, d).select("ts"), flows.flow_pivot(trades, views.LEGS), FLOW_COLUMNS)
    line = flows.lookup_zero(line, flows.hourly_activity(views.wallet_activity(spark, d)),
                             ["wallet_tx_count", "wallet_notional"])
    return line.select("ts", *[rounded(F.log1p(c)).alias(f"{c}_l") for c in
                               FLOW_COLUMNS + ["wallet_tx_count", "wallet_notional"]])


PIVOT_CTES = {
    "pivoted": """
        SELECT date_trunc('hour', trade_time) AS ts,
               coalesce(sum(notional_usd) FILTER (WHERE symbol = 'VIEW' AND side = 'BUY'), 0) AS leg2_long,
               coalesce(sum(notional_usd) FILTER (WHERE symbol = 'VIEW' AND side <> 'BUY'), 0) AS leg2_short,
               coalesce(sum(notional_usd) FILTER (WHERE symbol = 'CLICK' AND side = 'BUY'), 0) AS leg1_long,
               coalesce(sum(notional_usd) FILTER (WHERE symbol = 'CLICK' AND side <> 'BUY'), 0) AS leg1_short
        FROM trades GROUP BY 1""",
    "activity": """
        SELECT date_trunc('hour', tx_time) AS ts, count(*) AS wallet_tx_count,
               coalesce(sum(notional_usd), 0) AS wallet_notional FROM wallet_activity GROUP BY 1""",
}


def volume_zscores(spark, d):
    s = feature_ops.spread_blocks()
    df = s.close(s.open(views.spread(spark, d), means=["leg1_volume", "leg2_volume"]))
    df = df.withColumns({
        "leg1_z": zscore("leg1_volume", "leg1_volume_mean", "leg1_volume_std"),
        "leg2_z": zscore("leg2_volume", "leg2_volume_mean", "leg2_volume_std"),
        "vol_ratio": eps_divide("leg1_volume", "leg2_volume"),
        "vol_imbalance": F.col("leg1_volume") - F.col("leg2_volume"),
    })
    return _select(df, ["ts"], ["leg1_z", "leg2_z", "vol_ratio", "vol_imbalance"])


def bollinger_z(spark, d):
    s = feature_ops.spread_blocks(back=20)
    df = s.close(ts_ops.with_bollinger(s.open(views.spread(spark, d)), s, "spread_log", 20))
    return _select(df, ["ts"], ["bb_mid", "bb_std", "bb_z"])


def realised_vol(spark, d):
    s = feature_ops.spread_blocks(back=21)
    df = s.open(views.spread(spark, d)).withColumn("ret", ts_ops.difference(s, "spread_log"))
    df = s.close(df.withColumn("rv_20", ts_ops.realised_vol(s, "ret", 20)))
    return _select(df, ["ts"], ["rv_20"])


def momentum_accel(spark, d):
    s = feature_ops.spread_blocks(back=24)
    df = s.open(views.spread(spark, d)).withColumns(
        {f"mom_{h}": ts_ops.difference(s, "spread_log", k) for h, k in feature_ops.HORIZONS.items()})
    df = s.close(df.withColumn("acceleration", ts_ops.difference(s, "mom_1h")))
    return _select(df, ["ts"], ["mom_1h", "mom_4h", "mom_24h", "acceleration"])


def rolling_moments(spark, d):
    s = feature_ops.spread_blocks(back=21)
    df = s.open(views.spread(spark, d)).withColumn("ret", ts_ops.difference(s, "spread_log"))
    df = s.close(df.withColumns({"skew_20": ts_ops.rolling_skew(s, "ret"), "kurt_20": ts_ops.rolling_kurtosis(s, "ret")}))
    return _select(df, ["ts"], ["skew_20", "kurt_20"])


def ema_trend(spark, d):
    s = feature_ops.spread_blocks(back=ts_ops.ema_halo(feature_ops.EMA_SPANS.values()))
    df = s.close(ts_ops.with_ema(s.open(views.spread(spark, d)), s, "spread_log", feature_ops.EMA_SPANS))
    return _select(df.withColumn("trend", F.col("ema_20") - F.col("ema_50")), ["ts"], ["ema_20", "ema_50", "trend"])


def targets(spark, d):
    s = feature_ops.spread_blocks(ahead=24)
    df = s.open(views.spread(spark, d))
    df = s.close(df.withColumns(ts_ops.targets(s, "spread_log", feature_ops.HORIZONS)))
    return df.select("ts", *[rounded(f"y_{h}").alias(f"y_{h}") for h in feature_ops.HORIZONS],
                     *[f"dir_{h}" for h in feature_ops.HORIZONS], *[f"valid_{h}" for h in feature_ops.HORIZONS])


def time_cycles(spark, d):
    return _select(views.spread(spark, d).withColumns(cyclic_time("ts")), ["ts"],
                   ["hour_sin", "hour_cos", "dow_sin", "dow_cos"])


def features(spark, d, **kw):
    return feature_ops.feature_matrix(views.spread(spark, d), views.trades(spark, d), views.wallet_activity(spark, d),
                                      views.LEGS, **kw)


def feature_matrix(spark, d):
    labels = [f"dir_{h}" for h in feature_ops.HORIZONS]
    return _select(features(spark, d), ["exchange", "pair", "ts", *labels],
                   feature_ops.FEATURES + [f"y_{h}" for h in feature_ops.HORIZONS], 5)


def feature_audit(spark, d):
    return feature_ops.audit_finite(features(spark, d), feature_ops.FEATURES + feature_ops.TARGETS)


def inventory(spark, d):
    return candle_ops.inventory(views.candles(spark, d))


def unexpected_members(spark, d):
    return candle_ops.unexpected_members(candle_ops.inventory(views.candles(spark, d)), "1h", ["CLICK", "VIEW"])


def oldest_rows(spark, d):
    """First 100 bars of every symbol."""
    c = views.candles(spark, d)
    head = first_rows(c, ["exchange", "symbol"], ["open_time"], time_block("open_time", feature_ops.WEEK), 100)
    return _select(head, ["symbol", "open_time", "pos", "n_rows"], ["close"])


def distinct_members(spark, d):
    return views.candles(spark, d).select("symbol").distinct()


def _window(n):
    return f"(ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


FEATURE_SQL = {
    "spread": "spread",
    "spread_ret": "ret",
    "roll_mean": f"avg(spread) OVER {_window(24)}",
    "roll_std": f"greatest(stddev_pop(spread) OVER {_window(24)}, 1e-6)",
    "leg1_volume": "leg1_volume",
    "leg2_volume": "leg2_volume",
    "leg1_z": "(leg1_volume - avg(leg1_volume) OVER ()) / (stddev_pop(leg1_volume) OVER () + 1e-6)",
    "leg2_z": "(leg2_volume - avg(leg2_volume) OVER ()) / (stddev_pop(leg2_volume) OVER () + 1e-6)",
    "vol_ratio": "leg1_volume / (leg2_volume + 1e-6)",
    **{f"{c}_l": f"ln(1 + coalesce({c}, 0))" for c in FLOW_COLUMNS},
    "wallet_tx_l": "ln(1 + coalesce(wallet_tx_count, 0))",
    "wallet_notional_l": "ln(1 + coalesce(wallet_notional, 0))",
    "rv_20": f"CASE WHEN pos >= 19 THEN coalesce(nullif(stddev_samp(ret) OVER {_window(20)}, 0), 1e-6) ELSE 1e-6 END",
    **{f"mom_{h}": f"coalesce(spread - lag(spread, {k}) OVER (ORDER BY ts), 0)"
       for h, k in feature_ops.HORIZONS.items()},
    "velocity": "coalesce(spread - lag(spread) OVER (ORDER BY ts), 0)",
    "acceleration": "coalesce(ret - lag(ret) OVER (ORDER BY ts), 0)",
    "vol_imbalance": "leg1_volume - leg2_volume",
    "skew_20": f"CASE WHEN pos >= 19 THEN coalesce(skewness(ret) OVER {_window(20)}, 0) ELSE 0 END",
    "kurt_20": f"CASE WHEN pos >= 19 THEN coalesce(kurtosis(ret) OVER {_window(20)}, -3) ELSE 0 END",
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)",
    "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)",
    "dow_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)",
    "bb_mid": "coalesce(mid, mid0, 0)",
    "bb_std": "coalesce(std, std0, 1e-6)",
    "bb_z": "(spread - coalesce(mid, mid0, 0)) / (coalesce(std, std0, 1e-6) + 1e-6)",
    **{f"y_{h}": f"coalesce(lead(spread, {k}) OVER (ORDER BY ts) - spread, 0)" for h, k in feature_ops.HORIZONS.items()},
}
LABEL_SQL = {
    **{f"dir_{h}": f"CASE WHEN lead(spread, {k}) OVER (ORDER BY ts) - spread > 0 THEN 1 ELSE 0 END"
       for h, k in feature_ops.HORIZONS.items()},
    **{f"valid_{h}": f"lead(spread, {k}) OVER (ORDER BY ts) IS NOT NULL" for h, k in feature_ops.HORIZONS.items()},
}
BOLLINGER_CTES = {
    "banded": f"""
        SELECT *, CASE WHEN pos >= 19 THEN avg(spread) OVER {_window(20)} END AS mid,
               CASE WHEN pos >= 19 THEN CASE WHEN stddev_samp(spread) OVER {_window(20)} = 0 THEN 1e-6
                    ELSE stddev_samp(spread) OVER {_window(20)} END END AS std FROM spread""",
    "bands": """
        SELECT *, max(CASE WHEN pos = 19 THEN mid END) OVER () AS mid0,
               max(CASE WHEN pos = 19 THEN std END) OVER () AS std0 FROM banded""",
}
EMA_CTES = {
    "ema": """
        SELECT a.ts AS ema_ts,
               sum(power(1 - 2.0 / 21, a.pos - b.pos) * b.spread) / sum(power(1 - 2.0 / 21, a.pos - b.pos)) AS ema_20,
               sum(power(1 - 2.0 / 51, a.pos - b.pos) * b.spread) / sum(power(1 - 2.0 / 51, a.pos - b.pos)) AS ema_50
        FROM spread a JOIN spread b ON b.pos <= a.pos GROUP BY a.ts""",
}


def _feature_sql(names, source="spread", digits=6, keep="ts", ctes=None):
    columns = {n: FEATURE_SQL[n] for n in names if n in FEATURE_SQL}
    labels = "".join(f", {LABEL_SQL[n]} AS {n}" for n in names if n in LABEL_SQL)
    return sql(f"SELECT {keep}, {_r(columns, digits)}{labels} FROM {source}", "spread", ctes=ctes)


def _matrix_sql():
    plain = [f for f in feature_ops.FEATURES if f not in ("ema_20", "ema_50", "trend")]
    columns = {n: FEATURE_SQL[n] for n in plain + [f"y_{h}" for h in feature_ops.HORIZONS]}
    columns |= {"ema_20": "ema_20", "ema_50": "ema_50", "trend": "ema_20 - ema_50"}
    labels = ", ".join(f"{LABEL_SQL[f'dir_{h}']} AS dir_{h}" for h in feature_ops.HORIZONS)
    return sql(f"SELECT exchange, pair, ts, {labels}, {_r(columns, 5)} FROM joined WHERE n_rows >= 500",
               "spread", "wallet_activity",
               ctes={**PIVOT_CTES, **BOLLINGER_CTES, **EMA_CTES, "joined": """
                   SELECT b.*, p.* EXCLUDE (ts), w.* EXCLUDE (ts), e.* EXCLUDE (ema_ts) FROM bands b
                   LEFT JOIN pivoted p ON p.ts = b.ts LEFT JOIN activity w ON w.ts = b.ts
                   JOIN ema e ON e.ema_ts = b.ts"""})


QUERIES = {
    "candles_hourly": (candles_hourly, sql(
        "SELECT exchange, symbol, interval_code, open_time, trades_count, "
        + _r({c: c for c in ("open", "high", "low", "close", "volume")}) + " FROM candles", "candles")),
    "pair_spread_features": (pair_spread_features, sql(
        "SELECT exchange, pair, ts, " + _r({
            "spread_log": "spread", **{c: FEATURE_SQL[c] for c in
                                       ("spread_ret", "roll_mean", "roll_std", "leg1_volume", "leg2_volume")}})
        + " FROM spread", "spread")),
    "flow_hourly": (flow_hourly, sql(
        "SELECT date_trunc('hour', trade_time) AS ts_hour, symbol, side, round(sum(notional_usd), 3) + 0.0 AS notional "
        "FROM trades GROUP BY ALL", "trades")),
    "flow_hourly_pivot": (flow_hourly_pivot, sql(
        "SELECT s.ts, " + _r({f"{c}_l": f"ln(1 + coalesce({c}, 0))" for c in
                              FLOW_COLUMNS + ["wallet_tx_count", "wallet_notional"]})
        + " FROM pair_spread s LEFT JOIN pivoted p ON p.ts = s.ts LEFT JOIN activity w ON w.ts = s.ts",
        "pair_spread", "wallet_activity", ctes=PIVOT_CTES)),
    "volume_zscores": (volume_zscores, _feature_sql(["leg1_z", "leg2_z", "vol_ratio", "vol_imbalance"])),
    "bollinger_z": (bollinger_z, _feature_sql(["bb_mid", "bb_std", "bb_z"], "bands", ctes=BOLLINGER_CTES)),
    "realised_vol": (realised_vol, _feature_sql(["rv_20"])),
    "momentum_accel": (momentum_accel, _feature_sql(["mom_1h", "mom_4h", "mom_24h", "acceleration"])),
    "rolling_moments": (rolling_moments, _feature_sql(["skew_20", "kurt_20"])),
    "ema_trend": (ema_trend, sql(
        "SELECT ema_ts AS ts, " + _r({"ema_20": "ema_20", "ema_50": "ema_50", "trend": "ema_20 - ema_50"}) + " FROM ema",
        "spread", ctes=EMA_CTES)),
    "targets": (targets, _feature_sql([f"{p}_{h}" for p in ("y", "dir", "valid") for h in feature_ops.HORIZONS])),
    "time_cycles": (time_cycles, _feature_sql(["hour_sin", "hour_cos", "dow_sin", "dow_cos"])),
    "feature_matrix": (feature_matrix, _matrix_sql()),
    "feature_audit": (feature_audit, sql(
        "SELECT unnest([" + ", ".join(f"'{c}'" for c in feature_ops.FEATURES + feature_ops.TARGETS)
        + "]) AS column_name, CAST(0 AS BIGINT) AS nan_count, CAST(0 AS BIGINT) AS inf_count, "
        "CAST(0 AS BIGINT) AS null_count")),
    "inventory": (inventory, sql(
        "SELECT symbol, interval_code, count(*) AS cnt FROM candles GROUP BY ALL", "candles")),
    "unexpected_members": (unexpected_members, sql(
        "SELECT symbol, interval_code, count(*) AS cnt FROM candles "
        "WHERE interval_code = '1h' AND symbol NOT IN ('CLICK', 'VIEW') GROUP BY ALL", "candles")),
    "oldest_rows": (oldest_rows, sql(
        "SELECT symbol, open_time, rn - 1 AS pos, n AS n_rows, round(close, 6) + 0.0 AS close FROM (SELECT *, row_number() OVER"
        " (PARTITION BY symbol ORDER BY open_time) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM candles)"
        " WHERE rn <= 100", "candles")),
    "distinct_members": (distinct_members, sql("SELECT DISTINCT symbol FROM candles", "candles")),
}
