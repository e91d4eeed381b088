"""Features, labels, windows, splits and audits of all pairs of symbols: every series apart from the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.math import rounded
from tickloom.operators import datasets
from tickloom.operators import features as feature_ops
from tickloom.operators import timeseries as ts_ops
from tickloom.plans import views
from tickloom.plans.oracle import sql
from tickloom.plans.spread_queries import FEATURE_SQL, FLOW_COLUMNS, LABEL_SQL, _r

SERIES = ["exchange", "pair", "ts"]


def _select(df, keep, numbers, digits=6):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in numbers])


def pairs_matrix(spark, d):
    """All features and labels, flows by each pair's own legs."""
    m = feature_ops.feature_matrix(views.spreads(spark, d), views.trades(spark, d), views.wallet_activity(spark, d), None)
    return _select(m, [*SERIES, *[f"dir_{h}" for h in feature_ops.HORIZONS]],
                   feature_ops.FEATURES + [f"y_{h}" for h in feature_ops.HORIZONS], 5)


def _labelled(spark, d):
    s = feature_ops.spread_blocks(back=1, ahead=24)
    df = s.open(views.spreads(spark, d).withColumnRenamed("spread_log", "spread"))
    return s.close(df.withColumns({"spread_ret": ts_ops.difference(s, "spread"), **ts_ops.targets(s, "spread", feature_ops.HORIZONS)}))


def pairs_windows(spark, d):
    """Sequence samples of 168 rows with the labels of the row after."""
    ds = datasets.window_dataset(_labelled(spark, d), ["spread", "spread_ret", "leg1_volume"], ["y_1h", "y_24h", "dir_4h"])

    def window_sum(c):
        return F.aggregate("window", F.lit(0.0), lambda a, x: a + x[c])

    total = {c: window_sum(c) for c in ("spread", "spread_ret", "leg1_volume")}
    return ds.select(*SERIES, "pos", "dir_4h", F.size("window").alias("steps"),
                     rounded(F.element_at("window", 1)["spread"]).alias("first_spread"),
                     rounded(F.element_at("window", -1)["spread"]).alias("last_spread"),
                     *[rounded(t, 5).alias(f"sum_{c}") for c, t in total.items()], rounded("y_1h").alias("y_1h"), rounded("y_24h").alias("y_24h"))


def pairs_flat_windows(spark, d):
    ds = datasets.flat_windows(views.spreads(spark, d))
    part = lambda i: F.aggregate(F.slice("features", 168 * i + 1, 168), F.lit(0.0), lambda a, x: a + x)
    return ds.select(*SERIES, F.size("features").alias("width"), *[rounded(part(i), 5).alias(f"sum_{i}") for i in range(3)],
                     *[rounded(f"y_{h}").alias(f"y_{h}") for h in feature_ops.HORIZONS])


def pairs_latest_window(spark, d):
    return _select(datasets.latest_window(views.spreads(spark, d)), SERIES, ["spread_log", "leg1_z", "leg2_z"])


def pairs_split(spark, d):
    s = feature_ops.spread_blocks()
    df = datasets.time_split(s.close(s.open(views.spreads(spark, d))))
    return df.groupBy("exchange", "pair", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"),
        rounded(F.avg("spread_log")).alias("mean_spread"))


def pairs_audit(spark, d):
    """Audit of columns that do hold what it looks for: NULL before each series' 24th row, NaN where the root of a
    negative change is taken, infinity where a volume is divided out of a change of 0 trades."""
    s = feature_ops.spread_blocks(back=24)
    df = s.open(views.spreads(spark, d))
    df = df.withColumns({"ret": ts_ops.difference(s, "spread_log"), "mean_24": ts_ops.full_window(F.avg("spread_log").over(s.rows(-23, 0)), 24)})
    df = s.close(df).withColumns({
        "root_ret": F.sqrt("ret"),
        "odd_volume": F.pow(F.col("leg1_volume") % 2, F.lit(-1.0)) * F.when(F.col("leg2_volume") % 3 > 0, 1.0).otherwise(-1.0)})
    return feature_ops.audit_finite(df, ["spread_log", "ret", "mean_24", "root_ret", "odd_volume"])


def _apart(text: str) -> str:
    """Windows of one series turned into windows of each series."""
    return text.replace("OVER (ORDER BY", "OVER (PARTITION BY exchange, pair ORDER BY").replace("OVER ()", "OVER (PARTITION BY exchange, pair)")


FEATURES, LABELS = ({n: _apart(e) for n, e in texts.items()} for texts in (FEATURE_SQL, LABEL_SQL))

PAIRS = {
    "pairs": """
        SELECT a.exchange, a.symbol || '/' || b.symbol AS pair, a.symbol AS leg1, b.symbol AS leg2, a.open_time AS ts,
               ln(a.close / b.close) AS spread, a.volume AS leg1_volume, b.volume AS leg2_volume
        FROM candles a JOIN candles b ON a.exchange = b.exchange AND a.interval_code = b.interval_code AND a.open_time = b.open_time
        WHERE a.symbol < b.symbol""",
    "spread": _apart("""
        SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n_rows,
               spread - coalesce(lag(spread) OVER (ORDER BY ts), spread) AS ret FROM pairs"""),
}
FLOWS = {
    "flows": """
        SELECT date_trunc('hour', trade_time) AS hour, symbol, coalesce(sum(notional_usd) FILTER (WHERE side = 'BUY'), 0) AS long,
               coalesce(sum(notional_usd) FILTER (WHERE side <> 'BUY'), 0) AS short FROM trades GROUP BY ALL""",
    "activity": """
        SELECT date_trunc('hour', tx_time) AS hour, count(*) AS wallet_tx_count, sum(notional_usd) AS wallet_notional
        FROM wallet_activity GROUP BY 1""",
}
BANDS = {
    "banded": _apart("""
        SELECT *, CASE WHEN pos >= 19 THEN avg(spread) OVER (ORDER BY ts ROWS 19 PRECEDING) END AS mid,
               CASE WHEN pos >= 19 THEN CASE WHEN stddev_samp(spread) OVER (ORDER BY ts ROWS 19 PRECEDING) = 0 THEN 1e-6
                    ELSE stddev_samp(spread) OVER (ORDER BY ts ROWS 19 PRECEDING) END END AS std FROM spread"""),
    "bands": _apart("""
        SELECT *, max(CASE WHEN pos = 19 THEN mid END) OVER () AS mid0, max(CASE WHEN pos = 19 THEN std END) OVER () AS std0 FROM banded"""),
    "ema": """
        SELECT a.pair AS ema_pair, a.ts AS ema_ts,
               sum(power(1 - 2.0 / 21, a.pos - b.pos) * b.spread) / sum(power(1 - 2.0 / 21, a.pos - b.pos)) AS ema_20,
               sum(power(1 - 2.0 / 51, a.pos - b.pos) * b.spread) / sum(power(1 - 2.0 / 51, a.pos - b.pos)) AS ema_50
        FROM spread a JOIN spread b ON a.pair = b.pair AND b.pos <= a.pos AND b.pos > a.pos - 1800 GROUP BY ALL""",
}


def _matrix_sql():
    plain = [f for f in feature_ops.FEATURES if f not in ("ema_20", "ema_50", "trend")]
    columns = {n: FEATURES[n] for n in plain + [f"y_{h}" for h in feature_ops.HORIZONS]}
    columns |= {"ema_20": "ema_20", "ema_50": "ema_50", "trend": "ema_20 - ema_50"}
    labels = ", ".join(f"{LABELS[f'dir_{h}']} AS dir_{h}" for h in feature_ops.HORIZONS)
    flows = ", ".join(f"{c[:4]}f.{c[5:]} AS {c}" for c in FLOW_COLUMNS)
    return sql(f"SELECT exchange, pair, ts, {labels}, {_r(columns, 5)} FROM joined WHERE n_rows >= 500", "candles", "wallet_activity",
               ctes={**PAIRS, **FLOWS, **BANDS, "joined": f"""
                   SELECT b.*, {flows}, w.wallet_tx_count, w.wallet_notional, ema_20, ema_50 FROM bands b
                   LEFT JOIN flows leg1f ON leg1f.hour = b.ts AND leg1f.symbol = b.leg1
                   LEFT JOIN flows leg2f ON leg2f.hour = b.ts AND leg2f.symbol = b.leg2
                   LEFT JOIN activity w ON w.hour = b.ts JOIN ema ON ema_pair = b.pair AND ema_ts = b.ts"""})


W168 = "(PARTITION BY exchange, pair ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"
F168 = "(PARTITION BY exchange, pair ORDER BY ts ROWS 167 PRECEDING)"

QUERIES = {
    "pairs_matrix": (pairs_matrix, _matrix_sql()),
    "pairs_windows": (pairs_windows, sql(
        "SELECT exchange, pair, ts, pos, dir_4h, 168 AS steps, " + _r({
            "first_spread": "first_spread", "last_spread": "last_spread", "y_1h": "y_1h", "y_24h": "y_24h"}) + ", "
        + _r({f"sum_{c}": f"sum_{c}" for c in ("spread", "spread_ret", "leg1_volume")}, 5) + " FROM w WHERE pos >= 168 AND pos < n_rows - 24",
        "candles", ctes={**PAIRS, "w": (
            f"SELECT *, first_value(spread) OVER {W168} AS first_spread, last_value(spread) OVER {W168} AS last_spread,"
            f" sum(spread) OVER {W168} AS sum_spread, sum(ret) OVER {W168} AS sum_spread_ret, sum(leg1_volume) OVER {W168} AS sum_leg1_volume,"
            f" {FEATURES['y_1h']} AS y_1h, {FEATURES['y_24h']} AS y_24h, {LABELS['dir_4h']} AS dir_4h FROM spread")})),
    "pairs_flat_windows": (pairs_flat_windows, sql(
        "SELECT exchange, pair, ts, 504 AS width, " + _r({f"sum_{i}": f"s{i}" for i in range(3)}, 5) + ", "
        + _r({f"y_{h}": f"y_{h}" for h in feature_ops.HORIZONS}) + " FROM w WHERE pos >= 167 AND pos < n_rows - 24", "candles", ctes={
            **PAIRS,
            "z": _apart("SELECT *, (leg1_volume - avg(leg1_volume) OVER ()) / (stddev_pop(leg1_volume) OVER () + 1e-8) AS z1,"
                        " (leg2_volume - avg(leg2_volume) OVER ()) / (stddev_pop(leg2_volume) OVER () + 1e-8) AS z2 FROM spread"),
            "w": f"SELECT *, sum(spread) OVER {F168} AS s0, sum(z1) OVER {F168} AS s1, sum(z2) OVER {F168} AS s2, "
                 + ", ".join(f"{FEATURES[f'y_{h}']} AS y_{h}" for h in feature_ops.HORIZONS) + " FROM z"})),
    "pairs_latest_window": (pairs_latest_window, sql(
        "SELECT exchange, pair, ts, " + _r({"spread_log": "spread", **{
            f"leg{i}_z": _apart(f"(leg{i}_volume - avg(leg{i}_volume) OVER ()) / (stddev_pop(leg{i}_volume) OVER () + 1e-8)") for i in (1, 2)}})
        + " FROM newest", "candles", ctes={**PAIRS, "newest": "SELECT * FROM spread WHERE pos >= n_rows - 168"})),
    "pairs_split": (pairs_split, sql(
        "SELECT exchange, pair, CASE WHEN pos < floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(ts) AS from_ts,"
        " max(ts) AS to_ts, round(avg(spread), 6) + 0.0 AS mean_spread FROM spread GROUP BY ALL", "candles", ctes=PAIRS)),
    "pairs_audit": (pairs_audit, sql(
        "SELECT 'spread_log' AS column_name, 0::BIGINT AS nan_count, 0::BIGINT AS inf_count, count(*) FILTER (WHERE spread IS NULL) AS null_count"
        " FROM spread UNION ALL SELECT 'ret', 0, 0, count(*) FILTER (WHERE ret IS NULL) FROM spread"
        " UNION ALL SELECT 'mean_24', 0, 0, count(*) FILTER (WHERE pos < 23) FROM spread"
        " UNION ALL SELECT 'root_ret', count(*) FILTER (WHERE ret < 0), 0, 0 FROM spread"
        " UNION ALL SELECT 'odd_volume', 0, count(*) FILTER (WHERE leg1_volume % 2 = 0), 0 FROM spread", "candles", ctes=PAIRS)),
}
