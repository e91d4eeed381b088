"""Window features against their definitions, with series cut into many blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import datasets, edges, features, tokens
from tickloom.operators import timeseries as ts_ops
from tickloom.operators.blocks import SeriesBlocks, first_rows, last_rows, newest_rows, time_block, with_position

START = dt.datetime(2024, 1, 1)
LENGTHS = (1, 2, 19, 20, 23, 24, 50, 51, 168, 169, 3000)


def series_frame(spark, lengths=LENGTHS, constant=False, seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for n in lengths:
        x = np.full(n, 1.25) if constant else np.cumsum(rng.normal(0, 0.01, n))
        parts.append(pd.DataFrame({
            "exchange": "x", "pair": f"p{n}", "ts": [START + dt.timedelta(hours=i) for i in range(n)],
            "spread_log": x, "leg1_volume": rng.gamma(2.0, 50.0, n), "leg2_volume": rng.gamma(2.0, 20.0, n)}))
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def moments(window):
    """Sample deviation, bias-corrected skewness and excess kurtosis of a full window, from their definitions."""
    n, apart = len(window), np.asarray(window, float) - np.mean(window)
    m2, m3, m4 = (float(np.mean(apart ** p)) for p in (2, 3, 4))
    if m2 == 0:
        return 0.0, 0.0, -3.0
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    return (m2 * n / (n - 1)) ** 0.5, g1 * (n * (n - 1)) ** 0.5 / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def weighted_mean(values, span):
    """Mean with weights (1 - 2 / (span + 1)) ** age over the values there are; None before the first."""
    ages = len(values) - 1 - np.arange(len(values))
    there = ~np.isnan(values)
    weights = (1 - 2 / (span + 1)) ** ages[there]
    return float((weights * values[there]).sum() / weights.sum()) if there.any() else None


def expected(g):
    """What each feature of a row is by its definition, from explicit slices of one series."""
    s = g["spread_log"].to_numpy()
    n = len(s)
    ret = np.array([s[i] - s[i - 1] if i else 0.0 for i in range(n)])
    rows = []
    full = [i for i in range(n) if i >= 19]
    for i in range(n):
        day = s[max(0, i - 23):i + 1]
        vol, skew, kurt = moments(ret[i - 19:i + 1]) if i >= 19 else (0.0, 0.0, 0.0)
        row = {"spread_ret": ret[i], "roll_mean": day.sum() / len(day),
               "roll_std": max(1e-6, (((day - day.sum() / len(day)) ** 2).sum() / len(day)) ** 0.5),
               "rv_20": vol or 1e-6, "skew_20": skew, "kurt_20": kurt}
        for name, k in features.HORIZONS.items():
            row[f"mom_{name}"] = s[i] - s[i - k] if i >= k else 0.0
            row[f"y_{name}"] = s[i + k] - s[i] if i + k < n else 0.0
        row["acceleration"] = (s[i] - s[i - 1]) - (s[i - 1] - s[i - 2] if i >= 2 else 0.0) if i else 0.0
        row["ema_20"], row["ema_50"] = (weighted_mean(s[max(0, i - 1200):i + 1], span) for span in (20, 50))
        if full:  # the head takes the first full window
            band = s[max(i, 19) - 19:max(i, 19) + 1]
            row["bb_z"] = (s[i] - band.mean()) / ((moments(band)[0] or 1e-6) + 1e-6)
        else:
            row["bb_z"] = s[i] / (1e-6 + 1e-6)
        v = g["leg1_volume"].to_numpy()
        row["leg1_z"] = (v[i] - v.sum() / n) / ((((v - v.sum() / n) ** 2).sum() / n) ** 0.5 + 1e-6)
        rows.append(row)
    return pd.DataFrame(rows)


def build(spark, spread, **kw):
    trades = spark.createDataFrame([], "symbol string, side string, trade_time timestamp, notional_usd double")
    activity = spark.createDataFrame([], "tx_time timestamp, notional_usd double")
    return features.feature_matrix(spread, trades, activity, {"leg2": "B", "leg1": "A"}, min_history=1, **kw)


@pytest.mark.parametrize("block_rows", [1024, 65536])
def test_features_match_their_definitions(spark, block_rows):
    spread, pdf = series_frame(spark)
    got = build(spark, spread, block_rows=block_rows).toPandas().sort_values(["pair", "ts"])
    assert len(got) == len(pdf)
    for pair, g in pdf.groupby("pair"):
        mine = got[got["pair"] == pair].reset_index(drop=True)
        for c, want in expected(g).items():
            np.testing.assert_allclose(mine[c], want, rtol=1e-9, atol=5e-9, err_msg=f"{pair} {c}")


def test_moments_of_returns_far_from_zero(spark):
    """A steady drift with tiny noise, where raw power sums would cancel."""
    rng = np.random.default_rng(8)
    drift = np.cumsum(0.01 + rng.normal(0, 1e-9, 60))
    pdf = pd.DataFrame({"exchange": "x", "pair": "p", "ts": [START + dt.timedelta(hours=i) for i in range(60)],
                        "spread_log": drift, "leg1_volume": 1.0, "leg2_volume": 1.0})
    got = build(spark, spark.createDataFrame(pdf)).toPandas().sort_values("ts").reset_index(drop=True)
    ret = np.diff(drift)
    for i in range(20, 60):
        vol, skew, kurt = moments(ret[i - 20:i])
        np.testing.assert_allclose(got.loc[i, ["rv_20", "skew_20", "kurt_20"]].astype(float), [vol, skew, kurt], rtol=1e-4, atol=1e-12)


def test_exponential_mean_with_gaps(spark):
    values = [None, 5.0, None, 5.0, None, None, 5.0, 8.0, None, 2.0] + [None, 3.0] * 300
    rows = [("x", "p", START + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "exchange string, pair string, ts timestamp, v double")
    spans = {"e": 20}
    s = SeriesBlocks(("exchange", "pair"), ("ts",), time_block("ts", 86400), back=ts_ops.ema_halo(spans.values()), block_rows=1024)
    got = [r["e"] for r in s.close(ts_ops.with_ema(s.open(df), s, "v", spans)).orderBy("ts").collect()]
    plain = np.array([np.nan if v is None else v for v in values])
    for i, e in enumerate(got):
        want = weighted_mean(plain[:i + 1], 20)
        assert e is None if want is None else e == pytest.approx(want, rel=1e-9)
    assert got[6] == pytest.approx(5.0)
    with pytest.raises(ValueError):
        ts_ops.ema_halo([1])


def test_newest_rows(spark):
    spread, _ = series_frame(spark, (5, 700))
    got = newest_rows(spread, ["exchange", "pair"], ["ts"], 30).groupBy("pair").agg(
        F.count("*").alias("n"), F.max("age").alias("age"), F.min("ts").alias("ts")).collect()
    assert {(r["pair"], r["n"], r["age"], r["ts"]) for r in got} == {
        ("p5", 5, 4, START), ("p700", 30, 29, START + dt.timedelta(hours=670))}
    plan = newest_rows(spread, ["exchange", "pair"], ["ts"], 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_constant_series_is_finite(spark):
    spread, _ = series_frame(spark, (40,), constant=True)
    got = build(spark, spread).toPandas()
    assert np.isfinite(got[features.FEATURES].to_numpy(dtype=float)).all()
    assert (got["bb_z"].abs() < 1e-9).all() and np.allclose(got["ema_50"], 1.25)
    assert set(got.sort_values("ts")["kurt_20"][19:]) == {-3.0} and (got["skew_20"] == 0).all()


def test_audit_counts_bad_values(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (float("inf"), -float("inf"))], "a double, b double")
    rows = {r["column_name"]: (r["nan_count"], r["inf_count"], r["null_count"])
            for r in features.audit_finite(df, ["a", "b"]).collect()}
    assert rows == {"a": (1, 1, 0), "b": (0, 1, 1)}


def test_null_tail_mode(spark):
    spread, _ = series_frame(spark, (30,))
    got = build(spark, spread, zero_fill=False).orderBy("ts").toPandas()
    assert got["y_24h"].isna().sum() == 24 and got["valid_24h"].sum() == 6
    assert got["dir_1h"].isna().sum() == 1


def test_min_history_drops_short_series_only(spark):
    spread, _ = series_frame(spark, (10, 60))
    trades = spark.createDataFrame([], "symbol string, side string, trade_time timestamp, notional_usd double")
    activity = spark.createDataFrame([], "tx_time timestamp, notional_usd double")
    got = features.feature_matrix(spread, trades, activity, {"leg2": "B", "leg1": "A"}, min_history=50)
    assert {r["pair"] for r in got.select("pair").distinct().collect()} == {"p60"}


def test_positions_and_tails(spark):
    spread, pdf = series_frame(spark, (5, 700))
    block = time_block("ts", 86400)
    keys = ["exchange", "pair"]
    placed = with_position(spread, keys, ["ts"], block, ["leg1_volume"])
    wrong = placed.where(F.col("pos") != F.unix_seconds("ts") / 3600 - F.lit(int(pd.Timestamp(START).timestamp()) / 3600))
    assert placed.count() == len(pdf) and wrong.count() == 0
    stats = placed.select("pair", "n_rows", "leg1_volume_mean", "leg1_volume_std").distinct().toPandas().set_index("pair")
    for pair, g in pdf.groupby("pair"):
        row = stats.loc[pair]
        assert row["n_rows"] == len(g)
        assert row["leg1_volume_mean"] == pytest.approx(g["leg1_volume"].mean())
        assert row["leg1_volume_std"] == pytest.approx(g["leg1_volume"].std(ddof=0))
    tail = last_rows(spread, keys, ["ts"], block, 30).groupBy("pair").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    assert {(r["pair"], r["n"], r["lo"]) for r in tail.collect()} == {("p5", 5, 0), ("p700", 30, 670)}
    head = first_rows(spread, keys, ["ts"], block, 30).groupBy("pair").agg(F.count("*").alias("n"), F.max("pos").alias("hi"))
    assert {(r["pair"], r["n"], r["hi"]) for r in head.collect()} == {("p5", 5, 4), ("p700", 30, 29)}


def test_block_size_is_checked():
    with pytest.raises(ValueError):
        SeriesBlocks(("a",), ("ts",), None, back=10, block_rows=300)
    with pytest.raises(ValueError):
        SeriesBlocks(("a",), ("ts",), None, back=300, block_rows=256)


def hot_ticks(spark, rows=30_000):
    """One token holds a third of all rows; the others share the rest."""
    i = F.col("id")
    return spark.range(rows).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(1 + i % 200).alias("token_id"), i.alias("metric_id"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i * 37) % 900_000)).alias("metric_time"),
        (F.lit(1.0) + F.xxhash64(i) % 1000 / 7.0 + 200).alias("price"),
        (F.pmod(F.xxhash64(i + 7), F.lit(100)) / 100.0).alias("pump_probability"))


def test_gainers_on_hot_token(spark):
    m = hot_ticks(spark)
    dim = spark.range(201).select(F.col("id").alias("token_id"), F.lit("m").alias("mint"), F.lit("s").alias("symbol"))
    got = tokens.gainers(m, dim, block_rows=256, limit=30).collect()
    w = Window.partitionBy("token_id").orderBy("metric_time", "metric_id")
    old = F.lag("price", 3).over(w)
    want = m.withColumn("g", (F.col("price") - old) / old).where("g is not null") \
        .orderBy(F.desc("g"), "token_id", "metric_id").limit(30).collect()
    assert [(r["metric_id"], round(r["pct_gain"], 9)) for r in got] == [(r["metric_id"], round(r["g"], 9)) for r in want]


@pytest.mark.parametrize("ttl", [None, 600])
def test_edges_on_hot_token(spark, ttl):
    m = hot_ticks(spark)
    got = edges.rising_edges(m, "token_id", "metric_time", "metric_id", F.col("pump_probability") >= 0.85, ttl)
    w = Window.partitionBy("token_id").orderBy("metric_time", "metric_id")
    was = F.coalesce(F.lag(F.col("pump_probability") >= 0.85).over(w), F.lit(False))
    if ttl:
        was = was & (F.unix_micros("metric_time") - F.unix_micros(F.lag("metric_time").over(w)) <= ttl * 1_000_000)
    want = m.withColumn("was", was).where((F.col("pump_probability") >= 0.85) & ~F.col("was"))
    assert got.select("metric_id").exceptAll(want.select("metric_id")).count() == 0
    assert got.count() == want.count() > 0


@pytest.mark.parametrize("block_rows", [256, 65536])
def test_window_datasets(spark, block_rows):
    spread, pdf = series_frame(spark, (100, 400, 1000))
    flat = datasets.flat_windows(spread, rows=168, block_rows=block_rows).toPandas()
    assert flat.groupby("pair").size().to_dict() == {"p400": 400 - 24 - 167, "p1000": 1000 - 24 - 167}
    g = pdf[pdf["pair"] == "p1000"].reset_index(drop=True)
    mine = flat[flat["pair"] == "p1000"].sort_values("ts").reset_index(drop=True)
    z = (g["leg2_volume"] - g["leg2_volume"].mean()) / (g["leg2_volume"].std(ddof=0) + 1e-8)
    for row, i in ((0, 167), (300, 467), (len(mine) - 1, 975)):
        np.testing.assert_allclose(mine["features"][row][:168], g["spread_log"][i - 167:i + 1], atol=1e-12)
        np.testing.assert_allclose(mine["features"][row][336:], z[i - 167:i + 1], atol=1e-9)
        assert mine["y_24h"][row] == pytest.approx(g["spread_log"][i + 24] - g["spread_log"][i])
    seq = datasets.window_dataset(spread, ["spread_log"], ["leg1_volume"], rows=168, block_rows=block_rows)
    seq = seq.where("pair = 'p1000'").orderBy("ts").toPandas()
    assert len(seq) == 1000 - 168 - 24 and (seq["pos"].iloc[0], seq["pos"].iloc[-1]) == (168, 975)
    np.testing.assert_allclose([x["spread_log"] for x in seq["window"][500]], g["spread_log"][500:668], atol=1e-12)


def test_splits(spark):
    spread, _ = series_frame(spark, (10, 51))
    s = features.spread_blocks()
    df = datasets.time_split(s.close(s.open(spread)))
    assert {(r["pair"], r["n"]) for r in df.where("split = 'train'").groupBy("pair").agg(F.count("*").alias("n")).collect()} \
        == {("p10", 8), ("p51", 40)}
    train, test = datasets.random_split(spread, 0.8, 1)
    assert train.count() + test.count() == spread.count()


def test_ema_halo_covers_precision():
    assert ts_ops.ema_halo([20, 50]) == 1024
    assert (1 - 2 / 51) ** ts_ops.ema_halo([50]) < 1e-17
