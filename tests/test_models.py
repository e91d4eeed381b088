"""Training and scoring of boosted trees, registry and fallbacks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from tickloom.operators import datasets, models
from tickloom.plans import signal_queries


def test_horizon_models_learn_the_series(spark):
    n = 260
    wave = np.sin(np.arange(n) / 3.0)
    spread = spark.createDataFrame(pd.DataFrame({
        "exchange": "x", "pair": "p", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "spread_log": wave,
        "leg1_volume": 1.0 + np.arange(n) % 5, "leg2_volume": 2.0 + np.arange(n) % 3}))
    flat = datasets.flat_windows(spread, rows=8).cache()
    fitted = models.train_horizons(flat, ["1h", "4h"], depth=3, rounds=8)
    scored = models.score_horizons(flat, fitted)
    errors = scored.agg(*[F.avg(F.pow(F.col(f"mu_{h}") - F.col(f"y_{h}"), 2)).alias(h) for h in fitted],
                        *[F.var_pop(f"y_{h}").alias(f"v_{h}") for h in fitted]).first()
    for h in fitted:
        assert errors[h] < 0.5 * errors[f"v_{h}"]


def test_token_scores_default_missing_inputs(spark):
    rows = [(float(i), float(i % 7), 1.0 if i % 7 > 3 else -1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "marketcap double, velocity double, target double").withColumn("symbol", F.lit("s"))
    model = models.train_tokens(df, "target", depth=2, rounds=3)
    got = models.score_tokens(df.withColumn("holders", F.lit(None).cast("int")), model)
    alphas = got.groupBy("velocity").agg(F.avg("alpha")).collect()
    assert all((a > 0.6) == (v > 3) and 0 < a < 1 for v, a in alphas)
    assert set(models.TOKEN_FEATURES) <= set(got.columns)


def test_fallback_and_registry(spark):
    v1 = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k long, prediction double")
    v2 = spark.createDataFrame([(2, 0.9)], "k long, prediction double")
    got = {r["k"]: (r["prediction"], r["model"]) for r in models.fall_back(v2, v1, ["k"]).collect()}
    assert got == {1: (0.1, "v1"), 2: (0.9, "v2")}
    old = spark.createDataFrame([(f"m{i}", "1", i) for i in range(60)], "name string, version_tag string, n int") \
        .withColumn("created_at", F.timestamp_seconds("n"))
    new = spark.createDataFrame([("fresh", "2")], "name string, version_tag string").withColumn("created_at", F.timestamp_seconds(F.lit(100)))
    listed = models.newest_models(models.register_models(old, new)).collect()
    assert len(listed) == 50 and (listed[0]["name"], listed[0]["n"], listed[1]["name"]) == ("fresh", None, "m59")


@pytest.fixture
def fits(monkeypatch):
    """Settings and training rows of every fit; the fits themselves take two rounds."""
    seen, gbt, train_horizons, train_tokens = [], models.gbt, models.train_horizons, models.train_tokens

    def short(label, *args, **kw):
        full = gbt(label, *args, **kw)
        seen.append((full.getMaxDepth(), full.getMaxIter(), full.getStepSize(), full.getCheckpointInterval()))
        return full.setMaxIter(2).setMaxDepth(2)

    monkeypatch.setattr(models, "gbt", short)
    rows = {}
    monkeypatch.setattr(models, "train_horizons", lambda df, *a, **kw: train_horizons(rows.setdefault("train", df), *a, **kw))
    monkeypatch.setattr(models, "train_tokens", lambda df, *a, **kw: train_tokens(rows.setdefault("train", df), *a, **kw))
    return seen, rows


def test_window_models_are_whole_and_keep_test_rows_apart(spark, fits):
    seen, rows = fits
    got = signal_queries.gbt_scores(spark, "/root/testdata/sf0.01").toPandas()
    assert seen == [(6, 300, 0.05, 10)] * 3
    train = rows["train"].selectExpr("size(features) AS width", "pos", "n_rows", "ts").toPandas()
    n = train["n_rows"].iloc[0]
    assert set(train["width"]) == {504} and train["pos"].min() == 167
    assert train["pos"].max() + 24 < math.floor(n * 0.8) and train["ts"].max() < got["ts"].min()
    assert len(got) == n - math.floor(n * 0.8) and got.notna().all().all()


def test_token_model_learns_a_later_price(spark, fits):
    seen, rows = fits
    d = "/root/testdata/sf0.01"
    got = signal_queries.token_alpha(spark, d)
    assert seen == [(6, 300, 0.05, 10)]
    train = rows["train"].toPandas()
    assert got.count() == signal_queries.enriched(spark, d).count() > 0
    for f in set(models.TOKEN_FEATURES) & set(train.columns):
        assert abs(np.corrcoef(train[f].astype(float), train["alpha_target"])[0, 1]) < 0.95 or train[f].nunique() == 1
    old = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "value + 1.0 AS price", "ts")
    last = old.agg(F.max("ts")).first()[0]
    price = {k: old.where(F.col("ts") <= at).groupBy("user_id").agg(F.max_by("price", "ts").alias("p")).toPandas().set_index("user_id")["p"]
             for k, at in (("then", last - pd.Timedelta(days=7)), ("now", last))}
    want = (price["now"] / price["then"] - 1.0).dropna()
    assert sorted(train["alpha_target"]) == pytest.approx(sorted(want), rel=1e-9)


def test_fits_get_tasks_by_the_number_of_their_rows(spark, monkeypatch):
    seen = []

    class Noted(Estimator):
        def _fit(self, dataset):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count()))

    monkeypatch.setattr(models, "gbt", lambda label, **kw: Noted())
    flat = spark.range(40_000, numPartitions=1).selectExpr(
        "'x' AS exchange", "'p' AS pair", "timestamp_seconds(id) AS ts", "array_repeat(id * 1.0D, 504) AS features", "id * 1.0D AS y_1h")
    models.train_horizons(flat, ["1h"])
    models.train_horizons(flat.limit(300), ["1h"])
    models.train_tokens(spark.range(40_000, numPartitions=12).selectExpr("id AS holders", "id * 1.0D AS target"), "target")
    assert seen == [(3, 40_000), (1, 300), (1, 40_000)]


def test_prediction_rows(spark):
    out = spark.createDataFrame([(7, 0.1, -1.0, 0.0, 0.2, -2.0, 1.0)],
                                "k int, mu_1h double, log_sigma_1h double, logit_1h double, mu_4h double, log_sigma_4h double, logit_4h double")
    rows = models.decode_predictions(models.prediction_rows(out, ["k"], ["1h", "4h"])).orderBy("horizon").collect()
    assert [(r["horizon"], r["mu"], r["direction"]) for r in rows] == [("1h", 0.1, "neutral"), ("4h", 0.2, "up")]
    assert rows[1]["sigma"] == pytest.approx(math.exp(-2))
