"""Physical plans: no cross joins or Python rows, pruned scans, one shuffle for all feature windows."""

import re
from types import SimpleNamespace

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import timeseries as ts_ops
from tickloom.operators.blocks import SeriesBlocks, time_block
from tickloom.plans import registry
from tickloom.session import shared_dir

SF = "/root/testdata/sf0.001"
# These act while they are built (writes, streams, model fits); their parts are tested elsewhere.
ACTING = {"upsert_candles", "insert_ignore", "replace_slice", "rebuild_spread", "append_signals", "training_table",
          "gbt_scores", "token_alpha"}
NAMES = [n for n in registry.queries() if n not in ACTING and not n.startswith("stream_")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Plans as they are for tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# State from row to row (and counters of a summary), which no built-in function carries: blocks run in Arrow batches.
RECURSIVE = {"recursive_indicators", "regime_labels", "alert_cooldown", "trending_terms"}


def test_no_cross_joins_and_no_python(shuffled):
    for name in NAMES:
        text = plan(registry.queries()[name](shuffled, SF))
        for bad in ("CartesianProduct", "NestedLoop", *(() if name in RECURSIVE else ("Python", "InPandas"))):
            assert bad not in text, (name, bad)


def test_feature_windows_share_shuffle_and_sort(shuffled):
    text = plan(registry.queries()["feature_matrix"](shuffled, SF))
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*_blk#\d+L, ", text)) == 1
    assert len(re.findall(r"Sort \[[^\]]*_blk#", text)) == 1


def test_filters_and_columns_reach_the_scan(shuffled):
    text = plan(registry.queries()["whale_transfers"](shuffled, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,250000.0)]" in text
    text = plan(registry.queries()["liquidity_risk"](shuffled, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in text


def test_cluster_without_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
    local = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="y"))
    assert shared_dir(local) == shared_dir(local)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(lengths=st.lists(st.integers(1, 900), min_size=1, max_size=4), back=st.integers(1, 30), ahead=st.integers(1, 30),
       width=st.sampled_from([3600, 7 * 3600, 10**7]))
def test_any_blocking_gives_the_same_windows(spark, lengths, back, ahead, width):
    pdf = pd.concat([pd.DataFrame({"k": i, "ts": pd.date_range("2024-01-01", periods=n, freq="17min"),
                                   "x": [float((j * 7919 + i) % 101) for j in range(n)]}) for i, n in enumerate(lengths)])
    s = SeriesBlocks(("k",), ("ts",), time_block("ts", width), back=back, ahead=ahead, block_rows=256)
    df = s.open(spark.createDataFrame(pdf)).withColumns({
        "old": F.lag("x", back).over(s.row_window()), "new": F.lead("x", ahead).over(s.row_window()),
        "mean": ts_ops.expanding_mean(s, "x", back + 1)})
    got = s.close(df).toPandas().sort_values(["k", "ts"]).reset_index(drop=True)
    g = pdf.groupby("k")["x"]
    want = pd.DataFrame({"old": g.shift(back), "new": g.shift(-ahead),
                         "mean": g.transform(lambda v: v.rolling(back + 1, min_periods=1).mean())}).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["old", "new", "mean"]], want, check_exact=False, atol=1e-9)
