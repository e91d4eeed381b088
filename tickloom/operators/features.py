"""The 32-column feature table of a pair series, with labels and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.math import eps_divide, zscore
from tickloom.functions.times import cyclic_time
from tickloom.operators import timeseries as ts_ops
from tickloom.operators.blocks import SeriesBlocks, time_block
from tickloom.operators.flows import flow_pivot, hourly_activity, leg_flows, lookup_zero

SERIES_KEYS = ("exchange", "pair")
HORIZONS = {"1h": 1, "4h": 4, "24h": 24}
EMA_SPANS = {"ema_20": 20, "ema_50": 50}
WEEK = 7 * 86400

# The input order of the models.
FEATURES = [
    "spread", "spread_ret", "roll_mean", "roll_std", "leg1_volume", "leg2_volume",
    "leg1_z", "leg2_z", "vol_ratio", "leg2_long_l", "leg2_short_l", "leg1_long_l",
    "leg1_short_l", "wallet_tx_l", "wallet_notional_l", "rv_20", "mom_1h", "mom_4h",
    "mom_24h", "ema_20", "ema_50", "trend", "bb_z", "velocity", "acceleration",
    "vol_imbalance", "skew_20", "kurt_20", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
]
TARGETS = [f"{p}_{h}" for p in ("y", "dir") for h in HORIZONS]


def spread_blocks(back: int = 0, ahead: int = 0, block_rows: int = 65536, block_seconds: int = 4 * WEEK) -> SeriesBlocks:
    return SeriesBlocks(SERIES_KEYS, ("ts",), time_block("ts", block_seconds), back, ahead, block_rows)


def feature_matrix(
    spread: DataFrame,
    trades: DataFrame,
    activity: DataFrame,
    legs: dict[str, str] | None,
    min_history: int = 500,
    zero_fill: bool = True,
    block_rows: int = 65536,
) -> DataFrame:
    """All features and labels per (exchange, pair, ts).

    Flows are aggregated by hour before they meet the timeline: those of the symbols `legs` names, or,
    where it is None, of the legs in each pair's own name. All row windows
    share one shuffle by (series, row block); series shorter than `min_history`
    are left out rather than failing the job.
    """
    flow_names = [f"{p}_{s}" for p in legs or ("leg2", "leg1") for s in ("long", "short")]
    timeline = leg_flows(spread, trades) if legs is None else lookup_zero(spread, flow_pivot(trades, legs), flow_names)
    timeline = lookup_zero(timeline, hourly_activity(activity), ["wallet_tx_count", "wallet_notional"])

    s = spread_blocks(back=ts_ops.ema_halo(EMA_SPANS.values()), ahead=max(HORIZONS.values()), block_rows=block_rows)
    df = s.open(timeline.withColumnRenamed("spread_log", "spread"), means=["leg1_volume", "leg2_volume"], rows_of=spread)
    df = df.where(F.col("n_rows") >= min_history)

    # Two window stages over the same clustering and sort order; what the second
    # one needs from the first is named here.
    df = df.withColumns({
        "spread_ret": ts_ops.difference(s, "spread"),
        "roll_mean": ts_ops.expanding_mean(s, "spread", 24),
        "roll_std": ts_ops.expanding_std(s, "spread", 24),
        **{f"mom_{h}": ts_ops.difference(s, "spread", k) for h, k in HORIZONS.items()},
        **ts_ops.targets(s, "spread", HORIZONS, zero_fill),
        **ts_ops.band_windows(s, "spread", 20),
        **ts_ops.ema_inner(s, "spread", EMA_SPANS),
    })
    df = s.close(df.withColumns({
        "acceleration": ts_ops.difference(s, "mom_1h"),
        "rv_20": ts_ops.realised_vol(s, "spread_ret", 20),
        "skew_20": ts_ops.rolling_skew(s, "spread_ret", 20),
        "kurt_20": ts_ops.rolling_kurtosis(s, "spread_ret", 20),
        **ts_ops.bands(s, "spread", 20),
        **ts_ops.ema(s, EMA_SPANS),
    }))

    df = df.withColumns({
        "leg1_z": zscore("leg1_volume", "leg1_volume_mean", "leg1_volume_std"),
        "leg2_z": zscore("leg2_volume", "leg2_volume_mean", "leg2_volume_std"),
        "vol_ratio": eps_divide("leg1_volume", "leg2_volume"),
        "vol_imbalance": F.col("leg1_volume") - F.col("leg2_volume"),
        "trend": F.col("ema_20") - F.col("ema_50"),
        "velocity": F.col("mom_1h"),
        "wallet_tx_l": F.log1p("wallet_tx_count"),
        "wallet_notional_l": F.log1p("wallet_notional"),
        **{f"{n}_l": F.log1p(n) for n in flow_names},
        **cyclic_time("ts"),
    })
    labels = TARGETS if zero_fill else TARGETS + [f"valid_{h}" for h in HORIZONS]
    return df.select(*SERIES_KEYS, "ts", "pos", "n_rows", *FEATURES, *labels)


def audit_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinity and NULL counts of the listed columns in one pass, as long rows."""
    inf = F.lit(float("inf"))
    wide = df.agg(*[
        F.struct(
            F.count_if(F.isnan(c)).alias("nan_count"),
            F.count_if(F.abs(F.col(c).cast("double")) == inf).alias("inf_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
        ).alias(c)
        for c in columns
    ])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in columns]))
    return wide.select(rows.alias("r")).select("r.column_name", "r.s.nan_count", "r.s.inf_count", "r.s.null_count")
