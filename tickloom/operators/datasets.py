"""Window datasets, splits and evaluation losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.math import clamp, zscore
from tickloom.operators.blocks import SeriesBlocks, newest_rows
from tickloom.operators.features import HORIZONS, SERIES_KEYS, spread_blocks
from tickloom.operators.timeseries import targets


def latest_window(spread: DataFrame, rows: int = 168, eps: float = 1e-8) -> DataFrame:
    """Newest rows of each series with volume z-scores over just those rows."""
    s = spread_blocks()
    tail = newest_rows(spread, s.keys, s.order, rows)
    series = Window.partitionBy(*s.keys)  # at most `rows` rows each

    def z(volume: str) -> Column:
        return zscore(volume, F.avg(volume).over(series), F.stddev_pop(volume).over(series), eps)

    return tail.select(*s.keys, "ts", "spread_log", z("leg1_volume").alias("leg1_z"), z("leg2_volume").alias("leg2_z"))


def window_dataset(matrix: DataFrame, features: Sequence[str], labels: Sequence[str], rows: int = 168, gap: int = 24,
                   block_rows: int = 65536) -> DataFrame:
    """Sequence samples: the `rows` feature rows before a row, with that row's labels.

    Samples whose labels would need rows past the end (`gap`) are left out. `pos`
    and `n_rows` of a whole feature matrix are used as they are.
    """
    s = SeriesBlocks(SERIES_KEYS, ("ts",), spread_blocks().block, back=rows, block_rows=block_rows)
    df = s.open(matrix, placed={"pos", "n_rows"} <= set(matrix.columns))
    df = df.withColumn("window", F.collect_list(F.struct(*features)).over(s.rows(-rows, -1)))
    kept = s.close(df).where((F.col("pos") >= rows) & (F.col("pos") < F.col("n_rows") - gap))
    return kept.select(*s.keys, "ts", "pos", "window", *labels)


def flat_windows(spread: DataFrame, rows: int = 168, eps: float = 1e-8, block_rows: int = 65536,
                 horizons: dict[str, int] = HORIZONS, labelled: bool = True) -> DataFrame:
    """One vector per row: `rows` spreads, then z-scored volumes of both legs, with deltas.

    Rows whose deltas would need rows past the end are left out unless `labelled` is false; their deltas then mean nothing.
    """
    s = SeriesBlocks(SERIES_KEYS, ("ts",), spread_blocks().block, back=rows - 1, ahead=max(horizons.values()),
                     block_rows=block_rows)
    df = s.open(spread, means=["leg1_volume", "leg2_volume"]).withColumns({
        "leg1_z": zscore("leg1_volume", "leg1_volume_mean", "leg1_volume_std", eps),
        "leg2_z": zscore("leg2_volume", "leg2_volume_mean", "leg2_volume_std", eps),
    })
    frame = s.rows(-(rows - 1), 0)
    values = [F.collect_list(c).over(frame) for c in ("spread_log", "leg1_z", "leg2_z")]
    df = df.withColumns({
        "features": F.flatten(F.array(*values)),
        **{n: c for n, c in targets(s, "spread_log", horizons).items() if n.startswith("y_")},
    })
    last = max(horizons.values())
    kept = s.close(df).where((F.col("pos") >= rows - 1) & (F.col("pos") < F.col("n_rows") - (last if labelled else 0)))
    return kept.select(*s.keys, "ts", "pos", "n_rows", "features", *[f"y_{h}" for h in horizons])


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds `split`: the first `share` of each series is train. Needs `pos`, `n_rows`."""
    return df.withColumn("split", F.when(F.col("pos") < F.floor(F.col("n_rows") * share), "train").otherwise("test"))


def random_split(df: DataFrame, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Split without regard to time; overlapping windows then leak between the parts."""
    train, test = df.randomSplit([share, 1 - share], seed)
    return train, test


def gaussian_nll(mu: Column, log_sigma: Column, y: Column, bound: float | None = 3.0, eps: float = 1e-6) -> Column:
    s = log_sigma if bound is None else clamp(log_sigma, -bound, bound)
    sigma = F.exp(s)
    return (mu - y) * (mu - y) / (sigma * sigma + eps) + s * 2.0


def direction_cross_entropy(logit: Column, label: Column) -> Column:
    """Cross-entropy of class logits (0, z), in the form that cannot overflow."""
    return F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0)) - logit * label


def loss_metrics(predictions: DataFrame, direction_weight: float = 0.7) -> DataFrame:
    """Losses per horizon and over all, from long rows (horizon, mu, log_sigma, logit, y, dir)."""
    nll = gaussian_nll(F.col("mu"), F.col("log_sigma"), F.col("y"))
    plain = gaussian_nll(F.col("mu"), F.col("log_sigma"), F.col("y"), None, 1e-8)
    ce = direction_cross_entropy(F.col("logit"), F.col("dir"))
    rows = predictions.select(F.explode(F.array("horizon", F.lit("all"))).alias("horizon"),
                              nll.alias("nll"), plain.alias("nll_plain"), ce.alias("ce"))
    agg = rows.groupBy("horizon").agg(F.avg("nll").alias("nll"), F.avg("nll_plain").alias("nll_unclamped"),
                                      F.avg("ce").alias("direction_loss"), F.count(F.lit(1)).alias("samples"))
    return agg.withColumn("loss", F.col("nll") + F.col("direction_loss") * direction_weight)
