"""How predictions turned out: the return until the first price after a horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import seconds_interval
from tickloom.operators.asof import first_at_or_after


def prediction_outcomes(predictions: DataFrame, prices: DataFrame, horizon_seconds: int, keys: Sequence[str] = ("token_id",),
                        ts: str = "metric_time", price_ts: str = "metric_time", price_tie: str = "metric_id") -> DataFrame:
    """Predictions (with the price they were made at) and `future_price`, `future_time`, `future_return`.

    The future price is the key's first one at or after the prediction's time plus the horizon, equal
    times by `price_tie`; all three are NULL where there is none yet. A price of 0 has no return.
    """
    until = F.col(ts).cast("timestamp") + seconds_interval(horizon_seconds)
    found = first_at_or_after(predictions, prices, keys, until, price_ts, price_tie, ["price", price_ts], "_future")
    return found.select(*predictions.columns, F.col("_future.price").alias("future_price"), F.col(f"_future.{price_ts}").alias("future_time"),
                        (F.try_divide(F.col("_future.price"), F.col("price")) - 1.0).alias("future_return"))


def prediction_performance(outcomes: DataFrame, since: Column, by: Sequence[str] = (), ts: str = "metric_time",
                           confidence: str = "pump_probability", threshold: float = 0.85, pump: float = 0.0) -> DataFrame:
    """Predictions not older than `since`: their number, how many have an outcome, the mean future return, the
    number of high confidence (`threshold` or more) and the share of those with an outcome that rose by more than `pump`.
    """
    high = F.col(confidence) >= threshold
    known = F.col("future_return").isNotNull()
    return outcomes.where(F.col(ts) >= since).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(known).alias("with_outcome"),
        F.avg("future_return").alias("avg_future_return"),
        F.count_if(high).alias("high_conf_count"),
        F.try_divide(F.count_if(high & (F.col("future_return") > pump)), F.count_if(high & known)).alias("high_conf_pump_rate"))
