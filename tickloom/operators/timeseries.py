"""Row-window features of a series, on top of `SeriesBlocks`.

Functions return columns for a frame opened with `SeriesBlocks.open`; those
that need more than one window stage take and return the DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import SUB_ROWS, SeriesBlocks

POS = "pos"


def difference(s: SeriesBlocks, value: str, k: int = 1) -> Column:
    """x[i] - x[i-k]; the first k rows of a series are 0."""
    return F.when(F.col(POS) < k, F.lit(0.0)).otherwise(F.col(value) - F.lag(value, k).over(s.row_window()))


def expanding_mean(s: SeriesBlocks, value: str, n: int) -> Column:
    """Mean of up to n rows; the head uses the rows there are."""
    return F.avg(value).over(s.rows(-(n - 1), 0))


def expanding_std(s: SeriesBlocks, value: str, n: int, floor: float = 1e-6) -> Column:
    """Population deviation of up to n rows, not below `floor`."""
    return F.greatest(F.stddev_pop(value).over(s.rows(-(n - 1), 0)), F.lit(floor))


def full_window(value: Column, n: int) -> Column:
    """NULL until the series has n rows."""
    return F.when(F.col(POS) >= n - 1, value)


def realised_vol(s: SeriesBlocks, returns: str, n: int = 20, floor: float = 1e-6) -> Column:
    """Sample deviation of n returns; short head and exact zero become `floor`."""
    std = full_window(F.stddev_samp(returns).over(s.rows(-(n - 1), 0)), n)
    return F.when(std.isNull() | (std == 0), F.lit(floor)).otherwise(std)


def rolling_skew(s: SeriesBlocks, value: str, n: int = 20) -> Column:
    """Bias-corrected skewness of n rows; 0 in the head and for constant windows."""
    factor = math.sqrt(n * (n - 1)) / (n - 2)
    return F.coalesce(full_window(F.skewness(value).over(s.rows(-(n - 1), 0)), n) * factor, F.lit(0.0))


def rolling_kurtosis(s: SeriesBlocks, value: str, n: int = 20) -> Column:
    """Bias-corrected excess kurtosis; 0 in the head, -3 for constant windows."""
    scale = (n - 1) / ((n - 2) * (n - 3))
    plain = F.kurtosis(value).over(s.rows(-(n - 1), 0))
    corrected = (plain * (n + 1) + 6.0) * scale
    return F.when(F.col(POS) < n - 1, F.lit(0.0)).otherwise(F.coalesce(corrected, F.lit(-3.0)))


def ema_halo(spans: Sequence[int]) -> int:
    """Rows of history after which the weights are below double precision."""
    return SUB_ROWS * max(_ema_terms(span) for span in spans)


def _ema_terms(span: int) -> int:
    if span < 2:
        raise ValueError("an exponential mean needs a span of 2 or more")
    decay = 1.0 - 2.0 / (span + 1.0)
    return max(1, math.ceil(math.log(1e-17) / (SUB_ROWS * math.log(decay))))


def ema_inner(s: SeriesBlocks, value: str, spans: dict[str, int]) -> dict[str, Column]:
    """Weighted prefix sums of values and of weights inside sub-blocks, the first stage of `ema`.

    Rows without a value carry no weight, so a gap does not pull the mean towards zero.
    """
    k = F.col(POS) % SUB_ROWS
    out: dict[str, Column] = {}
    for name, span in spans.items():
        q = 1.0 - 2.0 / (span + 1.0)
        weight = F.when(F.col(value).isNotNull(), F.pow(F.lit(q), -k)).otherwise(F.lit(0.0))
        out[f"_in_{name}"] = F.coalesce(F.sum(F.col(value) * weight).over(s.sub_running()), F.lit(0.0)) * F.pow(F.lit(q), k)
        out[f"_wt_{name}"] = F.sum(weight).over(s.sub_running()) * F.pow(F.lit(q), k)
    return out


def ema(s: SeriesBlocks, spans: dict[str, int]) -> dict[str, Column]:
    """Exponential means with normalised weights: sum q^(t-i) x_i / sum q^(t-i) over rows with a value.

    Weighted prefix sums run inside 256-row sub-blocks (`ema_inner`), where q^-k
    cannot overflow; the end values of the few sub-blocks before carry in the
    rest. The frame must be opened with `back >= ema_halo(spans)`. NULL until
    the series has a value.
    """
    k = F.col(POS) % SUB_ROWS

    def total(column: str, q: float, span: int) -> Column:
        end = F.when(k == SUB_ROWS - 1, F.col(column))
        carry = F.lit(0.0)
        for j in range(1, _ema_terms(span) + 1):
            carry = carry + F.coalesce(F.sum(end).over(s.sub_before(j)), F.lit(0.0)) * q ** (SUB_ROWS * (j - 1))
        return F.col(column) + carry * F.pow(F.lit(q), k + 1)

    def mean(name: str, span: int) -> Column:
        q = 1.0 - 2.0 / (span + 1.0)
        weight = total(f"_wt_{name}", q, span)
        return F.when(weight > 0, total(f"_in_{name}", q, span) / weight)

    return {name: mean(name, span) for name, span in spans.items()}


def with_ema(df: DataFrame, s: SeriesBlocks, value: str, spans: dict[str, int]) -> DataFrame:
    return df.withColumns(ema_inner(s, value, spans)).withColumns(ema(s, spans))


def band_windows(s: SeriesBlocks, value: str, n: int = 20, eps: float = 1e-6) -> dict[str, Column]:
    """Mean and sample deviation of full windows, the first stage of `bands`."""
    frame = s.rows(-(n - 1), 0)
    std = full_window(F.stddev_samp(value).over(frame), n)
    return {
        "_mid": full_window(F.avg(value).over(frame), n),
        "_std": F.when(std == 0, F.lit(eps)).otherwise(std),
    }


def bands(s: SeriesBlocks, value: str, n: int = 20, eps: float = 1e-6) -> dict[str, Column]:
    """`bb_mid`, `bb_std`, `bb_z`; the head is filled back from the first full window.

    The head (pos < n - 1) and the first full window (pos = n - 1) lie in the
    same row block, so the fill is a frame over one bounded block.
    """
    first = F.col(POS) == n - 1
    head = {c: F.max(F.when(first, F.col(c))).over(s.block_all()) for c in ("_mid", "_std")}
    mid = F.coalesce(F.col("_mid"), head["_mid"], F.lit(0.0))
    std = F.coalesce(F.col("_std"), head["_std"], F.lit(eps))
    return {"bb_mid": mid, "bb_std": std, "bb_z": (F.col(value) - mid) / (std + F.lit(eps))}


def with_bollinger(df: DataFrame, s: SeriesBlocks, value: str, n: int = 20, eps: float = 1e-6) -> DataFrame:
    return df.withColumns(band_windows(s, value, n, eps)).withColumns(bands(s, value, n, eps))


def targets(s: SeriesBlocks, value: str, horizons: dict[str, int], zero_fill: bool = True) -> dict[str, Column]:
    """`y_<h>` = x[i+h] - x[i], `dir_<h>` = 1 if positive, `valid_<h>` flag.

    With `zero_fill` the tail without a future row is 0 / 0, otherwise NULL.
    """
    out: dict[str, Column] = {}
    for name, h in horizons.items():
        delta = F.lead(value, h).over(s.row_window()) - F.col(value)
        valid = F.col(POS) + h < F.col("n_rows")
        label = F.when(delta > 0, F.lit(1)).otherwise(F.lit(0))
        out[f"y_{name}"] = F.when(valid, delta).otherwise(F.lit(0.0) if zero_fill else F.lit(None).cast("double"))
        out[f"dir_{name}"] = F.when(valid, label).otherwise(F.lit(0) if zero_fill else F.lit(None).cast("int"))
        out[f"valid_{name}"] = valid
    return out
