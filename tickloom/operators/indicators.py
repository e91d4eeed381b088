"""Recursive indicators of a series: RSI, MACD, ADX and supertrend, over blocks of any series.

Each of them carries a state from row to row. A block of rows acts on the state that enters it as a
function that is known without that state: smoothed means are affine functions of it, a final band is a
step function (it stays as it is or is replaced by a basic band). So blocks are summed up on their own,
the few functions of a series are applied one after the other, and then every block runs from its true
state. What depends on smoothed means (ADX, the bands) takes a second round.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tickloom.operators.blocks import SeriesBlocks, block_seconds_for, time_block
from tickloom.session import cut_lineage


@dataclass(frozen=True)
class Periods:
    rsi: int = 14
    fast: int = 12
    slow: int = 26
    signal: int = 9
    adx: int = 14
    atr: int = 10
    width: float = 3.0


INDICATORS = ["rsi", "macd", "macd_signal", "macd_hist", "plus_di", "minus_di", "adx", "atr", "final_upper", "final_lower", "trend", "supertrend"]


def smoothed(values: np.ndarray, n: int, state: float | None, warm: int = 0) -> np.ndarray:
    """Wilder's mean: y = (y (n - 1) + x) / n; without a state it begins with the plain mean of the first n values after `warm`."""
    out = np.full(len(values), np.nan)
    begin = 0
    if state is None:
        begin = warm + n
        if len(values) < begin:
            return out
        state = float(np.mean(values[warm:begin]))
        out[begin - 1] = state
    for i, x in enumerate(values[begin:].tolist(), begin):
        state = (state * (n - 1) + x) / n
        out[i] = state
    return out


def exponential(values: np.ndarray, n: int, state: float | None) -> np.ndarray:
    """y = y + 2 / (n + 1) (x - y), from the first value where there is no state."""
    out, step = np.empty(len(values)), 2.0 / (n + 1.0)
    for i, x in enumerate(values.tolist()):
        state = x if state is None else state + step * (x - state)
        out[i] = state
    return out


class BandFunction:
    """What a block makes of the upper band that enters it (a lower band is an upper one with all signs turned).

    The band x becomes the basic band where that is lower or the close before is above x, and stays
    otherwise. So it stays through the block if no basic band of the block is below it and no close above;
    else its first replacement decides all that follows. Bands that were replaced meet: at any time the
    different ones ascend, and both ends drop into the newest. `cuts` lists, for falling lows of the basic
    band and for rising closes, the x replaced there with the band at the end of the block and the last
    row at which the close stood above it (-1: none).
    """

    def __init__(self, basic: Sequence[float], close: Sequence[float], close_before: float):
        value, parent, broke = [], [], []
        live: deque[int] = deque()
        low, high = -np.inf, np.inf  # what has stayed so far
        over: list[tuple[float, int, int]] = []  # bands above the first number fall to the node, at the row
        under: list[tuple[float, int, int]] = []
        before = close_before
        for row, (band, now) in enumerate(zip(basic, close, strict=True)):
            fallen = []
            while live and value[live[-1]] > band:
                node = live.pop()
                broke[node] = row - 1 if value[node] < before else broke[node]
                fallen.append(node)
            while live and value[live[0]] < before:
                node = live.popleft()
                broke[node] = row - 1
                fallen.append(node)
            if not (live and value[live[-1]] == band):
                value.append(band)
                parent.append(-1)
                broke.append(-1)
                live.append(len(value) - 1)
            newest = live[-1]
            for node in fallen:
                parent[node] = newest
            if band < high:
                high = band
                over.append((band, row, newest))
            if before > low:
                low = before
                under.append((before, row, newest))
            before = now
        last = len(close) - 1
        for node in live:
            if value[node] < before:
                broke[node] = last
        self.last, self.close = last, before

        def end(node: int) -> tuple[float, int]:
            row = broke[node]
            while parent[node] >= 0:
                node = parent[node]
                row = broke[node] if broke[node] >= 0 else row
            return value[node], row

        self.over = [(at, row, *end(node)) for at, row, node in over]
        # A band below the close before has been broken through by it, at the row before its replacement.
        self.under = [(at, row, *((v, b) if b >= row - 1 else (v, row - 1))) for at, row, node in under for v, b in [end(node)]]

    def text(self) -> str:
        return json.dumps([self.over, self.under, self.last, self.close])

    @staticmethod
    def apply(text: str, x: float) -> tuple[float, int]:
        """The band at the end of the block and the last row at which the close stood above the band."""
        over, under, last, close = json.loads(text)
        first_over = bisect_right([-c[0] for c in over], -x)  # the first band lower than x
        first_under = bisect_right([c[0] for c in under], x)  # the first close above x
        found = [c for c in ([over[first_over]] if first_over < len(over) else []) + ([under[first_under]] if first_under < len(under) else [])]
        if not found:
            return x, last if close > x else -1
        row = min(c[1] for c in found)  # where both happen at one row, both lead to the same band
        return next(c[2] for c in found if c[1] == row), max(c[3] for c in found if c[1] == row)


def run_bands(basic: np.ndarray, close: np.ndarray, close_before: float | None, state: float | None) -> np.ndarray:
    """Final upper band of every row; NaN before the basic band begins."""
    out = np.full(len(basic), np.nan)
    before = close_before
    for i, (band, now) in enumerate(zip(basic.tolist(), close.tolist(), strict=True)):
        if band == band:
            if state is None or band < state or before > state:
                state = band
            out[i] = state
        before = now
    return out


def run_trend(upper: np.ndarray, lower: np.ndarray, close: np.ndarray, state: float | None) -> np.ndarray:
    """1 while the close last stood above the upper band, -1 while below the lower; 1 at the beginning."""
    out = np.full(len(close), np.nan)
    for i, (up, down, now) in enumerate(zip(upper.tolist(), lower.tolist(), close.tolist(), strict=True)):
        if up == up:
            state = 1.0 if now > up else -1.0 if now < down else 1.0 if state is None else state
            out[i] = state
    return out


SMOOTH = ["gain", "loss", "true", "plus", "minus", "range"]
MEANS = [*SMOOTH, "fast", "slow", "signal"]


def _inputs(part: pd.DataFrame) -> dict[str, np.ndarray]:
    """What enters the smoothed means, row by row; the first row of a series has no change."""
    close, high, low = (part[c].to_numpy(float) for c in ("close", "high", "low"))
    before, high_before, low_before = (part[c].to_numpy(float) for c in ("_close", "_high", "_low"))
    change = np.nan_to_num(close - before)
    true = np.where(np.isnan(before), high - low, np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before))))
    up, down = np.nan_to_num(high - high_before), np.nan_to_num(low_before - low)
    return {"gain": np.maximum(change, 0), "loss": np.maximum(-change, 0), "true": true, "range": true,
            "plus": np.where((up > down) & (up > 0), up, 0.0), "minus": np.where((down > up) & (down > 0), down, 0.0)}


def _means(part: pd.DataFrame, p: Periods, state: dict | None) -> dict[str, np.ndarray]:
    found, close = _inputs(part), part["close"].to_numpy(float)
    n = {"gain": p.rsi, "loss": p.rsi, "true": p.adx, "plus": p.adx, "minus": p.adx, "range": p.atr}
    out = {c: smoothed(found[c], n[c], None if state is None else state[c], warm=1) for c in SMOOTH}
    out["fast"] = exponential(close, p.fast, None if state is None else state["fast"])
    out["slow"] = exponential(close, p.slow, None if state is None else state["slow"])
    out["signal"] = exponential(out["fast"] - out["slow"], p.signal, None if state is None else state["signal"])
    return out


def _directions(means: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = (np.where(means["true"] > 0, 100 * means[c] / means["true"], np.where(np.isnan(means["true"]), np.nan, 0.0))
                       for c in ("plus", "minus"))
        total = plus + minus
        index = np.where(total > 0, 100 * np.abs(plus - minus) / total, np.where(np.isnan(total), np.nan, 0.0))
    return plus, minus, index


def _basic(part: pd.DataFrame, means: dict[str, np.ndarray], p: Periods) -> tuple[np.ndarray, np.ndarray]:
    middle = (part["high"].to_numpy(float) + part["low"].to_numpy(float)) / 2
    return middle + p.width * means["range"], middle - p.width * means["range"]


def _echo(n: int, beta: float, decay: float) -> float:
    """What a state of 1 that fades by `decay` a row leaves in a mean with step `beta` after n rows."""
    rows = np.arange(1, n + 1)
    return float(np.sum(beta * (1 - beta) ** (n - rows) * decay ** rows))


def _affine(n: int, p: Periods) -> np.ndarray:
    """The matrix by which n rows act on the means that enter them (in the order of MEANS)."""
    fades = [1 - 1 / k for k in (p.rsi, p.rsi, p.adx, p.adx, p.adx, p.atr)] + [1 - 2 / (k + 1) for k in (p.fast, p.slow, p.signal)]
    out = np.diag([fade ** n for fade in fades])
    out[8, 6], out[8, 7] = _echo(n, 2 / (p.signal + 1), fades[6]), -_echo(n, 2 / (p.signal + 1), fades[7])
    return out


def _entry(part: pd.DataFrame, names: Sequence[str]) -> dict | None:
    """The state that enters a block; None at the beginning of a series."""
    return None if int(part["_blk"].iloc[0]) == 0 else {c: float(part[f"_in_{c}"].iloc[0]) for c in names}


def recursive_indicators(candles: DataFrame, keys: Sequence[str], ts: str = "open_time", periods: Periods = Periods(),
                         block_rows: int = 65_536) -> DataFrame:
    """keys, ts and INDICATORS for every candle (close, high, low) of every series.

    rsi, plus_di, minus_di, adx, atr are Wilder's, begun with plain means; NULL until there are rows
    enough (rsi of a motionless window: 50). macd and its signal begin with the first close. Bands are the
    middle of high and low plus and minus `width` atr; the trend turns up when the close stands above the
    final upper band, down below the lower, and supertrend is the band on the other side. Keys are not
    NULL, `ts` is unique within a series; candles that lack a time, close, high or low are left out.

    A series of any length is spread over its blocks of `block_rows` rows, which hold the longest beginning.
    """
    p, keys = periods, list(keys)
    if block_rows < max(2 * p.adx + 1, p.rsi + 1, p.atr + 1):
        raise ValueError("a block must hold the rows with which the means begin")
    whole = candles.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (ts, "close", "high", "low")))
    whole = whole.select(*keys, F.col(ts), *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low")])
    s = SeriesBlocks(tuple(keys), (ts,), time_block(ts, block_seconds_for(whole, keys, ts)), back=1, block_rows=-(-block_rows // 256) * 256)
    opened = s.open(whole)
    rows = s.close(opened.withColumns({f"_{c}": F.lag(c).over(s.row_window()) for c in ("close", "high", "low")}))
    rows = cut_lineage(rows.withColumn("_blk", F.floor(F.col("pos") / F.lit(block_rows)).cast("long")).drop("n_rows"))
    key_fields = [f for f in rows.schema.fields if f.name in keys]
    block_schema = StructType([*key_fields]).add("_blk", "long")

    def ordered(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values("pos", ignore_index=True)

    def named(part: pd.DataFrame) -> dict:
        return {k: part[k].iloc[0] for k in keys} | {"_blk": int(part["_blk"].iloc[0])}

    # First round: the means.
    def summed_up(part: pd.DataFrame) -> pd.DataFrame:
        part = ordered(part)
        first = int(part["_blk"].iloc[0]) == 0
        means = _means(part, p, None if first else dict.fromkeys(MEANS, 0.0))
        return pd.DataFrame([named(part) | {"_rows": len(part), "_exit": [float(means[c][-1]) for c in MEANS]}])

    def means_scan(part: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for row in part.sort_values("_blk").to_dict("records"):
            exit_ = np.array(row["_exit"], float)
            out.append({k: row[k] for k in [*keys, "_blk"]} | {f"_in_{c}": None if state is None else float(x)
                                                              for c, x in zip(MEANS, state if state is not None else exit_, strict=True)})
            state = exit_ if state is None else exit_ + _affine(int(row["_rows"]), p) @ state
        return pd.DataFrame(out)

    entering = StructType([*block_schema.fields])
    for c in MEANS:
        entering = entering.add(f"_in_{c}", "double")
    maps = rows.groupBy(*keys, "_blk").applyInPandas(
        summed_up, StructType([*block_schema.fields]).add("_rows", "long").add("_exit", ArrayType(DoubleType())))
    entries = cut_lineage(maps.groupBy(*keys).applyInPandas(means_scan, entering))
    rows = rows.join(entries, [*keys, "_blk"])

    # Second round: what is made of the means.
    def bands_summed_up(part: pd.DataFrame) -> pd.DataFrame:
        part = ordered(part)
        state = _entry(part, MEANS)
        means = _means(part, p, state)
        upper, lower = _basic(part, means, p)
        close = part["close"].to_numpy(float)
        index = _directions(means)[2]
        out = named(part) | {"_rows": len(part)}
        if state is None:
            up, down = run_bands(upper, close, None, None), -run_bands(-lower, -close, None, None)
            adx = smoothed(index, p.adx, None, warm=p.adx)
            out |= {"_state": [float(x[-1]) for x in (adx, up, down, run_trend(up, down, close, None))], "_up": None, "_down": None}
        else:
            before = float(part["_close"].iloc[0])
            functions = [BandFunction(upper.tolist(), close.tolist(), before).text(),
                         BandFunction((-lower).tolist(), (-close).tolist(), -before).text()]
            out |= {"_state": [float(smoothed(index, p.adx, 0.0)[-1])], "_up": functions[0], "_down": functions[1]}
        return pd.DataFrame([out])

    def bands_scan(part: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for row in part.sort_values("_blk").to_dict("records"):
            out.append({k: row[k] for k in [*keys, "_blk"]} | dict(zip(
                ("_in_adx", "_in_upper", "_in_lower", "_in_trend"), [None] * 4 if state is None else state, strict=True)))
            if state is None:
                state = [float(x) for x in row["_state"]]
                continue
            adx = float(row["_state"][0]) + (1 - 1 / p.adx) ** int(row["_rows"]) * state[0]
            upper, rose = BandFunction.apply(row["_up"], state[1])
            lower, fell = BandFunction.apply(row["_down"], -state[2])
            trend = state[3] if max(rose, fell) < 0 else 1.0 if rose >= fell else -1.0
            state = [adx, upper, -lower, trend]
        return pd.DataFrame(out)

    maps = rows.groupBy(*keys, "_blk").applyInPandas(
        bands_summed_up, StructType([*block_schema.fields]).add("_rows", "long").add("_state", ArrayType(DoubleType()))
        .add("_up", "string").add("_down", "string"))
    entering = StructType([*block_schema.fields])
    for c in ("adx", "upper", "lower", "trend"):
        entering = entering.add(f"_in_{c}", "double")
    rows = rows.join(cut_lineage(maps.groupBy(*keys).applyInPandas(bands_scan, entering)), [*keys, "_blk"])

    # Every block from its true state.
    def finished(part: pd.DataFrame) -> pd.DataFrame:
        part = ordered(part)
        state = _entry(part, [*MEANS, "adx", "upper", "lower", "trend"])
        means = _means(part, p, state)
        close, before = part["close"].to_numpy(float), float(part["_close"].iloc[0])
        plus, minus, index = _directions(means)
        basic_up, basic_down = _basic(part, means, p)
        held = state or dict.fromkeys(("adx", "upper", "lower", "trend"))
        upper = run_bands(basic_up, close, before, held["upper"])
        lower = -run_bands(-basic_down, -close, -before, None if state is None else -held["lower"])
        trend = run_trend(upper, lower, close, held["trend"])
        moved = means["gain"] + means["loss"]
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(moved > 0, 100 * means["gain"] / moved, np.where(np.isnan(moved), np.nan, 50.0))
        macd = means["fast"] - means["slow"]
        out = part[[*keys, ts]].copy()
        values = [rsi, macd, means["signal"], macd - means["signal"], plus, minus, smoothed(index, p.adx, held["adx"], warm=p.adx),
                  means["range"], upper, lower, trend, np.where(trend > 0, lower, upper)]
        for name, column in zip(INDICATORS, values, strict=True):
            out[name] = pd.Series(column).astype(object).where(~np.isnan(column), None)
        return out

    result = StructType([*key_fields, whole.schema[ts]])
    for name in INDICATORS:
        result = result.add(name, "double")
    return rows.groupBy(*keys, "_blk").applyInPandas(finished, result)

