"""Regime labels: a value's rank in its trailing window, and labels that change only past a margin."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tickloom.operators.blocks import SeriesBlocks, block_seconds_for, time_block, with_position
from tickloom.session import cut_lineage

#: Rows of a window that are compared at a time.
COMPARED = 1 << 22


@dataclass(frozen=True)
class Regime:
    """Three labels by two limits: a value above `high` + `margin` is the last label, below `low` - `margin` the
    first; a label is left for the middle one only once the value is `margin` inside of its limit."""

    labels: tuple[str, str, str]
    low: float = 1 / 3
    high: float = 2 / 3
    margin: float = 0.05

    def __post_init__(self):
        if not self.low + self.margin <= self.high - self.margin:
            raise ValueError("the margins of the two limits must not overlap")

    def steps(self, value: np.ndarray) -> np.ndarray:
        """For every row where each of the labels 0, 1, 2 leads to; a missing value (NaN) changes nothing."""
        out = np.tile(np.arange(3), (len(value), 1))
        with np.errstate(invalid="ignore"):
            out[:, 0] = np.where(value >= self.low + self.margin, 1, 0)
            out[:, 2] = np.where(value <= self.high - self.margin, 1, 2)
            out[value >= self.high + self.margin] = 2
            out[value <= self.low - self.margin] = 0
        return out


VOLATILITY = Regime(("low", "medium", "high"))
LIQUIDITY = Regime(("thin", "normal", "deep"))
TREND = Regime(("downtrend", "range", "uptrend"), -0.02, 0.02, 0.01)


def trailing_rank(values: np.ndarray, home: np.ndarray, n: int, least: int) -> np.ndarray:
    """Share of the last `n` values (the own one included) that are not above the own one, for the rows `home`.

    Missing values do not count; NaN where the own one is missing or fewer than `least` are there.
    """
    padded = np.append(np.full(n - 1, np.nan), values)
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)
    out = np.full(len(home), np.nan)
    for at in range(0, len(home), max(1, COMPARED // n)):
        rows = home[at:at + max(1, COMPARED // n)]
        own = windows[rows]
        there = (~np.isnan(own)).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = (own <= values[rows, None]).sum(axis=1) / there
        out[at:at + len(rows)] = np.where((there >= least) & ~np.isnan(values[rows]), share, np.nan)
    return out


def trailing_ranks(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], n: int = 168, least: int = 24,
                   block_rows: int = 65_536) -> DataFrame:
    """Adds `<value>_rank` in 0..1: exact rolling ranks of every series, in row blocks that know the n - 1 rows before.

    `ts` is unique within a series; keys and `ts` are not NULL. A NULL or NaN value has no rank and counts in none.
    """
    s = SeriesBlocks(tuple(keys), (ts,), time_block(ts, block_seconds_for(df, keys, ts)), back=n - 1,
                     block_rows=max(block_rows, -(-n // 256) * 256))
    opened = s.open(df).drop("_sub")

    def ranked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        home = np.flatnonzero(part["_home"].to_numpy() == part["_blk"].to_numpy())
        out = part.iloc[home].drop(columns=["_home", "_blk"])
        for c in values:
            rank = trailing_rank(part[c].astype(float).to_numpy(), home, n, least)
            out[f"{c}_rank"] = pd.Series(rank, index=out.index).astype(object).where(~np.isnan(rank), None)
        return out

    schema = StructType([f for f in opened.schema.fields if f.name not in ("_home", "_blk")])
    for c in values:
        schema = schema.add(f"{c}_rank", "double")
    return opened.groupBy(*keys, "_blk").applyInPandas(ranked, schema).drop("pos", "n_rows")


def with_regimes(df: DataFrame, keys: Sequence[str], ts: str, regimes: dict[str, tuple[str, Regime]], start: int = 1,
                 block_rows: int = 65_536) -> DataFrame:
    """Adds a label column per entry name -> (value column, regime); every series begins with the label `start`.

    A row's value takes each of the three labels to one: a function of three places. Those of a block are
    applied one after the other without knowing the label that enters, the functions of a series' blocks
    give every block its entering label, and then its rows are labelled; so series of any length are
    spread over their blocks. `ts` is unique within a series; a missing value keeps the label.
    """
    keys, names = list(keys), list(regimes)
    placed = with_position(df, keys, [ts], time_block(ts, block_seconds_for(df, keys, ts))).drop("n_rows")
    rows = cut_lineage(placed.withColumn("_blk", F.floor(F.col("pos") / F.lit(block_rows)).cast("long")))
    key_fields = [f for f in rows.schema.fields if f.name in keys]

    def steps(part: pd.DataFrame, name: str) -> list:
        column, regime = regimes[name]
        return regime.steps(part[column].astype(float).to_numpy()).tolist()

    def summed_up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        out = {k: part[k].iloc[0] for k in [*keys, "_blk"]}
        for name in names:
            whole = [0, 1, 2]
            for step in steps(part, name):
                whole = [step[x] for x in whole]
            out[f"_{name}"] = whole
        return pd.DataFrame([out])

    def scanned(part: pd.DataFrame) -> pd.DataFrame:
        state, out = dict.fromkeys(names, start), []
        for row in part.sort_values("_blk").to_dict("records"):
            out.append({k: row[k] for k in [*keys, "_blk"]} | {f"_in_{n}": state[n] for n in names})
            state = {n: int(row[f"_{n}"][state[n]]) for n in names}
        return pd.DataFrame(out)

    def labelled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        for name in names:
            state, labels = int(part[f"_in_{name}"].iloc[0]), []
            for step in steps(part, name):
                state = step[state]
                labels.append(regimes[name][1].labels[state])
            part[name] = labels
        return part[[f.name for f in result.fields]]

    blocks = StructType([*key_fields]).add("_blk", "long")
    function, entering = StructType([*blocks.fields]), StructType([*blocks.fields])
    for name in names:
        function, entering = function.add(f"_{name}", ArrayType(IntegerType())), entering.add(f"_in_{name}", "integer")
    result = StructType([f for f in rows.schema.fields if f.name not in ("pos", "_blk")])
    for name in names:
        result = result.add(name, "string")
    entries = cut_lineage(rows.groupBy(*keys, "_blk").applyInPandas(summed_up, function)).groupBy(*keys).applyInPandas(scanned, entering)
    return rows.join(entries, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(labelled, result)
