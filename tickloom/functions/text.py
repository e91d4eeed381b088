"""Text column functions: sentiment, symbols, identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.math import as_column, clamp

# The default sentiment lexicon.
POSITIVE_WORDS = (
    "bullish", "moon", "pump", "uptrend", "accumulate", "buy", "long", "strong",
    "breakout", "green", "ath",
)
NEGATIVE_WORDS = (
    "bearish", "dump", "crash", "sell", "liquidation", "short", "rekt", "panic",
    "rug", "down",
)


def text_sentiment(
    text: Column | str,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """Lexicon score in 0..1: each contained word counts once, sum kept in -5..5.

    Matching is by substring on the whole lower-cased text; NULL and empty text
    are neutral (0.5).
    """
    lower = F.lower(as_column(text))
    hits = [F.contains(lower, F.lit(w)).cast("int") for w in positive]
    hits += [-F.contains(lower, F.lit(w)).cast("int") for w in negative]
    score = reduce(lambda a, b: a + b, hits, F.lit(0))
    bounded = (clamp(score, -5, 5).cast("double") + 5.0) / 10.0
    return F.when(F.coalesce(F.length(lower), F.lit(0)) == 0, F.lit(0.5)).otherwise(bounded)


def dashed_product(symbol: Column | str) -> Column:
    """`ABCUSDT` -> `ABC-USDT`, `ABCUSD` -> `ABC-USD`, others unchanged."""
    return F.regexp_replace(as_column(symbol), r"^(.*?)(USDT|USD)$", "$1-$2")


def base_asset(symbol: Column | str) -> Column:
    s = as_column(symbol)
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - 4, F.lit(0)))


def quote_asset(symbol: Column | str) -> Column:
    return F.right(as_column(symbol), F.lit(4))


def short_id(value: Column | str, head: int = 4, tail: int = 4) -> Column:
    """`abcd…wxyz` form of a long identifier."""
    v = as_column(value)
    return F.concat(F.substring(v, 1, head), F.lit("…"), F.right(v, F.lit(tail)))


def same_symbol(a: Column | str, b: Column | str) -> Column:
    return F.upper(as_column(a)) == F.upper(as_column(b))


def first_text(*values: Column | str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(as_column(v), F.lit("")) for v in values])
