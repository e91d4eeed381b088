"""Numeric column functions. All stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str, default: float = 0.0) -> Column:
    """Numeric coercion: text that is not a number, NaN and NULL become `default`."""
    x = as_column(value).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def clamp(value: Column, low: float, high: float) -> Column:
    """Bound a value. NULL stays NULL (`least`/`greatest` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """x / NULLIF(y, 0)."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def eps_divide(numerator: Column | str, denominator: Column | str, eps: float = 1e-6) -> Column:
    """x / (y + eps), defined at y = 0."""
    return as_column(numerator) / (as_column(denominator) + F.lit(eps))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a / b) in doubles; NULL when the ratio is not positive."""
    ratio = F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))
    return F.when(ratio > 0, F.log(ratio))


def zscore(value: Column | str, mean: Column | str, std: Column | str, eps: float = 1e-6) -> Column:
    return (as_column(value) - as_column(mean)) / (as_column(std) + F.lit(eps))


def logistic(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(z)))


def two_class_softmax(z: Column | str, low: float = 0.001, high: float = 0.999) -> Column:
    """Probability of the second class for logits (0, z), kept off 0 and 1."""
    return clamp(logistic(z), low, high)


def normalise(value: Column | str, ceiling: float) -> Column:
    """0 for NULL or non-positive values, else min(1, v / ceiling)."""
    v = as_column(value)
    return F.when(v > 0, F.least(F.lit(1.0), v / F.lit(float(ceiling)))).otherwise(F.lit(0.0))


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounding for published numbers; adding 0.0 turns -0.0 into 0.0."""
    return F.round(as_column(value), digits) + F.lit(0.0)


def fixed_text(value: Column | str, digits: int = 3) -> Column:
    """`1234.500`-style text without thousands separators, '-' when not finite."""
    x = as_column(value).try_cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.format_string(f"%.{digits}f", x)).otherwise(F.lit("-"))


def percent_text(value: Column | str, digits: int = 1) -> Column:
    x = as_column(value).try_cast("double")
    text = fixed_text(x * 100, digits)
    return F.when(text == "-", text).otherwise(F.concat(text, F.lit("%")))


def exponent_text(value: Column | str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}e", as_column(value).cast("double"))


def satoshi_to_coin(value: Column | str) -> Column:
    return as_column(value).cast("double") / F.lit(1e8)


def token_units(value: Column | str, decimals: Column | str) -> Column:
    """On-chain integer amount to token units: value / 10^decimals."""
    return as_column(value).try_cast("double") / F.pow(F.lit(10.0), as_column(decimals).try_cast("int"))
