"""Time column functions (session time zone is UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.math import as_column


def hour_bucket(ts: Column | str) -> Column:
    return F.date_trunc("hour", as_column(ts))


def cyclic_time(ts: Column | str) -> dict[str, Column]:
    """sin/cos of the hour of day and of the weekday (Monday = 0)."""
    hour = F.hour(as_column(ts)).cast("double")
    day = F.weekday(as_column(ts)).cast("double")
    hour_angle = hour * F.lit(2 * math.pi / 24)
    day_angle = day * F.lit(2 * math.pi / 7)
    return {
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "dow_sin": F.sin(day_angle),
        "dow_cos": F.cos(day_angle),
    }


def interval_seconds(code: Column | str, default: int = 900) -> Column:
    """`15m`, `4h`, `1d` to seconds; any other unit gives the default."""
    c = as_column(code)
    count = F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("long")
    unit = F.right(c, F.lit(1))
    return (
        F.when(unit == "m", count * 60)
        .when(unit == "h", count * 3600)
        .when(unit == "d", count * 86400)
        .otherwise(F.lit(default).cast("long"))
    )


def interval_minutes(code: Column | str, default: int = 15) -> Column:
    return (interval_seconds(code, default * 60) / 60).cast("int")


def millis_to_timestamp(ms: Column | str) -> Column:
    return F.timestamp_millis(as_column(ms).try_cast("long"))


def timestamp_to_millis(ts: Column | str) -> Column:
    return F.unix_millis(as_column(ts).cast("timestamp"))


def iso_text(ts: Column | str) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def seconds_interval(seconds: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
