"""Signal and token scoring as column expressions; every threshold is a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.math import as_column, clamp, normalise, number


# Default weights and thresholds of the signal rules.
@dataclass(frozen=True)
class AlphaWeights:
    momentum: float = 0.4
    sentiment: float = 0.4
    on_chain: float = 0.2


@dataclass(frozen=True)
class DirectionThresholds:
    buy: float = 0.6
    hold: float = 0.45


@dataclass(frozen=True)
class TokenThresholds:
    buy: float = 0.65
    sell: float = 0.35
    min_confidence: float = 0.6


@dataclass(frozen=True)
class AlertRule:
    """(buys OR change OR probability) AND market cap AND volume; all >=."""

    min_buys: float = 20
    min_change: float = 5
    min_probability: float = 0.6
    min_marketcap: float = 3000
    min_volume: float = 50


@dataclass(frozen=True)
class LevelRule:
    stop_ranges: float = 1.5
    target_ranges: float = 3.0
    flat_share: float = 0.005
    digits: int = 2


@dataclass(frozen=True)
class ChangeRule:
    threshold: float = 0.002
    confidence_scale: float = 200.0
    band: float = 0.02


@dataclass(frozen=True)
class SignalConfig:
    weights: AlphaWeights = field(default_factory=AlphaWeights)
    directions: DirectionThresholds = field(default_factory=DirectionThresholds)
    levels: LevelRule = field(default_factory=LevelRule)
    lookback: int = 50
    cap: float = 0.1


def recency(age_seconds: Column | str) -> Column:
    return F.exp(-number(age_seconds) / F.lit(3600.0))


def trade_imbalance(buys: Column | str, sells: Column | str) -> Column:
    """(b - s) / (b + s), 0 when there are no trades."""
    b, s = number(buys), number(sells)
    return F.when(b + s == 0, F.lit(0.0)).otherwise((b - s) / (b + s))


def existence_score(key: Column | str) -> Column:
    return F.when(as_column(key).isNotNull(), F.lit(0.7)).otherwise(F.lit(0.1))


def alpha_blend(momentum: Column, sentiment: Column, on_chain: Column, w: AlphaWeights = AlphaWeights()) -> Column:
    blend = (
        F.lit(w.momentum) * ((momentum + F.lit(1.0)) / F.lit(2.0))
        + F.lit(w.sentiment) * sentiment
        + F.lit(w.on_chain) * on_chain
    )
    return clamp(blend, 0.0, 1.0)


def alpha_direction(alpha: Column | str, t: DirectionThresholds = DirectionThresholds()) -> Column:
    a = as_column(alpha)
    return F.when(a >= t.buy, "BUY").when(a > t.hold, "HOLD").otherwise("SELL")


def alpha_confidence(alpha: Column | str) -> Column:
    return clamp(F.abs(as_column(alpha) - 0.5) * 2.0, 0.0, 1.0)


def finite_or(value: Column | str, default: float) -> Column:
    v = as_column(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(v)


def token_direction(alpha: Column | str, t: TokenThresholds = TokenThresholds()) -> Column:
    a = finite_or(alpha, 0.5)
    return F.when(a >= t.buy, "BUY").when(a <= t.sell, "SELL").otherwise("HOLD")


def price_levels(direction: Column, entry: Column, high: Column, low: Column, r: LevelRule = LevelRule()) -> dict[str, Column]:
    """Stop and target around the entry from the last candle's range."""
    span = F.when(high - low != 0, high - low).otherwise(entry * r.flat_share)
    side = F.when(direction == "BUY", F.lit(1.0)).otherwise(F.lit(-1.0))
    return {
        "entry_price": F.round(entry, r.digits),
        "stop_loss": F.round(entry - side * r.stop_ranges * span, r.digits),
        "take_profit": F.round(entry + side * r.target_ranges * span, r.digits),
    }


def change_direction(change: Column, r: ChangeRule = ChangeRule()) -> Column:
    return F.when(change > r.threshold, "BUY").when(change < -r.threshold, "SELL").otherwise("HOLD")


def change_levels(direction: Column, entry: Column, r: ChangeRule = ChangeRule()) -> dict[str, Column]:
    down, up = entry * F.lit(1 - r.band), entry * F.lit(1 + r.band)
    is_buy = direction == "BUY"
    return {
        "stop_loss": F.when(is_buy, down).otherwise(up),
        "take_profit": F.when(is_buy, up).otherwise(down),
    }


def marketcap_score(v: Column | str) -> Column:
    return F.lit(1.0) - normalise(v, 2_000_000)


def liquidity_score(v: Column | str) -> Column:
    x = number(v)
    return F.when(x <= 5000, F.lit(0.1)).when(x <= 15000, F.lit(0.4)).otherwise(normalise(x, 50_000))


def volume_score(v: Column | str) -> Column:
    return normalise(v, 500_000)


def holders_score(v: Column | str) -> Column:
    return normalise(v, 2000)


def trade_count_score(v: Column | str) -> Column:
    return normalise(v, 20000)


def turnover_score(volume: Column | str, liquidity: Column | str) -> Column:
    ratio = F.try_divide(as_column(volume), as_column(liquidity))
    return F.when(as_column(liquidity) == 0, F.lit(0.0)).otherwise(normalise(ratio, 50))


def trend_score(probability: Column | str, change: Column | str, buys: Column | str, sells: Column | str, volume: Column | str) -> Column:
    """100 p + 0.5 change% + 0.5 (buys - sells) + volume / 1000; `change` is a fraction."""
    return (
        number(probability) * 100.0
        + number(change) * 100.0 * 0.5
        + (number(buys) - number(sells)) * 0.5
        + number(volume) / 1000.0
    )


def change_label(change: Column | str, threshold: float = 0.05) -> Column:
    c = as_column(change)
    return F.when(c > threshold, "BUY").when(c < -threshold, "SELL").otherwise("")


def meets_alert_rule(r: AlertRule = AlertRule(), buys="buys_5m", change="price_change_1h",
                     probability="pump_probability", marketcap="marketcap", volume="volume_5m") -> Column:
    triggered = (
        (number(buys) >= r.min_buys)
        | (number(change) >= r.min_change)
        | (number(probability) >= r.min_probability)
    )
    return triggered & (number(marketcap) >= r.min_marketcap) & (number(volume) >= r.min_volume)


def decode_direction(p_up: Column | str, cut: float = 0.55) -> Column:
    p = as_column(p_up)
    return F.when(p > cut, "up").when(F.lit(1.0) - p > cut, "down").otherwise("neutral")


def heuristic_probability(mu: Column, sigma: Column) -> Column:
    """0.5 + mu / (4 sigma), the shift kept in +-0.4; tiny sigmas are replaced by 1e-3."""
    s = F.when(sigma > 1e-8, sigma).otherwise(F.lit(1e-3))
    return clamp(mu / (F.lit(4.0) * s), -0.4, 0.4) + 0.5
