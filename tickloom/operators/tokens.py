"""Token radar: latest state, filters, ranking, gainers, liquidity risk, enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scores
from tickloom.functions.math import number, safe_divide
from tickloom.functions.times import seconds_interval
from tickloom.operators.blocks import SeriesBlocks, block_seconds_for, time_block


def token_live(metrics: DataFrame, as_of: Column, short_seconds: int = 300, long_seconds: int = 3600,
               tie: str = "metric_id") -> DataFrame:
    """Latest state per token: price, trailing totals, price change, age; rows of one time go by `tie`.

    One grouped aggregation of combinable aggregates: a hot token is reduced on
    the map side and never gathered in one task.
    """
    at = F.col("metric_time")
    now = as_of.cast("timestamp")
    is_buy = F.col("side") == "BUY"
    short, long = at >= now - seconds_interval(short_seconds), at >= now - seconds_interval(long_seconds)
    place = F.when(at.isNotNull(), F.struct(at, F.col(tie)))
    old = F.max_by("price", F.when(at <= now - seconds_interval(long_seconds), place))
    latest = F.max_by("price", place)
    return metrics.groupBy("token_id").agg(
        latest.alias("price"),
        F.max_by("liquidity", place).alias("marketcap"),
        F.coalesce(F.sum(F.when(short, F.col("volume"))), F.lit(0.0)).alias("volume_5m"),
        F.count_if(is_buy & short).alias("buys_5m"),
        F.count_if(~is_buy & short).alias("sells_5m"),
        F.count_if(is_buy & long).alias("buys_1h"),
        F.count_if(~is_buy & long).alias("sells_1h"),
        (safe_divide(latest, old) - 1.0).alias("price_change_1h"),
        F.max_by("pump_probability", place).alias("pump_probability"),
        ((F.unix_micros(F.max(now)) - F.unix_micros(F.min(at))) / 1e6).alias("age_seconds"),
        F.max(at).alias("updated_at"),
    )


def gainers(metrics: DataFrame, tokens: DataFrame, steps: int = 3, limit: int = 30, block_seconds: int | None = None,
            block_rows: int = 65536) -> DataFrame:
    """Largest relative price rise over `steps` rows of a token, over all history rows.

    The lag runs per row block, so a token with a third of all rows is spread
    over many tasks. No more than `limit` rows of one token can be among the
    first `limit` of all, so each token keeps its best rows only (a group limit
    that acts before the shuffle) and the dimension join sees few rows.
    """
    seconds = block_seconds or block_seconds_for(metrics, ["token_id"], "metric_time")
    s = SeriesBlocks(("token_id",), ("metric_time", "metric_id"), time_block("metric_time", seconds),
                     back=steps, block_rows=block_rows)
    df = s.open(metrics.select("token_id", "metric_time", "metric_id", "price"))
    df = s.close(df.withColumn("price_before", F.lag("price", steps).over(s.row_window())))
    gain = F.try_divide(F.col("price") - F.col("price_before"), F.col("price_before"))
    best = Window.partitionBy("token_id").orderBy(F.desc_nulls_first("pct_gain"), "metric_id")
    return (
        df.where(F.col("price_before").isNotNull())
        .withColumn("pct_gain", gain)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= limit)
        .join(tokens, "token_id")
        .select("token_id", "mint", "symbol", "metric_id", "price", "price_before", "pct_gain")
        .orderBy(F.desc_nulls_first("pct_gain"), "token_id", "metric_id")
        .limit(limit)
    )


def liquidity_risk(metrics: DataFrame, tokens: DataFrame, min_samples: int = 10, limit: int = 50) -> DataFrame:
    """Coefficient of variation of liquidity; more than `min_samples` rows needed.

    Aggregated before the join, so the join sees one row per token.
    """
    agg = (
        metrics.where(F.col("liquidity").isNotNull())
        .groupBy("token_id")
        .agg(safe_divide(F.stddev_samp("liquidity"), F.avg("liquidity")).alias("risk_score"),
             F.count(F.lit(1)).alias("samples"))
        .where(F.col("samples") > min_samples)
    )
    return (
        agg.join(tokens, "token_id")
        .select("token_id", "mint", "symbol", "risk_score", "samples")
        .orderBy(F.desc_nulls_first("risk_score"), "token_id")
        .limit(limit)
    )


def radar(live: DataFrame, min_probability=0.0, min_marketcap=0.0, min_buys=0, min_change=0.0) -> DataFrame:
    """Threshold filter that rejects NULLs; probability then market cap, NULLs last."""
    kept = live.where(
        (F.col("pump_probability") >= min_probability) & (F.col("marketcap") >= min_marketcap)
        & (F.col("buys_1h") >= min_buys) & (F.col("price_change_1h") >= min_change))
    return ranked(kept, ["pump_probability", "marketcap"])


def ranked(df: DataFrame, columns: Sequence[str], tie: str = "token_id", limit: int | None = None,
           nulls: str = "last") -> DataFrame:
    """Descending order with an explicit NULL place and a unique tie-break."""
    desc = F.desc_nulls_last if nulls == "last" else F.desc_nulls_first
    out = df.orderBy(*[desc(c) for c in columns], F.asc(tie))
    return out if limit is None else out.limit(limit)


def radar_null_safe(live: DataFrame, min_probability: float, min_marketcap: float, min_buys: float,
                    min_change_pct: float) -> DataFrame:
    """As `radar`, NULL counts as 0 and the change threshold is in percent."""
    return live.where(
        (number("pump_probability") >= min_probability) & (number("marketcap") >= min_marketcap)
        & (number("buys_1h") >= min_buys) & (number("price_change_1h") * 100.0 >= min_change_pct))


def first_present(df: DataFrame, *names: str) -> Column:
    """First non-NULL of the columns that exist (column-name variants of feeds)."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None)


def dashboard(live: DataFrame, min_marketcap=0.0, min_buys=0.0, min_change_pct=0.0, max_age_days=0.0,
              scored_only=False, percent_above: float | None = 2.0) -> DataFrame:
    """Normalised token rows: numeric coercion, name variants, one percent unit, age.

    A change above `percent_above` is taken as percent, otherwise as a fraction;
    None reads every value as a fraction. `max_age_days=0` switches the age limit off.
    """
    change = number(first_present(live, "price_change_1h"))
    pct = change * 100.0 if percent_above is None else F.when(change > percent_above, change).otherwise(change * 100.0)
    seconds = number(first_present(live, "age_seconds"))
    minutes = F.when(seconds > 0, seconds / 60.0).otherwise(number(first_present(live, "age_minutes", "age_min")))
    df = live.select(
        "token_id",
        number("price").alias("price"),
        number("marketcap").alias("marketcap"),
        number("volume_5m").alias("volume_5m"),
        number("buys_5m").alias("buys_5m"),
        number("sells_5m").alias("sells_5m"),
        number(first_present(live, "buys_1h", "buys1h")).alias("buys_1h"),
        F.col("pump_probability").cast("double").alias("pump_probability"),
        pct.alias("change_pct"),
        minutes.alias("age_minutes"),
        (minutes / 60.0 / 24.0).alias("age_days"),
    )
    keep = (F.col("marketcap") >= min_marketcap) & (F.col("buys_1h") >= min_buys) & (F.col("change_pct") >= min_change_pct)
    if max_age_days > 0:
        keep = keep & (F.col("age_days") <= max_age_days)
    if scored_only:
        keep = keep & (F.coalesce("pump_probability", F.lit(0.0)) > 0)
    return df.where(keep)


def dashboard_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc(F.coalesce("pump_probability", F.lit(0.0))), F.desc("marketcap"), F.desc("volume_5m"), "token_id")


def top_trending(normalised: DataFrame, limit: int = 20) -> DataFrame:
    """Trend score over dashboard rows (change already in percent)."""
    score = scores.trend_score("pump_probability", F.col("change_pct") / 100.0, "buys_5m", "sells_5m", "volume_5m")
    return normalised.withColumn("trend_score", score).orderBy(F.desc("trend_score"), "token_id").limit(limit)


def token_trends(live: DataFrame, limit: int = 200) -> DataFrame:
    """Trend table of a live view (built with a 6-hour long window), best scores first."""
    score = scores.trend_score("pump_probability", "price_change_1h", "buys_5m", "sells_5m", "volume_5m")
    return live.withColumn("score", score).orderBy(F.desc_nulls_first("score"), "token_id").limit(limit)


def alerts(live: DataFrame, rule: scores.AlertRule = scores.AlertRule(), stamp: Column | None = None) -> DataFrame:
    """Alert rows: rule filter, NULL as 0, projection; `stamp` adds a processing time."""
    names = [c for c in ("mint", "symbol", "name") if c in live.columns]
    out = live.where(scores.meets_alert_rule(rule)).select(
        "token_id", *names,
        F.col("price").cast("double").alias("price"),
        number("marketcap").alias("marketcap"),
        number("buys_5m").alias("buys_5m"),
        number("volume_5m").alias("volume_5m"),
        number("price_change_1h").alias("price_change_1h"),
        number("pump_probability").alias("pump_probability"),
        "updated_at",
    )
    return out if stamp is None else out.withColumn("alerted_at", stamp)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by `order`, ties settled by the remaining columns.

    `max(struct)` combines on the map side, so copies of a hot key collapse
    before the shuffle; a `row_number` window would move them all.
    """
    return _extreme_per_key(df, keys, order, F.max)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _extreme_per_key(df, keys, order, F.min)


def _extreme_per_key(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def merge_feeds(feeds: Sequence[DataFrame], key: str = "symbol") -> DataFrame:
    """Merge feeds by key; a later feed overrides field by field.

    A feed that has a column overrides with its value (its 0 defaults count);
    columns a feed lacks keep the earlier value. Empty keys are dropped.
    """
    columns = list(dict.fromkeys(c for f in feeds for c in f.columns if c != key))
    tagged = [
        f.withColumns({"_rank": F.lit(i), "_has": F.array(*[F.lit(c) for c in f.columns])})
        for i, f in enumerate(feeds)
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    merged = union.groupBy(key).agg(*[
        F.max_by(c, F.when(F.array_contains("_has", c), F.col("_rank"))).alias(c) for c in columns
    ])
    return merged.where(F.length(key) > 0)


def lookup_first(symbols: DataFrame, feed: DataFrame, fields: dict[str, float | None], key: str = "symbol",
                 order: Sequence[str] = ()) -> DataFrame:
    """Left lookup of the first feed row per key, with defaults."""
    first = earliest_per_key(feed, [key], list(order) or [c for c in feed.columns if c != key])
    joined = symbols.join(first.select(key, *fields), key, "left")
    return joined.select(*symbols.columns, *[F.coalesce(F.col(f), F.lit(d)).alias(f) if d is not None else F.col(f)
                                             for f, d in fields.items()])


def enrich_tokens(trending: DataFrame, market: DataFrame, social: DataFrame, known: DataFrame) -> DataFrame:
    """Trending tokens with market data (inner), sentiment (default 0.5) and existence score.

    All three lookups hold one row per symbol.
    """
    exists = known.select("symbol").distinct().withColumn("_known", F.lit(True))
    return (
        trending.join(market, "symbol")
        .join(social, "symbol", "left")
        .join(exists, "symbol", "left")
        .withColumns({
            "social_score": F.coalesce("social_score", F.lit(0.5)),
            "bitquery_score": scores.existence_score("_known"),
            "recency": scores.recency("age_seconds"),
            "velocity": scores.trade_imbalance("buys_5m", "sells_5m"),
        })
        .drop("_known")
    )


def token_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "marketcap_score": scores.marketcap_score("marketcap"),
        "liquidity_score": scores.liquidity_score("liquidityusd"),
        "volume_score": scores.volume_score("volumeusd"),
        "holders_score": scores.holders_score("holders"),
        "trade_count_score": scores.trade_count_score("tradecount"),
        "turnover_score": scores.turnover_score("volumeusd", "liquidityusd"),
    })


def token_signals(scored: DataFrame, alpha: str = "alpha", t: scores.TokenThresholds = scores.TokenThresholds()) -> DataFrame:
    """Direction and confidence from alpha; HOLD and weak signals are dropped."""
    a = scores.finite_or(alpha, 0.5)
    return (
        scored.withColumn(alpha, a)
        .withColumn("direction", scores.token_direction(alpha, t))
        .withColumn("confidence", F.least(F.lit(1.0), F.abs(F.col(alpha) - 0.5) * 2.0))
        .where((F.col("direction") != "HOLD") & (F.col("confidence") >= t.min_confidence))
    )


def confident_signals(signals: DataFrame, min_confidence: float = 0.0, limit: int = 200, tie: str = "symbol") -> DataFrame:
    """Newest signals; a NULL confidence is kept."""
    keep = F.col("confidence").isNull() | (F.col("confidence") >= min_confidence)
    return signals.where(keep).orderBy(F.desc_nulls_last("created_at"), F.asc(tie)).limit(limit)
