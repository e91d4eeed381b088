"""Published table schemas, drift checks and domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "market_candles": """exchange string, symbol string, interval_code string, open_time timestamp, close_time timestamp,
        open double, high double, low double, close double, volume double, quote_volume double, trades_count int,
        taker_buy_base_volume double, taker_buy_quote_volume double, is_closed boolean""",
    "market_candles_exact": """exchange string, symbol string, interval_code string, open_time timestamp,
        close_time timestamp, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8),
        volume decimal(30,10), quote_volume decimal(30,10), trades_count int, taker_buy_base_volume decimal(30,10),
        taker_buy_quote_volume decimal(30,10), is_closed boolean, created_at timestamp""",
    "pair_spread": "exchange string, pair string, ts timestamp, spread_log double, leg1_volume double, leg2_volume double",
    "futures_transactions": """symbol string, tx_time timestamp, side string, price double, quantity double,
        notional_usd double, success_rate double""",
    "wallet_activity": "tx_time timestamp, notional_usd double",
    "followed_wallets": "id long, chain string, address string, label string, is_active boolean, created_at timestamp",
    "whale_transfers": """chain string, wallet_from string, wallet_to string, asset string, amount_usd double,
        direction string, exchange_target string, tx_hash string, ts timestamp, raw string""",
    "token_transfers": """token string, wallet_from string, wallet_to string, amount double, amount_usd double,
        ts timestamp, tx_hash string, raw string""",
    "tokens": "token_id long, mint string, symbol string, name string",
    "token_metrics": "token_id long, metric_time timestamp, price double, liquidity double",
    "token_history": "mint string, timestamp timestamp, price double, pump_probability double",
    "token_live": """token_id long, mint string, symbol string, name string, price double, marketcap double,
        volume_5m double, buys_5m int, sells_5m int, buys_1h int, sells_1h int, price_change_1h double,
        pump_probability double, age_seconds double, updated_at timestamp""",
    "token_signals": """symbol string, trend_score double, social_score double, momentum double, alpha double,
        direction string, confidence double, marketcap double, liquidityusd double, volumeusd double, holders int,
        tradecount int, age_seconds double, buys_5m int, sells_5m int, buys_vs_sells_ratio double, pumpfun_score double,
        dex_score double, bitquery_score double, model_version_id int, created_at timestamp""",
    "signals": """symbol string, timeframe string, model_name string, direction string, confidence double,
        entry_price double, stop_loss double, take_profit double, created_at timestamp""",
    "assets": "id long, symbol string, name string, base_asset string, quote_asset string, is_active boolean, created_at timestamp",
    "timeframes": "code string, granularity_minutes int, label string",
    "model_versions": "name string, version_tag string, trained_on_rows long, notes string, features string, created_at timestamp",
    "portfolios": "id long, owner string, name string, base_currency string, created_at timestamp",
    "portfolio_positions": "portfolio_id long, asset_id long, symbol string, quantity double, avg_entry_price double",
    "asset_ohlcv": """asset_id long, symbol string, source string, timeframe string, ts timestamp, open double,
        high double, low double, close double, volume double""",
    "portfolio_quant_metrics": """portfolio_id long, snapshot_ts timestamp, period_days int, total_return double,
        annualized_return double, volatility double, sharpe_ratio double, sortino_ratio double, max_drawdown double,
        var_95 double, concentration_index double, num_assets int""",
    "training_rows": """alpha_target double, recency double, social_score double, marketCap double, liquidityUSD double,
        volumeUSD double, holders double, tradeCount double, velocity double""",
}

# Natural keys of the tables that are written by key.
KEYS = {
    "market_candles": ["exchange", "symbol", "interval_code", "open_time"],
    "pair_spread": ["exchange", "pair", "ts"],
    "followed_wallets": ["chain", "address"],
    "assets": ["symbol"],
    "timeframes": ["code"],
    "model_versions": ["name", "version_tag"],
    "asset_ohlcv": ["symbol", "source", "timeframe", "ts"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def drift(df: DataFrame, name: str) -> list[str]:
    """Differences to the contract: missing, extra and retyped columns."""
    want = {f.name: f.dataType.simpleString() for f in schema(name)}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [f"missing {c}" for c in want if c not in have]
    out += [f"extra {c}" for c in have if c not in want]
    out += [f"{c}: {have[c]} instead of {want[c]}" for c in want if c in have and have[c] != want[c]]
    return out


def check(df: DataFrame, name: str) -> DataFrame:
    """The frame itself, or an error naming the drift; stored data is never dropped."""
    found = drift(df, name)
    if found:
        raise ValueError(f"{name}: " + "; ".join(found))
    return df


def align(df: DataFrame, name: str) -> DataFrame:
    """Contract columns in order; fields the frame lacks become NULL."""
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema(name)])


def signal_is_valid() -> Column:
    """Direction in its domain and confidence NULL or within 0..1."""
    confidence = F.col("confidence")
    return F.col("direction").isin("BUY", "SELL", "HOLD") & (confidence.isNull() | confidence.between(0, 1))


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of a domain rule; NULL outcomes are quarantined."""
    ok = F.coalesce(rule, F.lit(False))
    return df.where(ok), df.where(~ok)
