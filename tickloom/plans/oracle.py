"""DuckDB text of the derived market tables, composed as CTEs."""

from __future__ import annotations

def live_sql(long: str) -> str:
    """Latest state per token with a one-day short window and the given long window."""
    return f"""
        SELECT token_id, arg_max(price, metric_time) AS price,
               arg_max(liquidity, metric_time) AS marketcap,
               coalesce(sum(volume) FILTER (WHERE metric_time >= mx - INTERVAL 1 DAY), 0) AS volume_5m,
               count(*) FILTER (WHERE side = 'BUY' AND metric_time >= mx - INTERVAL 1 DAY) AS buys_5m,
               count(*) FILTER (WHERE side <> 'BUY' AND metric_time >= mx - INTERVAL 1 DAY) AS sells_5m,
               count(*) FILTER (WHERE side = 'BUY' AND metric_time >= mx - INTERVAL {long}) AS buys_1h,
               count(*) FILTER (WHERE side <> 'BUY' AND metric_time >= mx - INTERVAL {long}) AS sells_1h,
               arg_max(price, metric_time) / arg_max(price, metric_time)
                   FILTER (WHERE metric_time <= mx - INTERVAL {long}) - 1 AS price_change_1h,
               arg_max(pump_probability, metric_time) AS pump_probability,
               (epoch_us(max(mx)) - epoch_us(min(metric_time))) / 1e6 AS age_seconds,
               max(metric_time) AS updated_at
        FROM (SELECT *, max(metric_time) OVER () AS mx FROM token_metrics) GROUP BY token_id"""


VIEWS = {
    "trades": """
        SELECT event_id AS trade_id, upper(event_type) AS symbol, ts AS trade_time, value + 1.0 AS price,
               CAST(1 + user_id % 10 AS DOUBLE) AS quantity,
               (value + 1.0) * (1 + user_id % 10) * 100.0 AS notional_usd,
               CASE WHEN event_id % 2 = 1 THEN 'SELL' ELSE 'BUY' END AS side, user_id
        FROM events""",
    "candles": """
        SELECT 'synthetic' AS exchange, symbol, '1h' AS interval_code, date_trunc('hour', trade_time) AS open_time,
               arg_min(price, trade_time) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, trade_time) AS close, sum(quantity) AS volume, count(*) AS trades_count
        FROM trades GROUP BY symbol, date_trunc('hour', trade_time)""",
    "pair_spread": """
        SELECT a.exchange, 'CLICK/VIEW' AS pair, a.open_time AS ts, ln(a.close / b.close) AS spread_log,
               a.volume AS leg1_volume, b.volume AS leg2_volume
        FROM candles a JOIN candles b
          ON a.exchange = b.exchange AND a.interval_code = b.interval_code AND a.open_time = b.open_time
        WHERE a.symbol = 'CLICK' AND b.symbol = 'VIEW'""",
    "spread": """
        SELECT exchange, pair, ts, spread_log AS spread, leg1_volume, leg2_volume,
               row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n_rows,
               spread_log - coalesce(lag(spread_log) OVER (ORDER BY ts), spread_log) AS ret
        FROM pair_spread""",
    "wallet_activity": """
        SELECT trade_time AS tx_time, user_id AS wallet_id, notional_usd FROM trades WHERE symbol = 'PURCHASE'""",
    "token_metrics": """
        SELECT user_id AS token_id, event_id AS metric_id, ts AS metric_time, value + 1.0 AS price,
               (value + 1.0) * (1 + event_id % 7) * 1000.0 AS liquidity,
               CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, value AS volume,
               (event_id % 100) / 100.0 AS pump_probability
        FROM events""",
    "tokens": "SELECT c_custkey AS token_id, c_name AS mint, c_mktsegment AS symbol FROM customer",
    "token_live": live_sql("7 DAY"),
    "positions": """
        SELECT user_id % 20 AS portfolio_id, upper(event_type) AS symbol,
               CAST(sum(1 + user_id % 3) AS DOUBLE) AS quantity
        FROM events GROUP BY user_id % 20, upper(event_type)""",
    "daily_closes": """
        SELECT symbol, date_trunc('day', trade_time) AS ts, arg_max(price, trade_time) AS close
        FROM trades GROUP BY symbol, date_trunc('day', trade_time)""",
    "transfers": """
        SELECT o_orderkey AS tx_id, o_orderpriority AS chain, o_custkey AS wallet_from,
               o_totalprice AS amount_usd, o_orderdate AS ts FROM orders""",
    "messages": """
        SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 1.0 ELSE 2.0 END AS weight FROM conversations""",
}

NEEDS = {
    "candles": ["trades"],
    "pair_spread": ["candles"],
    "spread": ["pair_spread"],
    "wallet_activity": ["trades"],
    "token_live": ["token_metrics"],
    "daily_closes": ["trades"],
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def sql(body: str, *names: str, ctes: dict[str, str] | None = None) -> str:
    """`WITH <views>, <own ctes> body`."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _closure(names)]
    parts += [f"{n} AS ({text})" for n, text in (ctes or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
