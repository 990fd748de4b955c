"""Canonical schemas. All timestamps are epoch nanoseconds in longs; missing values are NULL, never NaN."""

TICKS = "venue string, symbol string, itype string, bid double, ask double, bid_qty double, ask_qty double, exchange_ts_raw_ns bigint, exchange_ts_ns bigint, received_ts_ns bigint, update_id bigint, seq bigint"
TRADES = "venue string, symbol string, price double, qty double, side string, exchange_ts_raw_ns bigint, exchange_ts_ns bigint, received_ts_ns bigint, seq bigint"
SNAPSHOTS = "venue string, symbol string, snap_ts_ns bigint, bid double, ask double, bid_qty double, ask_qty double, midquote double, spread double, log_return double, mid_high double, mid_low double, bid_high double, ask_low double, exchange_lat_ms double, receive_lat_ms double, exchange_ts_ns bigint, received_ts_ns bigint"
BARS = "symbol string, open_time_ms bigint, open double, high double, low double, close double, volume double, n_src int"
KLINE_CSV = "open_time_ms bigint, open double, high double, low double, close double, volume double"
FAIR_PRICE = "grp string, snap_ts_ns bigint, fair_price double, log_fair_price double, uncertainty_bps double, p_pre double, vol_ann_pct double, n_ticks_used int"
BBO_CAPTURE = "tick_ts_ns bigint, exchange string, symbol string, bid double, ask double, bid_qty double, ask_qty double, exchange_ts_ns bigint, received_ts_ns bigint"
TRADE_CAPTURE = "tick_ts_ns bigint, exchange string, symbol string, price double, qty double, side string, exchange_ts_ns bigint, received_ts_ns bigint"
LEAD_LAG_CSV = "sample_ts bigint, canonical_symbol string, exchange string, bid double, ask double, bid_qty double, ask_qty double, exchange_ts bigint, received_ts bigint"
INNOVATIONS = "snap_ts_ns bigint, tick_ts_ns bigint, group_idx int, member_idx int, log_mid double, tau_ms double, q double, p_pre double, innovation double, s double, gain double, y_post double, p_post double"
GROUP_SNAPS = "snap_ts_ns bigint, group_idx int, y double, p double, p_pre_fwd double, tau_fwd_ms double, n_ticks int, last_tick_ts_ns bigint"

#: The snapshot fields that analytics can read, with the short names that are accepted for them.
FIELDS = {
    "bid": "bid", "ask": "ask", "bid_qty": "bid_qty", "ask_qty": "ask_qty", "midquote": "midquote", "mid": "midquote", "spread": "spread", "log_return": "log_return",
    "mid_high": "mid_high", "high": "mid_high", "mid_low": "mid_low", "low": "mid_low", "bid_high": "bid_high", "ask_low": "ask_low",
    "exchange_lat_ms": "exchange_lat_ms", "elat": "exchange_lat_ms", "receive_lat_ms": "receive_lat_ms", "rlat": "receive_lat_ms",
}


def field(name: str) -> str:
    try:
        return FIELDS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown snapshot field {name!r}") from None
