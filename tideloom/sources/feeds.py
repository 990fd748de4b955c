"""Venue payloads (JSON text, one message a row) to quotes, trades and book updates, as SQL projections.

Raw rows have venue and itype (in lower case, as the tables below name them), raw, received_ts_ns and seq. Unknown messages give no rows.
Times go to nanoseconds; numbers that don't parse are NULL. All venues are decoded in one scan: a CASE picks the format, each level
of a message is parsed once (objects to maps, arrays to arrays of texts) and bound to a name, and one generator emits the rows,
so nothing is inlined into the fields and nothing is shuffled. The venues asked for are a filter that reaches the scan.
"""

from __future__ import annotations

import re
import struct as _struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan

# Places of a quote's fields in each venue's message, unit of its time, whether crossed quotes are dropped, and the condition
# that tells quote messages from others.
QUOTES = {
    ("binance", "spot"): ("data.s", "data.b", "data.a", "data.B", "data.A", "data.E", "ms", True, "data.u"),
    ("binance", "perp"): ("data.s", "data.b", "data.a", "data.B", "data.A", "data.E", "ms", True, "data.u"),
    ("bybit", "spot"): ("data.s", "data.b[0][0]", "data.a[0][0]", "data.b[0][1]", "data.a[0][1]", "ts", "ms", False, "data.s"),
    ("bybit", "perp"): ("data.s", "data.b[0][0]", "data.a[0][0]", "data.b[0][1]", "data.a[0][1]", "ts", "ms", False, "data.s"),
    ("coinbase", "spot"): ("product_id", "best_bid", "best_ask", "best_bid_size", "best_ask_size", "time", "rfc3339", True, "best_bid"),
    ("coinbase", "perp"): ("events[0].tickers[0].product_id", "events[0].tickers[0].best_bid", "events[0].tickers[0].best_ask", "events[0].tickers[0].best_bid_quantity", "events[0].tickers[0].best_ask_quantity", "timestamp", "rfc3339", True, "events[0].tickers[0].product_id"),
    ("kraken", "spot"): ("[3]", "[1][0]", "[1][1]", "[1][3]", "[1][4]", "[1][2]", "s", False, "[3]"),
    ("kraken", "perp"): ("product_id", "bid", "ask", "bid_size", "ask_size", "time", "ms", True, "product_id"),
    ("okx", "spot"): ("arg.instId", "data[0].bids[0][0]", "data[0].asks[0][0]", "data[0].bids[0][1]", "data[0].asks[0][1]", "data[0].ts", "ms", False, "data[0].ts"),
    ("okx", "perp"): ("arg.instId", "data[0].bids[0][0]", "data[0].asks[0][0]", "data[0].bids[0][1]", "data[0].asks[0][1]", "data[0].ts", "ms", False, "data[0].ts"),
    ("kucoin", "spot"): ("topic", "data.bestBid", "data.bestAsk", "data.bestBidSize", "data.bestAskSize", "data.time", "ms", False, "data.bestBid"),
    ("kucoin", "perp"): ("data.symbol", "data.bestBidPrice", "data.bestAskPrice", "data.bestBidSize", "data.bestAskSize", "data.ts", "ns", False, "data.bestBidPrice"),
    ("bingx", "spot"): ("data.s", "data.b", "data.a", "data.B", "data.A", "data.E", "ms", False, "data.s"),
    ("bingx", "perp"): ("data.s", "data.b", "data.a", "data.B", "data.A", "data.E", "ms", False, "data.s"),
    ("hyperliquid", "perp"): ("data.coin", "data.levels[0][0].px", "data.levels[1][0].px", "data.levels[0][0].sz", "data.levels[1][0].sz", "data.time", "ms", False, "data.levels"),
    ("extended", "perp"): ("data.m", "data.b[0].p", "data.a[0].p", "data.b[0].q", "data.a[0].q", "ts", "ms", True, "data.b[0].p"),
    ("nado", "perp"): ("product_id", "bid_price", "ask_price", "bid_qty", "ask_qty", "timestamp", "ns", True, "bid_price"),
}

# Trades. Symbol, price, quantity, time, unit, then the place of the side, its value for sells, and the array of trades if there is one.
TRADES = {
    ("binance", "perp"): ("data.s", "data.p", "data.q", "data.T", "ms", "data.m", "true", None),
    ("bybit", "perp"): ("s", "p", "v", "T", "ms", "S", "Sell", "data"),
    ("hyperliquid", "perp"): ("coin", "px", "sz", "time", "ms", "side", "A", "data"),
    ("hibachi", "perp"): ("symbol", "data.trade.price", "data.trade.quantity", "data.trade.timestamp", "ms", "data.trade.takerSide", "Sell", None),
    ("hotstuff", "perp"): ("params.data.instrument", "params.data.price", "params.data.size", "params.data.timestamp", "ms", "params.data.side", "sell", None),
    ("risex", "perp"): ("market_id", "data.price", "data.size", "timestamp", "ns", "data.maker_side", "0", None),
    ("extended", "perp"): ("m", "p", "q", "T", "ms", "S", "SELL", "data"),
    ("nado", "perp"): ("product_id", "price", "taker_qty", "timestamp", "ns", "is_taker_buyer", "false", None),
    ("zeroone", "perp"): ("market_symbol", "price", "base_size", "time", "rfc3339", "side", "sell", "trades.trades"),
}

# Incremental books. Symbol, bids, asks, time, unit, kind of level (pairs, or the names of price and size), place and value that mark a snapshot.
BOOKS = {
    ("mexc", "perp"): ("symbol", "data.bids", "data.asks", "ts", "ms", None, None, None),
    ("lighter", "perp"): ("channel", "order_book.bids", "order_book.asks", "order_book.timestamp", "ms", ("price", "size"), "type", "subscribed/order_book"),
    ("apex", "perp"): ("data.s", "data.b", "data.a", "ts", "us", None, "type", "snapshot"),
    ("hibachi", "perp"): ("symbol", "data.bid.levels", "data.ask.levels", "timestamp_ms", "ms", ("price", "quantity"), "messageType", "Snapshot"),
    ("hibachi", "spot"): ("symbol", "data.bid.levels", "data.ask.levels", "timestamp_ms", "ms", ("price", "quantity"), "messageType", "Snapshot"),
    ("hotstuff", "perp"): ("params.data.books.instrument_name", "params.data.books.bids", "params.data.books.asks", "params.data.books.timestamp", "ms", ("price", "size"), "params.data.update_type", "snapshot"),
    ("zeroone", "perp"): ("delta.market_symbol", "delta.bids", "delta.asks", None, "ms", None, None, None),
    ("risex", "perp"): ("market_id", "data.bids", "data.asks", "timestamp", "ns", ("price", "quantity"), "type", "snapshot"),
    ("bulk", "perp"): ("symbol", "bids", "asks", None, "ms", ("px", "sz"), "type", "snapshot"),
}
FIXED18 = {("nado", "perp")}


def _get(path: str | None, raw: str = "raw") -> str:
    return "CAST(NULL AS STRING)" if path is None else f"get_json_object({raw}, '$" + ("" if path.startswith("[") else ".") + f"{path}')"


def _ns(x: str, unit: str) -> str:
    if unit == "rfc3339":
        return f"unix_micros(try_to_timestamp({x})) * 1000"
    if unit == "s":
        return f"CAST(round(try_cast({x} AS DOUBLE) * 1e6D) AS BIGINT) * 1000"
    return f"try_cast({x} AS BIGINT) * {dict(ms=1000000, us=1000, ns=1)[unit]}"


def _decode(source: str, paths: dict[str, str | None], body, var: str = "m") -> str:
    """``body`` over the texts at ``paths`` of the JSON text ``source``; every inner level is parsed once."""
    levels, tree = [], {}
    found = {n: "CAST(NULL AS STRING)" for n, p in paths.items() if p is None}
    for name, path in paths.items():
        node = tree
        for step in re.findall(r"[^.\[\]]+", path or ""):
            node = node.setdefault(step, {})
        if path is not None:
            node.setdefault("", []).append(name)

    def walk(node: dict, text: str) -> None:
        for name in node.get("", []):
            found[name] = text
        inner = [k for k in node if k]
        if inner:
            v, is_array = f"{var}{len(levels)}", inner[0].isdigit()
            levels.append((v, f"from_json({text}, '{'array<string>' if is_array else 'map<string,string>'}')"))
            for k in inner:
                walk(node[k], f"get({v}, {k})" if is_array else f"try_element_at({v}, '{k}')")

    walk(tree, source)
    out = body(found)
    for v, e in reversed(levels):
        out = f"transform(array({e}), {v} -> {out})[0]"
    return out


def _emit(raw: DataFrame, branches: dict[tuple[str, str], str], carry: str = "venue, itype, received_ts_ns, seq") -> DataFrame:
    """Rows of the branch (an array of structs) of each message's venue."""
    case = "CASE " + " ".join(f"WHEN venue = '{v}' AND itype = '{i}' THEN {e}" for (v, i), e in branches.items()) + " END"
    known = raw.where(F.col("venue").isin(sorted({v for v, _ in branches})) & F.col("itype").isin(sorted({i for _, i in branches})))
    return known.selectExpr(*carry.split(", "), f"inline({case})")


def _struct_of(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def _number(key: tuple[str, str], text: str) -> str:
    return f"try_cast({text} AS DOUBLE)" + (" / 1e18D" if key in FIXED18 else "")


def quotes(raw: DataFrame, multipliers: DataFrame | None = None, keys=None) -> DataFrame:
    """Best bid and ask of the stateless feeds. ``multipliers``: (venue, itype, symbol, multiplier) for contract sizes (1 where unknown)."""
    branches = {}
    for key in keys or QUOTES:
        sym, b, a, bq, aq, ts, unit, crossed, need = QUOTES[key]

        def body(x: dict[str, str]) -> str:
            n = lambda c: _number(key, x[c])  # noqa: B023, E731
            symbol = f"regexp_extract({x['symbol']}, '([^:]+)$', 1)" if key == ("kucoin", "spot") else x["symbol"]  # noqa: B023
            row = _struct_of(symbol=symbol, bid=n("bid"), ask=n("ask"), bid_qty=n("bid_qty"), ask_qty=n("ask_qty"), exchange_ts_raw_ns=_ns(x["ts"], unit), update_id=f"try_cast({x['uid']} AS BIGINT)", _keep=f"{x['need']} IS NOT NULL")  # noqa: B023
            return f"array({row})"

        one = _decode("raw", {"symbol": sym, "bid": b, "ask": a, "bid_qty": bq, "ask_qty": aq, "ts": ts, "need": need, "uid": "data.u" if key[0] == "binance" else None}, body)
        rule = "x._keep" + (" AND x.bid > 0 AND x.ask > 0" if key == ("nado", "perp") else "") + (" AND (x.bid IS NULL OR x.ask IS NULL OR x.bid < x.ask)" if crossed else "")
        branches[key] = f"filter({one}, x -> {rule})"
    out = _emit(raw, branches).drop("_keep")
    if multipliers is not None:
        out = out.join(multipliers, ["venue", "itype", "symbol"], "left").withColumn("_k", F.coalesce("multiplier", F.lit(1.0)))
        out = out.withColumn("bid_qty", F.col("bid_qty") * F.col("_k")).withColumn("ask_qty", F.col("ask_qty") * F.col("_k")).drop("_k", "multiplier")
    return out.withColumn("exchange_ts_ns", F.col("exchange_ts_raw_ns"))


def trades(raw: DataFrame, keys=None) -> DataFrame:
    """Trades of all trade feeds; rows without a price or quantity are skipped."""
    branches = {}
    for key in keys or TRADES:
        sym, p, q, ts, unit, side, sell, many = TRADES[key]
        outer = "trades.market_symbol" if key == ("zeroone", "perp") else None

        def row(x: dict[str, str]) -> str:
            taker = f"CASE WHEN {x['side']} IS NULL THEN NULL WHEN lower({x['side']}) = '{sell.lower()}' THEN 'sell' ELSE 'buy' END"  # noqa: B023
            return _struct_of(symbol=x["symbol"], price=_number(key, x["price"]), qty=f"abs({_number(key, x['qty'])})", side=taker, exchange_ts_raw_ns=_ns(x["ts"], unit))  # noqa: B023

        paths = {"symbol": None if outer else sym, "price": p, "qty": q, "ts": ts, "side": side}
        if many is None:
            rows = _decode("raw", paths, lambda x: f"array({row(x)})")  # noqa: B023
        else:
            each = lambda x: "transform(from_json(" + x["all"] + ", 'array<string>'), t -> " + _decode("t", paths, lambda y: row({**y, "symbol": x["outer"]} if outer else y), "n") + ")"  # noqa: B023, E731
            rows = _decode("raw", {"all": many, "outer": outer}, each)
        branches[key] = f"filter({rows}, x -> x.price IS NOT NULL AND x.qty IS NOT NULL)"
    return _emit(raw, branches).withColumn("exchange_ts_ns", F.col("exchange_ts_raw_ns"))


def book_updates(raw: DataFrame, keys=None) -> DataFrame:
    """Level updates of the incremental feeds for ``operators.books``: side, price, qty, seq and the snapshot epoch."""
    branches = {}
    for key in keys or BOOKS:
        sym, b, a, ts, unit, names, mark, value = BOOKS[key]
        kind = "array<array<string>>" if names is None else f"array<struct<{names[0]}:string,{names[1]}:string>>"
        pick = ("get(x, 0)", "get(x, 1)") if names is None else (f"x.{names[0]}", f"x.{names[1]}")

        def body(x: dict[str, str]) -> str:
            side = lambda c: f"transform(coalesce(from_json({x[c]}, '{kind}'), array()), x -> named_struct('side', '{c}', 'price', try_cast({pick[0]} AS DOUBLE), 'qty', coalesce(try_cast({pick[1]} AS DOUBLE), 0D)))"  # noqa: B023, E731
            snap = f"coalesce({x['mark']} = '{value}', false)" if mark else "false"  # noqa: B023
            time = _ns(x["ts"], unit) if ts else "CAST(NULL AS BIGINT)"  # noqa: B023
            return "array(" + _struct_of(symbol=x["symbol"], exchange_ts_ns=time, is_snapshot=snap, _l=f"concat({side('bid')}, {side('ask')})") + ")"

        branches[key] = f"filter({_decode('raw', {'symbol': sym, 'bid': b, 'ask': a, 'ts': ts, 'mark': mark}, body)}, x -> x.symbol IS NOT NULL)"
    # snapshots so far, by buckets of seq: no task sorts a whole book's history
    out = scan.running(_emit(raw, branches), ["venue", "symbol"], ["seq"], scan.ROWS, F.col("is_snapshot").cast("long"), "sum", "epoch")
    cols = ["venue", "itype", "symbol", "exchange_ts_ns", "received_ts_ns", "seq", "epoch"]
    return out.select(*cols, F.explode("_l").alias("_x")).select(*cols, "_x.side", "_x.price", "_x.qty")


def _fields(data: bytes) -> dict[int, bytes]:
    """Length-delimited fields of a protobuf message (the last of each number); other wire types are skipped."""
    out, at = {}, 0

    def varint():
        nonlocal at
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            if b < 128:
                return v
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("truncated")
            out[tag >> 3] = data[at : at + n]
            at += n
        elif kind == 0:
            varint()
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError("unknown wire type")
    return out


def protobuf_ticker(data: bytes | None) -> tuple | None:
    """(symbol, bid, ask, bid_qty, ask_qty) of a wrapped book ticker (symbol in field 3, ticker in field 315), or None."""
    try:
        top = _fields(bytes(data))
        book = _fields(top[315])
        bid, bq, ask, aq = (float(book[i].decode()) for i in (1, 2, 3, 4))
        return top[3].decode(), bid, ask, bq, aq
    except (KeyError, ValueError, IndexError, TypeError, _struct.error):
        return None


def protobuf_quotes(raw: DataFrame, data: str = "data") -> DataFrame:
    """Quotes from binary messages; those that don't parse are dropped. A vectorised function, as no built-in reads protobuf without its package."""
    @F.pandas_udf("symbol string, bid double, ask double, bid_qty double, ask_qty double")
    def parse(x: pd.Series) -> pd.DataFrame:
        rows = [protobuf_ticker(v) or (None, None, None, None, None) for v in x]
        return pd.DataFrame(rows, columns=["symbol", "bid", "ask", "bid_qty", "ask_qty"])

    return raw.withColumn("_q", parse(data)).where("_q.symbol IS NOT NULL").select("venue", "itype", "_q.*", "received_ts_ns", "seq")


def volumes(raw: DataFrame) -> DataFrame:
    """24 h volumes in base units: (venue, itype, symbol, vol_24h) from rows of venue, itype and a ticker object raw, by venue rules."""
    n = lambda p: f"try_cast({_get(p)} AS DOUBLE)"
    v = f"""CASE lower(venue)
        WHEN 'binance' THEN {n('volume')} WHEN 'bybit' THEN {n('volume24h')} WHEN 'okx' THEN CASE WHEN lower(itype) = 'perp' THEN {n('volCcy24h')} ELSE {n('vol24h')} END
        WHEN 'kucoin' THEN coalesce({n('volumeOf24h')}, {n('vol')}) WHEN 'mexc' THEN coalesce({n('volume24')}, {n('volume')}) WHEN 'coinbase' THEN {n('volume')} WHEN 'kraken' THEN {n('vol24h')}
        WHEN 'hyperliquid' THEN try_divide({n('dayNtlVlm')}, {n('markPx')}) WHEN 'bingx' THEN {n('volume')} WHEN 'lighter' THEN {n('daily_base_token_volume')} WHEN 'apex' THEN {n('volume24h')}
        ELSE coalesce({n('volume')}, {n('volume24h')}) END"""
    s = f"coalesce({', '.join(_get(p) for p in ('symbol', 'instId', 's', 'product_id', 'name', 'coin'))})"
    return raw.selectExpr("venue", "itype", f"{s} AS symbol", f"{v} AS vol_24h").where("vol_24h IS NOT NULL")


def backoff_ms(attempt: int, initial_ms: int, most_ms: int, retry_after_ms: int | None = None) -> int:
    """Wait before reconnecting: min(initial * 2^min(n, 10), most); a server's retry-after counts if it is longer."""
    wait = min(initial_ms * 2 ** min(attempt, 10), most_ms)
    return max(wait, retry_after_ms) if retry_after_ms is not None else wait
