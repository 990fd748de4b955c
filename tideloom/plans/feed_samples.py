"""Messages of every decoded feed, made from ticks, trades and book updates, as SQL templates: ``{bid}`` is replaced by the column as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BINANCE = '{"stream":"s","data":{"s":"BTCUSDT","b":"{bid}","a":"{ask}","B":"{bid_qty}","A":"{ask_qty}","u":{seq},"E":{ms}}}'
_BYBIT = '{"topic":"orderbook.1","ts":{ms},"data":{"s":"BTCUSDT","b":[["{bid}","{bid_qty}"]],"a":[["{ask}","{ask_qty}"]]}}'
_OKX = '{"arg":{"channel":"bbo-tbt","instId":"BTC-USDT"},"data":[{"asks":[["{ask}","{ask_qty}","0"]],"bids":[["{bid}","{bid_qty}","0"]],"ts":"{ms}"}]}'
_BINGX = '{"dataType":"t","data":{"s":"BTC-USDT","b":"{bid}","a":"{ask}","B":{bid_qty},"A":"{ask_qty}","E":{ms}}}'

#: (venue, itype), symbol, message.
QUOTES = [
    (("binance", "spot"), "BTCUSDT", _BINANCE),
    (("binance", "perp"), "BTCUSDT", _BINANCE),
    (("bybit", "spot"), "BTCUSDT", _BYBIT),
    (("bybit", "perp"), "BTCUSDT", _BYBIT),
    (("coinbase", "spot"), "BTC-USD", '{"type":"ticker","product_id":"BTC-USD","best_bid":"{bid}","best_ask":"{ask}","best_bid_size":"{bid_qty}","best_ask_size":"{ask_qty}","time":"{iso}"}'),
    (("coinbase", "perp"), "BTC-PERP", '{"channel":"ticker","timestamp":"{iso}","events":[{"type":"update","tickers":[{"product_id":"BTC-PERP","best_bid":"{bid}","best_ask":"{ask}","best_bid_quantity":"{bid_qty}","best_ask_quantity":"{ask_qty}"}]}]}'),
    (("kraken", "spot"), "XBT/USD", '[340,["{bid}","{ask}","{seconds}","{bid_qty}","{ask_qty}"],"spread","XBT/USD"]'),
    (("kraken", "perp"), "PI_XBTUSD", '{"feed":"ticker","product_id":"PI_XBTUSD","bid":{bid},"ask":{ask},"bid_size":{bid_qty},"ask_size":{ask_qty},"time":{ms}}'),
    (("okx", "spot"), "BTC-USDT", _OKX),
    (("okx", "perp"), "BTC-USDT", _OKX),
    (("kucoin", "spot"), "BTC-USDT", '{"topic":"/market/ticker:BTC-USDT","data":{"bestBid":"{bid}","bestAsk":"{ask}","bestBidSize":"{bid_qty}","bestAskSize":"{ask_qty}","time":{ms}}}'),
    (("kucoin", "perp"), "XBTUSDTM", '{"topic":"t","data":{"symbol":"XBTUSDTM","bestBidPrice":"{bid}","bestAskPrice":"{ask}","bestBidSize":{bid_qty},"bestAskSize":{ask_qty},"ts":{ms}000000}}'),
    (("bingx", "spot"), "BTC-USDT", _BINGX),
    (("bingx", "perp"), "BTC-USDT", _BINGX),
    (("hyperliquid", "perp"), "BTC", '{"channel":"l2Book","data":{"coin":"BTC","time":{ms},"levels":[[{"px":"{bid}","sz":"{bid_qty}","n":1}],[{"px":"{ask}","sz":"{ask_qty}","n":1}]]}}'),
    (("extended", "perp"), "BTC-USD", '{"ts":{ms},"data":{"m":"BTC-USD","b":[{"p":"{bid}","q":"{bid_qty}"}],"a":[{"p":"{ask}","q":"{ask_qty}"}]}}'),
    (("nado", "perp"), "2", '{"type":"best_bid_offer","product_id":2,"bid_price":"{bid18}","ask_price":"{ask18}","bid_qty":"{bid_qty18}","ask_qty":"{ask_qty18}","timestamp":"{ms}000000"}'),
]

#: (venue, itype), symbol, text of a sell, text of a buy, message. A missing side is null.
TRADES = [
    (("binance", "perp"), "BTCUSDT", "true", "false", '{"data":{"s":"BTCUSDT","p":"{price}","q":"{qty}","T":{ms},"m":{side}}}'),
    (("bybit", "perp"), "BTCUSDT", '"Sell"', '"Buy"', '{"topic":"publicTrade","data":[{"s":"BTCUSDT","p":"{price}","v":"{qty}","T":{ms},"S":{side}}]}'),
    (("hyperliquid", "perp"), "BTC", '"A"', '"B"', '{"channel":"trades","data":[{"coin":"BTC","px":"{price}","sz":"{qty}","time":{ms},"side":{side}}]}'),
    (("hibachi", "perp"), "BTC/USDT-P", '"Sell"', '"Buy"', '{"symbol":"BTC/USDT-P","data":{"trade":{"price":"{price}","quantity":"{qty}","timestamp":{ms},"takerSide":{side}}}}'),
    (("hotstuff", "perp"), "BTC-PERP", '"sell"', '"buy"', '{"params":{"data":{"instrument":"BTC-PERP","price":"{price}","size":"{qty}","timestamp":{ms},"side":{side}}}}'),
    (("risex", "perp"), "1", "0", "1", '{"market_id":1,"data":{"price":"{price}","size":"{qty}","maker_side":{side}},"timestamp":{ms}000000}'),
    (("extended", "perp"), "BTC-USD", '"SELL"', '"BUY"', '{"data":[{"m":"BTC-USD","p":"{price}","q":"{qty}","T":{ms},"S":{side}}]}'),
    (("nado", "perp"), "2", "false", "true", '{"product_id":2,"price":"{price18}","taker_qty":"{qty18}","timestamp":"{ms}000000","is_taker_buyer":{side}}'),
    (("zeroone", "perp"), "BTCUSD", '"sell"', '"buy"', '{"trades":{"market_symbol":"BTCUSD","trades":[{"price":{price},"base_size":{qty},"time":"{iso}","side":{side}}]}}'),
]

_HIBACHI = '{"symbol":"{symbol}","messageType":"{Snapshot}","timestamp_ms":1700000000000,"data":{"{side}":{"levels":[{"price":"{price}","quantity":"{qty}"}]}}}'
#: (venue, itype), message; the words in braces mark a snapshot or an update. Formats without a mark have None.
BOOKS = [
    (("mexc", "perp"), None, '{"symbol":"{symbol}","ts":1700000000000,"data":{"{side}s":[[{price},{qty},1]]}}'),
    (("lighter", "perp"), ("subscribed/order_book", "update/order_book"), '{"channel":"{symbol}","type":"{mark}","order_book":{"timestamp":1700000000000,"{side}s":[{"price":"{price}","size":"{qty}"}]}}'),
    (("apex", "perp"), ("snapshot", "delta"), '{"topic":"t","type":"{mark}","ts":1700000000000000,"data":{"s":"{symbol}","{letter}":[["{price}","{qty}"]]}}'),
    (("hibachi", "perp"), ("Snapshot", "Update"), _HIBACHI.replace("{Snapshot}", "{mark}")),
    (("hibachi", "spot"), ("Snapshot", "Update"), _HIBACHI.replace("{Snapshot}", "{mark}")),
    (("hotstuff", "perp"), ("snapshot", "delta"), '{"params":{"data":{"update_type":"{mark}","books":{"instrument_name":"{symbol}","timestamp":1700000000000,"{side}s":[{"price":"{price}","size":"{qty}"}]}}}}'),
    (("zeroone", "perp"), None, '{"delta":{"market_symbol":"{symbol}","{side}s":[[{price},{qty}]]}}'),
    (("risex", "perp"), ("snapshot", "update"), '{"type":"{mark}","market_id":"{symbol}","timestamp":1700000000000000000,"data":{"{side}s":[{"price":"{price}","quantity":"{qty}"}]}}'),
    (("bulk", "perp"), ("snapshot", "delta"), '{"type":"{mark}","symbol":"{symbol}","{side}s":[{"px":{price},"sz":{qty}}]}'),
]


def _text(template: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(f"CAST({x} AS STRING)" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x) + ")"


def _iso(ms: str) -> str:
    return f"date_format(to_utc_timestamp(timestamp_millis({ms}), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def _messages(df: DataFrame, templates: list[str], keys: list[tuple[str, str]]) -> DataFrame:
    """Row n is a message of format seq % formats."""
    n = len(templates)
    case = "CASE seq % {} ".format(n) + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(templates)) + " END"
    of = lambda k: "element_at(array(" + ", ".join(f"'{x[k]}'" for x in keys) + f"), CAST(seq % {n} AS INT) + 1)"
    return df.selectExpr(f"{of(0)} AS venue", f"{of(1)} AS itype", f"{case} AS raw", "received_ts_ns", "seq")


def quote_messages(ticks: DataFrame) -> DataFrame:
    d = ticks.withColumn("ms", F.expr("exchange_ts_ns DIV 1000000")).withColumn("iso", F.expr(_iso("ms"))).withColumn("seconds", F.expr("concat(ms DIV 1000, '.', lpad(CAST(ms % 1000 AS STRING), 3, '0'))"))
    d = d.withColumns({f"{c}18": F.expr(f"CAST({c} * 1e18D AS DECIMAL(38, 0))") for c in ("bid", "ask", "bid_qty", "ask_qty")})
    return _messages(d, [t for _, _, t in QUOTES], [k for k, *_ in QUOTES])


def trade_messages(trades: DataFrame) -> DataFrame:
    d = trades.withColumn("ms", F.expr("exchange_ts_ns DIV 1000000")).withColumn("iso", F.expr(_iso("ms")))
    d = d.withColumns({f"{c}18": F.expr(f"CAST({c} * 1e18D AS DECIMAL(38, 0))") for c in ("price", "qty")})
    n = len(TRADES)
    word = lambda i: "element_at(array(" + ", ".join(f"'{x[i]}'" for x in TRADES) + f"), CAST(seq % {n} AS INT) + 1)"
    d = d.withColumn("side", F.expr(f"CASE side WHEN 'sell' THEN {word(2)} WHEN 'buy' THEN {word(3)} ELSE 'null' END"))
    return _messages(d, [x[4] for x in TRADES], [x[0] for x in TRADES])


def book_messages(updates: DataFrame) -> DataFrame:
    n = len(BOOKS)
    word = lambda i: "element_at(array(" + ", ".join(f"'{(x[1] or ('', ''))[i]}'" for x in BOOKS) + f"), CAST(seq % {n} AS INT) + 1)"
    d = updates.withColumn("symbol", F.col("venue")).withColumn("letter", F.substring("side", 1, 1)).withColumn("received_ts_ns", F.lit(0).cast("long"))
    d = d.withColumn("mark", F.expr(f"CASE WHEN seq % 50 = 0 THEN {word(0)} ELSE {word(1)} END"))
    return _messages(d, [x[2] for x in BOOKS], [x[0] for x in BOOKS])


def listed(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"
