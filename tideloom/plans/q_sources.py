"""Feeds, symbols, fees, captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters, feeds, files
from . import feed_samples as fs
from .common import r, rounded, sql, ticks

QUERIES, SQL = {}, {}


def q(name, fn, ctes=None, select=None, digits=6):
    QUERIES[name] = lambda s, d: rounded(fn(s, d), digits)
    if select:
        SQL[name] = sql(ctes or [], select)


MULT = [("okx", "perp", "BTC-USDT", 0.01)]
NQ, NT, NB = len(fs.QUOTES), len(fs.TRADES), len(fs.BOOKS)
at = lambda values, n: f"{fs.listed(values)}[(seq % {n})::INT + 1]"
okx = [k for k, *_ in fs.QUOTES].index(("okx", "perp"))
q("a3_feed_quotes", lambda s, d: feeds.quotes(fs.quote_messages(ticks(s, d)), s.createDataFrame(MULT, "venue string, itype string, symbol string, multiplier double")).select("venue", "itype", "symbol", "seq", "bid", "ask", "bid_qty", "ask_qty", "exchange_ts_raw_ns", "received_ts_ns"), [],
  f"SELECT {at([k[0] for k, *_ in fs.QUOTES], NQ)} AS venue, {at([k[1] for k, *_ in fs.QUOTES], NQ)} AS itype, {at([x[1] for x in fs.QUOTES], NQ)} AS symbol, seq, {r('bid', 'ask', *[f'{c} * CASE WHEN seq % {NQ} = {okx} THEN 0.01 ELSE 1 END AS {c}' for c in ('bid_qty', 'ask_qty')])}, exchange_ts_ns // 1000000 * 1000000 AS exchange_ts_raw_ns, received_ts_ns FROM ticks")
TR = "tr AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS price, l_quantity AS qty, CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' END AS side, epoch_us(l_shipdate) * 1000 AS t FROM lineitem WHERE l_quantity > 0)"
q("a3_feed_trades", lambda s, d: feeds.trades(fs.trade_messages(adapters.trades(s, d))).select("venue", "itype", "symbol", "seq", "price", "qty", "side", "exchange_ts_raw_ns"), [TR],
  f"SELECT {at([x[0][0] for x in fs.TRADES], NT)} AS venue, {at([x[0][1] for x in fs.TRADES], NT)} AS itype, {at([x[1] for x in fs.TRADES], NT)} AS symbol, seq, {r('price', 'qty', digits=9)}, side, t // 1000000 * 1000000 AS exchange_ts_raw_ns FROM tr", digits=9)
BM = f"bm AS (SELECT {at([x[0][0] for x in fs.BOOKS], NB)} AS v, {at([x[0][1] for x in fs.BOOKS], NB)} AS i, venue AS symbol, seq, side, price, qty, CASE WHEN seq % 50 = 0 AND {at([int(x[1] is not None) for x in fs.BOOKS], NB)} = '1' THEN 1 ELSE 0 END AS snap FROM books)"
q("a3_feed_books", lambda s, d: feeds.book_updates(fs.book_messages(adapters.book_updates(s, d))).select("venue", "itype", "symbol", "seq", "side", "price", "qty", "epoch"), [adapters.BOOKS_SQL, BM],
  f"SELECT v AS venue, i AS itype, symbol, seq, side, {r('price', 'qty')}, (sum(snap) OVER (PARTITION BY v, symbol ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS epoch FROM bm")
q("a16_capture_quotes", lambda s, d: files.capture_quotes(ticks(s, d)), [], f"SELECT received_ts_ns AS tick_ts_ns, venue AS exchange, symbol, {r('bid', 'ask', 'bid_qty', 'ask_qty')}, exchange_ts_ns, received_ts_ns FROM ticks")
q("a17_capture_trades", lambda s, d: files.capture_trades(adapters.trades(s, d)), [], "SELECT epoch_us(l_shipdate) * 1000 AS tick_ts_ns, l_linestatus AS exchange, 'SYM' AS symbol, round(l_extendedprice / l_quantity, 9) AS price, round(l_quantity, 9) AS qty, CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE '' END AS side, epoch_us(l_shipdate) * 1000 AS exchange_ts_ns, epoch_us(l_shipdate) * 1000 AS received_ts_ns FROM lineitem WHERE l_quantity > 0", digits=9)
