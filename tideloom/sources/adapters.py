"""Deterministic views of the test tables as market data: ticks from events, trades from lineitem, book updates from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks by the fixed rule that tests and SQL share. Only the four needed columns are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value").where("value > 0")
    half = "(5 + event_id % 20) / 1e4D"
    ex = "unix_micros(CAST(ts AS TIMESTAMP)) * 1000"
    return e.selectExpr(
        "event_type AS venue", "'SYM' AS symbol", "'spot' AS itype",
        f"value * (1 - {half}) AS bid", f"value * (1 + {half}) AS ask",
        "CAST(1 + event_id % 7 AS DOUBLE) AS bid_qty", "CAST(1 + event_id % 5 AS DOUBLE) AS ask_qty",
        f"{ex} AS exchange_ts_raw_ns", f"{ex} AS exchange_ts_ns", f"{ex} + 1000000 * ((event_id * 7) % 41 - 2) AS received_ts_ns",
        "event_id AS update_id", "event_id AS seq",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from line items: price, quantity, side by return flag, venue by line status, time by ship date."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    ns = "unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000"
    return li.where("l_quantity > 0").selectExpr(
        "l_linestatus AS venue", "'SYM' AS symbol", "l_extendedprice / l_quantity AS price", "l_quantity AS qty",
        "CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' END AS side",
        f"{ns} AS exchange_ts_raw_ns", f"{ns} AS exchange_ts_ns", f"{ns} AS received_ts_ns", "l_orderkey * 10 + l_linenumber AS seq",
    )


def book_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level updates: side, price, quantity (0 removes); every 500th event of a venue begins a snapshot epoch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value").where("value > 0")
    return e.selectExpr(
        "event_type AS venue", "'SYM' AS symbol", "event_id AS seq", "event_id DIV 500 AS epoch",
        "CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side",
        "CASE WHEN event_id % 2 = 0 THEN 100 - CAST(event_id * 13 % 40 AS DOUBLE) / 4 ELSE 100.25D + CAST(event_id * 13 % 40 AS DOUBLE) / 4 END AS price",
        "CASE WHEN event_id % 9 = 0 THEN 0D ELSE CAST(1 + event_id % 11 AS DOUBLE) END AS qty",
    )


TICKS_SQL = """ticks AS (SELECT event_type AS venue, 'SYM' AS symbol, event_id AS seq, event_id AS update_id,
  value * (1 - (5 + event_id % 20) / 1e4::DOUBLE) AS bid, value * (1 + (5 + event_id % 20) / 1e4::DOUBLE) AS ask,
  CAST(1 + event_id % 7 AS DOUBLE) AS bid_qty, CAST(1 + event_id % 5 AS DOUBLE) AS ask_qty,
  epoch_us(ts) * 1000 AS exchange_ts_ns, epoch_us(ts) * 1000 + 1000000 * ((event_id * 7) % 41 - 2) AS received_ts_ns
  FROM events WHERE value > 0)"""

BOOKS_SQL = """books AS (SELECT event_type AS venue, event_id AS seq, event_id // 500 AS epoch, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  CASE WHEN event_id % 2 = 0 THEN 100 - CAST(event_id * 13 % 40 AS DOUBLE) / 4 ELSE 100.25 + CAST(event_id * 13 % 40 AS DOUBLE) / 4 END AS price,
  CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE CAST(1 + event_id % 11 AS DOUBLE) END AS qty FROM events WHERE value > 0)"""
