"""Windowed aggregations of streams, with watermarks, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("venue", "symbol")


def event_time(stream: DataFrame, ts: str = "exchange_ts_ns", late: str = "10 seconds") -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros(F.expr(f"`{ts}` DIV 1000"))).withWatermark("event_time", late)


def _ohlc():
    m = (F.col("bid") + F.col("ask")) / 2
    o = F.struct("exchange_ts_ns", "seq")
    return [F.min_by(m, o).alias("open"), F.max(m).alias("high"), F.min(m).alias("low"), F.max_by(m, o).alias("close"), F.count("*").alias("n_src")]


def tumbling_bars(stream: DataFrame, length: str = "1 minute", late: str = "10 seconds", key=KEY) -> DataFrame:
    w = event_time(stream, late=late).groupBy(*key, F.window("event_time", length).alias("w")).agg(*_ohlc())
    return w.select(*key, (F.unix_micros("w.start") / 1000).cast("long").alias("open_time_ms"), "open", "high", "low", "close", "n_src")


def sliding_bars(stream: DataFrame, length: str, slide: str, late: str = "10 seconds", key=KEY) -> DataFrame:
    w = event_time(stream, late=late).groupBy(*key, F.window("event_time", length, slide).alias("w")).agg(*_ohlc())
    return w.select(*key, (F.unix_micros("w.start") / 1000).cast("long").alias("open_time_ms"), "open", "high", "low", "close", "n_src")


def sessions(stream: DataFrame, gap: str, late: str = "10 seconds", key=KEY) -> DataFrame:
    """Activity sessions (an extension): ticks of a key with no pause of ``gap``."""
    s = event_time(stream, late=late).groupBy(*key, F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n_ticks"))
    return s.select(*key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n_ticks")


def interval_quotes(stream: DataFrame, length: str = "100 milliseconds", late: str = "10 seconds", key=KEY) -> DataFrame:
    """Interval extremes and last quote of a stream (snapshots without carry-forward, which a batch over these rows adds)."""
    m = (F.col("bid") + F.col("ask")) / 2
    q = event_time(stream, late=late).groupBy(*key, F.window("event_time", length).alias("w")).agg(F.max_by(F.struct("bid", "ask", "bid_qty", "ask_qty"), F.struct("exchange_ts_ns", "seq")).alias("q"), F.max(m).alias("mid_high"), F.min(m).alias("mid_low"), F.max("bid").alias("bid_high"), F.min("ask").alias("ask_low"))
    return q.select(*key, (F.unix_micros("w.end") * 1000).alias("snap_ts_ns"), "q.*", "mid_high", "mid_low", "bid_high", "ask_low")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Capture sink; stopping the query and starting it again goes on from the checkpoint.

    ``trigger={"processingTime": "1 second"}`` is the timer form: ticks missed while a batch runs are skipped, and the next batch takes all rows.
    """
    return stream.writeStream.format("parquet").option("path", path).option("compression", "zstd").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_beacon(stream: DataFrame, beacon, apply, sink, checkpoint: str, trigger: dict | None = None):
    """Each micro-batch with the newest parameters: ``sink(apply(batch, params), epoch)``; the file is read when its time advances."""
    def run(batch: DataFrame, epoch: int) -> None:
        sink(apply(batch, beacon.load()[1]), epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
