"""Interval resampling of ticks into snapshots, with carry-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("venue", "symbol")


def carry_forward(buckets: DataFrame, cols: list[str], key=KEY, bucket: str = "_b") -> DataFrame:
    """One row for each key and bucket from the key's first to the last of all; ``cols`` keep their last known value.

    The span is one aggregated row; the grid comes from one generator a key, so only buckets are sorted, not ticks.
    """
    span = buckets.agg(F.max(bucket).alias("_end"))
    grid = buckets.groupBy(*key).agg(F.min(bucket).alias("_from")).join(F.broadcast(span)).select(*key, F.explode(F.sequence("_from", "_end")).alias(bucket))
    w = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(buckets, [*key, bucket], "left")
    return full.select(*[c for c in full.columns if c not in cols], *[F.last(c, True).over(w).alias(c) for c in cols])


def snapshots(ticks: DataFrame, step_ns: int, key=KEY, ts: str = "exchange_ts_ns", cap: int | None = None) -> DataFrame:
    """A snapshot of each key at each interval's end, from its first quote with both sides on.

    High and low of the mid, highest bid and lowest ask cover the interval's ticks and the current quote; the log return
    is against the snapshot before (NULL for the first). ``cap`` limits the ticks that an interval takes (the newest are lost); off by default.
    """
    t = ticks.where("bid IS NOT NULL AND ask IS NOT NULL").withColumn("_b", F.expr(f"`{ts}` DIV {step_ns}")).withColumn("_mid", (F.col("bid") + F.col("ask")) / 2)
    if cap is not None:
        t = t.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "_b").orderBy("seq"))).where(F.col("_rn") <= cap)
    q = F.struct("bid", "ask", "bid_qty", "ask_qty", F.col("exchange_ts_ns").alias("ex"), F.col("received_ts_ns").alias("rc"))
    b = t.groupBy(*key, "_b").agg(F.max_by(q, F.struct(F.col(ts), F.col("seq"))).alias("_q"), F.max("_mid").alias("_h"), F.min("_mid").alias("_l"), F.max("bid").alias("_bh"), F.min("ask").alias("_al"), F.count("*").cast("int").alias("n_ticks"))
    full = carry_forward(b, ["_q"], key)
    snap_ts = (F.col("_b") + 1) * step_ns
    s = full.select(
        *key, snap_ts.alias("snap_ts_ns"), "_q.bid", "_q.ask", "_q.bid_qty", "_q.ask_qty", ((F.col("_q.bid") + F.col("_q.ask")) / 2).alias("midquote"), (F.col("_q.ask") - F.col("_q.bid")).alias("spread"),
        "_h", "_l", "_bh", "_al", F.col("_q.ex").alias("exchange_ts_ns"), F.col("_q.rc").alias("received_ts_ns"), F.coalesce("n_ticks", F.lit(0)).alias("n_ticks"),
    )
    w = Window.partitionBy(*key).orderBy("snap_ts_ns")
    prev = F.lag("midquote").over(w)
    return s.select(
        *key, "snap_ts_ns", "bid", "ask", "bid_qty", "ask_qty", "midquote", "spread",
        F.when((prev > 0) & (F.col("midquote") > 0), F.ln(F.col("midquote") / prev)).alias("log_return"),
        F.greatest("_h", "midquote").alias("mid_high"), F.least("_l", "midquote").alias("mid_low"), F.greatest("_bh", "bid").alias("bid_high"), F.least("_al", "ask").alias("ask_low"),
        ((F.col("received_ts_ns") - F.col("exchange_ts_ns")) / 1e6).alias("exchange_lat_ms"), ((F.col("snap_ts_ns") - F.col("received_ts_ns")) / 1e6).alias("receive_lat_ms"),
        "exchange_ts_ns", "received_ts_ns", "n_ticks",
    )
