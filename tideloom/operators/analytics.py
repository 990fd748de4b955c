"""Analytics over the last n snapshots of each key. n counts rows; NULLs are dropped after the cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import field
from .buffers import last_n

KEY = ("venue", "symbol")
HOUR_BUNDLE = dict(lookback=36_000, twap_n=100, vol_n=600, bucket=10)


def _window(snaps: DataFrame, n: int, key=KEY) -> DataFrame:
    return last_n(snaps, n, key, ("snap_ts_ns",))


def _agg(snaps: DataFrame, name: str, n: int, fn, out: str, key=KEY) -> DataFrame:
    return _window(snaps, n, key).groupBy(*key).agg(fn(F.col(field(name))).alias(out))


def snap_mean(snaps, name, n, key=KEY):
    return _agg(snaps, name, n, F.avg, "value", key)


def snap_stdev(snaps, name, n, key=KEY):
    """Sample standard deviation; NULL for fewer than two values."""
    return _agg(snaps, name, n, F.stddev_samp, "value", key)


def snap_median(snaps, name, n, key=KEY):
    return snap_quantile(snaps, name, n, 0.5, key)


def snap_quantile(snaps, name, n, q, key=KEY):
    """Exact, linearly interpolated."""
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")
    return _agg(snaps, name, n, lambda c: F.percentile(c, q), "value", key)


def midquote_twap(snaps, n, key=KEY):
    return snap_mean(snaps, "midquote", n, key)


def mean_spread(snaps, n, key=KEY):
    return snap_mean(snaps, "spread", n, key)


def midquote_stdev(snaps, n, key=KEY):
    return snap_stdev(snaps, "midquote", n, key)


def realized_vol(snaps, n, key=KEY):
    return snap_stdev(snaps, "log_return", n, key)


def max_abs_log_return(snaps, n, key=KEY):
    return _agg(snaps, "log_return", n, lambda c: F.max(F.abs(c)), "value", key)


def log_returns(snaps, n, key=KEY):
    """The returns of each key, newest first (rn), without missing ones."""
    return _window(snaps, n, key).where("log_return IS NOT NULL").select(*key, "rn", "log_return")


def tick_midquote_mean(ticks, n, key=KEY):
    return last_n(ticks, n, key, ("seq",)).groupBy(*key).agg(F.avg((F.col("bid") + F.col("ask")) / 2).alias("value"))


def summary(snaps: DataFrame, n: int, key=KEY) -> DataFrame:
    """E1 to E9 in one aggregation."""
    return _window(snaps, n, key).groupBy(*key).agg(
        F.count("midquote").alias("n"), F.avg("midquote").alias("twap"), F.percentile("midquote", 0.5).alias("median_mid"), F.percentile("midquote", 0.99).alias("p99_mid"),
        F.stddev_samp("midquote").alias("mid_stdev"), F.stddev_samp("log_return").alias("realized_vol"), F.max(F.abs("log_return")).alias("max_jump"), F.avg("spread").alias("mean_spread"), F.max("mid_high").alias("max_high"),
    )


def range_buckets(snaps: DataFrame, window: int, bucket: int, key=KEY) -> DataFrame:
    """Ranges in basis points of row-count buckets from the window's oldest row; flat and non-positive buckets are left out."""
    w = Window.partitionBy(*key).orderBy("snap_ts_ns")
    b = _window(snaps, window, key).withColumn("_p", F.row_number().over(w) - 1).withColumn("bucket", F.expr(f"CAST(_p DIV {bucket} AS INT)"))
    g = b.where("midquote IS NOT NULL").groupBy(*key, "bucket").agg(F.max("midquote").alias("hi"), F.min("midquote").alias("lo"))
    return g.where("hi > lo AND lo > 0").select(*key, "bucket", ((F.col("hi") - F.col("lo")) / ((F.col("hi") + F.col("lo")) / 2) * 1e4).alias("range_bps"))


def range_stat(snaps: DataFrame, window: int, bucket: int, stat: str = "mean", q: float | None = None, key=KEY) -> DataFrame:
    fn = {"mean": lambda: F.avg("range_bps"), "median": lambda: F.percentile("range_bps", 0.5), "quantile": lambda: F.percentile("range_bps", q), "percentile": lambda: F.percentile("range_bps", q)}[stat.lower()]
    return range_buckets(snaps, window, bucket, key).groupBy(*key).agg(fn().alias("value"))


def quote_fills(snaps: DataFrame, side: str, spread_bps: float, lookback: int, key=KEY) -> DataFrame:
    """Simulated fills of a quote at mid * (1 +- spread) against the interval's extremes, with markouts against the next mid in basis points.

    The last row is never a quote, so n_total is one less than the rows; a fill without a valid next mid doesn't count.
    elapsed_s is that of the snapshot times, or 0.1 s a row where they don't rise.
    """
    sell = {"ask": True, "a": True, "sell": True, "bid": False, "b": False, "buy": False}[side.lower()]
    w = Window.partitionBy(*key).orderBy("snap_ts_ns")
    s = _window(snaps, lookback, key)
    s = s.select(*key, "snap_ts_ns", "midquote", F.lead("midquote").over(w).alias("_next"), F.col("bid_high" if sell else "ask_low").alias("_reach"))
    quote = F.col("midquote") * (1 + spread_bps / 1e4) if sell else F.col("midquote") * (1 - spread_bps / 1e4)
    hit = (F.col("_reach") >= quote) if sell else (F.col("_reach") <= quote)
    filled = F.coalesce((F.col("midquote") > 0) & (F.col("_next") > 0) & hit, F.lit(False))
    move = (quote - F.col("_next")) if sell else (F.col("_next") - quote)
    s = s.withColumn("_m", F.when(filled, move / F.col("midquote") * 1e4))
    span = (F.max("snap_ts_ns") - F.min("snap_ts_ns")) / 1e9
    out = s.groupBy(*key).agg(F.count("_m").alias("n_fills"), (F.count("*") - 1).alias("n_total"), F.when(span > 0, span).otherwise((F.count("*") - 1) * 0.1).alias("elapsed_s"), F.coalesce(F.avg("_m"), F.lit(0.0)).alias("mean_markout_bps"), F.coalesce(F.stddev_samp("_m"), F.lit(0.0)).alias("stdev_markout_bps"))
    return out.where("n_total > 0")


def display_bundle(snaps: DataFrame, lookback: int = 36_000, twap_n: int = 100, vol_n: int = 600, bucket: int = 10, warmup_ns: int = 5_000_000_000, key=KEY) -> DataFrame:
    """All display figures of each key in one aggregation, joined to bucket ranges and to both sides' fills at half of the p99 range."""
    s = _window(snaps, lookback, key)
    valid = Window.partitionBy(*key).orderBy(F.col("log_return").isNull(), "rn")
    s = s.withColumn("_vr", F.row_number().over(valid)).withColumn("_t0", F.min("snap_ts_ns").over(Window.partitionBy(*key))).withColumn("_t1", F.max("snap_ts_ns").over(Window.partitionBy(*key)))
    warm = (F.col("snap_ts_ns") - F.col("_t0") >= warmup_ns) | (F.col("_t1") - F.col("_t0") < warmup_ns)
    lat = lambda c: F.percentile(F.when(warm, F.col(c)), F.array(F.lit(0.5), F.lit(0.9999)))
    a = s.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(F.when((F.col("rn") <= twap_n) & (F.col("midquote") > 0), F.col("midquote"))).alias("twap"), F.percentile("spread", 0.5).alias("median_spread"),
        F.stddev_samp(F.when(F.col("_vr") <= vol_n, F.col("log_return"))).alias("vol"), F.max(F.abs("log_return")).alias("max_jump"), lat("exchange_lat_ms").alias("_e"), lat("receive_lat_ms").alias("_r"),
    ).where("n >= 2")
    a = a.select(*key, "n", "twap", "median_spread", "vol", "max_jump", F.col("_e")[0].alias("elat_p50"), F.col("_e")[1].alias("elat_p9999"), F.col("_r")[0].alias("rlat_p50"), F.col("_r")[1].alias("rlat_p9999"))
    r = range_buckets(snaps, lookback, bucket, key).groupBy(*key).agg(F.percentile("range_bps", F.array(F.lit(0.5), F.lit(0.99))).alias("_p"))
    r = r.select(*key, F.col("_p")[0].alias("range_p50"), F.col("_p")[1].alias("range_p99"))
    return a.join(r, list(key), "left")
