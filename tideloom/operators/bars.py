"""OHLC bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import retain

KEY = ("venue", "symbol")


def tick_bars(ticks: DataFrame, bar_ms: int = 60_000, key=KEY, ts: str = "exchange_ts_ns") -> DataFrame:
    """Bars of the mid: open, high, low, close; volume 0; n_src ticks. One partial aggregation."""
    m = (F.col("bid") + F.col("ask")) / 2
    t = ticks.select(*key, "seq", F.col(ts).alias("_ts"), m.alias("_m")).where("_m > 0").withColumn("open_time_ms", F.expr(f"_ts DIV {bar_ms * 1_000_000} * {bar_ms}"))
    o = F.struct("_ts", "seq")
    return t.groupBy(*key, "open_time_ms").agg(F.min_by("_m", o).alias("open"), F.max("_m").alias("high"), F.min("_m").alias("low"), F.max_by("_m", o).alias("close"), F.lit(0.0).alias("volume"), F.count("*").cast("int").alias("n_src"))


def aggregate_bars(bars: DataFrame, target: int, base_ms: int = 60_000, key=KEY) -> DataFrame:
    """Base bars to bars of ``target``; incomplete ones are dropped wherever they are. 1 is the identity, 0 gives none."""
    if target == 1:
        return bars
    if target <= 0:
        return bars.limit(0)
    span = base_ms * target
    g = bars.withColumn("_b", F.expr(f"open_time_ms DIV {span}")).groupBy(*key, "_b")
    out = g.agg(F.min_by("open", "open_time_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time_ms").alias("close"), F.sum("volume").alias("volume"), F.count("*").cast("int").alias("n_src"))
    return out.where(F.col("n_src") >= target).select(*key, (F.col("_b") * span).alias("open_time_ms"), "open", "high", "low", "close", "volume", "n_src")


def rolled_bars(bars: DataFrame, target: int, base_ms: int = 60_000, key=KEY) -> DataFrame:
    """What a live builder emits: when a base bar is followed by one beyond a target boundary and is itself next to that boundary, the
    last ``target`` available base bars become one bar that opens with the first of them."""
    span = base_ms * target
    w = Window.partitionBy(*key).orderBy("open_time_ms")
    f = w.rowsBetween(-(target - 1), 0)
    nxt = F.lead("open_time_ms").over(w)
    b = bars.select(
        *key, F.first("open_time_ms").over(f).alias("o"), F.first("open").over(f).alias("open"), F.max("high").over(f).alias("high"), F.min("low").over(f).alias("low"), "close",
        F.sum("volume").over(f).alias("volume"), F.count("*").over(f).cast("int").alias("n_src"), F.col("open_time_ms").alias("_t"), nxt.alias("_n"),
    )
    b = b.where(f"_n DIV {span} > _t DIV {span} AND _t + {base_ms} >= _n DIV {span} * {span}")
    return b.select(*key, F.col("o").alias("open_time_ms"), "open", "high", "low", "close", "volume", "n_src")


def virtual_head(bars: DataFrame, target: int, key=KEY) -> DataFrame:
    """At each base bar, taken as the live partial one: it and the ``target - 1`` before it as one bar; rows with fewer use what there is."""
    w = Window.partitionBy(*key).orderBy("open_time_ms")
    f = w.rowsBetween(-(target - 1), 0)
    return bars.select(*key, F.col("open_time_ms").alias("as_of_ms"), F.first("open_time_ms").over(f).alias("open_time_ms"), F.first("open").over(f).alias("open"), F.max("high").over(f).alias("high"), F.min("low").over(f).alias("low"), "close", F.count("*").over(f).cast("int").alias("n_src"))


def retain_bars(bars: DataFrame, capacity: int, key=KEY) -> DataFrame:
    return retain(bars, capacity, key, ("open_time_ms",))


def with_history(history: DataFrame, live: DataFrame, capacity: int | None = None, key=KEY) -> DataFrame:
    """Historical bars before live ones; for a time in both the live bar counts; newest ``capacity`` kept."""
    u = history.withColumn("_p", F.lit(1)).unionByName(live.withColumn("_p", F.lit(0)))
    w = Window.partitionBy(*key, "open_time_ms").orderBy("_p")
    u = u.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_p")
    return retain_bars(u, capacity, key) if capacity else u


def merge_first(first: DataFrame, second: DataFrame, key=("symbol",)) -> DataFrame:
    """Union in which ``first`` wins for equal open times (disk before backfill)."""
    u = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    rest = [c for c in first.columns if c not in (*key, "open_time_ms")]
    return u.groupBy(*key, "open_time_ms").agg(F.min_by(F.struct(*rest), "_p").alias("_r")).select(*key, "open_time_ms", "_r.*")


def bar_status(bars: DataFrame, as_of_ms: int | None = None, key=KEY) -> DataFrame:
    """Completed bars, last close and age of the partial one (the newest) at ``as_of_ms`` (default: the newest time of all)."""
    last = bars.agg(F.max("open_time_ms").alias("_m"))
    now = F.lit(as_of_ms) if as_of_ms is not None else F.col("_m")
    b = bars.groupBy(*key).agg((F.count("*") - 1).alias("n_completed"), F.max("open_time_ms").alias("_o"), F.max_by("close", "open_time_ms").alias("last_close"))
    return b.join(F.broadcast(last)).select(*key, "n_completed", "last_close", ((now - F.col("_o")) / 1000.0).alias("partial_age_s"), F.lit(True).alias("has_ticks"))


def return_bars(returns: DataFrame, bar_ns: int, expected: int, key=KEY, ts: str = "snap_ts_ns") -> DataFrame:
    """Garman-Klass variance of bars built from cumulative log returns; bars with under half of the samples are dropped."""
    r = returns.where("log_return IS NOT NULL").withColumn("_b", F.expr(f"`{ts}` DIV {bar_ns}"))
    w = Window.partitionBy(*key, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    c = r.withColumn("_c", F.sum("log_return").over(w))
    g = c.groupBy(*key, "_b").agg(F.greatest(F.max("_c"), F.lit(0.0)).alias("h"), F.least(F.min("_c"), F.lit(0.0)).alias("l"), F.max_by("_c", ts).alias("c"), F.count("*").alias("n"))
    g = g.where(F.col("n") >= 0.5 * expected)
    return g.select(*key, (F.col("_b") * bar_ns).alias("bar_ts_ns"), F.expr("greatest(0.5 * (h - l) * (h - l) - (2 * ln(2) - 1) * c * c, 0)").alias("gk"), "n")
