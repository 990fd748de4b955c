"""As-of lookups, tick-to-snapshot joins, dimension lookups, group discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, right_seq: str | None = None, prefix: str = "r_", bucket: int = scan.HOUR_NS
) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time (NULLs where there is none).

    Union and a running last value by time buckets of width ``bucket``: linear in the rows, no range join, and a key's buckets run in
    parallel. The right columns get ``prefix``.
    """
    rcols = [c for c in right.columns if c not in on]
    lcols = [c for c in left.columns if c not in on]
    seq = (F.col(right_seq) if right_seq else F.lit(0)).cast("long")
    l = left.select(*on, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*lcols).alias("_l"))
    r = right.select(*on, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), seq.alias("_seq"), F.struct(*rcols).alias("_r"))
    u = l.unionByName(r, allowMissingColumns=True)
    u = scan.running(u, on, ["_ts", "_side", "_seq"], bucket, F.col("_r"), "last", "_found").where("_side = 1")
    return u.select(*on, *[F.col(f"_l.{c}").alias(c) for c in lcols], *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in rcols])


def join_on_snapshot(ticks: DataFrame, groups: DataFrame, on: str = "snap_ts_ns") -> DataFrame:
    return ticks.join(groups, on, "inner")


def last_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (drop duplicates, keep last)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def lookup(df: DataFrame, dim: DataFrame, on: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join to a dimension with defaults for what it lacks. The planner broadcasts the dimension if it is small."""
    out = df.join(dim, on, "left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out


def discover_groups(symbols: DataFrame, usd: tuple[str, ...] = ("USDT", "USDC", "USD")) -> DataFrame:
    """(venue, symbol) rows with base and quote to groups by base with at least two members; non-USD quotes are repriced by the quote's group."""
    g = symbols.select("venue", "symbol", "base", "quote").distinct()
    n = g.groupBy("base").agg(F.count("*").alias("n_members")).where("n_members >= 2")
    return g.join(n, "base").select(F.col("base").alias("grp"), "venue", "symbol", "n_members", F.when(~F.col("quote").isin(*usd), F.col("quote")).alias("reprice_group"))


def liquidity_factor(members: DataFrame, exponent: float = 0.75, grp: str = "grp", vol: str = "vol_24h", trust: str | None = None) -> DataFrame:
    """(max_vol / eff_vol) ** exponent within a group; unknown volumes count as 1 % of the largest; 1 where the largest is 0."""
    v = F.col(vol) * (F.coalesce(F.col(trust), F.lit(1.0)) if trust else F.lit(1.0))
    m = members.withColumn("_v", v).withColumn("_max", F.coalesce(F.max("_v").over(Window.partitionBy(grp)), F.lit(0.0)))
    eff = F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.col("_max") * 0.01)
    return m.withColumn("vol_adj", F.when(F.col("_max") > 0, F.pow(F.col("_max") / eff, F.lit(exponent))).otherwise(F.lit(1.0))).drop("_v", "_max")


def rank_members(members: DataFrame, grp: str = "grp", vol: str = "vol_24h", name: str = "venue") -> DataFrame:
    """Members with their rank by volume (descending), then name."""
    w = Window.partitionBy(grp).orderBy(F.col(vol).desc_nulls_last(), F.col(name))
    return members.withColumn("rank", F.row_number().over(w))


def forward_fill(df: DataFrame, cols: list[str], key: list[str], order: str) -> DataFrame:
    """Missing values from the row before, then those at the start from the first known one."""
    w = Window.partitionBy(*key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in cols})


def split_at_median(df: DataFrame, ts: str) -> DataFrame:
    """Adds part: train up to the median time, test after it."""
    m = df.agg(F.percentile(ts, 0.5).alias("_m"))
    return df.join(F.broadcast(m)).withColumn("part", F.when(F.col(ts) <= F.col("_m"), "train").otherwise("test")).drop("_m")


def expand_bars(samples: DataFrame, bars: DataFrame, bar_ns: int, key: list[str], ts: str, bar_ts: str) -> DataFrame:
    """Bar values on the samples inside each bar: an equi-join on the bar's start."""
    b = bars.withColumnRenamed(bar_ts, "_b")
    return samples.withColumn("_b", F.expr(f"`{ts}` DIV {bar_ns} * {bar_ns}")).join(b, [*key, "_b"], "left").drop("_b")
