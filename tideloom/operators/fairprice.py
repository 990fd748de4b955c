"""Cross-venue fair price: Gonzalo-Granger average (native), augmented Kalman filter (by buckets of time), quotes, reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds, gaussian
from .joins import asof_join
from .scan import DAY_NS

LN2 = float(np.log(2.0))


def observations(ticks: DataFrame, members: DataFrame) -> DataFrame:
    """Ticks of group members in log space: grp, venue, symbol, ts_ns, seq, log_mid, half_spread with the members' parameters.

    Time is the exchange's, else the receive time. Ticks without two positive sides are dropped.
    """
    m = ticks.where("bid > 0 AND ask > 0").select("venue", "symbol", "seq", F.coalesce("exchange_ts_ns", "received_ts_ns").alias("ts_ns"), "bid", "ask")
    m = m.withColumn("log_mid", F.ln((F.col("bid") + F.col("ask")) / 2)).withColumn("half_spread", F.ln(F.col("ask") / F.col("bid")) / 2)
    return m.join(members, ["venue", "symbol"])


def spread_ewma(obs: DataFrame, halflife_ms: float, bucket_ns: int = DAY_NS) -> DataFrame:
    key, order = ["grp", "venue", "symbol"], ["ts_ns", "seq"]
    began = obs.groupBy(*[F.col(k).alias(f"_b_{k}") for k in key]).agg(F.min("ts_ns").alias("_began"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in key])
    d = obs.join(began, same).drop(*[f"_b_{k}" for k in key])
    return folds.scan(d, key, order, ["half_spread", "ts_ns", "_began"], folds.SpreadEwma(halflife_ms), {"ewma_half_spread": "double"}, bucket_ns).drop("_began")


def noise_var(mode: str, floor: float = 0.0, scale: float = 1.0, liquidity: bool = False, half: str = "half_spread", ewma: str = "ewma_half_spread", static: str = "noise_var", adj: str = "vol_adj") -> Column:
    """Observation noise: instant, ewma or static; then the liquidity factor; then the scale. All but static are floored."""
    f2 = F.lit(float(floor) ** 2)
    v = {"instantspread": lambda: F.greatest(F.pow(half, F.lit(2.0)), f2), "ewmaspread": lambda: F.greatest(F.pow(ewma, F.lit(2.0)), f2), "static": lambda: F.col(static)}[mode.lower()]()
    if liquidity:
        v = F.greatest(F.pow(F.sqrt(v) * F.col(adj), F.lit(2.0)), f2)
    return v * float(scale) ** 2


def reprice(obs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Members with a reprice_group get its log fair price at or before the tick added (or themselves subtracted from it, if
    invert_reprice); ticks before its first price are dropped. ``quotes``: grp, snap_ts_ns, log_fair_price of groups evaluated before."""
    plain = obs.where("reprice_group IS NULL")
    q = quotes.select(F.col("grp").alias("reprice_group"), "snap_ts_ns", "log_fair_price")
    j = asof_join(obs.where("reprice_group IS NOT NULL"), q, ["reprice_group"], "ts_ns", "snap_ts_ns", prefix="_q_").where("_q_log_fair_price IS NOT NULL")
    j = j.withColumn("log_mid", F.when(F.coalesce("invert_reprice", F.lit(False)), F.col("_q_log_fair_price") - F.col("log_mid")).otherwise(F.col("log_mid") + F.col("_q_log_fair_price")))
    return plain.unionByName(j.select(*obs.columns))


def evaluation_order(deps: dict[str, set[str]]) -> list[str]:
    """Groups so that each comes after those it is repriced by; cycles are an error."""
    out: list[str] = []
    left = {g: set(d) for g, d in deps.items()}
    while left:
        ready = sorted(g for g, d in left.items() if not d & left.keys())
        if not ready:
            raise ValueError(f"groups depend on each other: {sorted(left)}")
        out += ready
        for g in ready:
            del left[g]
    return out


def gonzalo_granger(obs: DataFrame, step_ns: int, max_latency_ms: float = 0.0, halflife_ms: float = 0.0, h_per_ms: float = 0.0, noise: Column | None = None) -> DataFrame:
    """Weighted average of the members' newest log mids less their biases at each grid time; weights decay with age.

    Native: newest value by bucket, carry-forward, one weighted aggregation. Times at which the weights' sum is about 0 give no row.
    """
    from .snapshots import carry_forward

    key = ["grp", "venue", "symbol"]
    noise = noise_var("InstantSpread") if noise is None else noise
    o = obs.withColumn("_nv", noise).withColumn("_b", F.expr(f"(ts_ns - 1) DIV {step_ns}"))  # intervals open at their start
    b = o.groupBy(*key, "_b").agg(F.max_by(F.struct("ts_ns", "log_mid", "_nv", "bias", "gg_weight"), F.struct("ts_ns", "seq")).alias("_m"), F.count("*").alias("_n"))
    g = carry_forward(b, ["_m"], key).select("grp", ((F.col("_b") + 1) * step_ns).alias("snap_ts_ns"), "_m.*", "_n")
    age = (F.col("snap_ts_ns") - F.col("ts_ns")) / 1e6
    g = g.withColumn("_age", age)
    if max_latency_ms > 0:
        g = g.where(F.col("_age") <= max_latency_ms)
    w = F.col("gg_weight") * (F.exp(-F.col("_age") * LN2 / halflife_ms) if halflife_ms > 0 else F.lit(1.0))
    g = g.withColumn("_w", w).groupBy("grp", "snap_ts_ns").agg(F.sum(F.col("_w") * (F.col("log_mid") - F.col("bias"))).alias("_y"), F.sum(F.col("_w") * F.col("_w") * F.col("_nv")).alias("_p"), F.sum("_w").alias("_s"), F.min("_age").alias("_fresh"), F.coalesce(F.sum("_n"), F.lit(0)).cast("int").alias("n_ticks_used"))
    g = g.where("abs(_s) > 1e-30").select("grp", "snap_ts_ns", (F.col("_y") / F.col("_s")).alias("log_fair_price"), (F.col("_p") / (F.col("_s") * F.col("_s")) + F.greatest(F.col("_fresh"), F.lit(0.0)) * h_per_ms).alias("p"), "n_ticks_used")
    return output(g, h_per_ms)


def output(g: DataFrame, h_per_ms: float) -> DataFrame:
    """Adds fair_price = exp(y + p / 2), uncertainty in basis points and annual volatility in percent."""
    from ..functions.scalars import MS_PER_YEAR

    return g.withColumn("fair_price", F.exp(F.col("log_fair_price") + F.col("p") / 2)).withColumn("uncertainty_bps", F.sqrt("p") * 1e4).withColumn("vol_ann_pct", F.lit(float(np.sqrt(h_per_ms * MS_PER_YEAR)) * 100))


def gg_bias(obs: DataFrame, fair: DataFrame, halflife_ms: float, bucket_ns: int = DAY_NS) -> DataFrame:
    """Bias of each member by a weighted EWMA of its residuals against the fair price before it (off unless called)."""
    j = asof_join(obs, fair.select("grp", "snap_ts_ns", "log_fair_price"), ["grp"], "ts_ns", "snap_ts_ns", prefix="f_").where("f_log_fair_price IS NOT NULL")
    j = j.withColumn("_res", F.col("log_mid") - F.col("f_log_fair_price"))
    return folds.scan(j, ["grp", "venue", "symbol"], ["ts_ns", "seq"], ["_res", "ts_ns", "bias"], folds.BiasEwma(halflife_ms), {"bias_ewma": "double"}, bucket_ns).drop("_res")


def kalman(obs: DataFrame, step_ns: int, h_per_ms: float, h_bias_per_ms: float = 0.0, bias_init_p: float = 1e-6, noise: Column | None = None, rows: str = "snaps", bucket_ns: int = DAY_NS) -> DataFrame:
    """Augmented Kalman filter of each group: state (price, bias of each member). ``rows``: snaps or ticks (innovations).

    A group's history is filtered by buckets of about ``bucket_ns`` in parallel. Members are numbered by (venue, symbol).
    """
    noise = noise_var("InstantSpread") if noise is None else noise
    out = gaussian.filter_groups(obs, step_ns, h_per_ms, h_bias_per_ms, bias_init_p, noise, rows, bucket_ns)
    return output(out, h_per_ms) if rows == "snaps" else out


def fair_quotes(ticks: DataFrame, members: DataFrame, fair: DataFrame, h_per_ms: float = 0.0, horizon_ms: float = 0.0, join=asof_join) -> DataFrame:
    """Edges of each member tick against the fair price at or before it, in basis points; missing prices give NULLs.

    Inverted members are quoted inverted: sides and quantities change places. ``join``: ``streaming.processors.asof`` where both are streams.
    """
    m = ticks.join(members, ["venue", "symbol"]).withColumn("ts_ns", F.coalesce("exchange_ts_ns", "received_ts_ns"))
    inv = F.coalesce("invert_reprice", F.lit(False)) if "invert_reprice" in m.columns else F.lit(False)
    m = m.withColumn("_inv", inv)
    m = m.withColumns({"_bid": F.when(F.col("_inv"), 1 / F.col("ask")).otherwise(F.col("bid")), "_ask": F.when(F.col("_inv"), 1 / F.col("bid")).otherwise(F.col("ask")), "_bq": F.when(F.col("_inv"), F.col("ask_qty")).otherwise(F.col("bid_qty")), "_aq": F.when(F.col("_inv"), F.col("bid_qty")).otherwise(F.col("ask_qty"))})
    j = join(m.select("grp", "venue", "symbol", "seq", "ts_ns", "bias", "_bid", "_ask", "_bq", "_aq"), fair.select("grp", "snap_ts_ns", "log_fair_price", "p"), ["grp"], "ts_ns", "snap_ts_ns", prefix="f_")
    f = F.exp(F.col("f_log_fair_price") + F.col("bias") + F.col("f_p") / 2)
    j = j.withColumn("fair_at_venue", f).withColumn("_mid", (F.col("_bid") + F.col("_ask")) / 2)
    e = lambda x: x / F.col("fair_at_venue") * 1e4
    return j.select(
        "grp", "venue", "symbol", "seq", "ts_ns", F.col("_bid").alias("bid"), F.col("_ask").alias("ask"), F.col("_bq").alias("bid_qty"), F.col("_aq").alias("ask_qty"), "fair_at_venue",
        e(F.col("fair_at_venue") - F.col("_bid")).alias("edge_bid_bps"), e(F.col("_ask") - F.col("fair_at_venue")).alias("edge_ask_bps"), e(F.col("_mid") - F.col("fair_at_venue")).alias("edge_mid_bps"),
        (F.sqrt(F.col("f_p") + h_per_ms * horizon_ms) * 1e4).alias("uncertainty_bps"),
    )


def fair_table(quotes: DataFrame, as_of_ns: int, h_per_ms: float = 0.0) -> DataFrame:
    """The newest quote of each member: edge, half spread, trade edge, highlight above 5 basis points, age."""
    from .joins import last_per

    q = last_per(quotes, ["grp", "venue", "symbol"], ["ts_ns", "seq"])
    half = (F.col("ask") - F.col("bid")) / (F.col("ask") + F.col("bid")) * 1e4
    q = q.withColumn("half_spread_bps", half).withColumn("trade_edge_bps", F.greatest(F.abs("edge_mid_bps") - F.col("half_spread_bps"), F.lit(0.0)))
    age = (F.lit(as_of_ns) - F.col("ts_ns")) / 1e6
    return q.select("grp", "venue", "symbol", "fair_at_venue", "edge_mid_bps", "half_spread_bps", "trade_edge_bps", (F.col("trade_edge_bps") > 5).alias("highlight"), age.alias("age_ms"), (F.sqrt(F.pow(F.col("uncertainty_bps") / 1e4, 2) + h_per_ms * age) * 1e4).alias("venue_uncertainty_bps"))


def history(fair: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("grp").orderBy(F.col("snap_ts_ns").desc())
    return fair.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def latest(fair: DataFrame) -> DataFrame:
    return history(fair, 1).drop("rn")
