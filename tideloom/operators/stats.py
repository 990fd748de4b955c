"""Cross-sectional statistics, noise estimates and the validation suite's tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_section(df: DataFrame, value: str = "log_mid", ts: str = "snap_ts_ns", venue: str = "venue", least: int = 2) -> DataFrame:
    """Median and mean over venues at each time with at least ``least`` venues; a venue's rows at one time are averaged first."""
    v = df.where(f"`{value}` IS NOT NULL").groupBy(ts, venue).agg(F.avg(value).alias("_v"))
    return v.groupBy(ts).agg(F.percentile("_v", 0.5).alias("median"), F.avg("_v").alias("mean"), F.count("*").alias("n_venues")).where(F.col("n_venues") >= least)


def cross_section_pivot(df: DataFrame, venues: list[str], value: str = "log_mid", ts: str = "snap_ts_ns", venue: str = "venue") -> DataFrame:
    """One column for each venue; the list of venues keeps it one pass."""
    return df.groupBy(ts).pivot(venue, venues).agg(F.avg(value))


def residuals(df: DataFrame, value: str = "log_mid", ts: str = "snap_ts_ns") -> DataFrame:
    return df.join(cross_section(df, value, ts), ts).withColumn("residual", F.col(value) - F.col("median"))


def rulers(df: DataFrame, value: str = "log_mid", rel_spread: str = "rel_spread", ts: str = "snap_ts_ns", venue: str = "venue", least: int = 500, floor: float = 1e-12) -> DataFrame:
    """Bias and noise variance of each venue: mean residual; sample variance less median(relative spread)^2 / 12, floored."""
    r = residuals(df, value, ts)
    g = r.groupBy(venue).agg(F.count("residual").alias("n"), F.avg("residual").alias("bias"), F.greatest(F.var_samp("residual") - F.pow(F.percentile(rel_spread, 0.5), 2) / 12, F.lit(floor)).alias("noise_var"))
    return g.where(F.col("n") >= least)


def residual_moments(df: DataFrame, value: str = "log_mid", ts: str = "snap_ts_ns", venue: str = "venue", least: int = 51, floor: float = 1e-14) -> DataFrame:
    g = residuals(df, value, ts).groupBy(venue).agg(F.count("residual").alias("n"), F.avg("residual").alias("bias"), F.greatest(F.var_pop("residual"), F.lit(floor)).alias("noise_var"))
    return g.where(F.col("n") >= least)


def noise_by_autocov(df: DataFrame, r: str, key: list[str], order: list[str], floor: float = 1e-12) -> DataFrame:
    """noise = max(-2 cov(r_t, r_t+1), 0) and signal = max(var_pop - noise, floor)."""
    d = df.where(f"`{r}` IS NOT NULL").withColumn("_n", F.lead(r).over(Window.partitionBy(*key).orderBy(*order)))
    g = d.groupBy(*key).agg(F.covar_pop(r, "_n").alias("_c"), F.var_pop(r).alias("_v"), F.count("*").alias("n"))
    g = g.withColumn("noise_var", F.greatest(-2 * F.col("_c"), F.lit(0.0)))
    return g.select(*key, "n", "noise_var", F.greatest(F.col("_v") - F.col("noise_var"), F.lit(floor)).alias("signal_var"))


def _lag_sums(df: DataFrame, x: str, lags: list[int], key: list[str], order: list[str]) -> DataFrame:
    """n, sum of squares s0 and lagged products s<k> of the centred series: two aggregations whatever the number of lags."""
    d = df.where(f"`{x}` IS NOT NULL")
    m = d.groupBy(*key).agg(F.avg(x).alias("_m"))
    w = Window.partitionBy(*key).orderBy(*order)
    d = d.join(m, key).withColumn("_x", F.col(x) - F.col("_m"))
    d = d.select(*key, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in lags])
    return d.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("s0"), *[F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"s{k}") for k in lags])


def acf(df: DataFrame, x: str, lags: int, key: list[str], order: list[str]) -> DataFrame:
    """(lag, acf) for lags 1..n of each key."""
    s = _lag_sums(df, x, list(range(1, lags + 1)), key, order)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}"), F.col("s0")).alias("acf")) for k in range(1, lags + 1)])
    return s.select(*key, F.explode(pairs).alias("p")).select(*key, "p.lag", "p.acf")


def acf_halflife(a: DataFrame, key: list[str]) -> DataFrame:
    """First lag whose autocorrelation is below 0.5 (NULL if none is)."""
    return a.groupBy(*key).agg(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))).alias("halflife"))


def acf_fft(df: DataFrame, x: str, lags: int, key: list[str], order: list[str]) -> DataFrame:
    """As ``acf`` for many lags, by one FFT a key."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", lag int, acf double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[x].dropna().to_numpy()
        v = v - v.mean() if len(v) else v
        n = 1 << max(1, 2 * len(v) - 1).bit_length()
        c = np.fft.irfft(np.abs(np.fft.rfft(v, n)) ** 2, n)[: lags + 1]
        k = np.arange(1, min(lags, len(v) - 1) + 1)
        out = pd.DataFrame({"lag": k, "acf": c[k] / c[0] if len(v) and c[0] > 0 else np.full(len(k), np.nan)})
        for name in key:
            out.insert(0, name, pdf[name].iloc[0])
        return out[[*key, "lag", "acf"]]

    return df.groupBy(*key).applyInPandas(run, schema)


def chi2_sf_even(q: Column, df: int) -> Column:
    """Survival of chi-squared with an even number of degrees: exp(-q/2) sum (q/2)^i / i!."""
    h, total, term = q / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


def _ljung_q(lags: int) -> Column:
    q = sum(((F.col(f"s{k}") / F.col("s0")) * (F.col(f"s{k}") / F.col("s0")) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return F.col("n") * (F.col("n") + 2) * q


def ljung_box(df: DataFrame, x: str, lags: int, key: list[str], order: list[str]) -> DataFrame:
    """Q = n (n + 2) sum acf_k^2 / (n - k), with its p value for an even number of lags."""
    s = _lag_sums(df, x, list(range(1, lags + 1)), key, order).where(f"n > {lags} AND s0 > 0")
    out = s.select(*key, "n", _ljung_q(lags).alias("q"))
    return out.withColumn("p_value", chi2_sf_even(F.col("q"), lags)) if lags % 2 == 0 else out


def variance_ratio(df: DataFrame, r: str, horizons: list[int], key: list[str], order: list[str]) -> DataFrame:
    """VR(q) = var(q-sums) / (q var(r)) over non-overlapping sums; a chunk that ends exactly at the series' end is left out, and 10 are needed."""
    d = df.where(f"`{r}` IS NOT NULL").withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    base = d.groupBy(*key).agg(F.count("*").alias("_n"), F.var_pop(r).alias("_v"))
    d = d.select(*key, "_p", F.col(r).alias("_r"), F.explode(F.array(*map(F.lit, horizons))).alias("q")).withColumn("_c", F.expr("_p DIV q"))
    c = d.groupBy(*key, "q", "_c").agg(F.sum("_r").alias("_s"), F.max("_p").alias("_e")).join(base, key).where("(_c + 1) * q < _n")
    g = c.groupBy(*key, "q").agg(F.count("*").alias("n_chunks"), F.var_pop("_s").alias("_vs"), F.first("_v").alias("_v"))
    return g.where("n_chunks >= 10 AND _v > 0").select(*key, "q", "n_chunks", (F.col("_vs") / (F.col("q") * F.col("_v"))).alias("vr"))


def signature(df: DataFrame, r: str, horizons: list[int], key: list[str], order: list[str]) -> DataFrame:
    return variance_ratio(df, r, horizons, key, order)


def ols(df: DataFrame, y: str, x: str, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def moments(df: DataFrame, x: str, key: list[str]) -> DataFrame:
    """Mean t statistic, variance, raw kurtosis, skewness and Jarque-Bera."""
    g = df.groupBy(*key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_sd"), F.var_samp(x).alias("variance"), (F.kurtosis(x) + 3).alias("kurtosis"), F.skewness(x).alias("skewness"))
    return g.withColumn("t_stat", F.try_divide("mean", F.col("_sd") / F.sqrt("n"))).withColumn("jarque_bera", F.col("n") / 6 * (F.pow("skewness", 2) + F.pow(F.col("kurtosis") - 3, 2) / 4)).drop("_sd")


def coverage(df: DataFrame, y: str, p: str, horizons: list[int], key: list[str], order: list[str], h: float = 0.0, step_ms: float = 1.0, least: int = 100) -> DataFrame:
    """Share of k-step changes within one and two predicted deviations sqrt(p + h k step)."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.select(*key, *[((F.lead(y, k).over(w) - F.col(y)) / F.sqrt(F.nullif(F.col(p) + h * k * step_ms, F.lit(0.0)))).alias(f"_z{k}") for k in horizons])
    z = d.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_z{k}").alias("z")) for k in horizons])).alias("e")).select(*key, "e.k", "e.z").where("z IS NOT NULL")
    return z.groupBy(*key, "k").agg(F.count("*").alias("n"), F.avg((F.abs("z") < 1).cast("double")).alias("within_1"), F.avg((F.abs("z") < 2).cast("double")).alias("within_2")).where(F.col("n") >= least)


def decile_ratio(df: DataFrame, forecast: str, actual: str, key: list[str], bins: int = 10) -> DataFrame:
    """Mean actual over mean forecast in quantile bins of the forecast, right-closed at interpolated edges (not ntile)."""
    qs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    e = df.groupBy(*key).agg(F.percentile(forecast, qs).alias("_e")) if key else df.agg(F.percentile(forecast, qs).alias("_e"))
    d = df.join(e, key) if key else df.join(F.broadcast(e))  # without keys the edges are one row
    d = d.withColumn("bin", F.expr(f"CAST(least(greatest(size(filter(_e, x -> x < `{forecast}`)), 1), {bins}) AS INT) - 1"))
    return d.groupBy(*key, "bin").agg(F.count("*").alias("n"), F.try_divide(F.avg(actual), F.avg(forecast)).alias("ratio"))


def _with_next(groups: DataFrame, on: str, keys: list[str], horizon: int, step: int | None) -> DataFrame:
    """``groups`` (keys, on, y) with _n, the y ``horizon`` steps later: by an equi-join where the grid's ``step`` is given, else the row ``horizon`` rows on."""
    if step:
        later = groups.select(*keys, (F.col(on) - horizon * step).alias(on), F.col("y").alias("_n"))
        return groups.select(*keys, on, "y").join(later, [*keys, on], "left")
    return groups.select(*keys, on, "y", F.lead("y", horizon).over(Window.partitionBy(*keys).orderBy(on)).alias("_n"))


def _residuals(ticks: DataFrame, groups: DataFrame, on: str, horizon: int, step: int | None) -> DataFrame:
    """Ticks with _e, what they are off the group's y, and _d, the group's next return."""
    keys = ["grp"] if "grp" in groups.columns else []
    by = [*keys, on] if "grp" in ticks.columns else [on]
    j = ticks.join(_with_next(groups, on, keys, horizon, step), by)
    return j.withColumn("_e", F.col("log_mid") - F.col("y")).withColumn("_d", F.col("_n") - F.col("y"))


def member_report(ticks: DataFrame, groups: DataFrame, on: str = "snap_ts_ns", member: str = "venue", horizon: int = 1, step: int | None = None) -> DataFrame:
    """Bias error, noise ratio, edge slope and hit rate of each member: ticks (log_mid, s) against group rows (y).

    Give the grid's ``step``, or groups with a key grp: without either the next row is found by one sort of all groups' rows.
    """
    return _residuals(ticks, groups, on, horizon, step).groupBy(member).agg(
        F.count("*").alias("n"), F.avg("_e").alias("bias_error"), F.try_divide(F.var_samp("_e"), F.avg("s")).alias("noise_ratio"), F.regr_slope("_d", "_e").alias("edge_beta"),
        F.avg(F.when((F.col("_e") != 0) & (F.col("_d") != 0), (F.signum("_e") == F.signum("_d")).cast("double"))).alias("hit_rate"),
    )


def residual_r2(ticks: DataFrame, groups: DataFrame, on: str = "snap_ts_ns", member: str = "venue", horizon: int = 1, step: int | None = None, least: int = 100) -> DataFrame:
    """How much of the fair price's next return each member's residual explains: n and r2 (0 is best: nothing is left in the residual).

    NULL under ``least`` pairs; 0 where the return or the residual doesn't vary.
    """
    j = _residuals(ticks, groups, on, horizon, step).where("_e IS NOT NULL AND NOT isnan(_e) AND _d IS NOT NULL AND NOT isnan(_d)")
    g = j.groupBy(member).agg(F.count("*").alias("n"), F.regr_r2("_d", "_e").alias("_r2"), F.regr_syy("_d", "_e").alias("_syy"), F.regr_sxx("_d", "_e").alias("_sxx"))
    return g.select(member, "n", F.when(F.col("n") < least, None).when(F.expr("_syy < 1e-30 OR _sxx <= 0"), 0.0).otherwise(F.col("_r2")).alias("r2"))


def residual_summary(r2: DataFrame) -> DataFrame:
    """Mean and greatest r2 over the members of ``residual_r2``."""
    return r2.agg(F.count("r2").alias("n_members"), F.avg("r2").alias("r2_mean"), F.max("r2").alias("r2_max"))


def block_error(df: DataFrame, h: str, r2: str, block: int, key: list[str], order: list[str]) -> DataFrame:
    """Mean relative error of block means of h against r2 over whole blocks (a last exact one is left out)."""
    d = df.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key))).withColumn("_b", F.expr(f"_p DIV {block}"))
    b = d.where(f"(_b + 1) * {block} < _n").groupBy(*key, "_b").agg(F.avg(h).alias("_h"), F.avg(r2).alias("_r")).where("_r > 0")
    return b.groupBy(*key).agg(F.count("*").alias("n_blocks"), F.avg(F.abs(F.col("_h") - F.col("_r")) / F.col("_r")).alias("tracking_error"))


def message_rate(df: DataFrame, key: list[str], ts: str, step_ns: int, alpha: float = 0.15) -> DataFrame:
    """EWMA of messages per second over fixed steps of each key."""
    from . import folds

    c = df.groupBy(*key, F.expr(f"`{ts}` DIV {step_ns}").alias("bucket")).agg((F.count("*") / (step_ns / 1e9)).alias("rate"))
    return folds.scan(c, key, ["bucket"], ["rate"], folds.Ewma(alpha), {"ewma_rate": "double"}, 1 << 16)


def order_stats(df: DataFrame, x: str, key: list[str], qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: the value at place int(n q) of the sorted ones; floor is half of the smallest."""
    s = df.where(f"`{x}` IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(x)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    pick = [F.max(F.when(F.col("_k") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(x))).alias(f"p{str(q)[2:]}") for q in qs]
    return s.groupBy(*key).agg(F.count("*").alias("n"), F.min(x).alias("least"), (F.min(x) / 2).alias("floor"), *pick, F.max(x).alias("most"))


def score(df: DataFrame, r: str, key: list[str], order: list[str], lags: int = 10, horizons: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """ACF(1), Ljung-Box and variance ratios of a fair-price return series, one row a key."""
    s = _lag_sums(df, r, list(range(1, lags + 1)), key, order)  # both statistics read these sums
    q = F.when((F.col("n") > lags) & (F.col("s0") > 0), _ljung_q(lags))
    a = s.select(*key, F.try_divide("s1", "s0").alias("acf_1"), q.alias("lb_q"))
    a = a.withColumn("p_value", chi2_sf_even(F.col("lb_q"), lags)) if lags % 2 == 0 else a
    v = variance_ratio(df, r, list(horizons), key, order).groupBy(*key).pivot("q", list(horizons)).agg(F.first("vr"))
    v = v.select(*key, *[F.col(str(h)).alias(f"vr_{h}") for h in horizons])
    return a.join(v, key, "left")
