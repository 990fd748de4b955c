"""Calibration and study: GARCH fits and EM rulers (a group is one pandas group), filter and smoother by buckets of steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gaussian, stats

def variance_lanes(returns: np.ndarray, alpha, beta, noise: float, target: float, paths: bool = False) -> np.ndarray:
    """Variance-targeted GARCH(1,1) with additive noise for many (alpha, beta) at once: one pass over the returns, one lane a pair.

    Gaussian negative log-likelihoods by lane (infinite outside the constraints), or with ``paths`` the variances before each return.
    """
    alpha, beta = np.broadcast_arrays(np.atleast_1d(np.asarray(alpha, float)), np.atleast_1d(np.asarray(beta, float)))
    squares = returns * returns
    news = np.maximum(squares - noise, 0.0)
    anchor, level = target * (1 - alpha - beta), np.full(alpha.shape, float(target))
    cost, seen = np.zeros(alpha.shape), np.empty((len(returns), *alpha.shape) if paths else (0,))
    with np.errstate(all="ignore"):  # lanes outside the constraints
        for i in range(len(returns)):
            if paths:
                seen[i] = level
            else:
                cost += np.log(level + noise) + squares[i] / (level + noise)
            level = anchor + alpha * news[i] + beta * level
    if paths:
        return seen
    allowed = (alpha > 0) & (beta > 0) & (alpha + beta < 0.9999) & np.isfinite(cost)
    return np.where(allowed, cost / 2, np.inf)


def nelder_mead(f, start: np.ndarray, size: float = 0.01, steps: int = 200, tol: float = 1e-8) -> np.ndarray:
    n = len(start)
    pts = [np.array(start, float)] + [np.array(start, float) + size * np.eye(n)[i] for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol * (1 + abs(vals[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        refl = mid + (mid - pts[-1])
        fr = f(refl)
        if fr < vals[0]:
            ext = mid + 2 * (mid - pts[-1])
            fe = f(ext)
            pts[-1], vals[-1] = (ext, fe) if fe < fr else (refl, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = refl, fr
        else:
            con = mid + 0.5 * (pts[-1] - mid)
            fc = f(con)
            if fc < vals[-1]:
                pts[-1], vals[-1] = con, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def garch_grid(returns: DataFrame, key: str = "grp", r: str = "log_return", order: str = "snap_ts_ns", alphas=None, betas=None, floor: float = 1e-12) -> DataFrame:
    """Likelihood of every allowed (alpha, beta) of the grid for each group, all in one pass over the group's returns.

    Noise and signal variances come from the lag-1 autocovariance.
    """
    alphas = np.asarray(alphas if alphas is not None else np.round(np.arange(0.01, 0.16, 0.01), 4), float)
    betas = np.asarray(betas if betas is not None else np.round(np.arange(0.80, 0.99, 0.01), 4), float)
    a, b = (x.ravel() for x in np.meshgrid(alphas, betas, indexing="ij"))
    a, b = a[a + b < 0.9999], b[a + b < 0.9999]
    base = stats.noise_by_autocov(returns, r, [key], [order], floor)
    d = returns.where(F.col(r).isNotNull()).select(key, order, F.col(r).alias("_r")).join(base.select(key, "noise_var", "signal_var"), key)

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)["_r"].to_numpy()
        return pd.DataFrame({key: k[0], "alpha": a, "beta": b, "nll": variance_lanes(x, a, b, pdf["noise_var"].iloc[0], pdf["signal_var"].iloc[0])})

    kind = dict(returns.dtypes)[key]
    return d.groupBy(key).applyInPandas(run, f"`{key}` {kind}, alpha double, beta double, nll double")


def garch_fit(returns: DataFrame, key: str = "grp", r: str = "log_return", order: str = "snap_ts_ns", refine: bool = True, **grid) -> DataFrame:
    """Best grid point of each group, refined by Nelder-Mead and clipped to alpha in [.005, .25] and beta in [.70, .995]."""
    g = garch_grid(returns, key, r, order, **grid)
    best = g.groupBy(key).agg(F.min(F.struct("nll", "alpha", "beta")).alias("_b")).select(key, F.col("_b.alpha").alias("alpha0"), F.col("_b.beta").alias("beta0"), F.col("_b.nll").alias("nll0"))
    base = stats.noise_by_autocov(returns, r, [key], [order])
    d = returns.where(F.col(r).isNotNull()).select(key, order, F.col(r).alias("_r")).join(best, key).join(base.select(key, "noise_var", "signal_var"), key)

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        x, one = pdf.sort_values(order)["_r"].to_numpy(), pdf.iloc[0]
        a, b, nll = one.alpha0, one.beta0, one.nll0
        if refine:
            loss = lambda p: float(variance_lanes(x, p[0], p[1], one.noise_var, one.signal_var)[0])
            got = nelder_mead(loss, np.array([a, b]))
            a, b = float(np.clip(got[0], 0.005, 0.25)), float(np.clip(got[1], 0.70, 0.995))
            nll = loss((a, b))
        return pd.DataFrame([(k[0], a, b, one.signal_var * (1 - a - b), one.noise_var, nll)], columns=[key, "alpha", "beta", "omega", "noise_var", "nll"])

    kind = dict(returns.dtypes)[key]
    return d.groupBy(key).applyInPandas(run, f"`{key}` {kind}, alpha double, beta double, omega double, noise_var double, nll double")


def constant_vol(returns: DataFrame, key: str = "grp", r: str = "log_return") -> DataFrame:
    return returns.groupBy(key).agg(F.var_pop(r).alias("h"))


def ewma_vol(returns: DataFrame, alpha: float, key: str = "grp", r: str = "log_return", order: str = "snap_ts_ns") -> DataFrame:
    from . import folds
    from .scan import DAY_NS

    d = returns.where(F.col(r).isNotNull()).withColumn("_r2", F.col(r) * F.col(r))
    return folds.scan(d, [key], [order], ["_r2"], folds.Ewma(alpha), {"h": "double"}, 8 * DAY_NS).drop("_r2")


def har_path(samples: DataFrame, bar_ns: int, expected: int, windows: list[int], betas: list[float], intercept: float, key: str = "grp") -> DataFrame:
    """HAR variance on return bars, each bar's forecast from the bars before it, filled forward, on the samples inside the next bar."""
    from .bars import return_bars
    from .joins import expand_bars, forward_fill

    b = return_bars(samples, bar_ns, expected, key=(key,))
    w = Window.partitionBy(key).orderBy("bar_ts_ns")
    x = F.lit(float(intercept))
    for n, be in zip(windows, betas):
        s = F.sum("gk").over(w.rowsBetween(-(n - 1), 0))
        x = x + float(be) * F.when((F.row_number().over(w) >= n) & (s > 0), F.ln(s))
    b = b.withColumn("_x", x).withColumn("har_h", F.lag(F.exp("_x")).over(w)).select(key, "bar_ts_ns", "har_h")
    return expand_bars(samples, forward_fill(b, ["har_h"], [key], "bar_ts_ns"), bar_ns, [key], "snap_ts_ns", "bar_ts_ns")


def observations(quotes: DataFrame, key: str = "grp", venue: str = "venue", ts: str = "snap_ts_ns") -> DataFrame:
    """Observations with the age of each quote in steps: steps since the venue's price last changed."""
    steps = Window.partitionBy(key).orderBy(ts)
    w = Window.partitionBy(key, venue).orderBy(ts)
    d = quotes.withColumn("step", F.dense_rank().over(steps) - 1)
    d = d.withColumn("_new", F.lag("log_mid").over(w).isNull() | (F.col("log_mid") != F.lag("log_mid").over(w)))
    last = F.max(F.when(F.col("_new"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("age", F.greatest(F.col("step") - last, F.lit(0)).cast("int")).drop("_new")


def smooth(step: np.ndarray, z: np.ndarray, r: np.ndarray, h: float, backward: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Scalar Kalman filter over steps (several observations in one step allowed) and the Rauch-Tung-Striebel pass: mean and variance by step."""
    n = int(step.max()) + 1 if len(step) else 0
    m, p, mp, pp = (np.zeros(n) for _ in range(4))
    x, v, begun, at = 0.0, 0.0, False, 0
    for s in range(n):
        if begun:
            v += h
        mp[s], pp[s] = x, v
        while at < len(step) and step[at] == s:
            if not begun:
                x, v, begun = z[at], r[at], True
                mp[s], pp[s] = x, v
            else:
                g = v / (v + r[at])
                x += g * (z[at] - x)
                v *= 1 - g
            at += 1
        m[s], p[s] = x, v
    if backward:
        for s in range(n - 2, -1, -1):
            if pp[s + 1] > 0:
                c = p[s] / pp[s + 1]
                m[s] += c * (m[s + 1] - mp[s + 1])
                p[s] += c * c * (p[s + 1] - pp[s + 1])
    return m, p


def _arrays(pdf: pd.DataFrame, venues: list[str]):
    pdf = pdf.sort_values(["step", "venue"], kind="stable")
    at = {v: i for i, v in enumerate(venues)}
    return pdf["step"].to_numpy(), pdf["venue"].map(at).to_numpy(), pdf["log_mid"].to_numpy(), pdf["age"].to_numpy()


def fit_rulers_em(obs: DataFrame, h: float, iterations: int = 30, key: str = "grp", floor: float = 1e-14) -> DataFrame:
    """(bias, sigma2) of each venue by EM: smooth with the present rulers, re-estimate them, centre the biases. One task a group."""
    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        venues = sorted(pdf["venue"].unique())
        step, v, z, age = _arrays(pdf, venues)
        bias, s2 = np.zeros(len(venues)), np.full(len(venues), 1e-8)
        n = np.bincount(v, minlength=len(venues))
        for _ in range(iterations):
            m, p = smooth(step, z - bias[v], s2[v] + h * age, h)
            e = z - m[step]
            bias = np.bincount(v, weights=e, minlength=len(venues)) / n
            bias -= bias.mean()
            s2 = np.maximum(np.bincount(v, weights=(e - bias[v]) ** 2 + p[step] - h * age, minlength=len(venues)) / n, floor)
        return pd.DataFrame({key: k[0], "venue": venues, "bias": bias, "noise_var": s2, "n": n})

    kind = dict(obs.dtypes)[key]
    return obs.select(key, "venue", "step", "log_mid", "age").groupBy(key).applyInPandas(run, f"`{key}` {kind}, venue string, bias double, noise_var double, n long")


def replay(obs: DataFrame, rulers: DataFrame, h: float, key: str = "grp", backward: bool = False, width: int = 4096) -> DataFrame:
    """(step, y, p) of each group with fitted rulers; ``backward`` adds the smoother's pass. Buckets of ``width`` steps run in parallel."""
    d = obs.select(key, "venue", "step", "log_mid", "age").join(rulers.select(key, "venue", "bias", "noise_var"), [key, "venue"])
    d = d.withColumn("z", F.col("log_mid") - F.col("bias")).withColumn("r", F.col("noise_var") + h * F.col("age"))
    f = gaussian.filter_level(d, key, h, width)
    return (gaussian.smooth_level(f, key, h) if backward else f).drop("_bk")


def compare(models: dict[str, DataFrame], key: str = "grp", y: str = "y", order: str = "step") -> DataFrame:
    """Scores of several fair-price series, in sample and out of it (halves by order)."""
    out = None
    for name, df in models.items():
        w = Window.partitionBy(key).orderBy(order)
        half = F.percentile(order, 0.5).over(Window.partitionBy(key))
        d = df.withColumn("r", F.col(y) - F.lag(y).over(w)).withColumn("part", F.when(F.col(order) <= half, "in").otherwise("out"))
        s = stats.score(d, "r", [key, "part"], [order]).withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out
