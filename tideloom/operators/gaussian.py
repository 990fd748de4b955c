"""Linear-Gaussian filters and smoothers by buckets of time, so that one group's history runs in many tasks.

A bucket is folded to one element: given the state x before it, the state after it is N(a x + b, c); further what the bucket's observations
say of x (information vector and matrix for one level, their root for price and biases). An element is what the filter itself gives
when started from a known state (variance 0) while it carries the sensitivity to that state. Elements are applied to the state in order, one
row a bucket; then each bucket is replayed from the state before it. Smoothing is affine in the next step's smoothed state, so it composes
the same way from the last bucket to the first. Buckets without rows are replayed too: their intervals are predicted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least variance of an innovation while a bucket is folded: an observation without noise has no finite information.
TINY = 1e-18

MEMBER = ["venue", "symbol", "bias", "noise_var"]


def by_buckets(d: DataFrame, key: list[str], bucket: str, maps: str, fold, starts: str, before, rows: str, replay) -> DataFrame:
    """``replay(rows of a bucket, state before it)`` of every bucket of a key; ``fold`` gives a bucket's map, ``before`` the states.

    Both passes over the rows read one shuffle by (key, bucket). ``before`` sees a key's maps, one row a bucket, and may add buckets
    that have no rows.
    """
    by = [*key, bucket]
    d = d.repartition(*by)
    st = d.groupBy(*by).applyInPandas(fold, maps).groupBy(*key).applyInPandas(before, starts)
    return d.groupBy(*by).cogroup(st.groupBy(*by)).applyInPandas(replay, rows)


# --- price and biases of a group -------------------------------------------------------------------------------------------------


def observe(x: np.ndarray, p: np.ndarray, k: int, z: float, r: float) -> tuple[float, float, np.ndarray]:
    """One observation z = x[0] + x[k] + noise, in place. Returns innovation, S and the gain."""
    innovation = z - x[0] - x[k]
    s = p[0, 0] + p[0, k] + p[k, 0] + p[k, k] + r
    gain = (p[:, 0] + p[:, k]) / s
    x += gain * innovation
    p -= np.outer(gain, p[0] + p[k])
    p += p.T.copy()
    p *= 0.5
    return innovation, s, gain


def _grow(p: np.ndarray, ms: float, h: float, h_bias: float) -> None:
    """The variances after ``ms`` milliseconds, in place."""
    d = np.einsum("ii->i", p)
    d[0] += h * ms
    d[1:] += h_bias * ms


def _triangle(m: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` rows of R in m = Q R. Heavy rows come first: Householder's steps keep what the light ones say."""
    r = np.linalg.qr(m[np.argsort(-np.abs(m).max(axis=1), kind="stable")], mode="r")[:n]
    return np.vstack([r, np.zeros((n - len(r), m.shape[1]))])


def element(ts, member, z, noise, n: int, end: int, h: float, h_bias: float):
    """(a, b, c, y, u) from the state just before the first tick to that at ``end``; ``member`` counts from 1.

    What the ticks say of the state before them is u x = y + unit noise: a root, since ticks without noise say very much of it.
    """
    a, b, c, at = np.eye(n), np.zeros(n), np.zeros((n, n)), int(ts[0])
    said = np.empty((len(ts), n + 1))
    for i, (t, k, lm, r) in enumerate(zip(ts.tolist(), member.tolist(), z.tolist(), noise.tolist())):
        _grow(c, max((t - at) / 1e6, 0.0), h, h_bias)
        seen = a[0] + a[k]
        r = max(r, TINY - (c[0, 0] + 2 * c[0, k] + c[k, k]))
        e, s, gain = observe(b, c, k, lm, r)
        said[i, :n], said[i, n] = seen, e
        said[i] /= np.sqrt(s)
        a -= np.outer(gain, seen)
        at = t
    _grow(c, max((end - at) / 1e6, 0.0), h, h_bias)
    u = _triangle(said, n)
    return a, b, c, u[:, n], u[:, :n]


def apply_element(x: np.ndarray, p: np.ndarray, e) -> tuple[np.ndarray, np.ndarray]:
    """The state after a bucket from the one just before its first tick: x + root w with w of unit variance, least squares for w."""
    a, b, c, y, u = e
    n = len(x)
    d, v = np.linalg.eigh(p)
    root = v * np.sqrt(np.maximum(d, 0.0))
    t = _triangle(np.vstack([np.column_stack([u @ root, y - u @ x]), np.eye(n, n + 1)]), n)
    w = np.linalg.solve(t[:, :n], np.column_stack([t[:, n], np.eye(n)]))
    spread = a @ root @ w[:, 1:]
    return a @ (x + root @ w[:, 0]) + b, spread @ spread.T + c


def _widen(e, idx: list[int], n: int, ms: float, h_bias: float):
    """An element of a bucket's own members among all ``n`` states; the others' biases only drift."""
    a, b, c, y, u = np.eye(n), np.zeros(n), np.eye(n) * h_bias * ms, np.zeros(n), np.zeros((n, n))
    at = np.ix_(idx, idx)
    a[at], b[idx], c[at], y[idx], u[at] = e
    return a, b, c, y, u


MAPS = "grp string, _bk long, first_ns long, last_ns long, z0 double, k0 long, members array<string>, bias array<double>, noise_var array<double>, a array<double>, b array<double>, c array<double>, y array<double>, u array<double>"
STARTS = "grp string, _bk long, lo long, hi long, members array<string>, bias array<double>, noise_var array<double>, x array<double>, p array<double>"
TICK_ROWS = "grp string, snap_ts_ns long, tick_ts_ns long, member_idx long, log_mid double, tau_ms double, q double, p_pre double, innovation double, s double, gain double, y_post double, p_post double"
SNAP_ROWS = "grp string, snap_ts_ns long, log_fair_price double, p double, p_pre double, p_pre_fwd double, tau_fwd_ms double, n_ticks_used long, last_tick_ts_ns long, biases array<double>"


def _names(pdf: pd.DataFrame) -> pd.Series:
    """A member's name; its order is that of (venue, symbol)."""
    return pdf["venue"] + "\x00" + pdf["symbol"]


def _columns(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(_m=_names(pdf)).sort_values(["ts_ns", "_m", "seq"], kind="stable", ignore_index=True)


def filter_groups(obs: DataFrame, step_ns: int, h: float, h_bias: float, bias_init_p: float, noise: Column, rows: str, bucket_ns: int) -> DataFrame:
    """Rows by snapshot or by tick (``rows``) of the filter over (price, bias of each member) of each ``grp``.

    A bucket is a whole number of intervals, about ``bucket_ns``. Ticks without a time or a price are left out.
    """
    per = max(1, bucket_ns // step_ns)
    d = obs.withColumn("noise", noise).where("ts_ns IS NOT NULL AND log_mid IS NOT NULL")
    d = d.select("grp", *MEMBER, "ts_ns", "seq", "log_mid", "noise", F.expr(f"(ts_ns - 1) DIV {step_ns} DIV {per}").alias("_bk"))

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        m = pdf.drop_duplicates("_m").sort_values("_m")
        k = np.searchsorted(m["_m"].to_numpy(dtype=object), pdf["_m"].to_numpy(dtype=object)) + 1
        ts, z = pdf["ts_ns"].to_numpy(), pdf["log_mid"].to_numpy()
        e = element(ts, k, z, pdf["noise"].to_numpy(), len(m) + 1, (key[1] + 1) * per * step_ns, h, h_bias)
        row = [key[0], key[1], ts[0], ts[-1], z[0], k[0], m["_m"].tolist(), m["bias"].tolist(), m["noise_var"].tolist()]
        return pd.DataFrame([row + [v.ravel() for v in e]], columns=_columns(MAPS))

    def before(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bk", ignore_index=True)
        known: dict[str, tuple[float, float]] = {}
        for m in pdf.itertuples():
            for name, bias, nv in zip(m.members, m.bias, m.noise_var):
                known.setdefault(name, (bias, nv))
        names = sorted(known)
        n, pos = len(names) + 1, {v: i + 1 for i, v in enumerate(names)}
        fixed = [names, [known[v][0] for v in names], [known[v][1] for v in names]]
        last = (int(pdf["last_ns"].iloc[-1]) - 1) // step_ns
        out, x, p, at = [], None, None, None
        for bucket, m in zip(pdf["_bk"].tolist(), pdf.itertuples()):
            while at is not None and at < bucket:  # intervals without ticks
                out.append([key[0], at, at * per, (at + 1) * per - 1, *fixed, x.copy(), p.ravel().copy()])
                _grow(p, per * step_ns / 1e6, h, h_bias)
                at += 1
            lo, hi, end = bucket * per, min((bucket + 1) * per - 1, last), (bucket + 1) * per * step_ns
            if x is None:
                lo = (m.first_ns - 1) // step_ns
                out.append([key[0], bucket, lo, hi, *fixed, None, None])
                x, p = begin(m.z0, pos[m.members[m.k0 - 1]], fixed[1], fixed[2], bias_init_p)
            else:
                out.append([key[0], bucket, lo, hi, *fixed, x.copy(), p.ravel().copy()])
                _grow(p, max((m.first_ns - bucket * per * step_ns) / 1e6, 0.0), h, h_bias)
            w = len(m.members) + 1
            e = [np.array(v, dtype=float) for v in (m.a, m.b, m.c, m.y, m.u)]
            e = [e[0].reshape(w, w), e[1], e[2].reshape(w, w), e[3], e[4].reshape(w, w)]
            idx = [0, *[pos[v] for v in m.members]]
            x, p = apply_element(x, p, _widen(e, idx, n, max((end - m.first_ns) / 1e6, 0.0), h_bias))
            at = bucket + 1
        return pd.DataFrame(out, columns=_columns(STARTS))

    names = _columns(SNAP_ROWS if rows == "snaps" else TICK_ROWS)

    def replay(key, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        st = start.iloc[0]
        pdf = _sorted(pdf)
        k = np.searchsorted(np.array(list(st["members"]), dtype=object), pdf["_m"].to_numpy(dtype=object)) + 1
        n = len(st["members"]) + 1
        state = None if st["x"] is None else (np.array(st["x"], dtype=float), np.array(st["p"], dtype=float).reshape(n, n))
        got = intervals(pdf, k, state, int(st["lo"]), int(st["hi"]), list(st["bias"]), list(st["noise_var"]), step_ns, h, h_bias, bias_init_p)[rows == "snaps"]
        return pd.DataFrame([(key[0], *v) for v in got], columns=names)

    return by_buckets(d, ["grp"], "_bk", MAPS, fold, STARTS, before, SNAP_ROWS if rows == "snaps" else TICK_ROWS, replay)


def begin(z: float, k: int, bias, noise_var, bias_init_p: float) -> tuple[np.ndarray, np.ndarray]:
    """State at a group's first tick: its member's price less its bias, with the member's own noise."""
    x = np.array([0.0, *bias])
    x[0] = z - x[k]
    p = np.eye(len(x)) * bias_init_p
    p[0, 0] = noise_var[k - 1]
    return x, p


def intervals(obs: pd.DataFrame, member, state, lo: int, hi: int, bias, noise_var, step_ns: int, h: float, h_bias: float, bias_init_p: float) -> tuple[list, list]:
    """(rows by tick, rows by snapshot) of the intervals ``lo`` to ``hi``, from the state at the start of ``lo`` (None: not begun)."""
    x, p = state if state else (None, np.zeros((1, 1)))
    ticks, snaps, at, last, i = [], [], lo * step_ns, lo * step_ns, 0
    ts, lm, nv = (obs[c].to_numpy() for c in ("ts_ns", "log_mid", "noise"))
    for b in range(lo, hi + 1):
        end, p0, used = (b + 1) * step_ns, p[0, 0], 0
        while i < len(ts) and ts[i] <= end:
            k, t = int(member[i]), int(ts[i])
            if x is None:
                (x, p), at = begin(lm[i], k, bias, noise_var, bias_init_p), t
            tau = max((t - at) / 1e6, 0.0)
            _grow(p, tau, h, h_bias)
            pre = p[0, 0]
            inn, s, gain = observe(x, p, k, lm[i], nv[i])
            ticks.append((end, t, k - 1, lm[i], tau, h * tau, pre, inn, s, gain[0], x[0], p[0, 0]))
            at, used, i = t, used + 1, i + 1
        pre, tau, last = p[0, 0], max((end - at) / 1e6, 0.0), at
        _grow(p, tau, h, h_bias)
        snaps.append((end, x[0], p[0, 0], p0, pre, tau, used, last, [float(v) for v in x[1:]]))
        at = end
    return ticks, snaps


# --- one level over whole steps --------------------------------------------------------------------------------------------------


def _level_element(step, z, r, hi: int, h: float):
    """(a, b, c, eta, j) from the level predicted to the first observed step to that at the end of step ``hi``."""
    a, b, c, eta, j, at = 1.0, 0.0, 0.0, 0.0, 0.0, int(step[0])
    for s, v, n in zip(step.tolist(), z.tolist(), r.tolist()):
        c += h * (s - at)
        var = max(c + n, 1e-300)
        g, e = c / var, v - b
        eta += a * e / var
        j += a * a / var
        a, b, c, at = a * (1 - g), b + g * e, c * (1 - g), s
    return a, b, c + h * (hi - at), eta, j


def _level_filter(step, z, r, x, v, lo: int, hi: int, h: float):
    """Mean and variance at the end of each step ``lo`` to ``hi``, from those at the end of the step before (None: not begun)."""
    m, p, i = np.zeros(hi - lo + 1), np.zeros(hi - lo + 1), 0
    for s in range(lo, hi + 1):
        v = v + h if x is not None else 0.0
        while i < len(step) and step[i] == s:
            if x is None:
                x, v = z[i], r[i]
            else:
                g = v / (v + r[i])
                x, v = x + g * (z[i] - x), v * (1 - g)
            i += 1
        m[s - lo], p[s - lo] = (0.0 if x is None else x), v
    return m, p


def _gap(first: int, last: int, width: int, known) -> list[tuple[int, int, int]]:
    return [(b, b * width, min((b + 1) * width - 1, known)) for b in range(first, last)]


def filter_level(obs: DataFrame, key: str, h: float, width: int, order: str = "venue") -> DataFrame:
    """(key, _bk, step, y, p) of a random walk seen with noise: ``obs`` has key, step, z, r; several rows a step come by ``order``.

    Steps start at 0 and those without rows are predicted. The first row begins the level: the limit of a start without knowledge.
    """
    kind = dict(obs.dtypes)[key]
    d = obs.where("step IS NOT NULL AND z IS NOT NULL AND r IS NOT NULL").withColumn("_bk", F.expr(f"step DIV {width}"))
    d = d.select(key, "_bk", F.col("step").cast("long").alias("step"), order, "z", "r")

    def fold(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["step", order], kind="stable")
        e = _level_element(*(pdf[c].to_numpy() for c in ("step", "z", "r")), (k[1] + 1) * width - 1, h)
        return pd.DataFrame([[*k, pdf["step"].iat[0], pdf["step"].iat[-1], *e]], columns=[key, "_bk", "first", "last", *"abcej"])

    def before(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bk")
        last, out, x, v, at = int(pdf["last"].iloc[-1]), [], None, 0.0, 0
        for b, first, a, c0, c, eta, j in zip(*(pdf[c].tolist() for c in ("_bk", "first", *"abcej"))):
            for g, lo, hi in _gap(at, b, width, last):
                out.append((k[0], g, lo, hi, x, v))
                v += h * width if x is not None else 0.0
            out.append((k[0], b, b * width, min((b + 1) * width - 1, last), x, v))
            if x is None:
                x, v = a * eta / j + c0, a * a / j + c
            else:
                v += h * (first - b * width + 1)
                x, v = a * (x + v * eta) / (1 + v * j) + c0, a * a * v / (1 + v * j) + c
            at = b + 1
        return pd.DataFrame(out, columns=[key, "_bk", "lo", "hi", "x", "v"])

    def replay(k, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf, st = pdf.sort_values(["step", order], kind="stable"), start.iloc[0]
        x = None if pd.isna(st["x"]) else float(st["x"])
        m, p = _level_filter(*(pdf[c].to_numpy() for c in ("step", "z", "r")), x, float(st["v"]), int(st["lo"]), int(st["hi"]), h)
        return pd.DataFrame({key: k[0], "_bk": k[1], "step": np.arange(int(st["lo"]), int(st["hi"]) + 1), "y": m, "p": p})

    head = f"`{key}` {kind}, _bk long"
    return by_buckets(d, [key], "_bk", f"{head}, first long, last long, a double, b double, c double, e double, j double", fold,
                      f"{head}, lo long, hi long, x double, v double", before, f"{head}, step long, y double, p double", replay)


def _shrink(p: np.ndarray, h: float) -> np.ndarray:
    """The smoother's gain of each step: the smoothed state is the filtered one plus gain times what the next step's moved."""
    return np.divide(p, p + h, out=np.zeros(len(p)), where=p + h > 0)


def smooth_level(filtered: DataFrame, key: str, h: float) -> DataFrame:
    """The Rauch-Tung-Striebel pass over ``filter_level``'s rows: (key, _bk, step, y, p)."""
    kind = dict(filtered.dtypes)[key]

    def fold(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        a, b, c = 1.0, 0.0, 0.0  # of the next bucket's first step: mean to a m + b, variance to a a p + c
        for y, p, g in zip(pdf["y"].tolist()[::-1], pdf["p"].tolist()[::-1], _shrink(pdf["p"].to_numpy(), h).tolist()[::-1]):
            a, b, c = g * a, y + g * (b - y), p + g * g * (c - (p + h))
        return pd.DataFrame([[*k, pdf["y"].iat[-1], pdf["p"].iat[-1], a, b, c]], columns=[key, "_bk", "y", "p", *"abc"])

    def before(k, pdf: pd.DataFrame) -> pd.DataFrame:
        out, m, v = [], None, None
        for b, y, p, a, c0, c in pdf.sort_values("_bk", ascending=False)[["_bk", "y", "p", "a", "b", "c"]].itertuples(index=False, name=None):
            m, v = (y, p + h) if m is None else (m, v)  # nothing follows the last step: it stays as it is
            out.append((k[0], b, m, v))
            m, v = a * m + c0, a * a * v + c
        return pd.DataFrame(out, columns=[key, "_bk", "m", "v"])

    def replay(k, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step", ignore_index=True)
        y, p, (m, v) = pdf["y"].to_numpy(), pdf["p"].to_numpy(), (float(start["m"].iat[0]), float(start["v"].iat[0]))
        g, ys, ps = _shrink(p, h), np.empty(len(y)), np.empty(len(y))
        for i in range(len(y) - 1, -1, -1):
            m, v = y[i] + g[i] * (m - y[i]), p[i] + g[i] * g[i] * (v - (p[i] + h))
            ys[i], ps[i] = m, v
        return pdf.assign(y=ys, p=ps)

    head = f"`{key}` {kind}, _bk long"
    return by_buckets(filtered, [key], "_bk", f"{head}, y double, p double, a double, b double, c double", fold,
                      f"{head}, m double, v double", before, f"{head}, step long, y double, p double", replay)
