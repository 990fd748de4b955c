"""Ordered recurrences as grouped pandas functions: ``scan`` where steps compose (buckets of a key in parallel), ``path`` where they
don't (one sequence a key)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scan import bucket_of

LN2 = float(np.log(2.0))


def path(df: DataFrame, key, order: list[str], inputs: list[str], step, out: dict[str, str]) -> DataFrame:
    """Adds columns ``out`` (name to type) by ``step(arrays) -> arrays``, called once a key with rows in ``order``."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in out] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()])
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        got = step(*[pdf[c].to_numpy() for c in inputs])
        for n, v in zip(out, got if isinstance(got, tuple) else (got,)):
            pdf[n] = v
        return pdf[names]

    return df.groupBy(*key).applyInPandas(run, schema)


def scan(df: DataFrame, key, order: list[str], inputs: list[str], rec, out: dict[str, str], width: int) -> DataFrame:
    """As ``path`` for a recurrence whose steps compose: a key's buckets (``width`` of the first order column) run in parallel.

    ``rec.fold`` reduces a bucket to one map of the state, ``rec.after`` applies such maps in order (one row a bucket), and ``rec.run``
    replays each bucket from the state before it. Both passes over the rows read one shuffle.
    """
    by = [*key, "_sc_b"]
    d = df.withColumn("_sc_b", bucket_of(df, order[0], width)).repartition(*by)  # else a partitioning by key alone would be kept
    starts = _prefix(_maps(d, by, order, inputs, rec), key, rec)
    schema = T.StructType([f for f in df.schema.fields if f.name not in out] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()])
    names = [f.name for f in schema]

    def replay(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        got = rec.run(tuple(start[c].iat[0] for c in rec.state), *[pdf[c].to_numpy() for c in inputs])
        for n, v in zip(out, got if isinstance(got, tuple) else (got,)):
            pdf[n] = v
        return pdf[names]

    return d.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(replay, schema)


def last_state(df: DataFrame, key, order: list[str], inputs: list[str], rec, width: int) -> DataFrame:
    """The state of each key after its last row: buckets are folded in parallel, then their maps are applied in order."""
    d = df.select(*dict.fromkeys([*key, *order, *inputs])).withColumn("_sc_b", bucket_of(df, order[0], width)).repartition(*key, "_sc_b")
    return _prefix(_maps(d, [*key, "_sc_b"], order, inputs, rec), key, rec, last=True).drop("_sc_b")


def _fields(names: dict[str, str]) -> list[T.StructField]:
    return [T.StructField(n, T._parse_datatype_string(t)) for n, t in names.items()]


def _maps(d: DataFrame, by: list[str], order: list[str], inputs: list[str], rec) -> DataFrame:
    def reduce_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        got = rec.fold(*[pdf[c].to_numpy() for c in inputs])
        return pd.DataFrame({**{c: [pdf[c].iat[0]] for c in by}, **{n: [v] for n, v in zip(rec.map, got)}})

    # all columns, unused ones too: a narrower projection would be a second shuffle beside the one that the replay reads
    return d.groupBy(*by).applyInPandas(reduce_bucket, T.StructType([d.schema[c] for c in by] + _fields(rec.map)))


def _prefix(maps: DataFrame, key, rec, last: bool = False) -> DataFrame:
    """The state before each bucket of a key (after the last one for ``last``)."""

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sc_b", na_position="first", ignore_index=True)
        states, at = [], rec.start
        for m in zip(*[pdf[c].tolist() for c in rec.map]):
            states.append(at)
            at = rec.after(at, m)
        got = pdf[[*key, "_sc_b"]]
        got, states = (got.tail(1), [at]) if last else (got, states)
        return got.assign(**{n: list(v) for n, v in zip(rec.state, zip(*states))})

    return maps.groupBy(*key).applyInPandas(before, T.StructType([maps.schema[c] for c in [*key, "_sc_b"]] + _fields(rec.state)))


class Ewma:
    """Recurrence of ``ewma``: a bucket maps s to a s + b; its first value stands in where nothing came before."""

    map = {"n": "double", "first": "double", "a": "double", "b": "double"}
    state = {"_st_n": "double", "_st_s": "double"}
    start = (0.0, np.nan)

    def __init__(self, alpha: float):
        self.alpha = alpha

    def fold(self, x):
        return float(len(x)), float(x[0]), (1 - self.alpha) ** len(x), float(ewma(x, self.alpha, 1.0, 0.0)[-1])

    def after(self, st, m):
        return st[0] + m[0], m[2] * (st[1] if st[0] else m[1]) + m[3]

    def run(self, st, x):
        return ewma(x, self.alpha, *st)


class LogGkEwma(Ewma):
    """Recurrence of ``log_gk_ewma``: only bars with a range count."""

    def __init__(self, halflife_bars: float):
        super().__init__(1 - np.exp(-LN2 / halflife_bars))

    def fold(self, gk):
        lg = np.log(gk[gk > 0])
        return super().fold(lg) if len(lg) else (0.0, np.nan, 1.0, 0.0)

    def after(self, st, m):
        return super().after(st, m) if m[0] else st

    def run(self, st, gk):
        return log_gk_ewma(gk, None, self.alpha, st[1] if st[0] else np.nan)


class Garch:
    """Recurrence of ``garch``: a bucket maps h to a h + b."""

    map = {"a": "double", "b": "double"}
    state = {"_st_h": "double"}

    def __init__(self, omega: float, alpha: float, beta: float, start: float):
        self.p, self.start = (omega, alpha, beta), (float(start),)

    def fold(self, r):
        return self.p[2] ** len(r), float(garch(r, *self.p, 0.0)[-1])

    def after(self, st, m):
        return (m[0] * st[0] + m[1],)

    def run(self, st, r):
        return garch(r, *self.p, st[0])


class EwmaVar:
    """Recurrence of ``ewma_var_per_ms``: a bucket's rows after its first price map h to max(a h + b, c); the first price waits for the
    price before the bucket."""

    map = {"n": "double", "lp": "double", "t": "bigint", "a": "double", "b": "double", "c": "double", "last_lp": "double", "last_t": "bigint"}
    state = {"_st_n": "double", "_st_h": "double", "_st_lp": "double", "_st_t": "bigint"}

    def __init__(self, halflife_ms: float, start: float, floor: float):
        self.halflife, self.floor, self.start = halflife_ms, floor, (0.0, float(start), 0.0, 0)

    def _step(self, lp, t, last, at):
        """(decay, gain) of one price after another; None where the variance stays."""
        if self.halflife <= 0 or t <= at:
            return None
        tau = (t - at) / 1e6
        d = np.exp(-tau * LN2 / self.halflife)
        return d, (1 - d) * (lp - last) ** 2 / tau

    def fold(self, price, ts_ns):
        good = price > 0
        lps, ts = np.log(price[good]).tolist(), ts_ns[good].tolist()
        if not lps:
            return 0.0, 0.0, 0, 1.0, 0.0, -np.inf, 0.0, 0
        a, b, c = 1.0, 0.0, -np.inf
        for i in range(1, len(lps)):
            s = self._step(lps[i], ts[i], lps[i - 1], ts[i - 1])
            if s:
                a, b, c = s[0] * a, s[0] * b + s[1], max(s[0] * max(c, -1e300) + s[1], self.floor)
        return float(len(lps)), lps[0], ts[0], a, b, c, lps[-1], ts[-1]

    def after(self, st, m):
        n, lp, t, a, b, c, last_lp, last_t = m
        if not n:
            return st
        h = st[1]
        s = self._step(lp, t, st[2], st[3]) if st[0] else None
        h = max(s[0] * h + s[1], self.floor) if s else h
        return st[0] + n, max(a * h + b, c), last_lp, int(last_t)

    def run(self, st, price, ts_ns):
        return ewma_var_per_ms(price, ts_ns, self.halflife, st[1], self.floor, st[2] if st[0] else None, st[3])


class SpreadEwma:
    """Recurrence of ``spread_ewma`` with the time of a key's first tick as an input: a bucket's rows after its first map s to a s + b."""

    map = {"v": "double", "t": "bigint", "began": "bigint", "a": "double", "b": "double", "last_t": "bigint"}
    state = {"_st_s": "double", "_st_t": "bigint"}
    start = (0.0, 0)

    def __init__(self, halflife_ms: float):
        self.halflife = halflife_ms

    def fold(self, x, ts_ns, began):
        v, t, b0 = x.tolist(), ts_ns.tolist(), int(began[0])
        a, b = 1.0, 0.0
        for i in range(1, len(v)):
            d = _spread_decay(t[i], t[i - 1], b0, self.halflife)
            a, b = a * d, (1 - d) * v[i] + d * b
        return v[0], t[0], b0, a, b, t[-1]

    def after(self, st, m):
        v, t, began, a, b, last_t = m
        d = _spread_decay(t, st[1], began, self.halflife)
        return a * ((1 - d) * v + d * st[0]) + b, int(last_t)

    def run(self, st, x, ts_ns, began):
        return spread_ewma(x, ts_ns, self.halflife, *st, int(began[0]))


class BiasEwma:
    """Recurrence of ``bias_ewma``: a bucket's rows after its first map (w, w b) linearly; the first row waits for the time before the bucket."""

    map = {"r": "double", "t": "bigint", "bias": "double", "d": "double", "w": "double", "wb": "double", "last_t": "bigint"}
    state = {"_st_t": "bigint", "_st_w": "double", "_st_wb": "double", "_st_bias": "double"}
    start = (0, 0.0, 0.0, None)

    def __init__(self, halflife_ms: float):
        self.halflife = halflife_ms

    def fold(self, res, ts_ns, bias):
        d, w, wb = 1.0, 0.0, 0.0
        for r, a in zip(res[1:].tolist(), _bias_gains(ts_ns, int(ts_ns[0]), self.halflife)[1:].tolist()):
            d, w, wb = (1 - a) * d, a + (1 - a) * w, a * r + (1 - a) * wb
        return float(res[0]), int(ts_ns[0]), float(bias[0]), d, w, wb, int(ts_ns[-1])

    def after(self, st, m):
        r, t, bias, d, w, wb, last_t = m
        a = float(_bias_gains(np.array([t]), st[0], self.halflife)[0])
        return int(last_t), d * (a + (1 - a) * st[1]) + w, d * (a * r + (1 - a) * st[2]) + wb, bias if st[3] is None else st[3]

    def run(self, st, res, ts_ns, bias):
        t, w, wb, b0 = st
        return bias_ewma(res, ts_ns, self.halflife, int(t), w, wb / w if w > 0 else bias[0] if b0 is None or b0 != b0 else b0)


def ewma(x, alpha: float, n: float = 0.0, s: float = np.nan):
    """s_0 = x_0, s_i = alpha x_i + (1 - alpha) s_(i-1); goes on from ``s`` where ``n`` rows came before."""
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        s = v if i == 0 and not n else alpha * v + (1 - alpha) * s
        out[i] = s
    return out


def ewma_var_per_ms(price, ts_ns, halflife_ms: float, start: float, floor: float, last: float | None = None, at: int = 0):
    """h of r**2 / tau with decay 2**(-tau / halflife), floored; constant for halflife 0. ``last`` and ``at``: log price and time before."""
    out = np.empty(len(price))
    h = start
    for i, (p, t) in enumerate(zip(price.tolist(), ts_ns.tolist())):
        if p > 0:
            lp = np.log(p)
            if halflife_ms > 0 and last is not None and t > at:
                tau = (t - at) / 1e6
                d = np.exp(-tau * LN2 / halflife_ms)
                h = max(d * h + (1 - d) * (lp - last) ** 2 / tau, floor)
            last, at = lp, t
        out[i] = h
    return out


def garch(r, omega: float, alpha: float, beta: float, start: float):
    out = np.empty(len(r))
    h = start
    for i, v in enumerate(r.tolist()):
        h = omega + alpha * v * v + beta * h
        out[i] = h
    return out


def log_gk_ewma(gk, halflife_bars: float | None, alpha: float | None = None, s: float = np.nan):
    """EWMA of ln(gk), by halflife or alpha, from ``s`` on; bars without range leave it as it is; NaN until the first."""
    out = np.empty(len(gk))
    a = 1 - np.exp(-LN2 / halflife_bars) if alpha is None else alpha
    for i, v in enumerate(gk.tolist()):
        if v > 0:
            s = np.log(v) if np.isnan(s) else a * np.log(v) + (1 - a) * s
        out[i] = s
    return out


def gk_ewma(gk, bar_ms: float, halflife_ms: float, start: float, floor_log: float, floor_h: float):
    """(mean of ln gk, mean of its square, h per ms) by EWMA over completed bars; the mean is floored."""
    d = np.exp(-bar_ms * LN2 / halflife_ms)
    m, q, h = start, start * start, np.exp(start) / bar_ms
    out = np.empty((len(gk), 3))
    for i, v in enumerate(gk.tolist()):
        if v > 0:
            lg = np.log(v)
            m, q = d * m + (1 - d) * lg, d * q + (1 - d) * lg * lg
            if m < floor_log:
                m, q = floor_log, floor_log * floor_log
            h = max(np.exp(m + max(q - m * m, 0.0) / 2) / bar_ms, floor_h)
        out[i] = m, q, h
    return out[:, 0].copy(), out[:, 1].copy(), out[:, 2].copy()


def _spread_decay(t: int, at: int, began: int, halflife_ms: float) -> float:
    if halflife_ms <= 0 or at <= 0:
        return 0.0
    ramp = max(min(max(t - began, 0) / 1e6, halflife_ms), 1.0)
    return float(np.exp(-max(t - at, 0) / 1e6 * LN2 / ramp))


def spread_ewma(half_spread, ts_ns, halflife_ms: float, s: float = 0.0, at: int = 0, began: int | None = None):
    """Time-weighted EWMA whose halflife ramps up with the time since the first tick (at least 1 ms); the last value for halflife 0."""
    out = np.empty(len(half_spread))
    for i, (v, t) in enumerate(zip(half_spread.tolist(), ts_ns.tolist())):
        began = t if began is None else began
        d = _spread_decay(t, at, began, halflife_ms)
        s, at = (1 - d) * v + d * s, t
        out[i] = s
    return out


def _bias_gains(ts_ns, at: int, halflife_ms: float):
    """The weight of each row by the time since the one before it (since ``at`` for the first); 0 where nothing came before."""
    before = np.concatenate([[at], ts_ns[:-1]])
    return 1 - np.exp(-np.where(before != 0, np.maximum(ts_ns - before, 0), 0) / 1e6 * LN2 / halflife_ms)


def bias_ewma(res, ts_ns, halflife_ms: float, at: int, w: float, b: float):
    """Time-weighted EWMA of residuals by cumulative weight ``w``: b stays where no time has passed."""
    out = np.empty(len(res))
    for i, (r, a) in enumerate(zip(res.tolist(), _bias_gains(ts_ns, at, halflife_ms).tolist())):
        if a > 0:
            w = a + (1 - a) * w
            b += a / w * (r - b)
        out[i] = b
    return out
