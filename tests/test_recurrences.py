"""Recurrences that compose: a scan by buckets gives what one pass over the whole key gives."""

import numpy as np
import pytest

from tideloom.operators import folds

RNG = np.random.default_rng(7)
N = 240
T = np.cumsum(RNG.integers(0, 4_000_000, N)) + 10_000_000
X = RNG.normal(0, 1, N)
GK = np.where(RNG.random(N) < 0.3, 0.0, RNG.random(N))
PRICE = np.where(RNG.random(N) < 0.1, 0.0, 100 * np.exp(np.cumsum(X) / 50))
CASES = {
    "ewma": (folds.Ewma(0.15), [X], lambda x: folds.ewma(x, 0.15)),
    "log_gk": (folds.LogGkEwma(5.0), [GK], lambda g: folds.log_gk_ewma(g, 5.0)),
    "garch": (folds.Garch(0.05, 0.1, 0.85, 1.0), [X], lambda r: folds.garch(r, 0.05, 0.1, 0.85, 1.0)),
    "var": (folds.EwmaVar(20.0, 1e-6, 1e-5), [PRICE, T], lambda p, t: folds.ewma_var_per_ms(p, t, 20.0, 1e-6, 1e-5)),
    "var_high_floor": (folds.EwmaVar(20.0, 1e-6, 1e-3), [PRICE, T], lambda p, t: folds.ewma_var_per_ms(p, t, 20.0, 1e-6, 1e-3)),
    "var_constant": (folds.EwmaVar(0.0, 1e-6, 1e-5), [PRICE, T], lambda p, t: folds.ewma_var_per_ms(p, t, 0.0, 1e-6, 1e-5)),
    "spread": (folds.SpreadEwma(50.0), [X, T, np.full(N, T[0])], lambda x, t, b: folds.spread_ewma(x, t, 50.0)),
    "spread_last": (folds.SpreadEwma(0.0), [X, T, np.full(N, T[0])], lambda x, t, b: folds.spread_ewma(x, t, 0.0)),
}


def cut(arrays, size):
    return [[a[i : i + size] for a in arrays] for i in range(0, N, size)]


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_maps_compose(name, size):
    rec, arrays, whole = CASES[name]
    at, got = rec.start, []
    for part in cut(arrays, size):
        got.append(rec.run(at, *part))
        at = rec.after(at, rec.fold(*part))
    np.testing.assert_allclose(np.concatenate(got), whole(*arrays), rtol=1e-9)


@pytest.mark.parametrize("name", ["ewma", "log_gk", "var", "spread"])
def test_scan_equals_one_pass(spark, name):
    rec, arrays, whole = CASES[name]
    cols = [f"x{i}" for i in range(len(arrays))]
    kinds = ["long" if a.dtype.kind == "i" else "double" for a in arrays]
    rows = [(k, i, *[a[i].item() for a in arrays]) for k in ("a", None) for i in range(N)]
    df = spark.createDataFrame(rows, "k string, i long, " + ", ".join(f"{c} {t}" for c, t in zip(cols, kinds)))
    got = folds.scan(df, ["k"], ["i"], cols, rec, {"s": "double"}, 50)
    assert got.columns == ["k", "i", *cols, "s"]
    want = [None if v != v else v for v in whole(*arrays).tolist()]
    rows = sorted(((r["k"] or "", r["i"], r["s"]) for r in got.collect()))
    for k, part in (("", rows[:N]), ("a", rows[N:])):
        assert [r[:2] for r in part] == [(k, i) for i in range(N)]
        for (_, _, v), w in zip(part, want):
            assert (v is None or v != v) if w is None else v == pytest.approx(w, rel=1e-9)
    assert folds.scan(df.limit(0), ["k"], ["i"], cols, rec, {"s": "double"}, 50).collect() == []


def test_last_state(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(X)], "k string, i long, x double")
    row = folds.last_state(df, ["k"], ["i"], ["x"], folds.Garch(0.05, 0.1, 0.85, 1.0), 31).first()
    assert row["_st_h"] == pytest.approx(folds.garch(X, 0.05, 0.1, 0.85, 1.0)[-1], rel=1e-9)
