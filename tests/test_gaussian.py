"""Filters and smoothers by buckets of time against the same recursions over one sequence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom.operators import calibrate, gaussian
from tideloom.operators.fairprice import kalman, noise_var

STEP = 1_000_000_000  # one second


def obs(spark, gap=False, quiet=False):
    """One group, three members; ``c`` comes late, ``gap`` leaves two minutes without ticks, ``quiet`` gives ticks without noise."""
    rng, rows, t = np.random.default_rng(7), [], 5 * STEP + 1
    for i in range(600):
        t += int(rng.integers(0, 900_000_000)) + (120 * STEP if gap and i == 300 else 0)
        m = int(rng.integers(0, 3 if i > 400 else 2))
        half = 0.0 if quiet and i % 3 == 0 else 1e-4 * (m + 1)
        rows.append(("G", "abc"[m], "S", 0.001 * m, 1e-4, t, i, 4.6 + 0.001 * m + float(rng.normal()) * 1e-3, half))
    return spark.createDataFrame(rows, "grp string, venue string, symbol string, bias double, noise_var double, ts_ns long, seq long, log_mid double, half_spread double")


def in_turn(o, rows):
    """The filter over all ticks of one group in one sequence, from the first interval to the last."""
    pdf = gaussian._sorted(o.withColumn("noise", noise_var("InstantSpread")).toPandas())
    m = pdf.drop_duplicates("_m").sort_values("_m")
    k = np.searchsorted(m["_m"].to_numpy(dtype=object), pdf["_m"].to_numpy(dtype=object)) + 1
    lo, hi = (int(pdf["ts_ns"].iloc[0]) - 1) // STEP, (int(pdf["ts_ns"].iloc[-1]) - 1) // STEP
    return gaussian.intervals(pdf, k, None, lo, hi, m["bias"].tolist(), m["noise_var"].tolist(), STEP, 1e-9, 1e-12, 1e-6)[rows == "snaps"]


@pytest.mark.parametrize("case", [{}, {"gap": True}, {"quiet": True}])
def test_buckets_of_one_group_give_the_sequential_filter(spark, case):
    o = obs(spark, **case)
    for rows, order in (("snaps", ["snap_ts_ns"]), ("ticks", ["tick_ts_ns", "member_idx"])):
        got = kalman(o, STEP, 1e-9, 1e-12, 1e-6, rows=rows, bucket_ns=20 * STEP).orderBy(*order).toPandas()
        want = sorted(in_turn(o, rows), key=(lambda r: r[0]) if rows == "snaps" else (lambda r: (r[1], r[2])))
        assert len(got) == len(want)
        cols = list(gaussian._columns(gaussian.SNAP_ROWS if rows == "snaps" else gaussian.TICK_ROWS))[1:]
        for i, c in enumerate(cols):
            exact = c.endswith("_ns") or c in ("member_idx", "n_ticks_used")
            a, b = np.array([np.ravel(v) for v in got[c]], dtype=float), np.array([np.ravel(r[i]) for r in want], dtype=float)
            assert a.shape == b.shape and (np.array_equal(a, b) if exact else np.allclose(a, b, rtol=1e-6, atol=1e-12)), (rows, c)


def test_one_group_runs_in_as_many_tasks_as_buckets(spark):
    """Each bucket is its own pandas group: the largest holds a bucket's ticks, not the group's."""
    o = obs(spark).withColumn("_bk", F.expr(f"(ts_ns - 1) DIV {20 * STEP}"))
    sizes = [r["count"] for r in o.groupBy("grp", "_bk").count().collect()]
    plan = kalman(obs(spark), STEP, 1e-9, bucket_ns=20 * STEP)._jdf.queryExecution().executedPlan().toString()
    assert len(sizes) > 10 and max(sizes) < 100 and "_bk" in plan


def test_members_without_rows_and_empty_input(spark):
    o = obs(spark)
    assert kalman(o.where("false"), STEP, 1e-9).count() == 0
    n = o.withColumn("ts_ns", F.when(F.col("seq") % 2 == 0, F.col("ts_ns")))
    assert kalman(n, STEP, 1e-9, rows="ticks", bucket_ns=20 * STEP).count() == 300


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_level_filter_and_smoother_by_buckets(spark, width):
    rng = np.random.default_rng(3)
    steps = [s for s in range(3, 200) if s not in range(90, 130)]
    rows = [("G", v, s, float(rng.normal()) * 0.1 + s * 0.01, int(rng.integers(0, 3))) for s in steps for v in "ab" if rng.random() < 0.7 or s == 3]
    o = spark.createDataFrame(rows, "grp string, venue string, step int, log_mid double, age int")
    rulers = spark.createDataFrame([("G", "a", 0.01, 0.02), ("G", "b", -0.01, 0.03)], "grp string, venue string, bias double, noise_var double")
    rows.sort(key=lambda r: (r[2], r[1]))
    bias, nv = {"a": 0.01, "b": -0.01}, {"a": 0.02, "b": 0.03}
    step, z, r = (np.array(v, dtype=float) for v in zip(*[(x[2], x[3] - bias[x[1]], nv[x[1]] + 0.005 * x[4]) for x in rows]))
    for backward in (False, True):
        m, p = calibrate.smooth(step.astype(int), z, r, 0.005, backward)
        got = calibrate.replay(o, rulers, 0.005, backward=backward, width=width).orderBy("step").toPandas()
        assert got["step"].tolist() == list(range(len(m)))
        assert np.allclose(got["y"], m, rtol=1e-9, atol=1e-12) and np.allclose(got["p"], p, rtol=1e-9, atol=1e-12)
