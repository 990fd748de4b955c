"""Residuals of members against the fair price's next return."""

import random

import numpy as np
from pyspark.sql import functions as F

from tideloom.operators import stats


def test_residual_r2_with_gaps_short_and_flat_members(spark):
    rng = random.Random(4)
    steps = [k for k in range(300) if k % 37]
    y = {k: rng.gauss(0, 1) for k in steps}
    fair = spark.createDataFrame([(k * 10, v) for k, v in y.items()], "snap_ts_ns long, y double")
    lead = {k: 0.5 * (y[k + 1] - y[k]) + rng.gauss(0, 0.3) for k in steps if k + 1 in y}
    ticks = [("leads", k * 10, y[k] + e) for k, e in lead.items()] + [("flat", k * 10, y[k]) for k in steps] + [("short", k * 10, y[k] + rng.random()) for k in steps[:50]]
    got = {r["venue"]: r for r in stats.residual_r2(spark.createDataFrame(ticks, "venue string, snap_ts_ns long, log_mid double"), fair, step=10).collect()}
    e, d = np.array(list(lead.values())), np.array([y[k + 1] - y[k] for k in lead])
    assert abs(got["leads"]["r2"] - np.corrcoef(e, d)[0, 1] ** 2) < 1e-9 and got["leads"]["n"] == len(lead)
    assert abs(got["flat"]["r2"]) < 1e-6 and got["short"]["r2"] is None
    frame = spark.createDataFrame([(v, r["r2"]) for v, r in got.items()], "venue string, r2 double")
    s = stats.residual_summary(frame).first()
    assert s["n_members"] == 2 and s["r2_max"] == frame.agg(F.max("r2")).first()[0]


def test_next_row_by_step_is_the_next_row(spark):
    fair = spark.createDataFrame([("g", k, float(k * k)) for k in range(8)], "grp string, snap_ts_ns long, y double")
    a, b = (sorted((r["snap_ts_ns"], r["_n"]) for r in stats._with_next(fair, "snap_ts_ns", ["grp"], 2, step).collect()) for step in (1, None))
    assert a == b
