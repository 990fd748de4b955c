"""Hand-computed expectations for the analytics, bars, volatility and cleaning operators."""

import math

import pytest
from pyspark.sql import functions as F

from tideloom.functions import symbols as sym
from tideloom.operators import analytics as an
from tideloom.operators import bars, books, buffers, cleaning, folds, joins, snapshots, stats, vol
from tideloom.operators.fairprice import evaluation_order, kalman, observations

SNAP = "venue string, symbol string, snap_ts_ns long, midquote double, spread double, log_return double, mid_high double, mid_low double, bid_high double, ask_low double"


def snaps(spark, mids, bid_high=None, ask_low=None, rets=None, step=100_000_000):
    mids = [None if m is None else float(m) for m in mids]
    rows = [("v", "s", (i + 1) * step, m, 1.0, None if rets is None else rets[i], None if m is None else m + 0.1, None if m is None else m - 0.1, bid_high and (bid_high[i] if isinstance(bid_high, list) else bid_high), ask_low and (ask_low[i] if isinstance(ask_low, list) else ask_low)) for i, m in enumerate(mids)]
    return spark.createDataFrame(rows, SNAP)


def one(df):
    return df.first().asDict()


def test_means_and_quantiles(spark):
    s = snaps(spark, [100.0 + i for i in range(10)])
    assert one(an.midquote_twap(s, 10))["value"] == 104.5
    assert one(an.snap_median(s, "mid", 3))["value"] == 108
    t = snaps(spark, [2.0, 4, 4, 4, 5, 5, 7, 9])
    assert one(an.midquote_stdev(t, 8))["value"] == pytest.approx(2.138, abs=1e-3)
    assert one(an.snap_stdev(t, "mid", 1))["value"] is None
    u = snaps(spark, [float(i) for i in range(1000)])
    assert one(an.snap_quantile(u, "mid", 1000, 0.9999))["value"] == pytest.approx(998.9001)
    with pytest.raises(ValueError):
        an.snap_quantile(u, "mid", 10, 1.5)
    with pytest.raises(ValueError):
        an.snap_mean(u, "nothing", 10)


def test_rows_are_cut_before_missing_values(spark):
    s = snaps(spark, [1.0, 2.0, None, 4.0])
    assert one(an.snap_mean(s, "mid", 2))["value"] == 4.0
    r = snaps(spark, [1.0, 1, 1], rets=[0.01, None, -0.01])
    assert an.log_returns(r, 3).count() == 2
    assert one(an.max_abs_log_return(r, 3))["value"] == 0.01


def test_fills(spark):
    s = snaps(spark, [100.0] * 10, bid_high=100.03, ask_low=99.97)
    f = one(an.quote_fills(s, "ask", 2.0, 100))
    assert (f["n_fills"], f["n_total"]) == (9, 9) and f["mean_markout_bps"] == pytest.approx(2.0)
    assert one(an.quote_fills(s, "bid", 2.0, 100))["n_fills"] == 9
    none = one(an.quote_fills(s, "ask", 5.0, 100))
    assert (none["n_fills"], none["n_total"], none["mean_markout_bps"], none["stdev_markout_bps"]) == (0, 9, 0.0, 0.0)
    v = snaps(spark, [100, 100.01, 100.02, 100.01, 100.0], bid_high=[100.005, 100.025, 100.025, 100.005, 100.005], ask_low=99.0)
    assert one(an.quote_fills(v, "ask", 1.0, 100))["n_fills"] == 1


def test_range_buckets(spark):
    assert an.range_buckets(snaps(spark, [100.0] * 20), 20, 5).count() == 0
    got = [r["range_bps"] for r in an.range_buckets(snaps(spark, [100.0 + i for i in range(6)]), 6, 3).orderBy("bucket").collect()]
    assert got == pytest.approx([2 / 101 * 1e4, 2 / 104 * 1e4])


BARS = "venue string, symbol string, open_time_ms long, open double, high double, low double, close double, volume double, n_src int"


def minute_bars(spark, n):
    return spark.createDataFrame([("v", "s", i * 60_000, 100.0 + i, 105.0 + i, 95.0 + i, 101.0 + i, 10.0, 1) for i in range(n)], BARS)


def test_aggregate_bars(spark):
    b = bars.aggregate_bars(minute_bars(spark, 10), 5).orderBy("open_time_ms").collect()
    assert len(b) == 2 and (b[0].open, b[0].high, b[0].low, b[0].close, b[0].volume) == (100, 109, 95, 105, 50)
    assert bars.aggregate_bars(minute_bars(spark, 7), 5).count() == 1
    assert bars.aggregate_bars(minute_bars(spark, 3), 1).count() == 3
    assert bars.aggregate_bars(minute_bars(spark, 3), 0).count() == 0


def ticks(spark, rows):
    return spark.createDataFrame([("v", "s", i, float(p), float(p), int(ms) * 1_000_000) for i, (p, ms) in enumerate(rows)], "venue string, symbol string, seq long, bid double, ask double, exchange_ts_ns long")


SEQ = [(100, 0), (102, 10_000), (99, 20_000), (101, 50_000), (103, 60_000), (105, 90_000), (104, 120_000), (106, 180_000)]


def test_rolled_and_virtual_bars(spark):
    b = bars.tick_bars(ticks(spark, SEQ))
    r = one(bars.rolled_bars(b, 3))
    assert (r["open"], r["high"], r["low"], r["close"], r["n_src"]) == (100, 105, 99, 104, 3)
    head = bars.virtual_head(bars.tick_bars(ticks(spark, SEQ[:5])), 2).orderBy(F.desc("as_of_ms")).first()
    assert (head.open, head.high, head.close) == (100, 103, 103)


def test_garman_klass_and_har(spark):
    b = spark.createDataFrame([("v", "s", 0, 100.0, 105.0, 95.0, 102.0, 0.0, 1), ("v", "s", 60_000, 0.0, 1.0, 1.0, 1.0, 0.0, 1)], BARS)
    g = [r[0] for r in b.orderBy("open_time_ms").select(vol.gk()).collect()]
    want = 0.5 * math.log(105 / 95) ** 2 - (2 * math.log(2) - 1) * math.log(1.02) ** 2
    assert g == pytest.approx([want, 0.0])
    p = vol.VolParams(f_h=[2.0] * 24, f_d=[1, 1, 1, 1.5, 1, 1, 1])  # 1970-01-01 is a Thursday
    assert b.where("open_time_ms = 0").select(vol.deseasoned_gk(p)).first()[0] == pytest.approx(want / 3)
    f = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "log_rv_1 double, log_rv_6 double, log_rv_24 double, log_rv_288 double")
    har = {"intercept": -2.0, "betas": [0.2, 0.4, 0.3, 0.1], "windows": [1, 6, 24, 288]}
    assert vol.har_predict(f, har).first()["log_pred"] == pytest.approx(0.3)


def test_buffers(spark):
    t = ticks(spark, [(i, i) for i in range(10)])
    assert [r["bid"] for r in buffers.last_n(t, 5).orderBy("rn").collect()] == [9, 8, 7, 6, 5]
    assert buffers.read_at(t, 0, 8).count() == 0 and buffers.read_at(t, 3, 8).count() == 1
    assert buffers.retain(t, 4).count() == 4
    with pytest.raises(ValueError):
        buffers.retain(t, 3)
    assert [r["pos"] for r in buffers.since(t, 4, 3).orderBy("pos").collect()] == [4, 5, 6]


def test_stale_drop_and_clock(spark):
    rows = [("v", "s", i, 1.0, 2.0, ex, ex, rc, i) for i, (ex, rc) in enumerate([(10_000_000, 11_000_000), (9_000_000, 11_000_000), (10_000_000, 10_500_000), (None, 12_000_000), (12_000_000, 12_500_000)])]
    t = spark.createDataFrame(rows, "venue string, symbol string, seq long, bid double, ask double, exchange_ts_raw_ns long, exchange_ts_ns long, received_ts_ns long, update_id long")
    assert [r["seq"] for r in cleaning.drop_stale(t).orderBy("seq").collect()] == [0, 2, 3, 4]
    off = [r["clock_offset_ns"] for r in cleaning.clock_correct_max(t.where("exchange_ts_ns IS NOT NULL")).orderBy("seq").collect()]
    assert off == [0, 0, -500_000, -500_000]


def test_snapshot_carry_forward(spark):
    t = ticks(spark, [(100, 10), (102, 50), (101, 350)]).withColumns({"bid_qty": F.lit(1.0), "ask_qty": F.lit(1.0), "received_ts_ns": F.col("exchange_ts_ns")})
    s = snapshots.snapshots(t, 100_000_000).orderBy("snap_ts_ns").collect()
    assert [r.midquote for r in s] == [102, 102, 102, 101] and [r.mid_low for r in s] == [100, 102, 102, 101]
    assert s[0].log_return is None and s[1].log_return == 0.0 and s[3].log_return == pytest.approx(math.log(101 / 102))


def test_books(spark):
    u = spark.createDataFrame([("v", "s", 1, 0, "bid", 99.0, 5.0), ("v", "s", 2, 0, "bid", 98.0, 1.0), ("v", "s", 3, 0, "ask", 101.0, 2.0), ("v", "s", 4, 0, "bid", 99.0, 0.0)], "venue string, symbol string, seq long, epoch long, side string, price double, qty double")
    r = one(books.top(u))
    assert (r["bid"], r["bid_qty"], r["ask"], r["ask_qty"]) == (98.0, 1.0, 101.0, 2.0)
    cleared = u.unionByName(spark.createDataFrame([("v", "s", 5, 1, "ask", 103.0, 1.0)], u.schema))
    r = one(books.top(cleared))
    assert r["bid"] is None and r["ask"] == 103.0


def test_asof_and_groups(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2)], "k string, t long, i int")
    right = spark.createDataFrame([("k", 2, 20.0), ("k", 5, 50.0)], "k string, t long, x double")
    got = {r["i"]: r["r_x"] for r in joins.asof_join(left, right, ["k"], "t", "t").collect()}
    assert got == {1: 50.0, 2: None}
    assert evaluation_order({"ETH": {"BTC"}, "BTC": set()}) == ["BTC", "ETH"]
    with pytest.raises(ValueError):
        evaluation_order({"a": {"b"}, "b": {"a"}})


def test_folds_and_stats(spark):
    import numpy as np

    assert folds.ewma(np.array([1.0, 3.0]), 0.5).tolist() == [1.0, 2.0]
    assert folds.garch(np.array([1.0, 2.0]), 0.1, 0.2, 0.5, 1.0).tolist() == pytest.approx([0.8, 1.3])
    d = spark.createDataFrame([("a", i, float((-1) ** i)) for i in range(100)], "k string, i int, x double")
    assert stats.acf(d, "x", 2, ["k"], ["i"]).where("lag = 1").first()["acf"] == pytest.approx(-0.99)
    q = stats.order_stats(d.withColumn("x", F.col("i").cast("double")), "x", ["k"]).first()
    assert (q["p5"], q["p99"], q["floor"]) == (50.0, 99.0, 0.0)


def test_kalman_two_members(spark):
    t = spark.createDataFrame([("a", "s", 1, 100.0, 100.1, 1_000_000, 1_000_000), ("b", "s", 2, 100.05, 100.15, 2_000_000, 2_000_000)], "venue string, symbol string, seq long, bid double, ask double, exchange_ts_ns long, received_ts_ns long")
    m = spark.createDataFrame([("a", "s", "g", 0.0, 1e-6), ("b", "s", "g", 0.0, 1e-6)], "venue string, symbol string, grp string, bias double, noise_var double")
    r = kalman(observations(t, m), 100_000_000, 1e-10).collect()
    assert len(r) == 1 and r[0]["fair_price"] == pytest.approx(100.075, abs=0.05) and r[0]["n_ticks_used"] == 2


def test_registry(spark):
    reg = sym.registry(spark, ["BTC", "ETH", "btc"])
    assert reg.count() == 20
    assert reg.where("canonical = 'PERP-ETH-USDT'").first()["symbol_id"] == 11
    with pytest.raises(ValueError):
        sym.registry(spark, [f"B{i}" for i in range(101)])
