"""Registered queries on tables that the given ones don't reach: long histories of a venue, values between two roundings, large micro-batches."""

import math
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideloom.functions import scalars as sc
from tideloom.plans import q_live, registry


def events(spark, path, rows, value="1 + id % 977 / 10D", venues=("click", "view", "error"), gap_us=7_003_001):
    """An events table of ``rows`` rows, ``gap_us`` between two."""
    names = ", ".join(f"'{v}'" for v in venues)
    e = spark.range(rows).selectExpr(
        "id AS event_id", f"timestamp_micros(1704067200000000 + id * {gap_us}) AS ts", "id % 11 AS user_id",
        f"element_at(array({names}), CAST(pmod(hash(id), {len(venues)}) AS INT) + 1) AS event_type", f"{value} AS value", "'{}' AS props")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(1).sortWithinPartitions("event_id").write.parquet(f"{path}/written")
    file, = (path / "written").glob("*.parquet")
    file.rename(path / "events.parquet")
    return str(path)


def both(spark, name, path):
    """The rows of a query and those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r)) for r in want.fetchall()]
    got = registry.QUERIES[name](spark, path)
    assert sorted(got.columns) == cols
    whole = lambda r: repr([v for v in r if v is not None and not isinstance(v, float)])
    return [sorted((tuple(r[c] for c in cols) for r in some), key=whole) for some in (got.collect(), rows)]


def test_a_position_is_read_however_many_rows_follow(spark, tmp_path):
    got, want = both(spark, "b2_read_at", events(spark, tmp_path, 70_000, venues=("click",)))
    assert got == want and len(got) == 1


def test_numbers_are_rounded_as_sql_rounds_them(spark, tmp_path):
    halves = "CASE id % 4 WHEN 0 THEN (id % 2000 + 0.5D) / 1000D WHEN 1 THEN 1 + id % 900 / 20D WHEN 2 THEN id % 4000 / 64D ELSE 1e3D + (id % 1000) * 50D END / (1 - (5 + id % 20) / 1e4D)"
    got, want = both(spark, "h12_formatting", events(spark, tmp_path, 20_000, value=halves))
    assert got == want


def test_short_numbers(spark):
    values = [0.5, 1.5, 998.5, 999.5, -0.4, 1e3, 1250.0, 1350.0, 74850.0, 249850.0, -1150.0, 999_950.0, 1e6, 1.25e6, 1.15e6, 4.5e21, 123.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[1] for r in df.select("i", sc.short_number("x")).orderBy("i").collect()]
    c = lambda v: "-" if v is None else f"{v / 1e6:.1f}M" if abs(v) >= 1e6 else f"{v / 1e3:.1f}K" if abs(v) >= 1e3 else f"{v:.0f}"
    assert got == [c(v) for v in values]
    df = spark.range(50_000).selectExpr("(xxhash64(id) % 100000000) / 2048D AS x").union(spark.range(50_000).selectExpr("(xxhash64(id) % 2000000) / 20D"))
    rows = df.select("x", sc.one_decimal("x").alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{r['x']:.1f}" for r in rows]


def test_clock_average_streams_by_in_order(spark):
    from tideloom.operators import cleaning

    raw = 1_704_067_200_000_000_123
    rows = [(v, "s", i, None if i % 5 == 0 else raw + 1_000_000 * i + (i * 7919) % 3_000_001, raw + 1_000_000 * i, 0) for v in ("a", None, "b") for i in range(700)]
    df = spark.createDataFrame(rows, "venue string, symbol string, seq long, received_ts_ns long, exchange_ts_raw_ns long, exchange_ts_ns long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = cleaning.clock_correct_ewma(df)
        got = {(r["venue"], r["seq"]): (r["clock_offset_ns"], r["exchange_ts_ns"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    acc, want = {}, {}
    for v, _, i, rc, ex, _ in rows:
        if rc is not None and (d := rc - ex - 1_000_000) < 0:
            acc[v] = int(0.999 * acc.get(v, 0) + (1 - 0.999) * d)
        want[v, i] = (acc.get(v, 0), ex + acc.get(v, 0))
    assert got == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no task holds a key's history


def test_bias_by_buckets_equals_one_sequence(spark):
    from tideloom.operators import fairprice

    rows = [("g", v, "s", i, 10**18 + (i // 2) * 40_000_000_000, (i * 37 % 101) / 50.0 + b, b) for v, b in (("a", 0.0), ("b", 0.3)) for i in range(600)]
    obs = spark.createDataFrame(rows, "grp string, venue string, symbol string, seq long, ts_ns long, log_mid double, bias double")
    fair = spark.createDataFrame([("g", 10**18, 0.1), ("g", 10**18 + 10**13, 0.4)], "grp string, snap_ts_ns long, log_fair_price double")
    got = [{(r["venue"], r["seq"]): r["bias_ewma"] for r in fairprice.gg_bias(obs, fair, 500_000.0, bucket_ns=n).collect()} for n in (10**11, 10**18)]
    want = {}
    for v in "ab":
        w, at = 0.0, 0
        for _, _, _, i, t, lm, bias in [r for r in rows if r[1] == v]:
            b = bias if i == 0 else b
            a = 1 - 2 ** (-((t - at) / 1e6 if at else 0.0) / 500_000.0)
            if a > 0:
                w = a + (1 - a) * w
                b += a / w * (lm - (0.4 if t >= 10**18 + 10**13 else 0.1) - b)
            at, want[v, i] = t, b
    for one in got:
        assert one.keys() == want.keys() and all(abs(one[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("name", ["j5_stream_stale_drop", "j6_stream_clock", "j9_stream_book", "g1_stream_kalman", "g6_stream_predict_only", "g8_stream_quotes"])
def test_micro_batches_are_bounded(spark, tmp_path, monkeypatch, name):
    path = events(spark, tmp_path, 2_600, venues=("click", "view", "purchase", "signup", "error"), gap_us=700_300_001)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("tideloom/live-*"))
    monkeypatch.setattr(q_live, "PART_ROWS", 600, raising=False)
    got, want = both(spark, name, path)
    assert len(got) == len(want) and len(got) > 4
    for x, y in zip(got, want):
        assert all(u == v or math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-4) for u, v in zip(x, y)), (x, y)
    landed = [pq.read_metadata(f).num_rows for x in set(shared.glob("tideloom/live-*")) - before for f in x.glob("in-*/*.parquet")]
    assert sum(landed) >= 2_600 and max(landed) <= 650
