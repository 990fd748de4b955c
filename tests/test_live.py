"""The landing source, the reconnect loop's sessions, and processors with timers, initial state and expiry."""

import json

import pytest

from tideloom.plans.common import run_to_end
from tideloom.sources import landing
from tideloom.streaming import processors as live


def land(path, connection, segment, lines):
    folder = path / f"connection={connection}" / f"segment={segment:012d}"
    folder.mkdir(parents=True)
    (folder / ".part.json.tmp").write_text("half of a li")
    (folder / "part-0.json").write_text("\n".join(lines))


def line(seq, **more):
    return json.dumps({"venue": "okx", "itype": "spot", "raw": f"m{seq}", "received_ts_ns": seq * 10, "seq": seq, "event": "message", **more})


def test_landing_stream_resumes_and_leaves_out_broken_lines(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "job")
    seen = []
    for k, lines in enumerate(([line(1), line(2)], [line(3), '{"seq": 4, "raw": "cut'], [line(5, more="unknown")])):
        land(inbox, "a", k, lines)
        if k == 1:
            land(inbox, "b", 0, [line(9)])
        run_to_end(landing.stream(spark, str(inbox)), out)
        seen.append(sorted((r["connection"], r["seq"]) for r in spark.read.schema(landing.SCHEMA).parquet(f"{out}/out").collect()))
    assert seen[0] == [("a", 1), ("a", 2)]
    assert seen[2] == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 9)]
    assert sorted(r["seq"] for r in landing.batch(spark, str(inbox)).collect()) == [1, 2, 3, 5, 9]


def test_storage_errors_wait_by_the_backoff(tmp_path):
    waits = []
    with pytest.raises(OSError):
        list(landing._read(str(tmp_path), landing.Landed("a", "none.json"), 100, 350, 4, waits.append))
    assert waits == [0.2, 0.35, 0.35]


def test_sessions_end_by_silence_close_and_limit(spark):
    ms = 1_000_000
    log = [(0, "message", None), (50_000, "message", None), (200_000, "message", None), (201_000, "close", None), (201_500, "close", None), (203_000, "limited", "7000"), (203_100, "message", None)]
    df = spark.createDataFrame([("c", t * ms, i, e, raw) for i, (t, e, raw) in enumerate(log)], "connection string, received_ts_ns long, seq long, event string, raw string")
    got = [tuple(r)[4:] for r in landing.connection_sessions(df).orderBy("session").collect()]
    assert got == [(2, "silence", 0, 1000), (1, "close", 1, 2000), (0, "close", 2, 4000), (0, "limited", 0, 7000), (1, None, None, None)]


TICK = "venue string, symbol string, seq long, exchange_ts_ns long, received_ts_ns long, bid double, ask double"


def tick(seq, seconds, bid=1.0, venue="v"):
    return venue, "s", seq, int(seconds * 1e9), int(seconds * 1e9), bid, bid + 0.1


def test_timer_emits_intervals_without_ticks_and_state_survives_restarts(spark, tmp_path):
    members = spark.createDataFrame([("v", "s", "g", 0.0, 1e-4), ("w", "s", "g", 0.1, 1e-4)], "venue string, symbol string, grp string, bias double, noise_var double")
    rows = []
    for part in ([tick(1, 5.5), tick(2, 8.2, 1.1, "w")], [tick(3, 41.0)], [tick(4, 60.5, 1.2)]):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(TICK).parquet(str(tmp_path / "in"))
        with live.rocksdb(spark):
            out = live.fair_price(stream, members, 10**9, 1e-9, late="1 second")
            run_to_end(out, str(tmp_path))
        rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).orderBy("snap_ts_ns").collect()
    ends = [r["snap_ts_ns"] // 10**9 for r in rows]
    assert ends == list(range(6, 60))  # one each second up to the watermark, 59.5
    assert {r["snap_ts_ns"] // 10**9 for r in rows if r["n_ticks_used"]} == {6, 9, 41}
    quiet = [r["p"] for r in rows if 9 <= r["snap_ts_ns"] // 10**9 < 41]
    assert quiet == sorted(quiet) and quiet[0] < quiet[-1]  # nothing seen: the variance grows


def test_asof_state_stays_bounded(spark, tmp_path):
    sizes = []
    for lo in range(1000, 1400, 100):
        spark.createDataFrame([tick(i, i + 0.5) for i in range(lo, lo + 100)], TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        prices = [("v", i * 10**9, float(i)) for i in range(lo, lo + 100, 3)]
        spark.createDataFrame(prices, "venue string, at_ns long, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        left = spark.readStream.schema(TICK).parquet(str(tmp_path / "l"))
        right = spark.readStream.schema("venue string, at_ns long, price double").parquet(str(tmp_path / "r"))
        with live.rocksdb(spark):
            out = live.asof(left.select("venue", "seq", "exchange_ts_ns"), right, ["venue"], "exchange_ts_ns", "at_ns", late="5 seconds")
            q = run_to_end(out, str(tmp_path))
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    assert all(r["r_price"] == r["seq"] // 100 * 100 + r["seq"] % 100 // 3 * 3.0 for r in rows)
    assert len(rows) > 380 and len({r["seq"] for r in rows}) == len(rows)
    assert max(sizes) <= 30  # the watermark's delay, not the stream


def test_ring_over_restarts(spark, tmp_path):
    schema = "venue string, symbol string, seq long"
    for lo, n in ((0, 3), (100, 6), (200, 1)):
        spark.createDataFrame([(v, "s", i) for v in "vw" for i in range(lo, lo + n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with live.rocksdb(spark):
            out = live.ring(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4)
            run_to_end(out, str(tmp_path))
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in live.ring_now(rows).select("venue", "seq").collect()) == [(v, i) for v in "vw" for i in (103, 104, 105, 200)]
    assert rows.agg({"write_count": "max"}).first()[0] == 10
    with pytest.raises(ValueError):
        live.ring(rows, 3)
