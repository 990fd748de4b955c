"""Feeds, files and the object interface."""

import json

from pyspark.sql import functions as F

from tideloom import api
from tideloom.operators.vol import VolParams
from tideloom.sources import adapters, feeds, files

SF = "/root/testdata/sf0.001"


def _pb(fields):
    out = b""
    for n, v in fields:
        tag, size = n << 3 | 2, len(v)
        for x in (tag, size):
            while x > 127:
                out += bytes([x & 127 | 128])
                x >>= 7
            out += bytes([x])
        out += v
    return out


def test_protobuf_ticker(spark):
    book = _pb([(1, b"100.5"), (2, b"2"), (3, b"100.6"), (4, b"3")])
    msg = _pb([(1, b"channel"), (3, b"BTCUSDT"), (315, book)])
    assert feeds.protobuf_ticker(msg) == ("BTCUSDT", 100.5, 100.6, 2.0, 3.0)
    assert feeds.protobuf_ticker(msg[:-3]) is None and feeds.protobuf_ticker(None) is None
    raw = spark.createDataFrame([("mexc", "spot", bytearray(msg), 1, 1), ("mexc", "spot", bytearray(b"x"), 1, 2)], "venue string, itype string, data binary, received_ts_ns long, seq long")
    assert feeds.protobuf_quotes(raw).count() == 1


def test_feeds_drop_and_scale(spark):
    rows = [
        ("binance", "spot", json.dumps({"data": {"s": "X", "b": "2", "a": "1", "B": "1", "A": "1", "u": 1}})),
        ("bybit", "spot", json.dumps({"ts": 5, "data": {"s": "X", "b": [], "a": [["2", "3"]]}})),
        ("nado", "perp", json.dumps({"product_id": 2, "bid_price": "1500000000000000000", "ask_price": "2000000000000000000", "bid_qty": "1000000000000000000", "ask_qty": "1", "timestamp": "7"})),
        ("bingx", "perp", json.dumps({"dataType": "t", "data": json.dumps({"s": "X", "b": "1", "a": "2", "B": 3, "A": "4", "E": 9})})),
        ("coinbase", "spot", json.dumps({"type": "heartbeat"})),
    ]
    raw = spark.createDataFrame([(v, i, m, 0, n) for n, (v, i, m) in enumerate(rows)], "venue string, itype string, raw string, received_ts_ns long, seq long")
    got = {r["venue"]: r for r in feeds.quotes(raw).collect()}
    assert set(got) == {"bybit", "nado", "bingx"}
    assert got["bybit"]["bid"] is None and got["bybit"]["ask"] == 2.0 and got["nado"]["bid"] == 1.5
    assert (got["bingx"]["bid_qty"], got["bingx"]["ask_qty"], got["bingx"]["exchange_ts_raw_ns"]) == (3.0, 4.0, 9_000_000)


def test_klines_and_capture_round_trip(spark, tmp_path):
    d = tmp_path / "k" / "BTCUSDT"
    d.mkdir(parents=True)
    (d / "2024-01-01.csv").write_text("t,o,h,l,c,v\n120000,1,2,0.5,1.5,3\n60000,1,2,0.5,1.5,3\n180000,0,2,1,1,1\n")
    (d / "2024-01-02.csv").write_text("t,o,h,l,c,v\n240000,1,2,0.5,1.5,3\n")
    assert files.read_klines(spark, str(tmp_path / "k"), "btc").count() == 3
    assert files.read_klines(spark, str(tmp_path / "k"), "btc", "2024-01-02").count() == 1
    t = files.capture_quotes(adapters.ticks(spark, SF))
    files.write_capture(t, str(tmp_path / "cap"))
    assert spark.read.parquet(str(tmp_path / "cap")).count() == t.count()


def test_lead_lag_csv(spark, tmp_path):
    rows = [(i * 10, "PERP-BTC-USDT", "a", 1.0 + i, 1.1 + i, 1.0, 1.0, i, i) for i in range(10)] + [(50, "PERP-BTC-USDT", "b", 2.0, 1.0, 1.0, 1.0, 5, 5)]
    from tideloom import schemas

    files.write_csv_gz(spark.createDataFrame(rows, schemas.LEAD_LAG_CSV), str(tmp_path / "ll"))
    got = files.read_lead_lag(spark, str(tmp_path / "ll"), 30)
    assert got.count() == 7 and got.first()["base"] == "BTC"


def test_config_and_beacon(tmp_path):
    p = tmp_path / "b.json"
    p.write_text(json.dumps({"groups": {"G": {"ann_vol": 0.5, "h_per_ms": 9}}}))
    b = files.Beacon(str(p))
    changed, params = b.load()
    assert changed and abs(params["groups"]["G"]["h_per_ms"] - 0.25 / (365.25 * 86_400_000)) < 1e-18 and not b.load()[0]
    v = files.vol_params({"target_min": 5, "seasonality": {"f_h": {3: 2.0}}, "models": {"har_ols": {"feature_names": ["log_rv_1", "log_rv_6"], "params": [0.1, 0.2, 0.3]}}})
    assert v.f_h[3] == 2.0 and v.f_d == [1.0] * 7 and v.har_ols["windows"] == [1, 6] and v.max_window() == 6
    assert files.merge_cache(str(tmp_path / "c.json"), {"a": 1}) == {"a": 1} and files.merge_cache(str(tmp_path / "c.json"), {"b": 2}) == {"a": 1, "b": 2}
    assert feeds.backoff_ms(20, 100, 5000) == 5000 and feeds.backoff_ms(1, 100, 5000, 900) == 900


def test_api(spark):
    t = adapters.ticks(spark, SF)
    m = api.FeedManager(api.AppConfig.from_dict({"snapshot_interval_ms": 3_600_000, "clock_correction": "none"}), t).start_spot_feeds().start_snapshots()
    a, venue = m.get_analytics(), t.first()["venue"]
    assert a.midquote_twap(venue, "SYM", 50) > 0 and a.log_returns(venue, "SYM", 5).count() <= 5
    assert a.midquote_twap("nowhere", "SYM", 50) is None
    md = m.get_market_data()
    assert md.get_bid(venue, "SYM") < md.get_ask(venue, "SYM")
    members = t.select("venue", "symbol").distinct().withColumns({"grp": F.lit("G"), "bias": F.lit(0.0), "noise_var": F.lit(1e-4), "gg_weight": F.lit(1.0)})
    fp = m.start_fair_price(members, step_ms=86_400_000, model="gg").get_fair_price()
    assert fp.groups() == ["G"] and fp.latest_price("G") > 0 and fp.history("G", 3).count() == 3
    assert fp.get_fair_quote("G", venue, "SYM").count() == 1
    v = m.start_vol_engine(VolParams(target_min=6), 3_600_000).get_vol_engine()
    assert {r["status"] for r in v.predict().collect()} <= {"Ok", "InsufficientBars"}
    reg = api.SymbolRegistry(spark, ["BTC"])
    assert reg.lookup("BTC_USDT", "perp") == 1 and reg.get_symbol(0) == "SPOT-BTC-USDT"


def test_kline_pages(spark):
    from tideloom.sources import files

    pages = [("A", '[[1,"2","3","1","2.5","7",0],[2,"2","3","1"],[3,"x","3","1","2","5"],[4,"2","3","1","2","0"]]'), ("B", "oops"), ("C", None), ("D", "[]"), ("A", '[[1,"2","3","1","2.5","7",0]]')]
    df = spark.createDataFrame(pages, "symbol string, payload string")
    got = [tuple(r) for r in files.decode_klines(df).collect()]
    assert got == [("A", 1, 2.0, 3.0, 1.0, 2.5, 7.0)] * 2
    assert sorted(r["open_time_ms"] for r in files.decode_klines(df, traded=False).collect()) == [1, 1, 4]
    assert files.decode_klines(df.limit(0)).count() == 0


def test_merge_order(spark):
    from tideloom.operators import cleaning

    rows = [("a", 1, 50, 1, None), ("a", 2, None, 40, 1), ("a", 3, None, None, 45), ("a", 4, None, None, None), ("a", 5, 50, None, None), (None, 6, 9, None, None), (None, 7, 8, None, None)]
    df = spark.createDataFrame(rows, "venue string, seq long, exchange_ts_ns long, received_ts_ns long, snap_ts_ns long")
    got = {r["seq"]: (r["merge_ns"], r["merge_pos"]) for r in cleaning.merge_order(df, bucket_ns=10, key=("venue",)).collect()}
    assert got == {4: (None, 1), 2: (40, 2), 3: (45, 3), 1: (50, 4), 5: (50, 5), 7: (8, 1), 6: (9, 2)}
