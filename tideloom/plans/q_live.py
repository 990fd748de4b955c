"""Live forms: feeds through the landing source, and keyed state with timers, initial state and expiry.

Every stream here runs in ``PARTS`` micro-batches or more with a restart between them: the next part of the tables lands, and the query goes on
from its checkpoint. What a key's state and task hold is bounded by a micro-batch, so streams whose rows wait for the watermark (and those of
``q_stream`` that sort a key's rows) take parts of about ``PART_ROWS`` rows, as many as there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fairprice as fp
from ..sources import feeds, landing
from ..streaming import processors as live
from . import feed_samples as fs
from . import model_sql as ms
from .common import BASE_MS, HOUR_NS, KEY, drop_symbol, r, rounded, run_to_end, scratch, sql, ticks
from .q_bars import CUT, hist
from .q_bars import SQL as BARS
from .q_core import SQL as CORE
from .q_fair import EDGES, FQ, GG, KF, MEMQ, SNAP, gg, members
from .q_sources import MULT
from .q_sources import SQL as SOURCES

QUERIES, SQL = {}, {}
PARTS = 3
PART_ROWS = 500_000


def q(name, fn, select=None, digits=6):
    QUERIES[name] = lambda s, d: rounded(drop_symbol(fn(s, d)), digits)
    if select:
        SQL[name] = select


def parts_of(df: DataFrame, ts: str, edges: list[int]) -> list[DataFrame]:
    """``df`` cut at the times ``edges``."""
    lows, highs = [None, *edges], [*edges, None]
    return [df.where((F.lit(True) if lo is None else F.col(ts) >= lo) & (F.lit(True) if hi is None else F.col(ts) < hi)) for lo, hi in zip(lows, highs)]


def edges_of(df: DataFrame, ts: str, n: int = PARTS) -> list[int]:
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    return [] if lo is None else [lo + (hi - lo) * k // n for k in range(1, n)]


def even_edges(df: DataFrame, ts: str, least: int = PARTS, rows: int | None = None) -> list[int]:
    """Values of ``ts`` that cut ``df`` into parts of about ``rows`` (``PART_ROWS``) rows, ``least`` parts at least. Rows of one value stay together."""
    n = max(least, -(-df.count() // (rows or PART_ROWS)))
    cuts = df.agg(F.percentile_approx(ts, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return sorted(set(cuts or []))


def staged(df: DataFrame, ts: str, edges: list[int]) -> list[DataFrame]:
    """``df`` cut at ``edges``, worked out once: written by part, so that each part is read without the others."""
    path = scratch(df.sparkSession, "parts")
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(ts))) if edges else F.lit(0)
    df.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(path)
    whole = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    return [whole.where(F.col("_part") == k).drop("_part") for k in range(len(edges) + 1)]


def in_parts(spark: SparkSession, tables: dict[str, list[DataFrame]], op) -> DataFrame:
    """Rows that ``op`` (streams by name to a stream) has written when the parts of ``tables`` have landed one after another."""
    path = scratch(spark, "live")
    n = max(len(p) for p in tables.values())
    for k in range(n):
        for name, parts in tables.items():
            parts[k].write.mode("append").parquet(f"{path}/in-{name}")
        streams = {name: spark.readStream.schema(parts[0].schema).parquet(f"{path}/in-{name}") for name, parts in tables.items()}
        with live.rocksdb(spark):
            out = op(**streams)
            run_to_end(out, path)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _landed_quotes(s: SparkSession, d: str) -> DataFrame:
    t = ticks(s, d)
    path = scratch(s, "feeds")
    mult = s.createDataFrame(MULT, "venue string, itype string, symbol string, multiplier double")
    for k, part in enumerate(parts_of(t, "seq", edges_of(t, "seq"))):
        landing.record(fs.quote_messages(part), f"{path}/landing", k)
        out = feeds.quotes(landing.stream(s, f"{path}/landing").drop("connection", "event"), mult)
        run_to_end(out, path)
    return s.read.schema(out.schema).parquet(f"{path}/out")


q("a1_feed_stream", lambda s, d: _landed_quotes(s, d).select("venue", "itype", F.col("symbol").alias("native"), "seq", "bid", "ask", "bid_qty", "ask_qty", "exchange_ts_raw_ns", "received_ts_ns"), SOURCES["a3_feed_quotes"].replace(" AS symbol", " AS native"))

EVENT = "CASE WHEN seq % 75 = 0 THEN 'limited' WHEN seq % 4 = 0 THEN 'close' ELSE 'message' END"


def _sessions(s: SparkSession, d: str) -> DataFrame:
    log = ticks(s, d).selectExpr("venue AS connection", "received_ts_ns", "seq", f"{EVENT} AS event", "CASE WHEN seq % 75 = 0 THEN '5000' END AS raw")
    return landing.connection_sessions(log, silence_ms=600_000, stable_ms=900_000)


q("a1_connection_sessions", _sessions, sql([
    f"lg AS (SELECT venue AS connection, received_ts_ns AS t, seq, {EVENT} AS event FROM ticks)",
    "st AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 600000000000 AND lag(event) OVER w = 'message' THEN 0 ELSE 1 END AS fresh FROM lg WINDOW w AS (PARTITION BY connection ORDER BY t, seq))",
    "nm AS (SELECT *, (sum(fresh) OVER (PARTITION BY connection ORDER BY t, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM st)",
    "ss AS (SELECT connection, session, min(t) AS start_ns, max(t) AS last_ns, count(*) FILTER (event = 'message') AS n_messages, last(event ORDER BY t, seq) AS le FROM nm GROUP BY ALL)",
    "en AS (SELECT *, CASE WHEN le <> 'message' THEN le WHEN lead(session) OVER (PARTITION BY connection ORDER BY session) IS NOT NULL THEN 'silence' END AS ended_by FROM ss)",
    "zr AS (SELECT *, CASE WHEN le = 'limited' OR last_ns - start_ns + CASE WHEN ended_by = 'silence' THEN 600000000000 ELSE 0 END > 900000000000 THEN 1 ELSE 0 END AS z FROM en)",
    "rn AS (SELECT *, sum(z) OVER (PARTITION BY connection ORDER BY session ROWS UNBOUNDED PRECEDING) AS run FROM zr)",
    "rt AS (SELECT *, (sum(1 - z) OVER (PARTITION BY connection, run ORDER BY session ROWS UNBOUNDED PRECEDING))::BIGINT AS n FROM rn)"],
    "SELECT connection, session, start_ns, last_ns, n_messages, ended_by, CASE WHEN ended_by IS NOT NULL THEN n END AS retry_count, "
    "CASE WHEN ended_by = 'limited' THEN 5000 WHEN ended_by IS NOT NULL THEN least(1000 * pow(2, least(n, 10)), 60000)::BIGINT END AS wait_ms FROM rt"))

MARK = "mk1 AS (SELECT max(exchange_ts_ns) // 1000000 - 10000 AS mark FROM ticks)"  # milliseconds


def _kalman(step: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        t = ticks(s, d).select(*KEY, "seq", "exchange_ts_ns", "received_ts_ns", "bid", "ask")
        parts = staged(t, "exchange_ts_ns", even_edges(t, "exchange_ts_ns"))
        return in_parts(s, {"ticks": parts}, lambda ticks: live.fair_price(ticks, members(s), step, *KF))

    return run


UPTO = "(SELECT max(b) FROM tk)"
q("g1_stream_kalman", _kalman(HOUR_NS), sql([MEMQ, *ms.kalman(HOUR_NS, *KF, upto=UPTO), MARK], SNAP + ", mk1 WHERE snap_ts_ns <= mark * 1000000", True), digits=5)
q("g6_stream_predict_only", lambda s, d: _kalman(HOUR_NS // 4)(s, d).where("n_ticks_used = 0"), sql([MEMQ, *ms.kalman(HOUR_NS // 4, *KF, upto=UPTO), MARK], SNAP + ", mk1 WHERE n = 0 AND snap_ts_ns <= mark * 1000000", True), digits=5)


def _quotes(s: SparkSession, d: str) -> DataFrame:
    t, fair = ticks(s, d), gg(s, d).select("grp", "snap_ts_ns", "log_fair_price", "p")
    t = t.select(*KEY, "seq", "exchange_ts_ns", "received_ts_ns", "bid", "ask", "bid_qty", "ask_qty")
    edges = even_edges(t, "exchange_ts_ns")
    tables = {"ticks": staged(t, "exchange_ts_ns", edges), "fair": staged(fair, "snap_ts_ns", edges)}
    out = in_parts(s, tables, lambda ticks, fair: fp.fair_quotes(ticks, members(s), fair, 1e-9, 60_000.0, join=live.asof))
    return out.drop("ts_ns", "bid", "ask", "bid_qty", "ask_qty")


q("g8_stream_quotes", _quotes, sql([MEMQ, GG, FQ, MARK], f"SELECT grp, venue, seq, {r(*EDGES, digits=4)} FROM fq, mk1 WHERE t <= mark * 1000000"), digits=4)


def _seeded(s: SparkSession, d: str) -> DataFrame:
    t = ticks(s, d).where(F.col("exchange_ts_ns") >= CUT * 1_000_000)
    parts = parts_of(t, "exchange_ts_ns", edges_of(t, "exchange_ts_ns"))
    return live.newest_bars(in_parts(s, {"ticks": parts}, lambda ticks: live.seeded_bars(ticks, hist(s, d), BASE_MS, 512))).select(*KEY, "open_time_ms", "close")


q("d6_stream_warmup", _seeded, BARS["d6_warmup"])


def _ring(s: SparkSession, d: str) -> DataFrame:
    t = ticks(s, d)
    parts = parts_of(t, "seq", edges_of(t, "seq"))
    return live.ring_now(in_parts(s, {"ticks": parts}, lambda ticks: live.ring(ticks.select(*KEY, "seq", "bid", "ask"), 64)))


q("b4_stream_ring", _ring, sql([], f"SELECT venue, seq, {r('bid', 'ask')} FROM ticks QUALIFY row_number() OVER (PARTITION BY venue ORDER BY seq DESC) <= 64"))
