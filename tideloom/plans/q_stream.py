"""Streams run to their end over the event files, and the remaining sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import cleaning, folds, pools
from ..sources import adapters, files
from ..sources.adapters import BOOKS_SQL
from ..streaming import state, windows
from .common import BARS_SQL, BASE_MS, HOUR_NS, KEY, SNAPS_SQL, base_bars, drop_symbol, r, rounded, run_to_end, scratch, snaps, sql, ticks
from .q_bars import ROLL
from .q_core import SQL as CORE_SQL
from .q_live import even_edges, in_parts, staged

QUERIES, SQL = {}, {}


def q(name, fn, select=None, digits=6):
    QUERIES[name] = lambda s, d: rounded(drop_symbol(fn(s, d)), digits)
    if select:
        SQL[name] = select


class _Reader:
    """Stands in for a session whose reader is a stream of the same files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.read = spark, self

    def parquet(self, path: str) -> DataFrame:
        folder, _, name = path.rpartition("/")
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The whole output of a stream over what there is now, through a Parquet sink in the shared folder."""
    path = scratch(spark, "stream")
    run_to_end(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def in_order(spark: SparkSession, df: DataFrame, op) -> DataFrame:
    """The output of ``op`` over a stream that takes ``df`` in micro-batches of bounded size, in the order of seq."""
    return in_parts(spark, {"rows": staged(df, "seq", even_edges(df, "seq", 1))}, lambda rows: op(rows))


q("j5_stream_stale_drop", lambda s, d: in_order(s, ticks(s, d).select(*KEY, "seq", "exchange_ts_ns"), state.drop_stale).select(*KEY, "seq"), sql([], "SELECT venue, seq FROM (SELECT venue, seq, exchange_ts_ns AS t, max(exchange_ts_ns) OVER (PARTITION BY venue ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ticks) WHERE m IS NULL OR t >= m"))
q("j6_stream_clock", lambda s, d: in_order(s, ticks(s, d).select(*KEY, "seq", "exchange_ts_raw_ns", "exchange_ts_ns", "received_ts_ns"), lambda rows: state.clock_correct(rows, "max")).select(*KEY, "seq", "clock_offset_ns", "exchange_ts_ns"), CORE_SQL["c4_clock_max"])
q("j2_stream_bars", lambda s, d: drained(s, state.rolled_bars(adapters.ticks(_Reader(s), d), 6, BASE_MS)), sql([BARS_SQL, ROLL], f"SELECT venue, ot AS open_time_ms, {r('open', 'high', 'low', 'close', 'volume')}, n_src FROM rb WHERE n // 21600000 > t // 21600000 AND t + 3600000 >= n // 21600000 * 21600000"))
q("j9_stream_book", lambda s, d: in_order(s, adapters.book_updates(s, d), state.book_tops).groupBy(*KEY).agg(F.max_by(F.struct("bid", "ask", "bid_qty", "ask_qty"), "seq").alias("q")).select(*KEY, "q.*"), CORE_SQL["j9_book_top"])

q("a18_lead_lag_rows", lambda s, d: files.lead_lag_rows(cleaning.grid_sample(ticks(s, d), 6 * HOUR_NS)).select("sample_ts", "exchange", "bid", "ask", "exchange_ts"), sql(["bk AS (SELECT venue, exchange_ts_ns // 21600000000000 AS b, arg_max({'bid': bid, 'ask': ask, 't': exchange_ts_ns}, seq) AS q FROM ticks GROUP BY ALL)", "gr AS (SELECT venue, unnest(range(min(b), (SELECT max(b) FROM bk) + 1)) AS b FROM bk GROUP BY venue)", "cf AS (SELECT gr.venue, gr.b, last_value(q IGNORE NULLS) OVER (PARTITION BY gr.venue ORDER BY gr.b ROWS UNBOUNDED PRECEDING) AS q FROM gr LEFT JOIN bk USING (venue, b))"], f"SELECT (b + 1) * 21600000000000 AS sample_ts, venue AS exchange, {r('q.bid AS bid', 'q.ask AS ask')}, q.t AS exchange_ts FROM cf"))
q("m3_garch_filter", lambda s, d: folds.path(snaps(s, d).where("log_return IS NOT NULL").select(*KEY, "snap_ts_ns", "log_return"), KEY, ["snap_ts_ns"], ["log_return"], lambda x: cal.variance_lanes(x, 0.1, 0.8, 0.01, 1.0, paths=True)[:, 0], {"h": "double"}).select(*KEY, "snap_ts_ns", "h"),
  sql([SNAPS_SQL, "x AS (SELECT venue, snap_ts_ns, log_return AS x, row_number() OVER (PARTITION BY venue ORDER BY snap_ts_ns) AS k FROM snaps WHERE log_return IS NOT NULL)", "g AS (SELECT venue, snap_ts_ns, k, x, 1.0::DOUBLE AS h FROM x WHERE k = 1 UNION ALL SELECT x.venue, x.snap_ts_ns, x.k, x.x, 0.1 + 0.1 * greatest(g.x * g.x - 0.01, 0) + 0.8 * g.h FROM g JOIN x ON x.venue = g.venue AND x.k = g.k + 1)"], f"SELECT venue, snap_ts_ns, {r('h')} FROM g", True))

# Blocks of raw call results made of the ticks: four pools a block, words of 256 bits; every 97th price call is cut short.
POOL_DIM = [(0, "p0", 10, 6, 6, 3000, False), (1, "p1", 60, 6, 6, 500, True), (2, "p2", 1, 6, 6, 100, False), (3, "p3", 200, 6, 6, 10000, True)]


def raw_polls(s, d):
    k = "524288 + (seq * 7919) % 1572864"
    t = ticks(s, d).selectExpr("seq", "seq DIV 4 AS block_number", "seq % 4 AS i", f"hex({k}) AS k", "hex(1000000000 + seq) AS l",
                               f"CAST(floor(2 * ln(({k}) / 1048576D) / ln(1.0001D)) AS BIGINT) AS tick")
    t = t.selectExpr(
        "block_number", "i", "seq", "'0x' || lpad(l || repeat('0', 16), 64, '0') AS liq",
        "'0x' || lpad(k || repeat('0', 19), 64, '0') || lpad(lower(hex(tick)), 64, IF(tick < 0, 'f', '0')) || repeat('0', 256) AS price")
    calls = [F.max(F.when(F.col("i") == i, c)) for i in range(4) for c in (F.expr("IF(seq % 97 = 0, left(price, 300), price)"), F.col("liq"))]
    return t.groupBy("block_number").agg(F.array(*calls).alias("results")).selectExpr("block_number", "block_number AS block_ts_ns", "block_number AS received_ts_ns", "results")


def pool_polls(s, d):
    dim = s.createDataFrame(POOL_DIM, "pool_index int, pool string, tick_spacing int, decimals0 int, decimals1 int, fee int, invert boolean")
    q = pools.pool_quotes(pools.pool_states(raw_polls(s, d), dim))
    return q.selectExpr("block_number", "pool", "sqrt_price_x96", "liquidity", "active_tick", "bid", "ask", f"bid_qty / {2.0**64!r}D AS bid_qty", f"ask_qty / {2.0**64!r}D AS ask_qty")


q("a8_pool_polls", pool_polls, sql([
    "dm AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {sp}, {fee}, {str(inv).lower()})" for i, n, sp, _, _, fee, inv in POOL_DIM) + ") v(i, pool, sp, fee, inv))",
    "kk AS (SELECT seq, seq // 4 AS block_number, seq % 4 AS i, 524288 + (seq * 7919) % 1572864 AS k, 1000000000 + seq AS l FROM ticks WHERE seq % 97 <> 0)",
    "st AS (SELECT block_number, pool, k, l, sp, fee, inv, k / 1048576.0::DOUBLE AS p, floor(2 * ln(k / 1048576.0::DOUBLE) / ln(1.0001::DOUBLE))::INT AS tick FROM kk JOIN dm ON kk.i = dm.i)",
    "pq AS (SELECT *, pow(1.0001, (floor(tick / sp::DOUBLE) * sp) / 2.0) AS lo, pow(1.0001, (floor(tick / sp::DOUBLE) * sp + sp) / 2.0) AS hi, CASE WHEN inv THEN 1 / (p * p) ELSE p * p END AS price FROM st)"],
    "SELECT block_number, pool, (k::HUGEINT * 75557863725914323419136::HUGEINT)::VARCHAR AS sqrt_price_x96, (l::HUGEINT * 18446744073709551616::HUGEINT)::VARCHAR AS liquidity, tick AS active_tick, "
    + r("price * (1 - fee / 1e6) AS bid", "price * (1 + fee / 1e6) AS ask", "l * CASE WHEN inv THEN hi - p ELSE 1 / lo - 1 / p END / 1e6 AS bid_qty", "l * CASE WHEN inv THEN p - lo ELSE 1 / p - 1 / hi END / 1e6 AS ask_qty") + " FROM pq"))

# Windows of streams: those that end by the watermark (ten seconds before the newest tick, in whole milliseconds) are emitted.
MARK_SQL = "mark AS (SELECT (max(exchange_ts_ns) // 1000000 - 10000) * 1000 AS w FROM ticks)"
US_SQL = "us AS (SELECT *, exchange_ts_ns // 1000 AS u, (bid + ask) / 2 AS mid FROM ticks)"
EDGES = "first(mid ORDER BY exchange_ts_ns, seq) AS open, max(mid) AS high, min(mid) AS low, last(mid ORDER BY exchange_ts_ns, seq) AS close, count(*) AS n_src"
q("j3_sliding_bars", lambda s, d: drained(s, windows.sliding_bars(adapters.ticks(_Reader(s), d), "6 hours", "2 hours")),
  sql([MARK_SQL, US_SQL, f"sw AS (SELECT venue, u // 7200000000 * 7200000000 - k * 7200000000 AS st, {EDGES} FROM us, range(3) x(k) GROUP BY ALL)"],
      f"SELECT venue, st // 1000 AS open_time_ms, {r('open', 'high', 'low', 'close')}, n_src FROM sw, mark WHERE st + 21600000000 <= w"))
q("j3_interval_quotes", lambda s, d: drained(s, windows.interval_quotes(adapters.ticks(_Reader(s), d), "1 hour")),
  sql([MARK_SQL, US_SQL, "iq AS (SELECT venue, u // 3600000000 * 3600000000 + 3600000000 AS e, last({'bid': bid, 'ask': ask, 'bid_qty': bid_qty, 'ask_qty': ask_qty} ORDER BY exchange_ts_ns, seq) AS q, "
       "max(mid) AS mid_high, min(mid) AS mid_low, max(bid) AS bid_high, min(ask) AS ask_low FROM us GROUP BY ALL)"],
      f"SELECT venue, e * 1000 AS snap_ts_ns, {r('q.bid AS bid', 'q.ask AS ask', 'q.bid_qty AS bid_qty', 'q.ask_qty AS ask_qty', 'mid_high', 'mid_low', 'bid_high', 'ask_low')} FROM iq, mark WHERE e <= w"))
q("j4_sessions", lambda s, d: drained(s, windows.sessions(adapters.ticks(_Reader(s), d), "1 hour")),
  sql([MARK_SQL, US_SQL, "cut AS (SELECT venue, u, CASE WHEN u - lag(u) OVER o <= 3600000000 THEN 0 ELSE 1 END AS c FROM us WINDOW o AS (PARTITION BY venue ORDER BY u))",
       "run AS (SELECT venue, u, sum(c) OVER (PARTITION BY venue ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT venue, u, max(c) AS c FROM cut GROUP BY ALL))",
       "many AS (SELECT venue, u, count(*) AS n FROM us GROUP BY ALL)",
       "ses AS (SELECT venue, g, min(u) AS start_us, max(u) + 3600000000 AS end_us, sum(n)::BIGINT AS n_ticks FROM run JOIN many USING (venue, u) GROUP BY ALL)"],
      "SELECT venue, start_us, end_us, n_ticks FROM ses, mark WHERE end_us <= w"))


def _partly_timed(s: SparkSession, d: str) -> DataFrame:
    """Ticks of which some lack the first time, some the first two."""
    return ticks(s, d).selectExpr(
        "venue", "symbol", "seq", "exchange_ts_ns + 60000000000 AS snap_ts_ns",
        "CASE WHEN seq % 3 > 0 THEN exchange_ts_ns END AS exchange_ts_ns", "CASE WHEN seq % 6 > 0 THEN received_ts_ns END AS received_ts_ns",
    )


q("j7_merge_order", lambda s, d: cleaning.merge_order(_partly_timed(s, d)).select(*KEY, "seq", "merge_ns", "merge_pos"),
  sql(["pt AS (SELECT venue, seq, CASE WHEN seq % 3 > 0 THEN exchange_ts_ns WHEN seq % 6 > 0 THEN received_ts_ns ELSE exchange_ts_ns + 60000000000 END AS merge_ns FROM ticks)"],
      "SELECT venue, seq, merge_ns, row_number() OVER (PARTITION BY venue ORDER BY merge_ns, seq) AS merge_pos FROM pt"))


def _kline_pages(s: SparkSession, d: str) -> DataFrame:
    """A page of bars a day and venue; quiet bars have volume 0."""
    row = """concat('[', open_time_ms, ',"', open, '","', high, '","', low, '","', close, '","', n_src - 1, '",0]')"""
    page = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.expr(row))), ","), F.lit(",[1,\"2\"]]"))
    return base_bars(s, d).groupBy("venue", F.expr("open_time_ms DIV 86400000")).agg(page.alias("payload"))


def _klines(s: SparkSession, d: str) -> DataFrame:
    kinds = [files.decode_klines(_kline_pages(s, d), symbol="venue", traded=t).withColumn("kind", F.lit(k)) for k, t in (("1m", True), ("1d", False))]
    return kinds[0].unionByName(kinds[1]).withColumnRenamed("symbol", "venue")


q("a10_klines", _klines,
  sql([BARS_SQL, "k AS (SELECT '1m' AS kind, * FROM bars WHERE n_src > 1 UNION ALL SELECT '1d', * FROM bars)"],
      f"SELECT kind, venue, open_time_ms, {r('open', 'high', 'low', 'close', '(n_src - 1)::DOUBLE AS volume')} FROM k WHERE open > 0"))
