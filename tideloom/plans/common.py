"""Settings that the registered queries and their SQL share, and small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, snapshots
from ..sources import adapters

HOUR_NS = 3_600_000_000_000
BASE_MS = 3_600_000
KEY = ["venue", "symbol"]


def ticks(s: SparkSession, d: str) -> DataFrame:
    return adapters.ticks(s, d)


def snaps(s: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshots(ticks(s, d), HOUR_NS)


def base_bars(s: SparkSession, d: str) -> DataFrame:
    return bars.tick_bars(ticks(s, d), BASE_MS)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors share: under the checkpoint folder, else under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tideloom/{label}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, path: str):
    """Runs a stream over what there is now into ``path``/out, going on from ``path``/log; returns the ended query."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded after all arithmetic, so that engines that sum in another order agree."""
    return df.select(*[(F.round(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


def drop_symbol(df: DataFrame) -> DataFrame:
    return df.drop("symbol")


SNAPS_SQL = """mt AS (SELECT *, (bid + ask) / 2 AS mid, exchange_ts_ns // 3600000000000 AS b FROM ticks),
bk AS (SELECT venue, b, arg_max({'bid': bid, 'ask': ask, 'bq': bid_qty, 'aq': ask_qty, 'ex': exchange_ts_ns, 'rc': received_ts_ns}, seq) AS q, max(mid) AS h, min(mid) AS l, max(bid) AS bh, min(ask) AS al, count(*)::INT AS n FROM mt GROUP BY ALL),
gr AS (SELECT venue, unnest(range(min(b), (SELECT max(b) FROM bk) + 1)) AS b FROM bk GROUP BY venue),
cf AS (SELECT gr.venue, gr.b, h, l, bh, al, coalesce(n, 0) AS n_ticks, last_value(q IGNORE NULLS) OVER (PARTITION BY gr.venue ORDER BY gr.b ROWS UNBOUNDED PRECEDING) AS q FROM gr LEFT JOIN bk ON gr.venue = bk.venue AND gr.b = bk.b),
s0 AS (SELECT venue, (b + 1) * 3600000000000 AS snap_ts_ns, q.bid AS bid, q.ask AS ask, q.bq AS bid_qty, q.aq AS ask_qty, (q.bid + q.ask) / 2 AS midquote, q.ask - q.bid AS spread, h, l, bh, al, q.ex AS exchange_ts_ns, q.rc AS received_ts_ns, n_ticks FROM cf),
snaps AS (SELECT venue, snap_ts_ns, bid, ask, bid_qty, ask_qty, midquote, spread, ln(midquote / lag(midquote) OVER w) AS log_return, greatest(coalesce(h, midquote), midquote) AS mid_high, least(coalesce(l, midquote), midquote) AS mid_low,
  greatest(coalesce(bh, bid), bid) AS bid_high, least(coalesce(al, ask), ask) AS ask_low, (received_ts_ns - exchange_ts_ns) / 1e6 AS exchange_lat_ms, (snap_ts_ns - received_ts_ns) / 1e6 AS receive_lat_ms, exchange_ts_ns, received_ts_ns, n_ticks
  FROM s0 WINDOW w AS (PARTITION BY venue ORDER BY snap_ts_ns)),
rk AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY snap_ts_ns DESC) AS rn FROM snaps)"""

BARS_SQL = """bars AS (SELECT venue, exchange_ts_ns // 3600000000000 * 3600000 AS open_time_ms, arg_min((bid + ask) / 2, seq) AS open, max((bid + ask) / 2) AS high, min((bid + ask) / 2) AS low, arg_max((bid + ask) / 2, seq) AS close, 0.0::DOUBLE AS volume, count(*)::INT AS n_src FROM ticks GROUP BY ALL),
gkb AS (SELECT *, CASE WHEN open > 0 AND high > 0 AND low > 0 AND close > 0 THEN greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0) ELSE 0 END AS gk FROM bars)"""


def sql(ctes: list[str], select: str, recursive: bool = False) -> str:
    from ..sources.adapters import TICKS_SQL

    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([TICKS_SQL, *ctes]) + "\n" + select


def r(*cols: str, digits: int = 6) -> str:
    """``round(x, digits) AS name`` for ``x AS name`` items."""
    out = []
    for c in cols:
        e, _, n = c.rpartition(" AS ") if " AS " in c else (c, "", c)
        out.append(f"round({e}, {digits}) AS {n}")
    return ", ".join(out)
