"""Files: kline CSV in, captures and diagnostics out, configuration and parameters."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.bars import merge_first

ROW_GROUP = 65_536


def read_klines(spark: SparkSession, folder: str, symbol: str | None = None, first_day: str | None = None) -> DataFrame:
    """1-minute bars from {folder}/{SYMBOL}USDT/YYYY-MM-DD.csv. Days before ``first_day`` are pruned by name; bad rows are dropped."""
    path = f"{folder}/{symbol.upper() + 'USDT' if symbol else '*USDT'}/*.csv"
    d = spark.read.schema(schemas.KLINE_CSV).option("header", True).option("enforceSchema", True).csv(path).withColumn("_f", F.input_file_name())
    if first_day:
        d = d.where(F.regexp_extract("_f", r"(\d{4}-\d{2}-\d{2})\.csv$", 1) >= first_day)
    return d.where("open > 0 AND volume > 0").select(F.regexp_extract("_f", r"/([^/]+)USDT/[^/]+$", 1).alias("symbol"), "open_time_ms", "open", "high", "low", "close", "volume")


def decode_klines(pages: DataFrame, payload: str = "payload", symbol: str = "symbol", traded: bool = True) -> DataFrame:
    """Bars of REST pages: ``payload`` is an array of arrays that begin with open time (ms), open, high, low, close, volume.

    Shorter entries are skipped, an unreadable number is 0, and only opens above 0 stay; with ``traded`` (pages of minutes) only volumes
    above 0 too, pages of hours and days keep quiet bars. Unreadable pages give nothing. Pages may overlap: ``merge_first`` drops repeats.
    """
    names = ["open", "high", "low", "close", "volume"]
    row = F.explode(F.from_json(F.col(payload), "array<array<string>>")).alias("row")
    d = pages.select(F.col(symbol).alias("symbol"), row).where("size(row) >= 6")
    numbers = [F.expr(f"coalesce(try_cast(row[{i}] AS DOUBLE), 0D)").alias(n) for i, n in enumerate(names, 1)]
    d = d.select("symbol", F.expr("coalesce(try_cast(row[0] AS BIGINT), 0L)").alias("open_time_ms"), *numbers)
    return d.where("open > 0 AND volume > 0" if traded else "open > 0")


def with_backfill(disk: DataFrame, backfill: DataFrame) -> DataFrame:
    """Disk bars and backfilled ones; disk wins for equal times."""
    return merge_first(disk, backfill)


def capture_quotes(ticks: DataFrame) -> DataFrame:
    return ticks.select(F.coalesce("received_ts_ns", "exchange_ts_ns").alias("tick_ts_ns"), F.col("venue").alias("exchange"), "symbol", "bid", "ask", "bid_qty", "ask_qty", "exchange_ts_ns", "received_ts_ns")


def capture_trades(trades: DataFrame) -> DataFrame:
    return trades.select(F.coalesce("received_ts_ns", "exchange_ts_ns").alias("tick_ts_ns"), F.col("venue").alias("exchange"), "symbol", "price", "qty", F.coalesce("side", F.lit("")).alias("side"), "exchange_ts_ns", "received_ts_ns")


def write_capture(df: DataFrame, path: str, mode: str = "append", by_day: bool = True) -> None:
    """Zstandard Parquet with bounded files, partitioned by day and exchange so that later reads can skip."""
    w = df.withColumn("day", F.to_date(F.timestamp_micros(F.expr("tick_ts_ns DIV 1000")))) if by_day else df
    out = w.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", ROW_GROUP * 64).option("parquet.block.row.count.limit", ROW_GROUP)
    (out.partitionBy("day", "exchange") if by_day else out).parquet(path)


def lead_lag_rows(samples: DataFrame) -> DataFrame:
    """Grid samples (of cleaning.grid_sample) as capture rows."""
    return samples.select(F.col("sample_ts_ns").alias("sample_ts"), F.col("symbol").alias("canonical_symbol"), F.col("venue").alias("exchange"), "bid", "ask", "bid_qty", "ask_qty", F.col("exchange_ts_ns").alias("exchange_ts"), F.col("received_ts_ns").alias("received_ts"))


def write_csv_gz(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)


def read_lead_lag(spark: SparkSession, path: str, warmup_ns: int = 0) -> DataFrame:
    """Capture rows with sane quotes after the warm-up, with mid, log_mid, rel_spread and base."""
    d = spark.read.schema(schemas.LEAD_LAG_CSV).option("header", True).csv(path)
    t0 = d.agg(F.min("sample_ts").alias("_t0"))
    d = d.join(F.broadcast(t0)).where(F.col("sample_ts") >= F.col("_t0") + warmup_ns).drop("_t0")
    d = d.where("bid > 0 AND ask > 0 AND ask > bid").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    return d.withColumn("log_mid", F.ln("mid")).withColumn("rel_spread", (F.col("ask") - F.col("bid")) / F.col("mid")).withColumn("base", F.try_element_at(F.split("canonical_symbol", "-"), F.lit(2)))


def innovation_rows(ticks: DataFrame, group_index: DataFrame) -> DataFrame:
    """Kalman tick rows as diagnostics; ``group_index``: (grp, group_idx)."""
    return ticks.join(group_index, "grp").select("snap_ts_ns", "tick_ts_ns", "group_idx", F.col("member_idx").cast("int"), "log_mid", "tau_ms", "q", "p_pre", "innovation", "s", "gain", "y_post", "p_post")


def group_rows(snaps: DataFrame, group_index: DataFrame) -> DataFrame:
    return snaps.join(group_index, "grp").where("n_ticks_used > 0").select("snap_ts_ns", "group_idx", F.col("log_fair_price").alias("y"), "p", "p_pre_fwd", "tau_fwd_ms", F.col("n_ticks_used").cast("int").alias("n_ticks"), "last_tick_ts_ns")


def params_json(df: DataFrame) -> str:
    """A small parameter table as one JSON array (one row a venue or group)."""
    return "[" + ",".join(df.toJSON().collect()) + "]"


def merge_cache(path: str, new: dict) -> dict:
    """Parameters by name merged over those in a file, written in one step."""
    old = json.load(open(path)) if os.path.exists(path) else {}
    out = old | new
    with open(path + ".tmp", "w") as f:
        json.dump(out, f, indent=1, sort_keys=True)
    os.replace(path + ".tmp", path)
    return out


class Beacon:
    """A parameter file that is read again when its time advances. An annual volatility comes before a rate per millisecond."""

    def __init__(self, path: str):
        self.path, self.mtime, self.params = path, -1.0, {}

    def load(self) -> tuple[bool, dict]:
        if not os.path.exists(self.path) or (m := os.path.getmtime(self.path)) <= self.mtime:
            return False, self.params
        from ..functions.scalars import MS_PER_YEAR

        self.mtime, raw = m, json.load(open(self.path))
        for g in raw.get("groups", {}).values():
            if g.get("ann_vol"):
                g["h_per_ms"] = g["ann_vol"] ** 2 / MS_PER_YEAR
        self.params = raw
        return True, raw


def load_config(path: str, defaults: dict | None = None) -> dict:
    """A YAML or JSON configuration over defaults."""
    text = open(path, encoding="utf-8").read()
    try:
        import yaml

        found = yaml.safe_load(text) or {}
    except ImportError:
        found = json.loads(text)
    return {"sample_interval_ms": 10, "snapshot_interval_ms": 100, "liquidity_exponent": 0.75, "clock_correction": "ewma", "min_latency_ms": 1.0, "clock_decay": 0.999} | (defaults or {}) | found


def vol_params(raw: dict):
    """Validated volatility parameters from a configuration's mapping."""
    from ..operators.vol import VolParams

    def har(m):
        if not m:
            return None
        windows = [int(n.removeprefix("log_rv_")) for n in m["feature_names"]]
        if len(m["params"]) != len(windows) + 1:
            raise ValueError("a HAR model needs an intercept and one parameter for each window")
        return {"intercept": m["params"][0], "betas": list(m["params"][1:]), "windows": windows}

    season, models = raw.get("seasonality", {}), raw.get("models", {})
    table = lambda m, n: [float((m or {}).get(i, (m or {}).get(str(i), 1.0))) for i in range(n)]
    for name, n in (("f_h", 24), ("f_d", 7)):
        if any(int(k) not in range(n) for k in season.get(name) or {}):
            raise ValueError(f"{name} has keys from 0 to {n - 1}")
    return VolParams(int(raw["target_min"]), table(season.get("f_h"), 24), table(season.get("f_d"), 7), har(models.get("har_ols")), har(models.get("har_qlike")), models.get("garch"))
