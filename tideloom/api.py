"""Object interface over the operators: registry, market data, analytics, fair price, volatility, configuration, manager.

Everything returns DataFrames (or one row's value where a method names one number), so calls can be put together before anything runs.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import symbols as sym
from .operators import analytics as an
from .operators import bars, buffers, cleaning, fairprice, snapshots, vol


def init_logging(level: str = "INFO") -> None:
    logging.basicConfig(level=getattr(logging, level.upper()))


class SymbolRegistry:
    def __init__(self, spark: SparkSession, bases: list[str]):
        self.frame = sym.registry(spark, bases)
        self._alias = {(r["itype"], r["alias"]): r["symbol_id"] for r in sym.aliases(self.frame).collect()}  # 5,000 rows at most
        self._name = {r["symbol_id"]: r["canonical"] for r in self.frame.select("symbol_id", "canonical").collect()}

    def lookup(self, symbol: str, itype: str) -> int | None:
        return self._alias.get((itype.upper(), symbol))

    def get_symbol(self, symbol_id: int) -> str | None:
        return self._name.get(symbol_id)


class MarketData:
    def __init__(self, ticks: DataFrame):
        self.ticks = ticks

    def _latest(self, venue: str, symbol: str) -> DataFrame:
        return buffers.latest(self.ticks.where((F.col("venue") == venue) & (F.col("symbol") == symbol)))

    def _one(self, venue, symbol, e):
        r = self._latest(venue, symbol).select(F.expr(e).alias("v")).first()
        return r["v"] if r else None

    def get_bid(self, venue, symbol):
        return self._one(venue, symbol, "bid")

    def get_ask(self, venue, symbol):
        return self._one(venue, symbol, "ask")

    def get_bid_qty(self, venue, symbol):
        return self._one(venue, symbol, "bid_qty")

    def get_ask_qty(self, venue, symbol):
        return self._one(venue, symbol, "ask_qty")

    def get_midquote(self, venue, symbol):
        return self._one(venue, symbol, "(bid + ask) / 2")

    def get_spread(self, venue, symbol):
        return self._one(venue, symbol, "ask - bid")

    def get_market_data(self, venue, symbol) -> DataFrame:
        return self._latest(venue, symbol)

    def get_midquote_mean(self, symbol: str, as_of_ns: int, max_recv_ms: float | None = 50.0, max_exch_ms: float | None = 150.0):
        q = cleaning.fresh_quotes(buffers.latest(self.ticks.where(F.col("symbol") == symbol)), as_of_ns, max_recv_ms, max_exch_ms)
        return q.agg(F.avg((F.col("bid") + F.col("ask")) / 2).alias("v")).first()["v"]


class Analytics:
    """Methods take (venue, symbol, ...) and return one value, or a frame for series; None where there is nothing."""

    def __init__(self, snaps: DataFrame, ticks: DataFrame | None = None):
        self.snaps, self.ticks = snaps, ticks

    def _of(self, venue, symbol):
        return self.snaps.where((F.col("venue") == venue) & (F.col("symbol") == symbol))

    @staticmethod
    def _value(df: DataFrame):
        r = df.select("value").first()
        return r["value"] if r else None

    def midquote_twap(self, venue, symbol, n):
        return self._value(an.midquote_twap(self._of(venue, symbol), n))

    def mean_spread(self, venue, symbol, n):
        return self._value(an.mean_spread(self._of(venue, symbol), n))

    def midquote_stdev(self, venue, symbol, n):
        return self._value(an.midquote_stdev(self._of(venue, symbol), n))

    def max_abs_log_return(self, venue, symbol, n):
        return self._value(an.max_abs_log_return(self._of(venue, symbol), n))

    def realized_vol(self, venue, symbol, n):
        return self._value(an.realized_vol(self._of(venue, symbol), n))

    def log_returns(self, venue, symbol, n) -> DataFrame:
        return an.log_returns(self._of(venue, symbol), n)

    def snap_mean(self, venue, symbol, field, n):
        return self._value(an.snap_mean(self._of(venue, symbol), field, n))

    def snap_stdev(self, venue, symbol, field, n):
        return self._value(an.snap_stdev(self._of(venue, symbol), field, n))

    def snap_median(self, venue, symbol, field, n):
        return self._value(an.snap_median(self._of(venue, symbol), field, n))

    def snap_quantile(self, venue, symbol, field, n, q):
        return self._value(an.snap_quantile(self._of(venue, symbol), field, n, q))

    def tick_midquote_mean(self, venue, symbol, n):
        return self._value(an.tick_midquote_mean(self.ticks.where((F.col("venue") == venue) & (F.col("symbol") == symbol)), n))

    def quote_fill_analysis(self, venue, symbol, side, spread_bps, lookback) -> DataFrame:
        return an.quote_fills(self._of(venue, symbol), side, spread_bps, lookback)

    def mid_range_bps_buckets(self, venue, symbol, window, bucket) -> DataFrame:
        return an.range_buckets(self._of(venue, symbol), window, bucket)

    def mid_range_bps_stat(self, venue, symbol, window, bucket, stat="mean", q=None):
        return self._value(an.range_stat(self._of(venue, symbol), window, bucket, stat, q))

    def get_latest_snapshot(self, venue, symbol) -> DataFrame:
        return an._window(self._of(venue, symbol), 1).drop("rn")


class FairPrice:
    def __init__(self, fair: DataFrame, ticks: DataFrame, members: DataFrame, h_per_ms: float = 0.0):
        self.fair, self.ticks, self.members, self.h = fair, ticks, members, h_per_ms

    def groups(self) -> list[str]:
        return sorted(r["grp"] for r in self.members.select("grp").distinct().collect())  # one row a group

    def latest(self, grp: str) -> DataFrame:
        return fairprice.latest(self.fair.where(F.col("grp") == grp))

    def history(self, grp: str, n: int) -> DataFrame:
        return fairprice.history(self.fair.where(F.col("grp") == grp), n)

    def latest_price(self, grp: str):
        r = self.latest(grp).select("fair_price").first()
        return r["fair_price"] if r else None

    def get_fair_quote(self, grp: str, venue: str, symbol: str, horizon_ms: float = 0.0) -> DataFrame:
        m = self.members.where((F.col("grp") == grp) & (F.col("venue") == venue) & (F.col("symbol") == symbol))
        t = buffers.latest(self.ticks.where((F.col("venue") == venue) & (F.col("symbol") == symbol)))
        return fairprice.fair_quotes(t, m, self.fair, self.h, horizon_ms)


class VolEngine:
    def __init__(self, base_bars: DataFrame, params: vol.VolParams, base_min: float = 1.0):
        self.bars, self.params, self.base_min = base_bars, params, base_min

    def symbols(self) -> list[str]:
        return sorted(r["symbol"] for r in self.bars.select("symbol").distinct().collect())  # registered symbols only

    def predict(self, symbol: str | None = None) -> DataFrame:
        b = self.bars if symbol is None else self.bars.where(F.col("symbol") == symbol)
        return vol.predict(b, self.params, self.base_min)


class AppConfig(dict):
    @classmethod
    def from_file(cls, path: str) -> AppConfig:
        from .sources.files import load_config

        return cls(load_config(path))

    @classmethod
    def from_dict(cls, d: dict) -> AppConfig:
        return cls(d)

    def to_dict(self) -> dict:
        return dict(self)


class FeedManager:
    """Puts the parts together over a batch of decoded ticks (a bounded replay of the feeds)."""

    def __init__(self, config: AppConfig, ticks: DataFrame):
        self.config, self.raw, self.ticks = config, ticks, ticks
        self.snaps = self.fair = self.members = self.base_bars = None

    def _start(self, itype: str) -> FeedManager:
        t = cleaning.drop_stale(cleaning.drop_crossed(self.raw.where(F.lower("itype") == itype)))
        method = self.config.get("clock_correction", "ewma")
        if method == "ewma":
            t = cleaning.clock_correct_ewma(t, self.config.get("min_latency_ms", 1.0), self.config.get("clock_decay", 0.999))
        elif method == "max":
            t = cleaning.clock_correct_max(t, self.config.get("min_latency_ms", 1.0))
        self.ticks = t
        return self

    def start_spot_feeds(self) -> FeedManager:
        return self._start("spot")

    def start_perp_feeds(self) -> FeedManager:
        return self._start("perp")

    def start_snapshots(self) -> FeedManager:
        self.snaps = snapshots.snapshots(self.ticks, int(self.config.get("snapshot_interval_ms", 100) * 1e6))
        return self

    def get_market_data(self) -> MarketData:
        return MarketData(self.ticks)

    def get_analytics(self) -> Analytics:
        return Analytics(self.snaps, self.ticks)

    def start_fair_price(self, members: DataFrame, step_ms: float = 100, model: str = "kalman", h_per_ms: float = 0.0, **options) -> FeedManager:
        obs = fairprice.observations(self.ticks, members)
        run = fairprice.kalman if model == "kalman" else fairprice.gonzalo_granger
        self.members, self.h, self.fair = members, h_per_ms, run(obs, int(step_ms * 1e6), h_per_ms=h_per_ms, **options)
        return self

    def get_fair_price(self) -> FairPrice:
        return FairPrice(self.fair, self.ticks, self.members, self.h)

    def start_vol_engine(self, params: vol.VolParams, base_ms: int = 60_000) -> FeedManager:
        self.base_bars, self.params, self.base_ms = bars.tick_bars(self.ticks, base_ms), params, base_ms
        return self

    def get_vol_engine(self) -> VolEngine:
        return VolEngine(self.base_bars, self.params, self.base_ms / 60_000)

    def shutdown(self) -> None:
        self.ticks.sparkSession.catalog.clearCache()
