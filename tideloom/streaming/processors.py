"""Keyed state with timers, initial state and expiry (``transformWithStateInPandas``; its state store is RocksDB).

* ``fair_price``: the Kalman filter of each group. Ticks wait until the watermark has passed their interval, so their order is that of the batch; a
  timer ends each interval, also those in which no tick came (predict only).
* ``asof``: each left row with the newest right row at or before it. Rows wait until the watermark; of what is older, only the newest
  right row is kept, so state doesn't grow with the stream.
* ``seeded_bars``: base bars of ticks on top of bars of history (initial state), newest ``capacity`` kept.
* ``ring``: the newest ``capacity`` rows of a key, with a time to live where one is given.

Rows later than the watermark are dropped by Spark. What one key holds is bounded by its rows inside the watermark's delay, or by the capacity.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.fairprice import noise_var, output
from ..operators.gaussian import observe
from .windows import event_time

KEY = ("venue", "symbol")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as these processors must; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _together(parts) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True)


class FairPrice(StatefulProcessor):
    """State of a group: the filter (x, p, time, next interval) and the ticks that wait for the watermark, as packed arrays (48 bytes a tick)."""

    ROW = np.dtype([("ts_ns", "<i8"), ("member", "<i8"), ("seq", "<i8"), ("log_mid", "<f8"), ("noise", "<f8"), ("noise_var", "<f8")])

    def __init__(self, step_ns: int, h: float, h_bias: float, bias_init_p: float):
        self.step, self.h, self.h_bias, self.init_p = step_ns, h, h_bias, bias_init_p

    def init(self, handle) -> None:
        self.handle = handle
        self.filter = handle.getValueState("filter", "x array<double>, p array<double>, at long, next long")
        self.waiting = handle.getListState("waiting", "ticks binary")
        self.biases = handle.getValueState("biases", "biases array<double>")

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for pdf in rows:
            if len(pdf) and not self.biases.exists():
                self.biases.update(([float(b) for b in pdf["biases"].iat[0]],))
            packed = np.empty(len(pdf), self.ROW)
            for c in self.ROW.names:
                packed[c] = pdf[c].to_numpy()
            self.waiting.appendList([(packed.tobytes(),)])
            if len(pdf):
                least = min(int(packed["ts_ns"].min()), least) if least is not None else int(packed["ts_ns"].min())
        if least is None:
            return iter(())
        if not self.filter.exists() and not list(self.handle.listTimers()):
            self._wait(least)
        elif not self.filter.exists():
            first, now = min(self.handle.listTimers()), self._end_ms((least - 1) // self.step)
            if now < first:
                self.handle.deleteTimer(first)
                self.handle.registerTimer(now)
        return iter(())

    def _end_ms(self, interval: int) -> int:
        return -(-(interval + 1) * self.step // 1_000_000)

    def _wait(self, ts: int) -> None:
        self.handle.registerTimer(self._end_ms((ts - 1) // self.step))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        ticks = np.concatenate([np.empty(0, self.ROW), *(np.frombuffer(r[0], self.ROW) for r in self.waiting.get())])
        ticks = ticks[np.lexsort((ticks["seq"], ticks["member"], ticks["ts_ns"]))]
        if self.filter.exists():
            xs, ps, at, b = self.filter.get()
            x, p = np.array(xs), np.array(ps).reshape(len(xs), -1)
        else:
            first = ticks[0]
            x, k = np.array([0.0, *self.biases.get()[0]]), int(first["member"]) + 1
            x[0] = first["log_mid"] - x[k]
            p = np.diag([float(first["noise_var"]), *[self.init_p] * (len(x) - 1)])
            at = int(first["ts_ns"])
            b = (at - 1) // self.step
        began = self.filter.exists()
        grow, i, out = np.diag([self.h, *[self.h_bias] * (len(x) - 1)]), 0, []
        due = ticks[: int(np.searchsorted(ticks["ts_ns"], mark * 1_000_000, "right"))]  # what ends by the mark lies before it
        ts_of, z_of = due["ts_ns"].tolist(), zip(due["member"].tolist(), due["log_mid"].tolist(), due["noise"].tolist())
        while self._end_ms(b) <= mark:  # a timer at the mark itself is spent, so nothing may wait there
            end, p0, used, began = (b + 1) * self.step, p[0, 0] if began else 0.0, 0, True
            while i < len(ts_of) and ts_of[i] <= end:
                ts, (member, log_mid, noise) = ts_of[i], next(z_of)
                p += grow * max((ts - at) / 1e6, 0.0)
                observe(x, p, member + 1, log_mid, noise)
                at, used, i = ts, used + 1, i + 1
            tau, pre, last = max((end - at) / 1e6, 0.0), p[0, 0], at
            p += grow * tau
            out.append((key[0], end, x[0], p[0, 0], p0, pre, tau, used, last))
            at, b = end, b + 1
        self.filter.update((x.tolist(), p.ravel().tolist(), int(at), int(b)))
        if i:
            self.waiting.clear()
            if len(ticks) > i:
                self.waiting.put([(ticks[i:].tobytes(),)])
        self.handle.registerTimer(self._end_ms(b))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in SNAPS.split(", ")])

    def close(self) -> None:
        pass


SNAPS = "grp string, snap_ts_ns long, log_fair_price double, p double, p_pre double, p_pre_fwd double, tau_fwd_ms double, n_ticks_used long, last_tick_ts_ns long"


def fair_price(ticks: DataFrame, members: DataFrame, step_ns: int, h_per_ms: float, h_bias_per_ms: float = 0.0, bias_init_p: float = 1e-6, noise=None, late: str = "10 seconds") -> DataFrame:
    """As ``operators.fairprice.kalman`` over a stream of ticks, up to the last interval that ends before the watermark.

    ``members`` is a static table; its members are numbered by (venue, symbol) in each group, those without ticks too.
    """
    both = F.struct(*KEY)
    m = members.join(members.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(*KEY, "bias"))).alias("_all")), "grp")
    m = m.withColumn("member", F.array_position(F.expr("transform(_all, a -> struct(a.venue, a.symbol))"), both) - 1).withColumn("biases", F.col("_all.bias")).drop("_all")
    t = ticks.where("bid > 0 AND ask > 0").withColumn("ts_ns", F.coalesce("exchange_ts_ns", "received_ts_ns"))
    t = event_time(t, "ts_ns", late).withColumn("log_mid", F.ln((F.col("bid") + F.col("ask")) / 2)).withColumn("half_spread", F.ln(F.col("ask") / F.col("bid")) / 2)
    o = t.join(m, list(KEY)).withColumn("noise", noise_var("InstantSpread") if noise is None else noise)
    o = o.select("grp", "ts_ns", "member", "seq", "log_mid", "noise", "biases", "noise_var", "event_time")
    out = o.groupBy("grp").transformWithStateInPandas(FairPrice(step_ns, h_per_ms, h_bias_per_ms, bias_init_p), SNAPS, "Append", "EventTime")
    return output(out, h_per_ms)


class Asof(StatefulProcessor):
    """State of a key: rows of both sides (as JSON, in packed Arrow tables) that wait for the watermark, and the newest right row before it."""

    ROW = pa.schema([("at", pa.int64()), ("side", pa.int32()), ("nth", pa.int64()), ("row", pa.large_string())])
    SLICE = 10_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.newest = handle.getValueState("newest", "at long, row string")

    def _packed(self, t: pa.Table) -> tuple[bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.ROW, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(t)
        return (sink.getvalue().to_pybytes(),)

    def _held(self) -> pa.Table:
        """What waits, by time; right rows before left ones of the same time."""
        t = pa.concat_tables([self.ROW.empty_table(), *(pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get())]).combine_chunks()
        return t.take(pc.sort_indices(t, [(c, "ascending") for c in self.ROW.names]))

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([self._packed(pa.Table.from_pandas(pdf[self.ROW.names], self.ROW, preserve_index=False))])
                first = -(-int(pdf["at"].min()) // 1_000_000)
                least = first if least is None else min(first, least)
        timers = sorted(self.handle.listTimers())
        if least is not None and (not timers or least < timers[0]):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, rows = timerValues.getCurrentWatermarkInMs(), self._held()
        cut = int(np.searchsorted(rows["at"].to_numpy(), mark * 1_000_000, "right"))  # sorted by time, so these come first
        now = self.newest.get() if self.newest.exists() else None
        rights = np.flatnonzero(rows["side"].to_numpy()[:cut] == 0)
        if len(rights):
            self.newest.update((rows["at"][rights[-1]].as_py(), rows["row"][rights[-1]].as_py()))
        self.waiting.clear()
        if rows.num_rows > cut:
            self.waiting.put([self._packed(rows.slice(cut))])
            self.handle.registerTimer(-(-rows["at"][cut].as_py() // 1_000_000))
        for lo in range(0, cut, self.SLICE):
            some, out = rows.slice(lo, min(self.SLICE, cut - lo)), []
            for at, side, row in zip(*(some[c].to_pylist() for c in ("at", "side", "row"))):
                if side == 0:
                    now = (at, row)
                else:
                    out.append((*key, row, now[1] if now else None))
            if out:
                yield pd.DataFrame(out, columns=[*(f"k{i}" for i in range(len(key))), "l", "r"])

    def close(self) -> None:
        pass


def _plain(v):
    """A value as state takes it: None for missing, Python numbers for numpy's."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.item() if isinstance(v, np.generic) else v


def asof(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, prefix: str = "r_", late: str = "10 seconds") -> DataFrame:
    """As ``operators.joins.asof_join`` of two streams: left rows before the watermark, which both sides' times move. Times are in nanoseconds."""
    lcols, rcols = ([c for c in s.columns if c not in on] for s in (left, right))
    lt, rt = T.StructType([left.schema[c] for c in lcols]), T.StructType([right.schema[c] for c in rcols])
    nth = F.col("seq").cast("long") if "seq" in lcols else F.lit(0).cast("long")

    def side(s: DataFrame, ts: str, cols: list[str], n: int, nth) -> DataFrame:
        keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
        return event_time(s.withColumn("at", F.col(ts)), "at", late).select(*keys, "event_time", "at", F.lit(n).alias("side"), nth.alias("nth"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("row"))

    both = side(left, left_ts, lcols, 1, nth).unionByName(side(right, right_ts, rcols, 0, F.lit(0).cast("long")))
    names = [f"k{i}" for i in range(len(on))]
    schema = T.StructType([*[T.StructField(n, left.schema[c].dataType) for n, c in zip(names, on)], T.StructField("l", T.StringType()), T.StructField("r", T.StringType())])
    out = both.groupBy(*names).transformWithStateInPandas(Asof(), schema, "Append", "EventTime")
    out = out.select(*names, F.from_json("l", lt).alias("l"), F.from_json("r", rt).alias("r"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, on)], *[F.col(f"l.{c}").alias(c) for c in lcols], *[F.col(f"r.{c}").alias(f"{prefix}{c}") for c in rcols])


BARS = "venue string, symbol string, open_time_ms long, open double, high double, low double, close double, volume double, n_src int, version long"
_BAR = ["open", "high", "low", "close", "volume", "n_src"]


class SeededBars(StatefulProcessor):
    """State of a key: its newest bars, told apart by whether ticks have touched them. A tick's bar takes a historical one's place."""

    def __init__(self, base_ms: int, capacity: int):
        self.base, self.capacity = base_ms, capacity

    def init(self, handle) -> None:
        self.bars = handle.getMapState("bars", "open_time_ms long", "open double, high double, low double, close double, volume double, n_src int, live boolean")
        self.version = handle.getValueState("version", "n long, seeded boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples():
            self.bars.updateValue((int(r.open_time_ms),), (*[float(getattr(r, c)) for c in _BAR[:5]], int(r.n_src), False))

    def handleInputRows(self, key, rows, timerValues):
        n, seeded = self.version.get() if self.version.exists() else (0, False)
        held = {k[0]: list(v) for k, v in self.bars.iterator()}
        touched = set() if seeded else set(held)
        for r in _together(rows).sort_values(["exchange_ts_ns", "seq"], kind="stable").itertuples():
            mid = (r.bid + r.ask) / 2
            if not mid > 0:
                continue
            t = int(r.exchange_ts_ns) // 1_000_000 // self.base * self.base
            b = held.get(t)
            if b is None or not b[6]:
                held[t] = [mid, mid, mid, mid, 0.0, 1, True]
            else:
                b[1], b[2], b[3], b[5] = max(b[1], mid), min(b[2], mid), mid, b[5] + 1
            touched.add(t)
        keep = set(sorted(held)[-self.capacity :])
        for t in held.keys() - keep:
            if self.bars.containsKey((t,)):
                self.bars.removeKey((t,))
        for t in touched & keep:
            self.bars.updateValue((t,), tuple(held[t]))
        self.version.update((n + 1, True))
        out = [(*key, t, *held[t][:6], n) for t in sorted(touched & keep)]
        yield pd.DataFrame(out, columns=[f.split()[0] for f in BARS.split(", ")])

    def close(self) -> None:
        pass


def seeded_bars(ticks: DataFrame, history: DataFrame, base_ms: int = 60_000, capacity: int = 512, key=KEY) -> DataFrame:
    """Bars of a stream of ticks that starts from ``history`` (bars): every bar that a micro-batch changed, and the seed at a key's first one.

    ``version`` counts a key's micro-batches: ``newest_bars`` of the sink's rows is the state of each key. A key's ticks come in order.
    """
    rows = ticks.select(*key, "seq", "exchange_ts_ns", "bid", "ask")
    seed = history.select(*key, "open_time_ms", *_BAR).groupBy(*key)
    return rows.groupBy(*key).transformWithStateInPandas(SeededBars(base_ms, capacity), BARS, "Append", "None", initialState=seed)


def newest_bars(rows: DataFrame, capacity: int = 512, key=KEY) -> DataFrame:
    """The bars that the state holds, from the rows a stream of ``seeded_bars`` has written."""
    from ..operators.bars import retain_bars

    last = rows.groupBy(*key, "open_time_ms").agg(F.max_by(F.struct(*_BAR), "version").alias("_b"))
    return retain_bars(last.select(*key, "open_time_ms", "_b.*"), capacity, key)


class Ring(StatefulProcessor):
    """State of a key: its newest rows as a list, which expires as one."""

    def __init__(self, schema: T.StructType, key: list[str], capacity: int, ttl_ms: int | None, order: str):
        self.schema, self.key, self.capacity, self.ttl, self.order = schema, key, capacity, ttl_ms, order
        self.rest = [c for c in schema.names if c not in key]

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", T.StructType([self.schema[c] for c in self.rest]), ttlDurationMs=self.ttl)
        self.writes = handle.getValueState("writes", "batch long, n long")

    def handleInputRows(self, key, rows, timerValues):
        batch, n = self.writes.get() if self.writes.exists() else (0, 0)
        new = [tuple(_plain(v) for v in r) for r in _together(rows)[self.rest].itertuples(index=False, name=None)]
        at = self.rest.index(self.order)
        held = sorted([*self.rows.get(), *new], key=lambda r: r[at])[-self.capacity :]
        self.rows.put(held)
        self.writes.update((batch + 1, n + len(new)))
        out = pd.DataFrame(held, columns=self.rest)
        for c, v in zip(self.key, key):
            out[c] = v
        yield out.assign(batch=batch, write_count=n + len(new))[[*self.schema.names, "batch", "write_count"]]

    def close(self) -> None:
        pass


def ring(stream: DataFrame, capacity: int, ttl_ms: int | None = None, key=KEY, order: str = "seq") -> DataFrame:
    """The ring of each key after each micro-batch that wrote to it (``batch`` counts them); ``ring_now`` takes the last one.

    With ``ttl_ms`` a ring is forgotten that long after its last write. Time then moves without rows, so Spark starts micro-batches
    for ever, also under ``availableNow``: stop such a query yourself.
    """
    if capacity <= 0 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("write_count", T.LongType())])
    return stream.groupBy(*key).transformWithStateInPandas(Ring(stream.schema, list(key), capacity, ttl_ms, order), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def ring_now(rows: DataFrame, key=KEY) -> DataFrame:
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("batch").alias("_batch"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return rows.join(last, [*same, F.col("batch") == F.col("_batch")]).select(*rows.columns).drop("batch", "write_count")
