"""Keyed state for streams: stale drop, id dedup, clock correction, books, rolled bars.

Each operator is ``groupBy(key).applyInPandasWithState``: rows of a micro-batch are taken in ``seq`` order, the state is a few numbers
(or one JSON text), and a stream's result equals the batch operator's over the same rows if batches arrive in order. A key's rows of one
micro-batch are held at once, so micro-batches must be bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ("venue", "symbol")
BAR = "venue string, symbol string, open_time_ms long, open double, high double, low double, close double, volume double, n_src int"


def _rows(parts: Iterator[pd.DataFrame], order=("seq",)) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def _keep_rising(stream: DataFrame, col: str, strict: bool, key=KEY) -> DataFrame:
    names = stream.columns

    def run(k, parts, state: GroupState):
        top = state.get[0] if state.exists else None
        pdf, keep = _rows(parts), []
        for v in pdf[col].tolist():
            known = v is not None and v == v
            ok = (not known and not strict) or (known and (top is None or (v > top if strict else v >= top)))
            if ok and known:
                top = int(v)
            keep.append(ok)
        if top is not None:
            state.update((top,))
        yield pdf[keep][names]

    return stream.groupBy(*key).applyInPandasWithState(run, stream.schema, "top long", "append", GroupStateTimeout.NoTimeout)


def drop_stale(stream: DataFrame, ts: str = "exchange_ts_ns", key=KEY) -> DataFrame:
    return _keep_rising(stream, ts, False, key)


def dedup_update_id(stream: DataFrame, uid: str = "update_id", key=KEY) -> DataFrame:
    return _keep_rising(stream, uid, True, key)


def clock_correct(stream: DataFrame, method: str = "ewma", min_latency_ms: float = 1.0, decay: float = 0.999, key=KEY) -> DataFrame:
    out = T.StructType([*[f for f in stream.schema.fields if f.name != "clock_offset_ns"], T.StructField("clock_offset_ns", T.LongType())])
    names, least = [f.name for f in out], int(min_latency_ms * 1e6)

    def run(k, parts, state: GroupState):
        ew, low = state.get if state.exists else (0, 0)
        pdf, off = _rows(parts), []
        for rc, ex in zip(pdf["received_ts_ns"].tolist(), pdf["exchange_ts_raw_ns"].tolist()):
            if rc == rc and ex == ex and rc is not None and ex is not None and (d := int(rc) - int(ex) - least) < 0:
                ew, low = int(decay * ew + (1 - decay) * d), min(low, d)
            off.append({"ewma": min(ew, 0), "max": low}.get(method, 0))
        state.update((ew, low))
        pdf["clock_offset_ns"] = off
        pdf["exchange_ts_ns"] = pdf["exchange_ts_raw_ns"] + pdf["clock_offset_ns"]
        yield pdf[names]

    return stream.groupBy(*key).applyInPandasWithState(run, out, "ewma long, low long", "append", GroupStateTimeout.NoTimeout)


def book_tops(stream: DataFrame, depth: int = 128, key=KEY) -> DataFrame:
    """Best prices after each update. A new level beyond ``depth`` is dropped, even a better one; a new epoch clears the book."""
    schema = "venue string, symbol string, seq long, bid double, ask double, bid_qty double, ask_qty double"

    def run(k, parts, state: GroupState):
        book = json.loads(state.get[0]) if state.exists else {"epoch": None, "bid": {}, "ask": {}}
        out = []
        for r in _rows(parts, ("seq", "side", "price")).itertuples():
            if book["epoch"] is not None and r.epoch > book["epoch"]:
                book["bid"], book["ask"] = {}, {}
            book["epoch"] = int(r.epoch)
            side, p = book[r.side], repr(float(r.price))
            if r.qty <= 0:
                side.pop(p, None)
            elif p in side or len(side) < depth:
                side[p] = float(r.qty)
            b = max(book["bid"], key=float, default=None)
            a = min(book["ask"], key=float, default=None)
            out.append((*k, r.seq, float(b) if b else None, float(a) if a else None, book["bid"].get(b), book["ask"].get(a)))
        state.update((json.dumps(book),))
        yield pd.DataFrame(out, columns=["venue", "symbol", "seq", "bid", "ask", "bid_qty", "ask_qty"])

    return stream.groupBy(*key).applyInPandasWithState(run, schema, "book string", "append", GroupStateTimeout.NoTimeout)


def rolled_bars(stream: DataFrame, target: int, base_ms: int = 60_000, key=KEY, ts: str = "exchange_ts_ns") -> DataFrame:
    """Target bars from ticks: late ticks fold into the open base bar; a bar is emitted as in ``operators.bars.rolled_bars``."""
    span = base_ms * target

    def run(k, parts, state: GroupState):
        s = json.loads(state.get[0]) if state.exists else {"part": None, "done": []}
        out = []
        for r in _rows(parts, (ts, "seq")).itertuples():
            mid = (r.bid + r.ask) / 2
            if not mid > 0:
                continue
            t = int(getattr(r, ts)) // 1_000_000 // base_ms * base_ms
            p = s["part"]
            if p is None:
                s["part"] = [t, mid, mid, mid, mid]
            elif t <= p[0]:
                p[2], p[3], p[4] = max(p[2], mid), min(p[3], mid), mid
            else:
                s["done"] = (s["done"] + [p])[-(2 * target + 4):]
                edge = t // span * span
                if t // span > p[0] // span and p[0] + base_ms >= edge:
                    g = s["done"][-target:]
                    out.append((*k, g[0][0], g[0][1], max(x[2] for x in g), min(x[3] for x in g), g[-1][4], 0.0, len(g)))
                s["part"] = [t, mid, mid, mid, mid]
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["venue", "symbol", "open_time_ms", "open", "high", "low", "close", "volume", "n_src"])

    return stream.groupBy(*key).applyInPandasWithState(run, BAR, "s string", "append", GroupStateTimeout.NoTimeout)
