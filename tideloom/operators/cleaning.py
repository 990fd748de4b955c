"""Ingest cleaning, dedup, clock correction and sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan

KEY = ("venue", "symbol")


def drop_crossed(df: DataFrame) -> DataFrame:
    """Drops crossed and locked quotes; quotes without one side stay."""
    return df.where("bid IS NULL OR ask IS NULL OR bid < ask")


def _max_before(df: DataFrame, col: str, key, bucket_rows: int) -> DataFrame:
    return scan.running(df, key, ["seq"], bucket_rows, F.col(col), "max", "_m", inclusive=False)


def drop_stale(df: DataFrame, ts: str = "exchange_ts_ns", key=KEY, bucket_rows: int = scan.ROWS) -> DataFrame:
    """Drops rows strictly older than the last accepted one; equal and null times pass. A dropped row never raises the running maximum."""
    return _max_before(df, ts, key, bucket_rows).where(f"`{ts}` IS NULL OR _m IS NULL OR `{ts}` >= _m").drop("_m")


def dedup_update_id(df: DataFrame, uid: str = "update_id", key=KEY, bucket_rows: int = scan.ROWS) -> DataFrame:
    """Keeps rows whose update id exceeds all before it."""
    return _max_before(df, uid, key, bucket_rows).where(f"_m IS NULL OR `{uid}` > _m").drop("_m")


def clock_delta(min_latency_ms: float = 1.0):
    return F.col("received_ts_ns") - F.col("exchange_ts_raw_ns") - F.lit(int(min_latency_ms * 1e6))


def clock_correct_max(df: DataFrame, min_latency_ms: float = 1.0, key=KEY, bucket_rows: int = scan.ROWS) -> DataFrame:
    """exchange_ts_ns = raw + the most negative latency excess so far (a running minimum by buckets of seq)."""
    d = F.least(clock_delta(min_latency_ms), F.lit(0))
    out = scan.running(df, key, ["seq"], bucket_rows, d, "min", "_off")
    out = out.withColumn("clock_offset_ns", F.coalesce("_off", F.lit(0).cast("long"))).drop("_off")
    return out.withColumn("exchange_ts_ns", F.col("exchange_ts_raw_ns") + F.col("clock_offset_ns"))


def clock_correct_ewma(df: DataFrame, min_latency_ms: float = 1.0, decay: float = 0.999, key=KEY) -> DataFrame:
    """As above with an average that moves on negative excesses only and is truncated to whole nanoseconds at each step.

    The truncation doesn't compose, so a key's rows stream by in order through one task, sorted by Spark; only the average is held.
    """
    out = T.StructType([*[f for f in df.schema.fields if f.name != "clock_offset_ns"], T.StructField("clock_offset_ns", T.LongType())])
    names = [f.name for f in out]
    least = int(min_latency_ms * 1e6)

    def run(batches):
        now, acc = None, 0
        for b in batches:
            codes = np.stack([b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in key])
            starts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            delta = pc.subtract(b.column("received_ts_ns"), b.column("exchange_ts_raw_ns")).cast(pa.int64())
            delta = pc.subtract(delta, least).fill_null(0).to_numpy(zero_copy_only=False)
            off = np.zeros(b.num_rows, np.int64)
            for lo, hi in zip(starts, starts[1:]):
                if hi == lo:
                    continue
                k = tuple(b.column(c)[lo].as_py() for c in key)
                if k != now:
                    now, acc = k, 0
                moves, seen = np.flatnonzero(delta[lo:hi] < 0), [acc]
                for d in delta[lo:hi][moves].tolist():
                    acc = int(decay * acc + (1 - decay) * d)
                    seen.append(acc)
                off[lo:hi] = np.minimum(seen, 0)[np.searchsorted(moves, np.arange(hi - lo), "right")]
            cols = dict(zip(b.schema.names, b.columns)) | {"clock_offset_ns": pa.array(off)}
            cols["exchange_ts_ns"] = pc.add(b.column("exchange_ts_raw_ns").cast(pa.int64()), cols["clock_offset_ns"])
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return df.repartition(*key).sortWithinPartitions(*key, F.col("seq").asc_nulls_last()).mapInArrow(run, out)


def grid_sample(df: DataFrame, step_ns: int, key=KEY, ts: str = "exchange_ts_ns") -> DataFrame:
    """The latest quote of each key at each grid time from its first one on, whether or not it changed."""
    from .snapshots import carry_forward

    rest = [c for c in df.columns if c not in key]
    b = df.withColumn("_b", F.expr(f"`{ts}` DIV {step_ns}")).groupBy(*key, "_b").agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col("seq"))).alias("_q"))
    return carry_forward(b, ["_q"], key).select(*key, ((F.col("_b") + 1) * step_ns).alias("sample_ts_ns"), "_q.*")


def subsample(df: DataFrame, target_ns: int, key=KEY, ts: str = "exchange_ts_ns") -> DataFrame:
    """Every r-th row, r = max(1, round(target / median gap))."""
    w = Window.partitionBy(*key).orderBy(ts, "seq")
    g = df.withColumn("_dt", F.col(ts) - F.lag(ts).over(w)).withColumn("_rn", F.row_number().over(w))
    r = g.groupBy(*key).agg(F.greatest(F.lit(1), F.round(target_ns / F.percentile("_dt", 0.5))).cast("int").alias("_r"))
    return g.join(r, list(key)).where("(_rn - 1) % _r = 0").drop("_dt", "_rn", "_r")


def dt_gate(df: DataFrame, key=KEY, ts: str = "exchange_ts_ns", low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Log returns over gaps strictly between low and high times the median gap."""
    w = Window.partitionBy(*key).orderBy(ts, "seq")
    m = (F.col("bid") + F.col("ask")) / 2
    g = df.withColumn("dt_ns", F.col(ts) - F.lag(ts).over(w)).withColumn("log_return", F.ln(m) - F.ln(F.lag(m).over(w)))
    med = g.groupBy(*key).agg(F.percentile("dt_ns", 0.5).alias("_m"))
    return g.join(med, list(key)).where(f"dt_ns > {low} * _m AND dt_ns < {high} * _m").drop("_m")


def strip_warmup(df: DataFrame, warmup_ns: int, ts: str = "exchange_ts_ns", key=()) -> DataFrame:
    """Drops the rows of the first ``warmup_ns`` (of all rows, or of each key)."""
    if key:
        return df.withColumn("_t0", F.min(ts).over(Window.partitionBy(*key))).where(F.col(ts) >= F.col("_t0") + warmup_ns).drop("_t0")
    t0 = df.agg(F.min(ts).alias("_t0"))
    return df.join(F.broadcast(t0)).where(F.col(ts) >= F.col("_t0") + warmup_ns).drop("_t0")  # one row


def fresh_quotes(df: DataFrame, as_of_ns, max_recv_ms: float | None = 50.0, max_exch_ms: float | None = 150.0) -> DataFrame:
    """Rows younger than the limits at ``as_of_ns`` (a number or a column); unknown times fail, None turns a check off."""
    now = as_of_ns if not isinstance(as_of_ns, int) else F.lit(as_of_ns)
    for col, limit in (("received_ts_ns", max_recv_ms), ("exchange_ts_ns", max_exch_ms)):
        if limit is not None:
            df = df.where(F.col(col).isNotNull() & (now - F.col(col) < int(limit * 1e6)))
    return df


def known_symbols(df: DataFrame, symbols: DataFrame, on: str = "symbol") -> DataFrame:
    return df.join(symbols.select(on).distinct(), on, "left_semi")


def unknown_symbols(df: DataFrame, symbols: DataFrame, on: str = "symbol") -> DataFrame:
    """One row for each unknown symbol with the rows it drops."""
    return df.join(symbols.select(on).distinct(), on, "left_anti").groupBy(on).agg(F.count("*").alias("n_dropped"))


def merge_order(df: DataFrame, times=("exchange_ts_ns", "received_ts_ns", "snap_ts_ns"), bucket_ns: int = 3_600_000_000_000, key=KEY) -> DataFrame:
    """Adds merge_ns, the first known of ``times``, and merge_pos, a row's place (from 1) in its key's order by merge_ns and seq.

    Rows without any time come first. Places are counted by time bucket: only a bucket is sorted in one task, and what runs over a
    key's whole history is one count a bucket.
    """
    names = [f"_mo_{k}" for k in key]
    d = df.drop("merge_ns", "merge_pos").withColumn("merge_ns", F.coalesce(*times)).withColumn("_mo_b", F.expr(f"merge_ns DIV {bucket_ns}"))
    per = d.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("_mo_b").alias("_mo_at")).agg(F.count("*").alias("_mo_n"))
    before = Window.partitionBy(*names).orderBy("_mo_at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_mo_before", F.coalesce(F.sum("_mo_n").over(before), F.lit(0)))
    same = F.col("_mo_b").eqNullSafe(F.col("_mo_at"))
    for k, n in zip(key, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    place = F.row_number().over(Window.partitionBy(*key, "_mo_b").orderBy("merge_ns", "seq"))
    out = d.withColumn("_mo_place", place).join(per, same).withColumn("merge_pos", F.col("_mo_before") + F.col("_mo_place"))
    return out.select(*d.drop("_mo_b").columns, "merge_pos")
