"""Retention and recency: latest row, reads by position, last n, bounded retention, reads since a cursor, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("venue", "symbol")


def latest(df: DataFrame, key=KEY, order=("exchange_ts_ns", "seq")) -> DataFrame:
    """Latest row of each key, by one partial aggregation (no sort)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def last_n(df: DataFrame, n: int, key=KEY, order=("seq",)) -> DataFrame:
    """The newest ``n`` rows of each key with their rank rn (1: newest). The rank filter is pushed into the window."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def retain(df: DataFrame, capacity: int, key=KEY, order=("seq",)) -> DataFrame:
    """Bounded retention; the capacity is a power of two, as a ring's is."""
    if capacity <= 0 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    return last_n(df, capacity, key, order).drop("rn")


def with_position(df: DataFrame, key=KEY, order=("seq",)) -> DataFrame:
    """Adds pos, the absolute write position from 0."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def read_at(df: DataFrame, pos: int, capacity: int | None = None, key=KEY, order=("seq",)) -> DataFrame:
    """The row at an absolute position; nothing if it isn't written yet, or overwritten where the ring has a ``capacity``."""
    p = with_position(df, key, order)
    if capacity is not None:
        n = F.count("*").over(Window.partitionBy(*key))
        p = p.withColumn("_n", n).where(F.col("pos") >= F.col("_n") - capacity).drop("_n")
    return p.where(F.col("pos") == pos)


def since(df: DataFrame, cursor: int, cap: int | None = None, key=KEY, order=("seq",)) -> DataFrame:
    """Rows at positions from ``cursor`` on; with ``cap`` only the first ``cap`` of them (the newest are lost, as in a capped drain)."""
    p = with_position(df, key, order).where(F.col("pos") >= cursor)
    return p.where(F.col("pos") < cursor + cap) if cap is not None else p


def write_counts(df: DataFrame, key=KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("write_count"))
