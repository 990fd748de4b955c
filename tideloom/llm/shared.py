"""Shared-folder helpers: lineage is cut in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import cache, reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tideloom-ckpt-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it. Only a local session, whose tasks share the driver's disk, may name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or _own_dir()


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so later jobs don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tideloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_side(df: DataFrame, row_bytes: int = 64, most: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its counted rows take at most ``most`` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def join_classes(rows: DataFrame, named: DataFrame, on: list[str], limit: float) -> DataFrame:
    """``rows`` with the values of ``named``, which has one row a class: ``on`` (the first a long), values, and ``_rows``, the class's rows.

    Classes of over ``limit`` rows are at most rows / ``limit`` and are broadcast. Their rows, and those with a null in ``on``, are spread
    evenly in the shuffle for the other classes, where they meet nothing.
    """
    values = [c for c in named.columns if c not in (*on, "_rows")]
    heavy = named.where(F.col("_rows") > limit).select(*[F.col(c).alias(f"_hv_{c}") for c in on + values])
    light = named.where(F.col("_rows") <= limit).select(*[F.col(c).alias(f"_lt_{c}") for c in on + values], F.lit(True).alias("_lt"))
    d = rows.join(F.broadcast(heavy), reduce(and_, [F.col(c) == F.col(f"_hv_{c}") for c in on]), "left")
    d = d.withColumn("_go", reduce(and_, [F.col(c).isNotNull() for c in on]) & F.col(f"_hv_{on[0]}").isNull())
    d = d.withColumn("_to", F.when(F.col("_go"), F.col(on[0])).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    meet = [F.col("_to") == F.col(f"_lt_{on[0]}"), F.col("_go") == F.col("_lt"), *[F.col(c) == F.col(f"_lt_{c}") for c in on[1:]]]
    d = d.join(light, reduce(and_, meet), "left")
    return d.select(*rows.columns, *[F.coalesce(f"_hv_{c}", f"_lt_{c}").alias(c) for c in values])


_kept = []


def kept(make):
    """``functools.cache`` for tables that a worker process keeps from task to task; the next operator's ``trim_memory`` drops them."""
    _kept.append(cache(make))
    return _kept[-1]


def trim_memory(keep=None) -> None:
    """Drop all ``kept`` tables but those of ``keep`` and give freed memory back to the system: a worker process lives through several
    stages and keeps what it once took."""
    for made in _kept:
        if made is not keep:
            made.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
