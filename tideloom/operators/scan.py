"""Running values of a key by buckets of its order, so that no task sorts a key's whole history.

Maxima, minima, sums and last known values are associative: each bucket gives one partial value, a window over a key's buckets gives what
stood before each of them, and that enters its bucket as a first row. Only buckets are sorted; one key's buckets run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 18  # width of a bucket of sequence numbers
HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
DAY_MS = 86_400_000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def bucket_of(df: DataFrame, col: str, width: int) -> Column:
    """A value that never falls as ``col`` rises; NULL where ``col`` is (nulls come first in both)."""
    if dict(df.dtypes)[col] in WHOLE:
        return F.expr(f"`{col}` DIV {int(width)}")
    return F.floor(F.col(col).cast("double") / width)


def running(df: DataFrame, key, order: list[str], width: int, value: Column, how: str, out: str, inclusive: bool = True) -> DataFrame:
    """Adds ``out``: the max, min, sum or last known ``value`` of a key's rows up to this one in ``order`` (before it unless ``inclusive``).

    Nulls are ignored; NULL where nothing is known. Rows that tie in ``order`` come in any order.
    """
    if how == "last":
        part = F.max_by("_sc_v", F.when(F.col("_sc_v").isNotNull(), F.struct(*order)))
        over = lambda c, w: F.last(c, True).over(w)
    else:
        fn = {"max": F.max, "min": F.min, "sum": F.sum}[how]
        part = fn("_sc_v")
        over = lambda c, w: fn(c).over(w)
    d = df.withColumn("_sc_b", bucket_of(df, order[0], width)).withColumn("_sc_v", value)
    before = Window.partitionBy(*key).orderBy("_sc_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = d.groupBy(*key, "_sc_b").agg(part.alias("_sc_p"))
    heads = heads.select(*key, "_sc_b", over("_sc_p", before).alias("_sc_v"), F.lit(0).alias("_sc_row")).where("_sc_v IS NOT NULL")
    inside = Window.partitionBy(*key, "_sc_b").orderBy("_sc_row", *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    u = d.withColumn("_sc_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return u.withColumn(out, over("_sc_v", inside)).where("_sc_row = 1").drop("_sc_b", "_sc_v", "_sc_row")
