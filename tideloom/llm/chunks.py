"""Chunks of documents by ranges of their key, spread evenly over hash partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffle_partitions

CHUNK_BYTES = 12 << 20


def balanced_labels(spark: SparkSession, count: int, partitions: int) -> list[int]:
    """``count`` ints of which the i-th is hashed to partition i modulo ``partitions``: keys that spread evenly."""
    per = -(-count // partitions)
    n = partitions * (30 + 3 * per)
    rows = spark.range(n).selectExpr("CAST(id AS INT) AS id").selectExpr("id", f"pmod(hash(id), {partitions}) AS p").groupBy("p").agg(F.slice(F.array_sort(F.collect_list("id")), 1, per).alias("ids")).collect()
    by = {r["p"]: r["ids"] for r in rows}
    return [by[i % partitions][i // partitions] for i in range(count)]


def key_ranges(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[Column, list[int], int]:
    """(ordinal of a row's chunk as a column, label of each chunk, rows). Chunks are ranges of ``key`` in ascending order.

    The number of chunks follows the text's bytes; cut points come from a sketch of the key column. Null keys are in the first chunk.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    n = max(1, min(size["n"], max(parts, -(-(size["b"] or 0) // chunk_bytes))))
    labels = balanced_labels(spark, n, parts)
    cuts = []
    if n > 1:
        fractions = "array(" + ",".join(f"{i}D/{n}" for i in range(1, n)) + ")"
        cuts = docs.agg(F.expr(f"percentile_approx(`{key}`, {fractions}, {max(10000, 20 * n)})").alias("c")).first()["c"] or []
    if not cuts:
        return F.lit(0), labels, size["n"]
    # binary search; n cut points take log2(n) steps
    array = "array(" + ",".join(f"{int(c)}L" for c in cuts) + ")"
    steps = len(cuts).bit_length()
    at = F.expr(f"""aggregate(array_repeat(0, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}),
        (a, x) -> CASE WHEN a.lo >= a.hi THEN a
            WHEN coalesce({array}[int((a.lo + a.hi) / 2)] <= `{key}`, false) THEN named_struct('lo', int((a.lo + a.hi) / 2) + 1, 'hi', a.hi)
            ELSE named_struct('lo', a.lo, 'hi', int((a.lo + a.hi) / 2)) END, a -> a.lo)""")
    return at, labels, size["n"]
