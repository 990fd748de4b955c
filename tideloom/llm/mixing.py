"""Mixing sources to target weights by hash-threshold histograms, native SQL only.

Sources share all words by weight; a target stops at ``MOST`` times its source's size and the excess is shared again by weight until none
is above. With sources in order of cap / weight that is closed: the first source that isn't capped fixes the share of one weight.

A document is taken whole, 0 to ``MOST`` times. Its repeats are nested budgets: repeat j of a source has the budget target - (j - 1) * size,
between 0 and the size, and takes the documents whose hash comes first until the budget is met. No sort finds the cut: words are summed by (source,
repeat, hash bucket), one window over the buckets finds the bucket in which the budget ends, and only that bucket is split again by the
hash's next 12 bits, until its documents have one hash. A document is taken if at least half of it is within the budget, so a source's taken words are within half a
document of each budget that ends inside it. Rows of one hash (repeated rows) are alike: how many of them are taken is a division, and
they are counted by partition of the written table, so one hot row needs no window over all its copies.

The hash is 60 bits of MD5 over id and text's MD5, so a rerun takes the same documents. Sources are one row each from the first aggregation
on; ranking them is one window over those rows.

Defined results: null text: size 0; null source: a source of its own, last; a source without words has target 0; repeated rows are
documents of their own; null ids count as any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, small_side

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 12, 5  # 60 bits of hash, 12 a level
FULL = 1 << BITS * LEVELS


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """_key, _source, _size (words) and _hash (60 bits) of each document, and _part, the partition that writes it."""
    d = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    digest = F.md5(F.concat(F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(":"), F.md5("_t")))
    return d.select(
        "_key", "_source", F.expr(r"regexp_count(_t, '[^\\x20\\x09-\\x0D]+')").cast("long").alias("_size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_hash"), F.spark_partition_id().alias("_part"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, _total (its words) and _target from ``sizes`` (_source, _size)."""
    s = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    s = s.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    of = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    s = s.withColumn("_weight", of[F.pmod(F.col("_rank") - 1, F.lit(len(weights)))])
    by = Window.orderBy(F.col("_total") / F.col("_weight"), "_rank")
    earlier = F.coalesce(F.sum("_total").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_left", F.sum("_total").over(Window.partitionBy()) - most * earlier)
    s = s.withColumn("_share", F.col("_left") / F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing)))  # of one weight, if all before are capped
    s = s.withColumn("_at", F.row_number().over(by))
    fits = F.when(F.expr(f"{most} * _total >= _share * _weight"), F.struct("_at", "_share"))
    s = s.withColumn("_unit", F.min(fits).over(Window.partitionBy())["_share"])
    return s.select("_source", "_total", F.least(F.expr(f"CAST({most} * _total AS DOUBLE)"), F.col("_unit") * F.col("_weight")).alias("_target"))


def cuts(rows: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """One row a source: _source, _total, _target, _whole, _cut, _fits and _alike.

    Every document is taken ``_whole`` times and those with a hash below ``_cut`` once more, as are ``_fits`` of the ``_alike`` rows whose hash
    is the cut. ``rows``: written ``sized``; ``goals``: written ``targets``. Repeats are nested, so just one of them ends inside a source.
    """
    g = goals.withColumn("_whole", F.expr(f"CASE WHEN _total = 0 THEN 0 ELSE int(least({most}, floor(_target / _total))) END"))
    g = g.withColumn("_budget", F.col("_target") - F.col("_whole") * F.col("_total"))
    open_ = g.where("_budget > 0").select(F.col("_source").alias("_s"), F.lit(0).cast("long").alias("_low"), "_budget")
    part = rows.select("_source", "_size", "_hash")
    for level in range(1, LEVELS + 1):
        width = 1 << BITS * (LEVELS - level)
        inside = F.expr(f"_source <=> _s AND _hash DIV {width << BITS} = _low DIV {width << BITS}")
        goal = small_side(open_.select("_s", "_low", "_budget"))
        if level > 1:  # the bucket is a 4096th of the rows; it is copied out, and later levels read only that
            part = materialize(part.join(goal, inside, "left_semi"), "mix-bucket")
        whole = [F.sum("_size").alias("_words"), F.count("*").alias("_alike"), F.min("_hash").alias("_first"), F.max("_hash").alias("_last")]
        sums = part.groupBy("_source", F.expr(f"_hash DIV {width} * {width}").alias("_hash")).agg(*whole)
        run = Window.partitionBy("_s").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
        m = sums.join(goal, inside).withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
        m = m.where("_before < _budget AND _budget <= _before + _words")
        open_ = materialize(m.select("_s", F.col("_hash").alias("_low"), (F.col("_budget") - F.col("_before")).alias("_budget"), "_words", "_alike", "_first", "_last"), "mix-cut")
        if open_.where("_first < _last").isEmpty():  # each cut stands between two hashes
            break
    met = open_.select("_s", F.col("_first").alias("_cut"), F.floor(F.col("_budget") * F.col("_alike") / F.col("_words") + 0.5).cast("long").alias("_fits"), "_alike")
    out = g.join(met, F.expr("_source <=> _s"), "left")
    return out.select("_source", "_total", "_target", "_whole", F.coalesce("_cut", F.lit(0)).alias("_cut"), F.coalesce("_fits", F.lit(0)).alias("_fits"), F.coalesce("_alike", F.lit(0)).alias("_alike"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a document: key, size, source_size, target and taken."""
    rows = materialize(sized(docs, key, text, source), "mix-sizes")
    goals = materialize(targets(rows, weights, most), "mix-targets")
    plan = materialize(cuts(rows, goals, most), "mix-plan").withColumnRenamed("_source", "_s")
    d = rows.join(small_side(plan), F.expr("_source <=> _s"))
    at_cut = "_alike > 1 AND _hash = _cut"
    # alike rows at the cut are numbered through the partitions that hold them
    own = d.where(at_cut).withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_hash")))
    held = d.where(at_cut).groupBy(F.col("_source").alias("_hs"), F.col("_part").alias("_hp")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_hs").orderBy("_hp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_hs", "_hp", before.alias("_held"))
    own = own.join(held, F.expr("_source <=> _hs AND _part = _hp")).withColumn("_nth", F.col("_nth") + F.col("_held"))
    once = d.where(f"NOT ({at_cut})").withColumn("_nth", F.lit(1).cast("long"))
    both = once.unionByName(own.select(*once.columns))
    more = F.when(F.expr("_hash < _cut OR (_hash = _cut AND _nth <= _fits)"), 1).otherwise(0)
    return both.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * (F.col("_whole") + more)).alias("taken"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rule by a running sum over sorted hashes.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, left(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, list_extract({list(WEIGHTS)}, 1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER o AS pos, ((sum(total) OVER ())::BIGINT - {MOST} * coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM s WINDOW o AS (ORDER BY total::DOUBLE / w, k)),
u AS (SELECT arg_min(share, pos) AS unit FROM r WHERE {MOST} * total >= share * w),
t AS (SELECT source, total, least(({MOST} * total)::DOUBLE, unit * w) AS target FROM r, u),
g AS (SELECT d.*, total, target, CASE WHEN total = 0 THEN 0 ELSE least({MOST}, floor(target / total))::BIGINT END AS whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target, (size * (whole + CASE WHEN target - whole * total > 0 AND before + size / 2.0 <= target - whole * total THEN 1 ELSE 0 END))::BIGINT AS taken FROM g
"""
