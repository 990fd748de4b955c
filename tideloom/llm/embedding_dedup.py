"""Embedding near-dedup: a subspace pigeonhole join on rotated vectors.

Unit vectors with a cosine of at least c are at a squared distance of at most 2 - 2c. A fixed orthogonal rotation spreads that distance over the
coordinates, which are split into blocks. Some block then holds no more than its share (in proportion to its coordinates)
of the squared distance, so the union of range joins in all blocks has every pair. A block's range join deals points by (label,
block, cell of the first coordinate, as wide as the radius): a point goes to its cell and the one before, and cells of many points are cut
into tiles. A tile finds the pairs within the block's radius from single-precision products (with slack), verifies them by the exact
cosine in double precision, and counts a pair in the first block that it qualifies in, so each link counts once. It sends
on link counts and a spanning forest, never pairs.

For vectors without structure a block of b of d coordinates meets a share of the pairs that depends on radius / deviation, which is
sqrt((2 - 2c) * b): many narrow blocks prune less in sum than few wide ones, so blocks have 16 coordinates.

Equal vectors of a label are one class that is compared once and counts with its size. Components come from star steps.

Defined results: null label, or a null or zero vector, or one with null or non-finite components: linked with nothing. Vectors of different lengths never
link. Rows with equal ids count as different vectors. Empty input: no rows. Extra columns aren't returned.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components, local_roots
from .shared import join_classes, materialize, shuffle_partitions, small_side, trim_memory

COSINE, BLOCK_DIMS, TILE, SLACK = 0.93, 16, 2000, 1e-9
NEAR = 1e-5  # over the rounding of single-precision squared distances of unit vectors
PAIRS = 1 << 20  # pairs looked at together
HEAVY = 20  # classes of more than rows / (HEAVY * partitions) rows are broadcast


@cache
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20 + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def block_edges(d: int) -> list[int]:
    return [*range(0, d, BLOCK_DIMS), d]


def _deal(threshold: float, key: str):
    def deal(batches):
        for b in batches:
            for d in sorted(set(b["_d"].to_pylist())):
                rows = b.filter(pa.compute.equal(b["_d"], d))
                vec = rows["_vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                unit = vec / np.linalg.norm(vec, axis=1)[:, None]
                turned = unit @ rotation(d)
                edges = block_edges(d)
                for k in range(len(edges) - 1):
                    radius = np.sqrt((2 - 2 * threshold + SLACK) * (edges[k + 1] - edges[k]) / d)
                    cell = np.floor(turned[:, edges[k]] / radius).astype(np.int32)
                    n = len(cell)
                    yield pa.RecordBatch.from_arrays([rows[key], rows["_size"], rows["_label"], rows["_d"], pa.array(np.full(n, k, np.int32)), pa.array(cell), rows["_vec"]], names=["_id", "_size", "_label", "_d", "_block", "_cell", "_vec"])

    return deal


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1)
        d, k, ti, tj = (one[c][0].as_py() for c in ("_d", "_block", "_i", "_j"))
        ids = table["_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, size, home, sub = ids[order], table["_size"].to_numpy()[order], table["_home"].to_numpy(zero_copy_only=False)[order], table["_sub"].to_numpy()[order]
        vec = table["_vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)[order]
        norm = np.linalg.norm(vec, axis=1)
        turned = vec / norm[:, None] @ rotation(d)
        edges = block_edges(d)
        limit = (2 - 2 * threshold + SLACK) * np.diff(edges) / d
        x = turned[:, edges[k] : edges[k + 1]].astype(np.float32)
        sq, one = (x * x).sum(1)[:, None], np.ones((len(x), 1), np.float32)
        left, right = np.hstack([-2 * x, one, sq]), np.ascontiguousarray(np.hstack([x, sq, one]).T)  # products are squared distances
        links, us, vs, lo = np.zeros(len(ids), np.int64), [], [], 0
        while lo < len(ids):
            hi = min(len(ids), lo + max(1, PAIRS // (len(ids) - lo)))
            u, v = np.divmod(np.flatnonzero(left[lo:hi] @ right[:, lo:] <= np.float32(limit[k] + NEAR)), len(ids) - lo)
            u, v, lo = u + lo, v + lo, hi
            far = (u < v) & (home[u] | home[v])
            if ti != tj:
                far &= sub[u] != sub[v]
            u, v = u[far], v[far]
            for p in range(0, len(u), 1 << 16):
                a, b = u[p : p + (1 << 16)], v[p : p + (1 << 16)]
                ok = (vec[a] * vec[b]).sum(1) / (norm[a] * norm[b]) >= threshold
                a, b = a[ok], b[ok]
                diff = turned[a] - turned[b]
                diff *= diff
                at = np.add.reduceat(diff, edges[:-1], axis=1) <= limit  # the same sums in every task
                mine = at.argmax(1) == k
                mine &= at[:, k]
                a, b = a[mine], b[mine]
                np.add.at(links, a, size[b])
                np.add.at(links, b, size[a])
                us.append(a)
                vs.append(b)
        u, v = (np.concatenate(z) if z else np.zeros(0, int) for z in (us, vs))
        root = local_roots(u, v, len(ids))
        trim_memory()
        has = np.flatnonzero(links)
        return pa.table({"_id": pa.array(ids[has], pa.int64()), "_links": pa.array(links[has]), "_root": pa.array(ids[root[has]], pa.int64())})

    return compare


def near_embeddings(rows: DataFrame, threshold: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each of ``rows``: key, n_links, component_id and kept."""
    src = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").alias("_label"), F.col(f"`{vector}`").cast("array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>").alias("_vec"))
    bad = "_label IS NULL OR _vec IS NULL OR size(_vec) = 0 OR exists(_vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) OR NOT exists(_vec, x -> x <> 0)"
    src = src.withColumn("_h", F.expr(f"CASE WHEN coalesce({bad}, true) THEN NULL ELSE xxhash64(_label, _vec) END")).withColumn("_h2", F.expr("CASE WHEN _h IS NOT NULL THEN hash(_vec, _label) END"))
    slim = src.select(key, "_h", "_h2")
    classes = src.where("_h IS NOT NULL").groupBy("_h", "_h2").agg(F.min(key).alias(key), F.count("*").alias("_size"), F.min_by(F.struct("_label", "_vec"), key).alias("_x"))
    classes = materialize(classes.select("_h", "_h2", F.col(key).alias("_first"), F.monotonically_increasing_id().alias("_id"), "_size", F.col("_x._label").alias("_label"), F.col("_x._vec").alias("_vec"), F.size("_x._vec").alias("_d")), "vectors")
    kinds = dict(classes.dtypes)
    dealt = classes.select("_id", "_size", "_label", "_d", "_vec").mapInArrow(_deal(threshold, "_id"), f"_id long, _size long, _label {kinds['_label']}, _d int, _block int, _cell int, _vec {kinds['_vec']}")
    both = dealt.withColumn("_t", F.explode(F.expr("array(struct(_cell AS c, true AS h), struct(_cell - 1 AS c, false AS h))"))).select("_id", "_size", "_label", "_d", "_block", "_vec", F.col("_t.c").alias("_cell"), F.col("_t.h").alias("_home"))
    cell = ["_label", "_d", "_block", "_cell"]
    counts = materialize(both.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"), F.max("_home").alias("_any")).where("_any").drop("_any"), "cells")
    # tiles of a cell: pairs of its parts; a point meets every part of its cell
    t = both.join(small_side(counts), cell).withColumn("_sub", F.expr("CAST(pmod(xxhash64(_id), _tiles) AS INT)"))
    t = t.withColumn("_p", F.explode(F.expr("transform(sequence(0, _tiles - 1), j -> struct(least(j, _sub) AS i, greatest(j, _sub) AS j))"))).select("_id", "_size", *cell, "_vec", "_home", "_sub", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))
    found = materialize(t.groupBy(*cell, "_i", "_j").applyInArrow(_compare(threshold), "_id long, _links long, _root long"), "links")
    links = found.groupBy("_id").agg(F.sum("_links").alias("_links"))
    comp = connected_components(found.select(F.col("_id").alias("a"), F.col("_root").alias("b")))
    named = classes.select("_h", "_h2", "_id", "_first", "_size").join(links, "_id", "left").join(comp.select(F.col("node").alias("_id"), "root"), "_id", "left").withColumn("root", F.coalesce("root", "_id"))
    least = named.groupBy("root").agg(F.min("_first").alias("_least"))
    named = named.join(least, "root").select("_h", "_h2", (F.col("_size") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"), "_least", F.col("_size").alias("_rows"))
    out = join_classes(slim, materialize(named, "named"), ["_h", "_h2"], slim.count() / (HEAVY * shuffle_partitions(rows.sparkSession)))
    return out.select(key, F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_least", key).cast("long").alias("component_id"), F.expr(f"`{key}` <=> coalesce(_least, `{key}`)").alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
