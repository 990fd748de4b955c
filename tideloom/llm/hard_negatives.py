"""Hard-negative mining: inner products bounded on an orthogonal PCA rotation, verified with integer products.

Vectors become integers, floor(256 x). Their second moments are summed in Spark; the moments' eigenvectors are an orthogonal rotation that puts
most of a vector's length into its leading components. A block of anchors meets a block of rows by partial products over the leading
components; what is left is at most the product of the residual norms, plus slack for rounding. Pairs that can't reach the anchor's
threshold (the k-th best so far, or the window's lower end), or that must be above its window, are discarded; the others go on to the next
components, and the survivors' scores are integer products.

Two rounds: an anchor's nearest rows of its own label give the positives, and their scores give the windows of the second round over
rows of other labels. Rows of one label and one integer vector are a class: each can only be named by its smallest ids, so a class keeps
``KEEP`` of them (no result needs more) and anchors of one class are searched once. Blocks are cut by counts; each block of rows answers
with at most ``KEEP`` classes for each query, and these are merged by (score, id). Work is anchors times rows, as a stated query set against all rows; an
exchange row stands for a block's row once for each block of anchors.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do those whose component times 256 isn't
finite; a null id is no anchor, keeps its label and comes last in ties; vectors of different lengths never meet; repeated rows are rows of
their own, also as each other's positives; scores beyond a long stop at its ends; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import join_classes, materialize, shuffle_partitions, small_side

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 5, 100, 256
KEEP = 6  # the first five others of a class, and the anchor itself
BLOCK, STRIP = 8192, (256, 2048)  # rows of a block; anchors and rows of one product
DENSE = 0.1  # share of pairs from which products stay whole matrices
NO_ID = (1 << 63) - 1
LOW, HIGH = -(1 << 63), (1 << 63) - 1
HEAVY = 20


def _integers(batches):
    for b in batches:
        vec = b["_vec"]
        lengths = np.diff(vec.offsets.to_numpy())
        flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * SCALE) + 0.0
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        whole = bad[offsets[1:]] == bad[offsets[:-1]]
        q = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b["_id"], b["_label"], q], names=["_id", "_label", "_q"]).filter(pa.array(whole))


def prepared(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """_id, _label, _q (whole numbers as doubles) and the hashes of _q, of the rows that take part. Labels are damaged where the id is divisible by 7."""
    d = rows.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("long").alias("_label"), F.col(f"`{vector}`").cast("array<double>").alias("_vec"))
    d = d.where("_label IS NOT NULL AND _vec IS NOT NULL AND NOT exists(_vec, x -> x IS NULL)")
    d = d.select(F.coalesce("_id", F.lit(NO_ID)).alias("_id"), F.expr("CASE WHEN _id % 7 = 0 THEN (_label + 1) % 10 ELSE _label END").alias("_label"), "_vec")
    q = d.mapInArrow(_integers, "_id long, _label long, _q array<double>")
    return q.select("_id", "_label", "_q", F.size("_q").alias("_d"), F.xxhash64("_q").alias("_h"), F.hash("_q", "_label").alias("_h2"))


def _moments(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        lengths = np.asarray(b["_d"])
        for d in np.unique(lengths):
            q = _matrix(b.filter(pa.array(lengths == d))["_q"], int(d))
            with np.errstate(over="ignore", invalid="ignore"):
                sums[int(d)] = sums.get(int(d), 0) + q.T @ q
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["_d", "_i", "_m"])


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each length: eigenvectors of the second moments, largest first. The driver gets d * d sums."""
    part = classes.select("_d", "_q").mapInArrow(_moments, "_d int, _i int, _m array<double>")
    cells = part.select("_d", "_i", F.posexplode("_m").alias("_j", "_v")).groupBy("_d", "_i", "_j").agg(F.sum("_v").alias("_v")).collect()
    out: dict[int, np.ndarray] = {}
    for d, i, j, v in cells:
        out.setdefault(d, np.zeros((d, d)))[i, j] = v
    for d, m in out.items():
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() if np.isfinite(m).all() else np.eye(d)
    return out


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, which hold whole numbers; exact, cut at the ends of a long."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(u, v)), LOW), HIGH) for u, v in zip(a.tolist(), b.tolist())], np.int64)


class Turned:
    """Vectors on the rotation with what is left of their norms after each stage."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        d = q.shape[1]
        self.q, self.stages = q, sorted({-(-d // 8), -(-d // 4), -(-d // 2), d})
        with np.errstate(over="ignore", invalid="ignore"):
            self.y = q @ turn
            self.norm = np.sqrt((q * q).sum(1))
            self.left = [np.sqrt((self.y[:, m:] ** 2).sum(1)) for m in self.stages]


def _survivors(a: Turned, ai: slice, r: Turned, ri: np.ndarray, meet: np.ndarray, floor: np.ndarray, ceiling: np.ndarray):
    """(i, j) of a strip whose bounds reach [floor, ceiling] of the anchor; i and j count inside the strip."""
    ya, yr, slack = a.y[ai], r.y[ri], 1e-9 * a.norm[ai][:, None] * r.norm[ri][None, :] + 1e-6
    total, at, pairs = 0.0, 0, None
    for s, m in enumerate(a.stages):
        la, lr = a.left[s][ai], r.left[s][ri]
        if pairs is None:
            total = total + ya[:, at:m] @ yr[:, at:m].T
            bound = la[:, None] * lr[None, :] + slack
            alive = meet & ~(total + bound < floor[:, None]) & ~(total - bound > ceiling[:, None])
            if m == a.stages[-1] or alive.mean() < DENSE:
                pairs = np.nonzero(alive)
                total = total[pairs]
        else:
            i, j = pairs
            total = total + np.einsum("ij,ij->i", ya[i, at:m], yr[j, at:m])
            bound = la[i] * lr[j] + slack[i, j]
            alive = ~(total + bound < floor[i]) & ~(total - bound > ceiling[i])
            pairs, total = (i[alive], j[alive]), total[alive]
        at = m
    return pairs


def search(anchors: Turned, rows: Turned, labels: tuple[np.ndarray, np.ndarray], first: np.ndarray, queries: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool, k: int):
    """The k best rows of each query by (score, ``first``): (query, row, score), and how many pairs were verified.

    ``queries``: anchor (ascending), least and greatest score. ``same``: rows of the anchor's label, else of other labels.
    """
    who, least, most = queries
    start = np.searchsorted(who, np.arange(len(anchors.q)))
    count = np.bincount(who, minlength=len(anchors.q))
    floor = least.copy()
    found = tuple(np.zeros(0, np.int64) for _ in range(3))
    order, verified = np.argsort(-rows.norm, kind="stable"), 0
    at, wide = 0, 64
    while at < len(order):  # short strips first: they set the thresholds of the long ones
        ri = order[at : at + wide]
        at, wide = at + wide, min(2 * wide, STRIP[1])
        qs, js, scores = [], [], []
        low, high = np.full(len(anchors.q), np.inf), np.full(len(anchors.q), -np.inf)
        np.minimum.at(low, who, floor.astype(np.float64))
        np.maximum.at(high, who, most.astype(np.float64))
        for p in range(0, len(anchors.q), STRIP[0]):
            ai = slice(p, p + STRIP[0])
            meet = (labels[0][ai][:, None] == labels[1][ri][None, :]) == same
            i, j = _survivors(anchors, ai, rows, ri, meet, low[ai], high[ai])
            i, j = i + p, ri[j]
            if not len(i):
                continue
            verified += len(i)
            score = integer_products(anchors.q[i], rows.q[j])
            n = count[i]
            q = np.repeat(start[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            score, j = np.repeat(score, n), np.repeat(j, n)
            ok = (score >= floor[q]) & (score <= most[q])
            qs.append(q[ok])
            js.append(j[ok])
            scores.append(score[ok])
        if not qs:
            continue
        q, j, score = (np.concatenate([old, *new]) for old, new in zip(found, (qs, js, scores)))
        by = np.lexsort((first[j], -score.astype(np.float64), q)) if np.abs(score.astype(np.float64)).max(initial=0) < 2.0**53 else np.array(sorted(range(len(q)), key=lambda t: (q[t], -int(score[t]), first[t])), np.int64)
        q, j, score = q[by], j[by], score[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        found = q[nth < k], j[nth < k], score[nth < k]
        kth = nth == k - 1
        floor[q[kth]] = score[kth]
    return *found, verified


_HITS = "_anchor long, _most long, _score long, _ids array<long>, _class long"


def _cells(turns: dict[int, np.ndarray], same: bool, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"_anchor": pa.array([], pa.int64()), "_most": pa.array([], pa.int64()), "_score": pa.array([], pa.int64()), "_ids": pa.array([], pa.list_(pa.int64())), "_class": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        d = left["_d"][0].as_py()
        turn = turns[d] if d else np.zeros((0, 0))
        a, r = Turned(_matrix(left["_q"], d), turn), Turned(_matrix(right["_q"], d), turn)
        ids = right["_ids"].to_pylist()
        windows = left["_windows"].to_pylist()
        who = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        least = np.array([x["lo"] for w in windows for x in w], np.int64)
        most = np.array([x["hi"] for w in windows for x in w], np.int64)
        labels = left["_label"].to_numpy(), right["_label"].to_numpy()
        q, j, score, _ = search(a, r, labels, np.array([i[0] for i in ids], np.int64), (who, least, most), same, k)
        anchor, name = left["_c"].to_numpy(), right["_c"].to_numpy()
        return pa.table({"_anchor": anchor[who[q]], "_most": most[q], "_score": score, "_ids": pa.array([ids[x] for x in j], pa.list_(pa.int64())), "_class": name[j]})

    return run


def _searched(anchors: DataFrame, rows: DataFrame, turns: dict[int, np.ndarray], same: bool, k: int, keep: int) -> DataFrame:
    """_anchor, _most and the first ``keep`` rows of each query as _rows: array of (_nth, _score, _id, _class), in order."""
    spark = rows.sparkSession
    n, m = rows.count(), anchors.count()
    by = ["_d", "_label"] if same else ["_d"]
    if same:  # blocks of a label follow its rows
        counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("_nr")).join(anchors.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("_na")), by)
        counts = small_side(materialize(counts, "mining-blocks"))
        a, r = anchors.join(counts, by), rows.join(counts, by)
    else:
        nr, na = max(min(shuffle_partitions(spark), -(-n // 256)), -(-n // BLOCK), 1), max(-(-m // BLOCK), 1)
        a, r = (x.withColumn("_nr", F.lit(nr)).withColumn("_na", F.lit(na)) for x in (anchors, rows))
    a = a.withColumn("_ab", F.expr("CAST(pmod(xxhash64(_c), _na) AS INT)")).withColumn("_rb", F.explode(F.expr("sequence(0, CAST(_nr AS INT) - 1)")))
    r = r.withColumn("_rb", F.expr("CAST(pmod(xxhash64(_c), _nr) AS INT)")).withColumn("_ab", F.explode(F.expr("sequence(0, CAST(_na AS INT) - 1)")))
    cell = [*by, "_ab", "_rb"]
    a, r = a.select(*cell, *(c for c in ("_c", "_label", "_q", "_windows") if c not in cell)), r.select(*cell, *(c for c in ("_c", "_label", "_q", "_ids") if c not in cell))
    a = a.toDF(*a.columns)  # anchors come from the rows; names of their own
    hits = a.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(_cells(turns, same, k), _HITS)
    each = hits.select("_anchor", "_most", "_score", "_class", F.explode("_ids").alias("_id"))
    nth = F.row_number().over(Window.partitionBy("_anchor", "_most").orderBy(F.col("_score").desc(), "_id", "_class"))
    each = each.withColumn("_nth", nth).where(F.col("_nth") <= keep)
    return each.groupBy("_anchor", "_most").agg(F.sort_array(F.collect_list(F.struct("_nth", "_score", "_id", "_class"))).alias("_rows"))


def hard_negatives(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    d = materialize(prepared(rows, key, label, vector), "mining-rows")
    named = ["_h", "_h2", "_label", "_d"]
    nth = F.row_number().over(Window.partitionBy(*named).orderBy("_id"))
    ids = d.withColumn("_nth", nth).where(F.col("_nth") <= KEEP).groupBy(*named).agg(F.sort_array(F.collect_list("_id")).alias("_ids"), F.first("_q").alias("_q"))
    sizes = d.groupBy(*named).agg(F.count("*").alias("_all"), F.count_if(F.expr(f"_id % {int(every)} = 0 AND _id <> {NO_ID}")).alias("_rows"))
    classes = materialize(ids.join(sizes, named).withColumn("_c", F.monotonically_increasing_id()), "mining-classes")
    turns = rotations(classes)
    anchors = classes.where("_rows > 0")
    all_scores = F.array(F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))
    near = _searched(anchors.withColumn("_windows", all_scores), classes, turns, True, KEEP, KEEP)
    # scores of possible positives: the anchor's own row isn't one, unless another row equals it
    near = near.select("_anchor", F.expr("transform(_rows, x -> struct(x._score AS s, x._id AS id, x._class = _anchor AS own))").alias("_near"))
    a = materialize(anchors.join(near, F.col("_c") == F.col("_anchor")).withColumn("_goals", F.expr("array_distinct(transform(filter(_near, x -> NOT x.own OR _all > 1), x -> x.s))")), "mining-anchors")
    # 80 p <= 100 n: n is at least ceil(4 p / 5); a window above itself is empty
    least = "CAST(ceil(CAST(s AS DECIMAL(38,1)) * 4 / 5) AS BIGINT)"
    windows = F.expr(f"transform(filter(_goals, s -> s >= 0), s -> struct({least} AS lo, s AS hi))")
    far = _searched(a.withColumn("_windows", windows).where("size(_windows) > 0"), classes, turns, False, NEGATIVES, NEGATIVES)
    far = far.groupBy(F.col("_anchor").alias("_fa")).agg(F.collect_list(F.struct(F.col("_most").alias("p"), F.col("_rows").alias("rows"))).alias("_far"))
    found = a.select(*named, "_c", "_near", "_rows").join(far, F.col("_c") == F.col("_fa")).select("_h", "_h2", "_label", "_d", "_near", "_far", "_rows")
    own = d.where(f"_id % {int(every)} = 0 AND _id <> {NO_ID}").select("_id", *named)
    out = join_classes(own, materialize(found, "mining-found"), named, own.count() / (HEAVY * shuffle_partitions(rows.sparkSession))).where("_near IS NOT NULL")
    out = out.withColumn("_me", F.expr("array_position(transform(_near, x -> x.own AND x.id = _id), true)"))
    out = out.withColumn("_p", F.explode(F.expr(f"slice(filter(_near, (x, i) -> i <> _me - 1), 1, {POSITIVES})")))
    out = out.withColumn("_n", F.explode(F.expr("flatten(transform(filter(_far, f -> f.p = _p.s), f -> f.rows))")))
    name = lambda c: F.expr(f"nullif({c}, {NO_ID})")
    return out.select(F.col("_id").alias("anchor_id"), name("_p.id").alias("positive_id"), F.col("_n._nth").cast("int").alias("rank"), name("_n._id").alias("negative_id"), F.col("_p.s").alias("positive_score"), F.col("_n._score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other, a.label = b.label AS same, CASE WHEN len(a.q) = 0 THEN 0 ELSE list_dot_product(a.q, b.q)::BIGINT END AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other NULLS LAST, b) AS k FROM s WHERE same),
n AS (SELECT p.r, p.k, p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.other NULLS LAST) AS rank
    FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
