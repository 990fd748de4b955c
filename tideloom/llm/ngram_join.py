"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A text's set is its distinct word n-grams. Sets are grouped into size bands so that similar sets lie in the same or in adjacent
bands; group k holds the pairs whose smaller set is in band k. Two sets with similarity >= t differ in at most H_k elements
there, so if hashing deals the universe into H_k + 1 segments, some segment's subset is the same in both. Each set indexes
its segment subsets (a sum of element hashes) in its own group and in the one below.

Poor subsets (empty ones, and those of very frequent elements alone) would match nearly everything. The allocation is by cost: a
set gives its e poor segments no tolerance and pays for that with one-deletion neighbourhoods on the first segments until e payers
(three elements or more, two of them not frequent) are among them. If two similar sets share no other subset, all segments but
the shared poor ones differ, at most e - 1 of them in more than one element, so some payer differs in exactly one and the
neighbourhoods meet. Only a set that can't pay indexes its poor segments. This holds for any fixed list of frequent elements; the list
is counted over all sets (in each batch first, then those of at least FREQUENT of all sets), so its size is bounded by the mean
set size / FREQUENT. Sets that may differ in one element at most use the one-deletion neighbourhood of the whole set.

Equal sets are one class (64-bit digest), so copies never meet in pairs. Signatures travel as packed blobs by hash range; the number
of ranges follows the counted shingles, so a range is of bounded size, and sends on a spanning forest of what shares a
signature. Candidate clusters are verified exactly on sets, in tiles of bounded size: a few pivots are compared with all sets of
the tile, and pairs inside the largest component found so are left out, as they can't change a component. Other pairs
are counted in strips, frequent tokens by a matrix product and rare ones over their posting lists. Tiles send on spanning forests
again; components come from star steps. Classes of very many rows get their component by a broadcast of bounded size.

Defined results: null, empty or blank text: empty set, linked with nothing. Fewer words than n: the whole sequence is the one element.
Equal texts are always linked (unless empty). Repeated rows all come back. Extra columns stay; equal names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import balanced_labels
from .graph import connected_components, forest, local_roots
from .shared import join_classes, materialize, shuffle_partitions, small_side, trim_memory
from .wordhash import cut_points, mix, pack_sorted, powers, slices, unpack_sorted, window_hashes, word_hashes

TILE_TOKENS, TILE_SETS = 1 << 19, 2048
RANGE_ENTRIES, FLUSH = 1 << 20, 1 << 20  # signatures in a range of the hash space (about), and those that a sender packs at once
CELLS, PIVOTS, DENSE = 1 << 21, 6, 14  # of a strip; compared with all; a token in a DENSE-th of the sets counts by matrix product
HEAVY = 20  # classes of more than rows / (HEAVY * partitions) rows are broadcast, so at most HEAVY * partitions
FREQUENT = 0.001  # share of all sets
_SALT = np.uint64(0xA24BAED4963EE407)
_GROUP, _PLACE, _EMPTY, _NEAR = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D))


def text_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The ascending distinct n-gram hashes of each text; A-Z lower-cased."""
    for _, _, data, off in slices(texts):
        h, first = word_hashes(data, off, lower=True)
        w, at = window_hashes(h, first, n)
        cut = np.searchsorted(at, first)
        for i in range(len(off) - 1):
            a, b = cut[i], cut[i + 1]
            if b > a:
                yield np.unique(w[a:b])
            elif first[i + 1] > first[i]:
                words = h[first[i] : first[i + 1]]
                yield mix(np.array([(words * powers(0xD6E8FEB86659FD93, len(words))).sum(dtype=np.uint64) + np.uint64(len(words) * int(_SALT) % 2**64)], np.uint64))
            else:
                yield w[:0]


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bands:
    """Size bands, difference bounds and signatures for a similarity threshold."""

    def __init__(self, threshold: float | str, frequent: np.ndarray | None = None):
        self.frequent = np.zeros(0, np.uint64) if frequent is None else frequent  # ascending
        self.t = Fraction(str(threshold))
        self.upper: list[int] = []  # largest size of each band
        self.diff: list[int] = []  # H of each group
        self.edges: dict[int, np.ndarray] = {}

    def band(self, size: int) -> int:
        while not self.upper or self.upper[-1] < size:
            low = self.upper[-1] + 1 if self.upper else 1
            u = int(low / self.t)
            self.upper.append(u)
            self.diff.append(int((1 - self.t) / (1 + self.t) * (u + int(u / self.t))))
        return int(np.searchsorted(self.upper, size))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        k = self.band(len(s))
        e = mix(s ^ _SALT)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(e, dtype=np.uint64)])
        rare = np.ones(len(s), bool)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
            rare = self.frequent[at] != s
        rares = np.concatenate([[0], np.cumsum(rare)])
        return np.concatenate([self._group(s, e, sums, g, rare, rares) for g in ((k - 1, k) if k else (k,))])

    def _group(self, s, e, sums, g, rare, rares) -> np.ndarray:
        salt = np.uint64((g + 1) * int(_GROUP) % 2**64)
        h = self.diff[g]
        if h == 0:
            return mix(sums[-1:] + salt)
        if h == 1:
            return mix(np.concatenate([sums[-1:], sums[-1] - e]) + (salt ^ _NEAR))
        m = h + 1
        if m not in self.edges:
            self.edges[m] = np.array([((j << 64) + m - 1) // m for j in range(1, m)], np.uint64)
        cut = np.empty(m + 1, np.int64)
        cut[0], cut[-1] = 0, len(s)
        cut[1:-1] = np.searchsorted(s, self.edges[m])
        size = np.diff(cut)
        place = np.arange(m, dtype=np.uint64) * _PLACE + salt
        sub = sums[cut[1:]] - sums[cut[:-1]]
        n_rare = rares[cut[1:]] - rares[cut[:-1]]
        good = n_rare > 0
        out = [sub[good] + place[good]]
        poor = m - int(good.sum())
        if poor:
            paid = np.cumsum((size >= 3) & (n_rare >= 2))
            if paid[-1] < poor:
                end = m
                out.append((sub[~good] + place[~good]) ^ _EMPTY)
            else:
                end = int(np.searchsorted(paid, poor)) + 1
            near = np.flatnonzero((size[:end] >= 2) & good[:end])
            out.append((sub[near] + place[near]) ^ _NEAR)
            if len(near):
                which = np.repeat(near, size[near])
                inside = np.concatenate([np.arange(cut[j], cut[j + 1]) for j in near])
                left = n_rare[which] - rare[inside] > 0  # what stays has an element that isn't frequent
                which, inside = which[left], inside[left]
                out.append((sub[which] - e[inside] + place[which]) ^ _NEAR)
        return mix(np.concatenate(out))


def _describe(n: int, key: str, text: str):
    def describe(batches):
        for whole in batches:
            for lo, hi, *_ in slices(whole[text], 8 << 20):
                b = whole.slice(lo, hi - lo)
                sets = list(text_sets(b[text], n))
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                often = counts >= max(8, 2 * FREQUENT * len(sets))
                heavy = [list(zip(tokens[often].view(np.int64).tolist(), counts[often].tolist()))] + [None] * (len(sets) - 1)
                yield pa.RecordBatch.from_arrays([
                    b[key], b["_mark"], pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([h and [{"t": t, "c": c} for t, c in h] for h in heavy], pa.list_(pa.struct([("t", pa.int64()), ("c", pa.int64())]))),
                ], names=["_key", "_mark", "n_shingles", "_set", "_heavy"])
        trim_memory()

    return describe


def frequent_elements(desc: DataFrame, n: int) -> np.ndarray:
    """Elements that a batch found frequent and that reach FREQUENT of all ``n`` sets; a bounded list, in ascending order."""
    h = desc.where("_heavy IS NOT NULL").select(F.explode("_heavy").alias("h")).groupBy("h.t").agg(F.sum("h.c").alias("c")).where(F.col("c") >= max(8, FREQUENT * n))
    return np.sort(np.array([r["t"] for r in h.select("t").collect()], np.int64).view(np.uint64))


def _index(n: int, text: str, threshold, buckets: list[int], frequent: np.ndarray):
    def packed(sigs: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        h, own = np.concatenate(sigs), np.concatenate(owners)
        order = np.argsort(h)
        h, own = h[order], own[order]
        cuts = cut_points(h, len(buckets))
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([
            pa.array([buckets[k] for k in full], pa.int32()),
            pa.array([pack_sorted(h[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
            pa.array([own[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
        ], names=["_bucket", "_sigs", "_own"])

    def index(batches):
        bands = Bands(threshold, frequent)
        sigs, owners, held = [], [], 0
        for b in batches:
            seen = set()
            for s in text_sets(b[text], n):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    sigs.append(np.unique(bands.signatures(s)))
                    owners.append(np.full(len(sigs[-1]), d, np.int64))
                    held += len(sigs[-1])
                    if held >= FLUSH:
                        yield packed(sigs, owners)
                        sigs, owners, held = [], [], 0
        if sigs:
            yield packed(sigs, owners)
        trim_memory()

    return index


def _share(table: pa.Table) -> pa.Table:
    h = np.concatenate([unpack_sorted(b) for b in table["_sigs"].to_pylist()])
    own = np.concatenate([np.frombuffer(b, np.int64) for b in table["_own"].to_pylist()])
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    a, b = forest(own[same], own[same + 1]) if len(same) else (own[:0], own[:0])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _load(n: int, text: str):
    def load(batches):
        for b in batches:
            sets = list(text_sets(b[text], n))
            keep = [i for i, (s, d) in enumerate(zip(sets, b["_set"].to_pylist())) if len(s) and digest(s) == d]
            r = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([r["_set"], r["_cluster"], r["_block"], r["_blocks"], pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["_set", "_cluster", "_block", "_blocks", "_tokens"])

    return load


class Postings:
    """Sets over the tokens that at least two of them share, for exact intersection sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(tokens, kind="stable")
        tokens, who = tokens[order], who[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        first = np.flatnonzero(new)
        df = np.diff(np.append(first, len(tokens)))
        keep = np.repeat(df > 1, df)
        self.members, self.df = who[keep], df[df > 1]  # sets by token, ascending
        self.begin = np.cumsum(self.df) - self.df
        column = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        order = np.argsort(self.members, kind="stable")
        self.columns = column[order]  # tokens by set
        self.place = np.searchsorted(self.members[order], np.arange(len(sets) + 1))
        self.dense = self.df * DENSE >= len(sets)

    def shared(self, rows: np.ndarray) -> np.ndarray:
        """Intersection sizes of the sets ``rows`` with all sets."""
        n = len(self.size)
        out = np.zeros((len(rows), n), np.int32)
        count = self.place[rows + 1] - self.place[rows]
        at = np.repeat(np.arange(len(rows)), count)
        cols = self.columns[np.repeat(self.place[rows] - (np.cumsum(count) - count), count) + np.arange(len(at))]
        dense = self.dense[cols]
        which = np.unique(cols[dense])
        width = max(64, CELLS // max(1, n))
        for lo in range(0, len(which), width):
            part = which[lo : lo + width]
            right = np.zeros((len(part), n), np.float32)
            for k, c in enumerate(part.tolist()):
                right[k, self.members[self.begin[c] : self.begin[c] + self.df[c]]] = 1
            mine = dense & (cols >= part[0]) & (cols <= part[-1])
            left = np.zeros((len(rows), len(part)), np.float32)
            left[at[mine], np.searchsorted(part, cols[mine])] = 1
            out += (left @ right).astype(np.int32)
        at, cols = at[~dense], cols[~dense]
        ends = np.cumsum(self.df[cols])
        flat, lo = out.ravel(), 0
        while lo < len(cols):  # as many posting lists at once as fit
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
            df = self.df[cols[lo:hi]]
            total = int(df.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(df) - df, df)
            cell = np.repeat(at[lo:hi] * n, df) + self.members[np.repeat(self.begin[cols[lo:hi]], df) + inside]
            flat += np.bincount(cell, minlength=len(flat)).astype(np.int32)
            lo = hi
        return out


def tile_roots(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Of each set the first set of its component, over the pairs that reach the threshold exactly."""
    n = len(sets)
    root, post = np.arange(n), Postings(sets)

    def join(rows: np.ndarray) -> np.ndarray:
        both = post.shared(rows).astype(np.int64)
        u, v = np.nonzero(both * threshold.denominator >= threshold.numerator * (post.size[rows, None] + post.size[None, :] - both))
        return local_roots(np.concatenate([np.arange(n), rows[u]]), np.concatenate([root, v]), n)

    done = np.zeros(n, bool)
    for _ in range(PIVOTS):
        sizes = np.bincount(root[~done], minlength=n)
        if sizes.max() == n or done.all():
            break
        pick = np.flatnonzero((root == sizes.argmax()) & ~done)[:1]
        done[pick] = True
        root = join(pick)
    rest = np.flatnonzero((root != np.bincount(root, minlength=n).argmax()) & ~done)
    step = max(1, CELLS // n)
    for lo in range(0, len(rest), step):
        root = join(rest[lo : lo + step])
    return root


def _verify(threshold: Fraction):
    def verify(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table["_set"].to_numpy(), return_index=True)
        raw = table["_tokens"].combine_chunks() if table["_tokens"].num_chunks != 1 else table["_tokens"].chunk(0)
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in first]
        if len(sets) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = tile_roots(sets, threshold)
        moved = np.flatnonzero(root != np.arange(len(sets)))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[root[moved]], pa.int64())})

    return verify


def ngram_join(docs: DataFrame, n: int = 5, threshold: float | str = "0.8", key: str = "doc_id", text: str = "text", marks: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its key, n_shingles and component_id, the smallest key reachable over links.

    ``marks`` adds _mark, the text's hash, and _least, the mark of the component's first row by (key, mark).
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    t = Fraction(str(threshold))
    own = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    kind = dict(own.dtypes)[key]
    marked = own.withColumn("_mark", mark_of(text))
    desc = materialize(marked.mapInArrow(_describe(n, key, text), f"_key {kind}, _mark bigint, n_shingles bigint, _set bigint, _heavy array<struct<t:bigint,c:bigint>>"), "sets")
    classes = desc.where("_set IS NOT NULL").groupBy("_set").agg(F.min(F.when(F.col("_key").isNotNull(), F.struct("_key", "_mark"))).alias("_f"), F.first("n_shingles").alias("_n"), F.count("*").alias("_rows"))
    classes = classes.select("_set", "_f", F.col("_f._key").alias("_first"), "_n", "_rows")
    total = desc.agg(F.count("*"), F.sum("n_shingles")).first()
    # about two signatures for each shingle's share of the difference bound, in two groups; neighbourhoods come on top
    ranges = max(parts, -(-int((total[1] or 0) * 4 * (1 - t) / (1 + t)) // RANGE_ENTRIES))
    buckets = balanced_labels(spark, ranges, parts)
    sent = own.select(text).mapInArrow(_index(n, text, str(threshold), buckets, frequent_elements(desc, total[0])), "_bucket int, _sigs binary, _own binary")
    shared = connected_components(sent.groupBy("_bucket").applyInArrow(_share, "a bigint, b bigint"))
    # candidate clusters, each in as many blocks as its tokens and sets need
    cand = materialize(shared.join(classes, F.col("node") == F.col("_set")).select("_set", F.col("root").alias("_cluster"), "_first", "_n"), "cand")
    sizes = cand.groupBy("_cluster").agg(F.greatest(F.ceil(F.sum("_n") / TILE_TOKENS), F.ceil(F.count("*") / TILE_SETS)).cast("int").alias("_blocks"))
    cand = cand.join(sizes, "_cluster").select("_set", "_cluster", "_first", "_blocks", F.expr("CAST(pmod(xxhash64(_set), _blocks) AS INT)").alias("_block"))
    texts = own.join(small_side(cand), F.col(key) == F.col("_first")).select("_set", "_cluster", "_block", "_blocks", text)
    loaded = texts.mapInArrow(_load(n, text), "_set bigint, _cluster bigint, _block int, _blocks int, _tokens binary")
    tiles = loaded.select("_set", "_cluster", "_tokens", F.explode(F.expr("transform(sequence(0, _blocks - 1), j -> struct(least(j, _block) AS _i, greatest(j, _block) AS _j))")).alias("t")).select("_set", "_cluster", "t._i", "t._j", "_tokens")
    links = tiles.groupBy("_cluster", "_i", "_j").applyInArrow(_verify(t), "a bigint, b bigint")
    comp = connected_components(links)
    smallest = comp.join(classes, F.col("node") == F.col("_set")).select("node", "root", "_f")
    by_root = smallest.groupBy("root").agg(F.min("_f").alias("_least")).withColumnRenamed("root", "_root")
    linked = smallest.join(by_root, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "_least")
    ids = materialize(classes.join(linked, F.col("_set") == F.col("_node"), "left").select("_set", F.coalesce("_least", "_f").alias("_id"), "_rows"), "ids")
    out = join_classes(desc.select("_key", "n_shingles", "_set", "_mark"), ids, ["_set"], total[0] / (HEAVY * parts))
    more = [F.col("_mark"), F.col("_id._mark").alias("_least")] if marks else []
    return out.select(F.col("_key").alias(key), "n_shingles", F.coalesce("_id._key", "_key").alias("component_id"), *more)


def mark_of(text: str):
    """A text's hash; null is empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float | str = "0.8", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row, the first by (key, text hash), of each component; columns as they are.

    Rows go by key and text, so rows that share a key but not a text are judged apart; of rows alike in both one stays. Rows without words or
    without a key are linked with nothing here, and all of them stay.
    """
    j = ngram_join(docs, n, threshold, key, text, marks=True).where(F.col(key).isNotNull() & F.col("_least").isNotNull())
    first = (F.col(key) == F.col("component_id")) & (F.col("_mark") == F.col("_least"))
    found = materialize(j.groupBy(F.col(key).alias("_k"), F.col("_mark").alias("_m"), first.alias("_first")).agg(F.count("*").alias("_c")).where("NOT _first OR _c > 1"), "gone")
    same = (F.col(f"`{key}`") == F.col("_k")) & (mark_of(text) == F.col("_m"))
    kept = docs.join(small_side(found.select("_k", "_m"), 24), same, "left_anti")
    if found.where("_first").isEmpty():
        return kept
    # rows that are their component's first, several times over: one of them
    again = docs.join(small_side(found.where("_first").select("_k", "_m"), 24), same)
    again = again.withColumn("_nth", F.row_number().over(Window.partitionBy("_k", "_m").orderBy("_m"))).where("_nth = 1")
    return kept.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=3, threshold="0.9")
