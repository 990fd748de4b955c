"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut. Whole pieces are sequences of their own. The
others are dealt by hash into groups of bounded size; each group is solved by several islands (tasks) that start from best-fit in
differently disturbed decreasing order. A crossover injects the best filled bins of one parent into the other, removes the bins
that hold one of their pieces, and best-fits the displaced pieces, largest first. After each epoch the islands' elites migrate to all
islands of the group. Bins that stay badly filled are dissolved at the end, and their pieces are packed once more over all groups.

Fitness is the number of bins, then the sum of squared fills. An island stops when it has as few bins as the tokens need, before any
crossover if a start has; the epochs after that only hand its elites on. On documents with many small pieces the starts often reach that bound.

Defined results: null or empty text: its end token alone. Repeated rows are packed each; pieces are told apart by row, not by key. Empty
input: no rows. Extra columns can be carried; equal names are replaced.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import tokenizer_path
from .byte_runs import column_runs
from .shared import materialize

CAPACITY, GROUP, ISLANDS, EPOCHS, POPULATION, BIRTHS = 2048, 16_000, 2, 2, 4, 6
PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: tuple[int, ...] = (0,), carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, carried columns, piece, start, length, ids_crc32 and, if asked for, ids."""
    fields = PIECE + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    carry = [key, *[c for c in (carry or []) if c != key and c not in {f.name for f in fields}]]
    tail = np.array(end, np.int32)

    def run(batches):
        tok = column_runs(tokenizer)
        for b in batches:
            for lo, hi, flat, off in tok.encode(b[text], tail):
                rows = b.slice(lo, hi - lo)
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, (x, y) in enumerate(pairwise(off.tolist())):
                    for p, s in enumerate(range(x, y, capacity)):
                        part = flat[s : min(s + capacity, y)]
                        at.append(i)
                        piece.append(p)
                        start.append(s - x)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                rows = rows.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in carry], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=[*carry, *[f.name for f in fields]])
        tok.rest()

    read = list(dict.fromkeys([*carry, text]))
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + fields))


class BestFit:
    """Bins by their free space; the tightest one that fits is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.by, self.bits = capacity, [], [[] for _ in range(capacity + 1)], 0

    def add_bin(self, free: int) -> int:
        self.free.append(free)
        self._put(len(self.free) - 1, free)
        return len(self.free) - 1

    def _put(self, b: int, free: int) -> None:
        if free:
            self.by[free].append(b)
            self.bits |= 1 << free

    def place(self, size: int) -> int:
        fit = self.bits >> size
        if not fit:
            return self.add_bin(self.capacity - size)
        free = size + (fit & -fit).bit_length() - 1
        stack = self.by[free]
        b = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.free[b] = free - size
        self._put(b, free - size)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bf, out = BestFit(capacity), np.empty(len(sizes), np.int64)
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        out[i] = bf.place(s)
    return out


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(bins, weights=sizes)
    fill = fill[fill > 0]
    return len(fill), -float(((fill / capacity) ** 2).sum())


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of ``father`` go into ``mother``; what they displace is best-fitted again, largest first."""
    fill = np.bincount(father, weights=sizes)
    ranked = np.argsort(-fill, kind="stable")
    take = rng.choice(ranked[: max(1, len(ranked) // 2)], max(1, len(ranked) // 4), replace=False)
    injected = np.zeros(len(fill), bool)
    injected[take] = True
    moved = injected[father]
    hit = np.zeros(int(mother.max()) + 1, bool)
    hit[mother[moved]] = True
    out = np.where(moved, father + len(hit), mother)
    loose = hit[mother] & ~moved
    keep = ~loose
    names, compact = np.unique(out[keep], return_inverse=True)
    bf = BestFit(capacity)
    for f in (capacity - np.bincount(compact, weights=sizes[keep])).astype(int).tolist():
        bf.add_bin(f)
    child = np.empty(len(sizes), np.int64)
    child[keep] = compact
    left = np.flatnonzero(loose)
    left = left[np.argsort(-sizes[left], kind="stable")]
    for i, s in zip(left.tolist(), sizes[left].tolist()):
        child[i] = bf.place(s)
    return child


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, births: int = BIRTHS) -> np.ndarray:
    """The best grouping that this island finds; ``elites`` came from the islands of the epoch before."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    pool = [(fitness(sizes, e, capacity), e) for e in elites]
    while len(pool) < population and not (pool and min(p[0][0] for p in pool) <= least):
        noise = 1 + 0.05 * len(pool) * rng.random(len(sizes))  # the first grouping of every island is best-fit-decreasing itself
        e = best_fit(sizes, np.argsort(-sizes * noise, kind="stable"), capacity)
        pool.append((fitness(sizes, e, capacity), e))
    pool.sort(key=lambda p: p[0])
    for _ in range(births):
        if pool[0][0][0] <= least or len(pool) < 2:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(sizes, pool[a][1], pool[b][1], capacity, rng)
        pool.append((fitness(sizes, child, capacity), child))
        pool.sort(key=lambda p: p[0])
        pool = pool[:population]
    return pool[0][1]


def _pack_groups(pieces: DataFrame, n: int, capacity: int, islands: int, epochs: int, base: int) -> DataFrame:
    """Adds _bin (long) and offset to pieces (columns _row and length among them), group by group."""
    groups = max(1, -(-n // GROUP))
    dealt = pieces.withColumn("_g", F.expr(f"pmod(xxhash64(_row, {base}), {groups})").cast("long"))
    slim = dealt.select("_g", "_row", "length", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("_i"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values("_row", kind="stable", ignore_index=True)

    def epoch(key, items: pd.DataFrame, sent: pd.DataFrame | None = None) -> pd.DataFrame:
        items = order(items)
        elites = [] if sent is None else [np.frombuffer(b, np.int32).astype(np.int64) for b in sent.sort_values("_from")["_elite"]]
        best = evolve(items["length"].to_numpy(), elites, capacity, int(key[0]) * islands + int(key[1]) + 7919 * len(elites))
        return pd.DataFrame({"_g": [key[0]], "_from": [key[1]], "_elite": [best.astype(np.int32).tobytes()]})

    schema = "_g long, _from int, _elite binary"
    elites = slim.groupBy("_g", "_i").applyInPandas(lambda k, d: epoch(k, d), schema)
    for _ in range(epochs - 1):
        migrants = elites.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        elites = slim.groupBy("_g", "_i").cogroup(migrants.groupBy("_g", "_i")).applyInPandas(lambda k, d, s: epoch(k, d, s), schema)
    names = [f.name for f in dealt.schema]

    def settle(key, items: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        items = order(items)
        sizes = items["length"].to_numpy()
        found = [np.frombuffer(b, np.int32).astype(np.int64) for b in sent.sort_values("_from")["_elite"]]
        bins = np.unique(min(found, key=lambda e: fitness(sizes, e, capacity)), return_inverse=True)[1]
        rank = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[rank])
        first = np.flatnonzero(np.diff(bins[rank], prepend=-1))
        begin = np.repeat((ends - sizes[rank])[first], np.diff(np.append(first, len(rank))))
        offset = np.empty(len(sizes), np.int64)
        offset[rank] = ends - sizes[rank] - begin
        items["_bin"] = base + (int(key[0]) << 20) + bins
        items["offset"] = offset
        items["_fill"] = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return items[[*names, "_bin", "offset", "_fill"]]

    out = T.StructType([*dealt.schema.fields, T.StructField("_bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())])
    return dealt.groupBy("_g").cogroup(elites.groupBy("_g")).applyInPandas(settle, out).drop("_g")


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, loose: float = 0.97) -> DataFrame:
    """``pieces`` (with a ``length`` of at most ``capacity``) with sequence_id and offset. ``loose``: fill under which bins are packed again."""
    src = materialize(pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    cols = [c for c in src.columns if c != "_row"]
    whole = src.where(F.col("length") >= capacity).select(*cols, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = src.where(F.col("length") < capacity)
    n = rest.count()
    if not n:
        return whole
    first = materialize(_pack_groups(rest, n, capacity, islands, epochs, 0), "packed")
    done = first.where(F.col("_fill") >= loose * capacity)
    again = first.where(F.col("_fill") < loose * capacity).drop("_bin", "offset", "_fill")
    m = again.count()
    last = _pack_groups(again, m, capacity, islands, epochs, 1 << 60) if m else None
    parts = [done, *([last] if last is not None else [])]
    for p in parts:
        whole = whole.unionByName(p.select(*cols, F.col("_bin").alias("sequence_id"), "offset"))
    return whole


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer, capacity, key, text, carry=carry, with_ids=with_ids), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
