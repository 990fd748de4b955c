"""Quality classifier: a byte-level convolutional network in numpy.

Filters of four bytes move over the whole text byte by byte. Their responses are max-pooled in overlapping chunks of 256 bytes (every 128
bytes), passed through a bias and a rectifier, and the chunks' features are combined as mean and maximum into one logistic probability.
A filter is a sum of one learned weight for each (place, byte); for scoring, the weights of two neighbouring places are summed into a
table over byte pairs, so a response is two table rows; pairs are read from even places and from odd ones.

Training is on the driver, on whole texts of at most ``max_docs`` labelled rows (half of each label as far as there are, chosen by
a hash of the key) and of at most ``max_bytes`` together (texts that don't fit any more are left out before any text is
fetched), weighted back to the labels' shares. Labels whose documents aren't in ``docs`` count for nothing; of a key that
repeats, one row is trained on. Labels are read only from rows with crc32(key as text) mod 5 not 0; neither labels nor other
columns are inputs of a score.

Defined results: null text is the empty text, which has a score too. No usable labels, or only one: every score is the share of label 1 (0.5 if
there is none). Any length is scored whole in bounded memory. Repeated rows all come back; extra columns stay, equal names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import materialize, trim_memory

FILTERS, HALF, MAX_DOCS, MAX_BYTES, EPOCHS, CUT = 16, 128, 2000, 6 << 20, 8, 0.3
BLOCK = 1 << 19  # bytes scored at once
PART_ROWS, PART_BYTES = 200, 4 << 20  # of texts whose features are held together, or one longer text


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each between three zero bytes and at least three, in whole half chunks; and the half chunks of each.

    So no window reaches from one text into the next.
    """
    halves = np.array([(len(t) + 6 + HALF - 1) // HALF for t in texts])
    buf = np.zeros(int(halves.sum()) * HALF + 4, np.uint8)
    at = 0
    for t, n in zip(texts, halves.tolist()):
        buf[at + 3 : at + 3 + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF
    return buf, halves


def byte_pairs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at even bytes and those that begin at odd ones, one more than half chunks hold."""
    return buf[:-2].view("<u2"), buf[1:-1].view("<u2")


def pooled(buf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Maximum response of each filter in each half chunk. ``one``, ``two``: responses by byte pair."""
    both = byte_pairs(buf)
    n = (len(both[0]) - 1) * 2 // HALF
    out = np.empty((n, one.shape[1]), np.float32)
    step = BLOCK // HALF
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        a, b = lo * HALF // 2, hi * HALF // 2
        for k, pairs in enumerate(both):
            y = one[pairs[a:b]]
            y += two[pairs[a + 1 : b + 1]]
            y = y.reshape(hi - lo, HALF // 2, -1).max(1)
            out[lo:hi] = np.maximum(out[lo:hi], y) if k else y
    return out


class Network:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, mean: np.ndarray, top: np.ndarray, shift: float):
        self.weights, self.bias, self.mean, self.top, self.shift = weights, bias, mean, top, shift

    @property
    def flat(self) -> bool:
        """Whether it has learned nothing: every text has the same score."""
        return not (self.mean.any() or self.top.any())

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights.astype(np.float32)
        pair = lambda a, b: np.ascontiguousarray((b[:, None, :] + a[None, :, :]).reshape(65536, -1))  # low byte first
        return pair(w[0], w[1]), pair(w[2], w[3])

    def score(self, texts: list[bytes], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        buf, halves = padded(texts)
        first = np.cumsum(halves) - halves
        feats = chunk_features(pooled(buf, *tables), halves, first) + self.bias
        np.maximum(feats, 0, out=feats)
        z = np.add.reduceat(feats, first, axis=0) / halves[:, None] @ self.mean + np.maximum.reduceat(feats, first, axis=0) @ self.top + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chunk_features(half: np.ndarray, halves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each half chunk with the next one of its text (the last one alone)."""
    out = half.astype(np.float64)
    last = np.zeros(len(half), bool)
    last[first + halves - 1] = True
    go = np.flatnonzero(~last)
    out[go] = np.maximum(half[go], half[go + 1])
    return out


def train(texts: list[bytes], labels: list[int], weight: dict[int, float], epochs: int = EPOCHS, seed: int = 5, rate: float = 0.01) -> Network:
    """Adam on the weighted logistic loss. Only the places of the maxima get gradients, so a step costs little more than a score."""
    rng = np.random.default_rng(seed)
    p = {"w": rng.normal(0, 0.15, (4, 256, FILTERS)), "b": np.zeros(FILTERS), "m": rng.normal(0, 0.1, FILTERS), "t": rng.normal(0, 0.1, FILTERS), "s": np.zeros(1)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    y = np.array(labels, np.float64)
    wt = np.array([weight[v] for v in labels])
    step = 0
    for _ in range(max(epochs, -(-12000 // max(1, len(texts))))):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            at = order[lo : lo + 32]
            net = Network(p["w"], p["b"], p["m"], p["t"], 0.0)
            one, two = net.tables()
            buf, halves = padded([texts[i] for i in at])
            n = int(halves.sum())
            half, place = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
            for a in range(0, n, BLOCK // HALF):
                b = min(n, a + BLOCK // HALF)
                for k, pairs in enumerate(byte_pairs(buf)):
                    resp = one[pairs[a * HALF // 2 : b * HALF // 2]]
                    resp += two[pairs[a * HALF // 2 + 1 : b * HALF // 2 + 1]]
                    resp = resp.reshape(b - a, HALF // 2, FILTERS)
                    best = resp.argmax(1)
                    high, where = np.take_along_axis(resp, best[:, None, :], 1)[:, 0], 2 * best + k + np.arange(a, b)[:, None] * HALF
                    if k:
                        high, where = np.maximum(half[a:b], high), np.where(high > half[a:b], where, place[a:b])
                    half[a:b], place[a:b] = high, where
            first = np.cumsum(halves) - halves
            raw = chunk_features(half, halves, first)
            nxt = np.minimum(np.arange(n) + 1, n - 1)
            place = np.where(raw > half, place[nxt], place)  # where the chunk's maximum is in its second half
            h = np.maximum(raw + p["b"], 0)
            owner = np.repeat(np.arange(len(at)), halves)
            mean = np.add.reduceat(h, first, axis=0) / halves[:, None]
            top = np.maximum.reduceat(h, first, axis=0)
            z = mean @ p["m"] + top @ p["t"] + p["s"][0]
            g = wt[at] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at]) / len(at)
            dh = (g / halves)[owner][:, None] * p["m"]
            is_top = h >= top[owner]
            share = np.add.reduceat(is_top.astype(np.float64), first, axis=0)
            dh += is_top * (g[owner][:, None] * p["t"]) / share[owner]
            dh *= h > 0
            gw = np.zeros_like(p["w"])
            f = np.broadcast_to(np.arange(FILTERS), dh.shape)
            for k in range(4):
                np.add.at(gw[k], (buf[place + k], f), dh)
            grads = {"w": gw + 1e-5 * p["w"], "b": dh.sum(0), "m": mean.T @ g, "t": top.T @ g, "s": np.array([g.sum()])}
            step += 1
            for k, v in grads.items():
                a, b = mom[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                p[k] = p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(p["w"], p["b"], p["m"], p["t"], float(p["s"][0]))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Network:
    """A network trained on a bounded sample of the labelled rows of ``docs``."""
    usable = labels.where(~held_out(key)).where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_y"))
    usable = materialize(usable.join(docs.select(key), key, "left_semi"), "labelled")
    counts = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    zero = np.zeros(FILTERS)
    flat = Network(np.zeros((4, 256, FILTERS)), zero, zero, zero, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(counts) < 2:
        return flat
    picks = None
    for v in sorted(counts):  # at most max_docs / 2 keys of each label
        part = usable.where(F.col("_y") == v).orderBy(F.xxhash64(key), key).limit(max_docs // 2)
        picks = part if picks is None else picks.unionByName(part)
    texts_of = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    sized = texts_of.join(F.broadcast(picks), key).groupBy(key).agg(F.max(F.octet_length("_t")).alias("_b")).collect()  # a number for each pick
    sized.sort(key=lambda r: str(r[key]))
    chosen, size = [], 0
    for i in np.random.default_rng(1).permutation(len(sized)):
        if size + sized[i]["_b"] <= max_bytes:
            chosen.append((sized[i][key],))
            size += sized[i]["_b"]
    if not chosen:
        return flat
    own = T.StructType([docs.schema[key]])  # an Arrow table needs no Python process in the executors
    few = docs.sparkSession.createDataFrame(pa.table([[k for (k,) in chosen]], schema=to_arrow_schema(own)), own).join(picks, key)
    rows = texts_of.join(F.broadcast(few), key).groupBy(key).agg(F.max("_y").alias("_y"), F.min("_t").alias("_t")).collect()
    at = {k: i for i, (k,) in enumerate(chosen)}
    rows.sort(key=lambda r: at[r[key]])
    texts, ys = [r["_t"].encode() for r in rows], [r["_y"] for r in rows]
    if len(set(ys)) < 2:
        return flat
    weight = {v: counts[v] / total / max(1, ys.count(v)) * len(ys) for v in counts}
    return train(texts, ys, weight)


def parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most PART_ROWS rows and PART_BYTES bytes of text, or one row with more."""
    size = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch[text]), 0), np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART_BYTES, "right"))
        hi = min(max(hi, lo + 1), lo + PART_ROWS, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def score_documents(docs: DataFrame, net: Network, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry``'s columns (all by default) with score and predicted. Work is by Arrow batch; nothing is shuffled."""
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in ("score", "predicted")]
    read = list(dict.fromkeys([*carry, text]))

    def run(batches):
        tables = net.tables()
        for b in batches:
            for part in parts(b, text):
                s = net.score([t or b"" for t in part[text].cast(pa.binary()).to_pylist()], tables)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in carry], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*carry, "score", "predicted"])
        trim_memory()

    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + new))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels), carry=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
