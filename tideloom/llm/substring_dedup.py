"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, repeats found through compact sorted exchanges.

A word is removed if some window that covers it repeats a window that starts earlier (smaller key, or the same text and an
earlier start). All windows are judged on the input.

1. Documents are dealt into chunks, ranges of the key, so an earlier chunk holds smaller keys only.
2. Each chunk hashes all its windows and sends each distinct hash once: ascending, as byte-packed gaps, one blob for each
   range (bucket) of the hash space. A passage that thousands of documents share costs at most one entry a chunk.
3. Each bucket counts the hashes over the chunks and answers each blob with one bit an entry: an earlier chunk has it.
4. Each chunk meets its answers, adds the repeats inside itself, merges covering windows into maximal intervals, and cuts them.

Windows are equal when their 64-bit hashes are (for n windows a false match has odds of about n*n / 2**65).

Defined results: null or empty text, or fewer words than a window: nothing removed. Rows with equal keys are ordered by their text; null
keys come first. Repeated rows all come back (the later copies lose their words). Empty input: no rows. The input's columns
stay; those named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import balanced_labels, key_ranges
from .shared import shuffle_partitions, trim_memory
from .wordhash import cut_points, pack_sorted, slices, unpack_sorted, window_hashes, word_hashes

WINDOW = 20
OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept_text", T.StringType()),
]


def _windows(texts: pa.Array, width: int):
    """For each slice: (first row, word index of each row, window hashes, their first words)."""
    for lo, hi, data, off in slices(texts):
        h, first = word_hashes(data, off)
        yield lo, hi, first, *window_hashes(h, first, width)


def _joined(found: list[np.ndarray]) -> np.ndarray:
    """All of ``found``, which is emptied: a chunk's hashes are held once."""
    h = np.concatenate([*found, np.zeros(0, np.uint64)])
    found.clear()
    return h


def _starts(h: np.ndarray) -> np.ndarray:
    """Where ascending ``h`` has a value for the first time."""
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return new


def _repeated(found: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    """Which hashes stand earlier in ``found`` (emptied) or, by ``earlier``'s bit for each distinct one in ascending order, in an earlier chunk."""
    h = _joined(found)
    order = np.argsort(h, kind="stable")
    new = _starts(h[order])
    del h
    again = earlier[np.cumsum(new, dtype=np.int32) - 1]
    again |= ~new
    out = np.empty(len(order), bool)
    out[order] = again
    return out


def _send(width: int, buckets: list[int], text: str):
    def send(table: pa.Table) -> pa.Table:
        trim_memory()
        h = _joined([w for *_, w, _ in _windows(table[text], width)])
        h.sort()
        h = h[_starts(h)]
        cuts = cut_points(h, len(buckets))
        full = np.flatnonzero(np.diff(cuts))
        blobs = [pack_sorted(h[cuts[k] : cuts[k + 1]]) for k in full]
        del h
        head = table.slice(0, 1)
        chunk, order = head["_chunk"][0].as_py(), head["_order"][0].as_py()
        return pa.table({
            "_bucket": pa.array([buckets[k] for k in full], pa.int32()), "_part": pa.array(full, pa.int32()),
            "_chunk": pa.array([chunk] * len(full), pa.int32()), "_order": pa.array([order] * len(full), pa.int32()), "_blob": pa.array(blobs, pa.binary()),
        })

    return send


SENT = "_bucket int, _part int, _chunk int, _order int, _blob binary"
ANSWER = "_chunk int, _part int, _bits binary, _n int"


def _answer(table: pa.Table) -> pa.Table:
    table = table.sort_by("_order")
    blobs = [unpack_sorted(b) for b in table["_blob"].to_pylist()]
    sizes = np.array([len(b) for b in blobs])
    h = np.concatenate(blobs)
    order = np.argsort(h, kind="stable")  # chunks come in order, so the first of equals is the earliest
    s = h[order]
    again = np.zeros(len(h), bool)
    again[order[1:][s[1:] == s[:-1]]] = True
    ends = np.cumsum(sizes)
    bits = [np.packbits(again[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pa.table({"_chunk": table["_chunk"], "_part": table["_part"], "_bits": pa.array(bits, pa.binary()), "_n": pa.array(sizes, pa.int32())})


def _cut(width: int, text: str, key: str, schema: pa.Schema):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        trim_memory()
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.take(pc.sort_indices(docs, sort_keys=[(key, "ascending"), (text, "ascending")], null_placement="at_start"))
        answers = answers.sort_by("_part")
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(answers["_bits"].to_pylist(), answers["_n"].to_pylist())]
        earlier = np.concatenate(bits) if bits else np.zeros(0, bool)
        parts, found = [], []
        for lo, hi, first, w, at in _windows(docs[text], width):
            parts.append((lo, hi, first, at.astype(np.int32)))
            found.append(w)
        repeated = _repeated(found, earlier)
        n_words, n_removed, spans, kept, done = [], [], [], [], 0
        texts = docs[text].combine_chunks() if docs[text].num_chunks != 1 else docs[text].chunk(0)
        raw = texts.cast(pa.binary())
        for lo, hi, first, at in parts:
            hit = at[repeated[done : done + len(at)]]
            done += len(at)
            cover = np.zeros(int(first[-1]) + width + 1, np.int32)
            cover[hit] += 1
            cover[hit + width] -= 1
            gone = np.cumsum(cover)[: int(first[-1])] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            lost = total[first[1:]] - total[first[:-1]]
            n_words.append(np.diff(first))
            n_removed.append(lost)
            for i in range(lo, hi):
                words = (raw[i].as_py() or b"").split()
                if lost[i - lo]:
                    mask = gone[first[i - lo] : first[i - lo + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                    keep = ~mask
                    words = [x for x, k in zip(words, keep.tolist()) if k]
                else:
                    spans.append([])
                kept.append(b" ".join(words))
        new = {
            "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
            "removed": pa.array(spans, schema.field("removed").type), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        return pa.table([new[f.name] if f.name in new else docs[f.name].cast(f.type) for f in schema], schema=schema)

    return cut


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """``carry``'s columns (all by default) with n_words, n_removed, removed (intervals of word places) and kept_text
    (kept words joined by one space). ``key`` is a number."""
    spark = docs.sparkSession
    carry = [c for c in (carry or docs.columns) if c not in {f.name for f in OUT} and c not in ("_chunk", "_order")]
    at, labels, _ = key_ranges(docs, key, text)
    parts = shuffle_partitions(spark)
    buckets = balanced_labels(spark, max(parts, -(-len(labels) // 2)), parts)
    inner = list(dict.fromkeys([*carry, key, text]))
    dealt = docs.select(*[F.col(f"`{c}`") for c in inner], at.alias("_order")).withColumn("_chunk", F.element_at(F.array(*map(F.lit, labels)), F.col("_order") + 1))
    sent = dealt.groupBy("_chunk").applyInArrow(_send(window, buckets, text), SENT)
    answers = sent.groupBy("_bucket").applyInArrow(_answer, ANSWER)
    schema = T.StructType([f for f in docs.schema if f.name in carry] + OUT)
    arrow = to_arrow_schema(schema)
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_cut(window, text, key, arrow), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
