"""Token-ID output: sorted Parquet files with one row a document and its ids as a list column.

Files are ranges of the key in ascending order. ``ids`` is dictionary-encoded (a vocabulary fits a dictionary page; where it
doesn't, the writer falls back to delta encoding), row groups and pages are small and have column and offset indexes, so a
read of some documents or of metadata alone skips the rest. ``part`` and ``part_start`` place a row: the ids before a document
are those of the parts before its own plus ``part_start``; the parts' totals are a table of one row a file.

Defined results: null or empty text: the end id alone. Rows with equal keys are ordered by their text, null keys come first. Long texts
are encoded whole. Extra columns go into the files; those named like a file column are replaced. Empty input: no rows.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_runs
from .bpe import tokenizer_path
from .piece_ids import BATCH_DOCS, piece_ids
from .shared import shared_dir, shuffle_partitions, trim_memory

FILE = [T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
#: Writer settings: 32 MB row groups, 64 KB pages of at most 500 rows, dictionary first, version 2 pages (delta otherwise).
WRITER = {"parquet.block.size": 32 << 20, "parquet.page.size": 64 << 10, "parquet.page.row.count.limit": 500, "parquet.dictionary.page.size": 1 << 20, "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def _encoder(path: str, end: np.ndarray):
    """(a function from a batch's texts to (first row, row after the last one, ids of each text and ``end``, offsets of the rows), part by part; what to call at a task's end)."""
    if byte_runs.fits(path):
        return partial(byte_runs.byte_runs(path).encode, end=end), partial(trim_memory, byte_runs.byte_runs)
    tok, tail = piece_ids(path), end.tobytes()

    def encode(texts):
        for lo in range(0, len(texts), BATCH_DOCS):
            got = [x + tail for x in tok.encode(texts.slice(lo, BATCH_DOCS).to_pylist())]
            yield lo, lo + len(got), np.frombuffer(b"".join(got), np.int32), np.cumsum([0, *[len(x) // 4 for x in got]])

    return encode, tok.rest


def _encode(path: str, text: str, carry: list[str], end: list[int]):
    tail = np.array(end, np.uint32).astype(np.int32)

    def run(batches):
        (encode, rest), part, before = _encoder(path, tail), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, flat, off in encode(b[text]):
                rows = b.slice(lo, hi - lo)
                ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in carry], pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + off[:-1]), pa.array(np.diff(off)), ids], names=[*carry, *[f.name for f in FILE]])
                before += int(off[-1])
        rest()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: tuple[int, ...] = (0,), carry: list[str] | None = None) -> None:
    """Encode ``docs`` by the tokenizer file at ``tokenizer``, append the ids ``end`` to each, and write the token files to ``path``."""
    spark = docs.sparkSession
    names = {f.name for f in FILE}
    carry = [key, *[c for c in (carry if carry is not None else docs.columns) if c not in names and c not in (key, text)]]
    rows = docs.select(*[F.col(f"`{c}`") for c in [*carry, text]]).repartitionByRange(shuffle_partitions(spark), key).sortWithinPartitions(key, text)
    out = rows.mapInArrow(_encode(tokenizer, text, carry, list(end)), T.StructType([docs.schema[c] for c in carry] + FILE))
    w = out.write.mode("overwrite")
    for k, v in WRITER.items():
        w = w.option(k, v)
    w.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before. ``ids=False`` reads no ids."""
    rows = spark.read.parquet(path)
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))  # one row a file
    rows = rows.join(F.broadcast(before), F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("part_start")).drop("_part", "_before")
    return rows if ids else rows.drop("ids")


def with_crc(rows: DataFrame, keep: list[str], name: str = "ids_crc32") -> DataFrame:
    """``keep``'s columns and the unsigned CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for b in batches:
            col = b["ids"]
            values, off = col.values.to_numpy(), col.offsets.to_numpy()
            crc = [zlib.crc32(values[x:y].astype("<u4", copy=False).tobytes()) for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(crc, pa.int64())], names=[*keep, name])

    return rows.select(*keep, "ids").mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(name, T.LongType())]))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark).rstrip('/')}/tideloom/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return with_crc(read_tokens(spark, path), ["doc_id", "start", "n_tokens"])
