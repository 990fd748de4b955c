"""Live feeds as a stream: a landing folder of recorded messages as a Python data source, and what the reconnect loop does with them.

A recorder (the socket side, not part of this library) writes one folder a connection, ``<path>/connection=<id>/segment=<n>/<name>.json``, with
a JSON object a line: ``venue, itype, raw, received_ts_ns, seq`` and ``event``. Files appear whole (written elsewhere, then renamed), and a later file's
segment and name sort after the earlier ones of its connection. The offset is the last name of each connection, so a query that is started again goes on from its
checkpoint; each file is a partition, so one busy connection is read by many tasks. Offsets list every connection, whose number is
that of sockets.
"""

from __future__ import annotations

import json
import time

import pyarrow as pa
import pyarrow.fs
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import backoff_ms

SCHEMA = "connection string, venue string, itype string, raw string, received_ts_ns long, seq long, event string"
_FIELDS = {"venue": pa.string(), "itype": pa.string(), "raw": pa.string(), "received_ts_ns": pa.int64(), "seq": pa.int64(), "event": pa.string()}
_OUT = pa.schema([("connection", pa.string()), *_FIELDS.items()])
SILENCE_MS, STABLE_MS, INITIAL_MS, MOST_MS = 90_000, 60_000, 1_000, 60_000


def _list(path: str) -> dict[str, list[str]]:
    """Names of the finished files of each connection, in order. Names that begin with a dot or an underscore are still being written."""
    fs, base = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    found: dict[str, list[str]] = {}
    for f in fs.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=True)):
        _, key, rest = f.path[len(base) :].rpartition("/connection=")
        connection, _, name = rest.partition("/")
        if f.is_file and key and name and not any(part[0] in "._" for part in name.split("/")):
            found.setdefault(connection, []).append(name)
    return {c: sorted(names) for c, names in found.items()}


class Landed(InputPartition):
    def __init__(self, connection: str, name: str):
        self.connection, self.name = connection, name


def read_messages(data: bytes) -> pa.Table:
    """The messages of one file. Lines that aren't JSON (a recorder that died while it wrote) are left out; unknown fields are ignored."""
    options = pa.json.ParseOptions(explicit_schema=pa.schema(_FIELDS.items()), unexpected_field_behavior="ignore")
    if not data.strip():
        return pa.schema(_FIELDS.items()).empty_table()
    try:
        return pa.json.read_json(pa.BufferReader(data), parse_options=options)
    except pa.ArrowInvalid:
        rows = []
        for line in data.splitlines():
            try:
                row = json.loads(line)
                rows.append({k: row.get(k) for k in _FIELDS})
            except (ValueError, AttributeError):
                continue
        return pa.Table.from_pylist(rows, schema=pa.schema(_FIELDS.items()))


def _read(path: str, part: Landed, initial_ms: int, most_ms: int, attempts: int, sleep=time.sleep):
    """A file's messages; a storage error is waited out by the feeds' backoff, and the last of ``attempts`` is raised."""
    for n in range(1, attempts + 1):
        try:
            fs, base = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
            with fs.open_input_file(f"{base}/connection={part.connection}/{part.name}") as f:
                table = read_messages(f.read())
            break
        except OSError:
            if n == attempts:
                raise
            sleep(backoff_ms(n, initial_ms, most_ms) / 1000)
    name = pa.array([part.connection] * table.num_rows, pa.string())
    yield from table.select(list(_FIELDS)).add_column(0, "connection", name).cast(_OUT).to_batches()


class _Files:
    def __init__(self, options):
        self.path = options["path"]
        self.wait = int(options.get("initialbackoffms", INITIAL_MS)), int(options.get("maxbackoffms", MOST_MS)), int(options.get("attempts", 5))

    def read(self, partition):
        return _read(self.path, partition, *self.wait)

    def files(self, start: dict, end: dict) -> list[Landed]:
        have = _list(self.path)
        return [Landed(c, n) for c in sorted(end) for n in have.get(c, []) if start.get(c, "") < n <= end[c]]


class LandingStream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {c: names[-1] for c, names in _list(self.path).items()}

    def partitions(self, start: dict, end: dict):
        return self.files(start, end)

    def commit(self, end: dict) -> None:  # files stay: they are the recorder's to remove
        pass


class LandingBatch(_Files, DataSourceReader):
    def partitions(self):
        return self.files({}, {c: names[-1] for c, names in _list(self.path).items()})


class FeedSource(DataSource):
    """``spark.readStream.format("tideloom_feed").load(path)``; options: initialBackoffMs, maxBackoffMs, attempts."""

    @classmethod
    def name(cls) -> str:
        return "tideloom_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return LandingStream(self.options)

    def reader(self, schema):
        return LandingBatch(self.options)


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("tideloom_feed").options(**options).load(path)


def batch(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.read.format("tideloom_feed").options(**options).load(path)


def record(messages: DataFrame, path: str, segment: int, files: int = 4) -> None:
    """Write messages as a recorder would, as the connections' segment number ``segment``: ranges of seq become files in order. ``messages``: the columns of the source but connection, which is
    made of venue and itype where it's missing; ``event`` defaults to message."""
    m = messages if "connection" in messages.columns else messages.withColumn("connection", F.concat_ws("-", "venue", "itype"))
    m = m if "event" in m.columns else m.withColumn("event", F.lit("message"))
    m = m.select("connection", F.lit(f"{segment:012d}").alias("segment"), *_FIELDS).repartitionByRange(files, "seq").sortWithinPartitions("connection", "seq")
    m.write.mode("append").partitionBy("connection", "segment").json(path)


def connection_sessions(log: DataFrame, silence_ms: int = SILENCE_MS, stable_ms: int = STABLE_MS, initial_ms: int = INITIAL_MS, most_ms: int = MOST_MS) -> DataFrame:
    """What the reconnect loop does over a log (connection, received_ts_ns, seq, event, raw): one row a session.

    A session ends at a ``close``, at a ``limited`` (raw: the server's retry-after in ms), or when nothing came for ``silence_ms``. The number of
    failures in a row starts anew after a session that lived over ``stable_ms`` and after a server's own wait; the wait before the next
    session is the backoff for that number, or the server's. The last session of a connection has no end yet: wait_ms is NULL.
    """
    key = Window.partitionBy("connection").orderBy("received_ts_ns", "seq")
    before = F.lag(F.struct("received_ts_ns", "event")).over(key)
    gap = F.col("received_ts_ns") - F.col("_before.received_ts_ns") > silence_ms * 1_000_000
    ends = ("close", "limited")
    d = log.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | gap | F.col("_before.event").isin(*ends), 1).otherwise(0))
    d = d.withColumn("session", F.sum("_new").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct("event", "raw"), F.struct("received_ts_ns", "seq"))
    s = d.groupBy("connection", "session").agg(F.min("received_ts_ns").alias("start_ns"), F.max("received_ts_ns").alias("last_ns"), F.count_if(F.col("event") == "message").alias("n_messages"), last.alias("_last"))
    by = Window.partitionBy("connection").orderBy("session")
    told = F.col("_last.event") == "limited"
    s = s.withColumn("ended_by", F.when(F.col("_last.event").isin(*ends), F.col("_last.event")).when(F.lead("session").over(by).isNotNull(), "silence"))
    lived = F.col("last_ns") - F.col("start_ns") + F.when(F.col("ended_by") == "silence", silence_ms * 1_000_000).otherwise(0)
    s = s.withColumn("_zero", F.when(told | (lived > stable_ms * 1_000_000), 1).otherwise(0))
    s = s.withColumn("_run", F.sum("_zero").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    retry = F.sum(1 - F.col("_zero")).over(Window.partitionBy("connection", "_run").orderBy("session").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("retry_count", F.when(F.col("ended_by").isNotNull(), retry))
    wait = F.when(told, F.expr("try_cast(_last.raw AS BIGINT)")).otherwise(F.least(F.lit(initial_ms) * F.pow(F.lit(2), F.least("retry_count", F.lit(10))), F.lit(most_ms)).cast("long"))
    return s.select("connection", "session", "start_ns", "last_ns", "n_messages", "ended_by", "retry_count", F.when(F.col("ended_by").isNotNull(), wait).alias("wait_ms"))
