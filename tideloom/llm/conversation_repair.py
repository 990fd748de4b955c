"""Conversation structure repair: cheapest edits by Dial's bucket queue, told apart by a lexicographic walk of tight arcs.

A conversation is a chain of rows; its graph has a node for each (rows done, state of the role grammar ``(s?(ua)+)?``) and an arc for
each edit: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty turn 5; an undeleted truncated row adds 5. Distances to the
end come from Dial's algorithm over the reversed arcs (costs are at most 6, so nodes wait in buckets by distance). The audit is then
walked from the start: of the arcs that are tight, the one with the least letter, D < I < K < R. A letter fixes the next node, as each
state admits just one of user and assistant. Rows that must go (blank, duplicate) aren't nodes: their D comes first whenever they are
reached, as an insertion can always wait until after them.

Rows are range-partitioned by (conversation, turn, role, text digest) and sorted, so a task streams whole conversations and repairs them as they
come. A conversation that a range cuts, or that is longer than a piece (``PIECE_ROWS``, ``PIECE_BYTES``), is repaired by pieces: min-plus matrices of the
pieces (Dial from each state of the end) are applied from the back, entries from the front, pieces are walked in parallel, and one task
streams the repaired text into SHA-256, which is sequential by definition, holding one piece at a time. So no task holds a whole hot conversation's rows;
what is bounded is the audit itself, a column value of a byte a row.

Defined results: a null turn comes first and has no part in the gaps; null role or text is one space, and in the damage's key a null id or turn
is one space too; rows of one turn go by role, then by the text's MD5; identical rows follow each other; a null conv_id is one
conversation; an empty or unknown role fits nowhere, so it is reroled or deleted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

PIECE_ROWS, PIECE_BYTES = 8192, 4 << 20
#: Next state of the role grammar by role initial, and the costs. States: 0 nothing, 1 system, 2 user, 3 assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FULL = {"u": "user", "a": "assistant"}
GOAL = (0, 3)
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60

FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_WS = r"' \t\n\u000B\u000C\r'"


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults: _conv, _turn, _role, _text and _m, how many copies of the row stay (0, 1 or 2)."""
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(key), F.lit(":"), text_of(turn))) % 20
    return rows.select(
        F.col(f"`{key}`").alias("_conv"), F.col(f"`{turn}`").cast("long").alias("_turn"),
        F.when(kind == 4, F.lit("user")).otherwise(text_of(role)).alias("_role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text_of(text), ".!?", "")).otherwise(text_of(text)).alias("_text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_m"),
    )


def plain(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{key}`").alias("_conv"), F.col(f"`{turn}`").cast("long").alias("_turn"), text_of(role).alias("_role"), text_of(text).alias("_text"), F.lit(1).alias("_m"))


def _fault() -> Column:
    """1 blank, 2 truncated, 0 neither."""
    end = F.expr(f"substring(trim(TRAILING {_WS} FROM _text), -1, 1)")
    return F.when(end == "", 1).when(end.isin(".", "!", "?"), 0).otherwise(2).cast("tinyint")


class Chain:
    """The rows of a conversation or of a piece of one, as a graph. ``seen``: (role, digest) of rows before it."""

    def __init__(self, turns, roles, digests, faults, copies, seen=frozenset()):
        self.initial, self.extra, self.at, self.gone = [], [], [], [0]  # of rows that may stay: initial, cost of staying, place; forced deletions before each and at the end
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        known, last, ends, times, distinct = set(seen), None, None, [], 0
        for i, (t, r, d, f, m) in enumerate(zip(turns, roles, digests, faults, copies)):
            if not m:
                continue
            c = r[:1]
            if last is None:
                ends = c
            else:
                self.illegal += last + c not in LEGAL
            self.illegal += (m - 1) * (c + c not in LEGAL)
            last = c
            if t is not None:
                distinct += not times or times[1] != t
                times = [times[0], t] if times else [t, t]
            if f == 1:
                self.blank += m
                self.gone[-1] += m
                continue
            if (r, d) in known:
                self.duplicate += m
                self.gone[-1] += m
                continue
            known.add((r, d))
            self.duplicate += m - 1
            self.truncated += f == 2
            self.initial.append(c)
            self.extra.append(TRUNCATED if f == 2 else 0)
            self.at.append(i)
            self.gone.append(m - 1)
        self.first, self.last, self.times, self.distinct = ends, last, times, distinct

    def forced(self) -> int:
        return DELETE * sum(self.gone)

    def arcs(self, i: int, q: int):
        """(letter, cost, next row, next state) in the order of the letters."""
        inside = i < len(self.initial)
        if inside:
            yield "D", DELETE, i + 1, q
        for to in {v for c, v in NEXT[q].items() if c in FULL}:
            yield "I", INSERT, i, to
        if inside:
            if self.initial[i] in NEXT[q]:
                yield "K", self.extra[i], i + 1, NEXT[q][self.initial[i]]
            for to in {v for c, v in NEXT[q].items() if c in FULL}:
                yield "R", REROLE + self.extra[i], i + 1, to

    def distances(self, end) -> list[int]:
        """Distance of node 4 i + q to the end, where state q has ``end[q]`` left; Dial's buckets over the reversed arcs."""
        n = len(self.initial)
        back = [[] for _ in range(4 * n + 4)]
        for i in range(n + 1):
            for q in range(4):
                for _, cost, j, to in self.arcs(i, q):
                    back[4 * j + to].append((cost, 4 * i + q))
        dist = [FAR] * (4 * n + 4)
        base = min(end)
        buckets: list[list[int]] = []

        def put(node: int, d: int) -> None:
            if d < dist[node]:
                dist[node] = d
                while len(buckets) <= d - base:
                    buckets.append([])
                buckets[d - base].append(node)

        for q in range(4):
            if end[q] < FAR:
                put(4 * n + q, end[q])
        k = 0
        while k < len(buckets):
            for node in buckets[k]:  # arcs without cost put nodes into the bucket that is being read
                if dist[node] == base + k:
                    for cost, before in back[node]:
                        put(before, base + k + cost)
            buckets[k] = []
            k += 1
        return dist

    def matrix(self) -> list[int]:
        """Cost from each state before to each state after, by rows; forced deletions are counted apart."""
        columns = [self.distances([0 if q == to else FAR for q in range(4)])[:4] for to in range(4)]
        return [columns[to][q] for q in range(4) for to in range(4)]

    def walk(self, end, q: int = 0, last: bool = True):
        """((letter, place or None, role initial or None) of each edit, state after it all). Only the ``last`` piece inserts after its rows."""
        dist, i, n, out = self.distances(end), 0, len(self.initial), []
        out += [("D", None, None)] * self.gone[0]
        while i < n or (last and dist[4 * i + q] > end[q]):
            here = dist[4 * i + q]
            letter, j, to = next((a, j, to) for a, cost, j, to in self.arcs(i, q) if cost + dist[4 * j + to] == here)
            out.append((letter, self.at[i] if letter in "KR" else None, " sua"[to] if letter in "IR" else None))
            if j > i:
                out += [("D", None, None)] * self.gone[j]
            i, q = j, to
        return out, q


def repaired_lines(edits, roles, texts) -> list[str]:
    out = []
    for letter, at, c in edits:
        if letter == "K":
            out.append(f"{roles[at]}:{texts[at]}")
        elif letter == "R":
            out.append(f"{FULL[c]}:{texts[at]}")
        elif letter == "I":
            out.append(f"{FULL[c]}:")
    return out


def _goal() -> list[int]:
    return [0 if q in GOAL else FAR for q in range(4)]


def _gaps(times, distinct: int) -> int:
    return times[1] - times[0] + 1 - distinct if times else 0


def _columns(batch: pa.RecordBatch, names) -> list[list]:
    return [batch[c].to_pylist() for c in names]


_ROW = ["_turn", "_role", "_digest", "_fault", "_m", "_text"]
_PIECE = "_seg int, _no int, _turns array<bigint>, _roles array<string>, _digests array<binary>, _faults array<tinyint>, _copies array<int>, _texts array<string>"


def _streamed(out: pa.Schema, piece_rows: int):
    """Sorted rows to finished conversations, and to pieces of those that may go on in another range or are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId()
        held: dict[str, list] = {c: [] for c in _ROW}
        ready: list[tuple] = []
        now, begun, size, no, whole = None, False, 0, 0, False  # whole: the conversation began inside this range and has no piece yet

        def piece() -> tuple:
            nonlocal no, size, whole
            row = (now, *[None] * 8, seg, no, *[list(held[c]) for c in _ROW])
            for c in _ROW:
                held[c].clear()
            no, size, whole = no + 1, 0, False
            return row

        def finish(ended: bool) -> None:
            if not (ended and whole):
                ready.append(piece())
                return
            chain = Chain(*[held[c] for c in _ROW[:5]])
            edits, _ = chain.walk(_goal())
            text = "\n".join(repaired_lines(edits, held["_role"], held["_text"]))
            cost = chain.forced() + chain.distances(_goal())[0]
            ready.append((now, _gaps(chain.times, chain.distinct), chain.blank, chain.duplicate, chain.truncated, chain.illegal, cost, "".join(e[0] for e in edits), hashlib.sha256(text.encode()).hexdigest(), *[None] * 8))
            for c in _ROW:
                held[c].clear()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], f.type) for i, f in enumerate(out)], schema=out)
            ready.clear()
            return got

        for b in batches:
            for conv_id, *row in zip(*_columns(b, ["_conv", *_ROW])):
                if not begun or conv_id != now:
                    if begun:
                        finish(True)
                    now, whole, size = conv_id, begun, 0
                    begun = True
                elif len(held["_m"]) >= piece_rows or size >= PIECE_BYTES:
                    ready.append(piece())
                for c, v in zip(_ROW, row):
                    held[c].append(v)
                size += len(row[-1])
                if len(ready) >= 4096 or (ready and ready[-1][0] == now and ready[-1][-1] is not None):
                    yield flush()
        if begun:
            finish(False)
            yield flush()

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece is worth without its texts."""
    names = ["_turns", "_roles", "_digests", "_faults", "_copies", "_seen"]
    for b in batches:
        rows = []
        for conv, seg, no, *row, seen in zip(*_columns(b, ["_conv", "_seg", "_no", *names])):
            c = Chain(*row, seen=_seen(seen))
            rows.append((conv, seg, no, c.matrix(), c.forced(), c.blank, c.duplicate, c.truncated, c.illegal, c.first, c.last, *(c.times or (0, 0)), c.distinct))
        types = [b.schema.field("_conv").type, pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[n.split()[0] for n in _MEASURED.format("x").split(", ")])


_MEASURED = "_conv {}, _seg int, _no int, _matrix array<bigint>, _forced long, blank long, duplicate long, truncated long, illegal long, _first string, _last string, _from long, _to long, _distinct long"
_PLANNED = "_seg int, _no int, _end array<bigint>, _is_last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _seen(keys) -> frozenset:
    return frozenset((k["r"], k["d"]) for k in keys or ())


def _planned(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is left after each piece of one conversation, by state; the conversation's counts stand with every piece."""
    pdf = pdf.sort_values(["_seg", "_no"], ignore_index=True)
    left, ends = _goal(), []
    for m in reversed(pdf["_matrix"].tolist()):
        ends.append(left)
        left = [min(int(m[4 * q + to]) + left[to] for to in range(4)) for q in range(4)]
        left = [min(x, FAR) for x in left]
    ends.reverse()
    illegal, gone, prev, low, high, distinct = int(pdf["illegal"].sum()), int(pdf["_forced"].sum()), None, None, None, 0
    for f, la, a, z, n in zip(*[pdf[c].tolist() for c in ("_first", "_last", "_from", "_to", "_distinct")]):
        if f is not None:
            illegal += prev is not None and prev + f not in LEGAL
            prev = la
        if n:
            distinct += int(n) - (high is not None and high == a)
            low, high = a if low is None else low, z
    counts = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")}
    gaps = int(high) - int(low) + 1 - distinct if distinct else 0
    last = [*[False] * (len(pdf) - 1), True]
    return pdf[["_seg", "_no"]].assign(_end=ends, _is_last=last, gaps=gaps, **counts, illegal=illegal, cost=int(left[0]) + gone)[[n.split()[0] for n in _PLANNED.split(", ")]]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State after a piece for each state before it (-1 where the end can't be reached)."""
    for b in batches:
        seg, no, out = b["_seg"], b["_no"], []
        for *row, seen, end, last in zip(*_columns(b, ["_turns", "_roles", "_digests", "_faults", "_copies", "_seen", "_end", "_is_last"])):
            c = Chain(*row, seen=_seen(seen))
            dist = c.distances(end)
            out.append([c.walk(end, q, last)[1] if dist[q] < FAR else -1 for q in range(4)])
        yield pa.RecordBatch.from_arrays([b["_conv"], seg, no, pa.array(out, pa.list_(pa.int32()))], names=["_conv", "_seg", "_no", "_exits"])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_seg", "_no"], ignore_index=True)
    q, out = 0, []
    for e in pdf["_exits"]:
        out.append(q)
        q = int(e[q])
    return pdf[["_seg", "_no"]].assign(_entry=pd.array(out, "int32"))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's part of the audit and of the repaired text."""
    for b in batches:
        for k, (*row, seen, end, last, entry, texts) in enumerate(zip(*_columns(b, ["_turns", "_roles", "_digests", "_faults", "_copies", "_seen", "_end", "_is_last", "_entry", "_texts"]))):
            edits, _ = Chain(*row, seen=_seen(seen)).walk(end, entry, last)
            lines = repaired_lines(edits, row[1], texts)
            one = b.slice(k, 1)
            yield pa.RecordBatch.from_arrays(
                [*[one[c] for c in ("_conv", "_seg", "_no", *NAMES[:6])], pa.array(["".join(e[0] for e in edits)]), pa.array(["\n".join(lines) if lines else None], pa.string())],
                names=["_conv", "_seg", "_no", *NAMES[:6], "_audit", "_lines"])


def _joined(out: pa.Schema):
    """Pieces in order to one row a conversation; the text goes through the digest a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audit, some, counts = None, None, [], False, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, *counts, "".join(audit), digest.hexdigest()), out)], schema=out)

        for b in batches:
            for conv, *got, part, lines in zip(*_columns(b, ["_conv", *NAMES[:6], "_audit", "_lines"])):
                if digest is None or conv != now:
                    if digest is not None:
                        yield row()
                    now, digest, audit, some, counts = conv, hashlib.sha256(), [], False, got
                audit.append(part)
                if lines is not None:
                    digest.update((("\n" if some else "") + lines).encode())
                    some = True
        if digest is not None:
            yield row()

    return run


def _arrow(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)


def repair(rows: DataFrame, partitions: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation of ``rows`` (``damaged`` or ``plain``): _conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["_conv"]
    d = rows.withColumn("_fault", _fault()).withColumn("_digest", F.unhex(F.md5("_text"))).withColumn("_k", F.monotonically_increasing_id())
    # _k parts rows that are alike in all else, so a run of them is no single range
    order = ["_conv", "_turn", "_role", "_digest", "_k"]
    ranged = d.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    fields = f"_conv {kind}, {FOUND}, {_PIECE}"
    shape = _arrow(spark.createDataFrame([], fields))
    names = ["_conv", *NAMES, "_seg", "_no", "_turns", "_roles", "_digests", "_faults", "_copies", "_texts"]
    made = materialize(ranged.select("_conv", *_ROW).mapInArrow(_streamed(shape, piece_rows), fields).select(*names), "conversations")
    done = made.where("_seg IS NULL").select("_conv", *NAMES)
    cut = made.where("_seg IS NOT NULL").drop(*NAMES)
    # rows of a piece whose role and text an earlier piece has: keys in more than one piece
    keys = cut.select("_conv", F.struct("_seg", "_no").alias("_p"), F.explode(F.expr("filter(transform(arrays_zip(_roles, _digests, _copies), x -> CASE WHEN x._copies > 0 THEN struct(x._roles AS r, x._digests AS d) END), x -> x IS NOT NULL)")).alias("_key")).distinct()
    firsts = keys.groupBy(F.col("_conv").alias("_c"), F.col("_key").alias("_f")).agg(F.min("_p").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    seen = keys.join(firsts, F.expr("_conv <=> _c AND _key = _f AND _p > _least")).groupBy("_p").agg(F.collect_list("_key").alias("_seen"))
    known = materialize(cut.join(seen.select("_p._seg", "_p._no", "_seen"), ["_seg", "_no"], "left"), "pieces")
    measured = known.drop("_texts").mapInArrow(_measured, _MEASURED.format(kind))
    planned = measured.groupBy("_conv").applyInPandas(_planned, _PLANNED)
    planned = materialize(known.join(planned, ["_seg", "_no"]), "planned")
    exits = planned.select("_conv", "_seg", "_no", "_turns", "_roles", "_digests", "_faults", "_copies", "_seen", "_end", "_is_last").mapInArrow(_exits, f"_conv {kind}, _seg int, _no int, _exits array<int>")
    entries = exits.groupBy("_conv").applyInPandas(_entries, "_seg int, _no int, _entry int")
    walked = planned.join(entries, ["_seg", "_no"]).mapInArrow(_walked, f"_conv {kind}, _seg int, _no int, {', '.join(FOUND.split(', ')[:6])}, _audit string, _lines string")
    flat = walked.repartition("_conv").sortWithinPartitions("_conv", "_seg", "_no")
    result = f"_conv {kind}, {FOUND}"
    return done.unionByName(flat.mapInArrow(_joined(_arrow(spark.createDataFrame([], result))), result))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows)).withColumnRenamed("_conv", "conv_id")
