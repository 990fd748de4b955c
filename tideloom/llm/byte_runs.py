"""Token ids of a column of texts, worked out by columns: each distinct piece of a slice is encoded once. For byte-level tokenizer files:

Pieces are cut in the column's own bytes where no token crosses: before white space, behind it, and where letters, digits and other
ASCII characters change. A place where the file's pattern could decide otherwise (a contraction, white space or letters beyond ASCII) isn't
cut; such a piece is longer, its ids are the same. Arrow finds a slice's distinct pieces. They are joined by line feeds, which the
pattern keeps apart from what follows, and go through the library's whole pipeline in strings of some tens of KB; the ids are
split at the line feed's and laid out by the pieces' places. Pieces with more white space than one space in front, or with a special token's
literal, are encoded as they are. A bounded table, itself of Arrow and numpy arrays, keeps pieces for the next slices; when it is full, those
met last stay. So memory is bounded by the slice and the table.

For files that drop white space and lower-case (``WordRuns``) texts are cut at ASCII white space. A run of ASCII alone is lower-cased and cut
into pre-tokens, whose ids come from the library's model. Runs with other characters, which may compose or hold white space, with a
contraction or with a special token's literal are pieces as they are, and ``piece_ids`` encodes those that the table lacks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import SPACE
from .piece_ids import PieceIds
from .shared import kept, trim_memory

SLICE, CHUNK = 8 << 20, 1000  # bytes of texts worked on at once (one text at least), pieces in one string
LIMIT, LONG = 600_000, 64  # pieces whose ids are kept from slice to slice, about 60 bytes each; the most bytes of such a piece
LETTER, DIGIT, OTHER, WHITE, WIDE = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[*range(9, 14), 32]] = WHITE
CLASS[128:] = WIDE
#: Whether a byte's class and the next one's are cut apart, whatever else stands there.
APART = np.zeros((5, 5), bool)
for _a, _b in ((LETTER, DIGIT), (LETTER, OTHER), (DIGIT, LETTER), (DIGIT, OTHER), (OTHER, LETTER), (OTHER, DIGIT), (LETTER, WHITE), (DIGIT, WHITE), (OTHER, WHITE)):
    APART[_a, _b] = True
APART = APART.reshape(-1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that may start a white-space character beyond ASCII; its last byte, with the byte before.
STARTS, LASTS, BEFORE = (np.isin(np.arange(256), x) for x in ((0xC2, 0xE1, 0xE2, 0xE3), (0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F), (0xC2, 0x9A, 0x80, 0x81)))


def bounds(data: np.ndarray, starts: np.ndarray, marks: list[tuple[int, int]]) -> np.ndarray:
    """Places at which pieces start, and the end. ``starts``: where the texts start, and the end; ``marks``: from where to where special tokens stand."""
    n = len(data)
    kind = CLASS[data]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = APART[kind[:-1] * 5 + kind[1:]]
    after = np.flatnonzero(data[:-1] == 39) + 1
    cut[after[kind[after] == LETTER]] = False  # a contraction may start before
    cut[starts] = True
    white = np.flatnonzero(kind == WHITE)
    # where the text surely goes on with something that isn't white space
    head = np.zeros(n + 1, bool)
    head[:n] = (kind != WHITE) & ~STARTS[data]
    head[starts] = False
    head[[a for a, _ in marks]] = False
    before = kind[np.maximum(white - 1, 0)]
    wide = white[before == WIDE]
    cut[wide[~(LASTS[data[wide - 1]] & BEFORE[data[wide - 2]])]] = True
    # the last of a run before a word is a piece of its own, or the word's space
    last = white[head[white + 1] & (cut[white] | (before == WHITE))]
    cut[last] = True
    cut[last[data[last] != 32] + 1] = True
    for a, b in marks:
        cut[a + 1 : b] = False
    cut[starts] = True
    return np.flatnonzero(cut)


@cache
def fits(path: str) -> bool:
    """Whether the file is one that this module reads: byte-level by the usual pattern, no normaliser, special tokens that take in no white space."""
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec["pre_tokenizer"] or {}
    plain = all(not (t["single_word"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in spec.get("added_tokens", []))
    return plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)


class ByteRuns:
    part = 1  # a slice has SLICE / part bytes

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        if not fits(path):
            raise ValueError("unknown kind of tokenizer file")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.marks = re.compile("|".join(re.escape(m) for m in special).encode()) if special else None
        self.space = re.compile(f"[{SPACE}]")
        (self.feed,) = self.tok.encode("\n", add_special_tokens=False).ids
        self._empty()

    def _empty(self) -> None:
        # the table: pieces, all their ids, the place of each piece's first one, their number, the slice that met it last
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.first, self.n, self.met, self.tick = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _marks(self, data) -> list[tuple[int, int]]:
        return [m.span() for m in self.marks.finditer(data)] if self.marks else []

    def _alone(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces can't stand between line feeds."""
        off, data = _parts(pieces)
        at, kind = off[:-1], CLASS[data]
        inner = kind == WHITE
        inner[at[(data[at] == 32) & (np.diff(off) > 1)]] = False
        odd = np.add.reduceat(inner, at, dtype=np.int64) > 0
        spot = np.flatnonzero(LASTS[data[1:]] & BEFORE[data[:-1]]) + 1  # maybe white space beyond ASCII
        maybe = np.unique(np.searchsorted(off, spot, "right") - 1)
        odd[[i for i in maybe.tolist() if self.space.search(pieces[i].as_py().removeprefix(" "))]] = True
        odd[[int(np.searchsorted(off, a, "right")) - 1 for a, _ in self._marks(data)]] = True
        return odd

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each piece's first one, their number)."""
        odd = self._alone(pieces)
        plain = pieces.filter(pa.array(~odd))
        first, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        off = np.append(np.arange(0, len(plain), CHUNK), len(plain)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(off), plain), "\n").to_pylist()
        ids = [np.array([*x, self.feed], np.int32) for x in self._ids(joined)]
        alone = [np.array(x, np.int32) for x in self._ids(pieces.filter(pa.array(odd)).to_pylist())]
        flat = np.concatenate([*ids, *alone, np.zeros(0, np.int32)])
        size = sum(map(len, ids))
        feeds = np.flatnonzero(flat[:size] == self.feed)
        if len(feeds) != len(plain):
            raise ValueError("a piece was split or lost")
        starts = np.append(0, feeds + 1)[: len(feeds)]
        first[~odd], n[~odd] = starts, feeds - starts
        n[odd] = [*map(len, alone)]
        first[odd] = size + np.cumsum(n[odd]) - n[odd]
        return flat, first, n

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the table, which learns what it lacks."""
        at = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().astype(np.int64)
        new = at < 0
        if new.any():
            learn = pieces.filter(pa.array(new))
            flat, first, n = self._encode(learn)
            at[new] = len(self.known) + np.arange(len(learn))
            self.known = pa.concat_arrays([self.known, learn])
            self.first, self.n = np.append(self.first, first + len(self.flat)), np.append(self.n, n)
            self.flat, self.met = np.append(self.flat, flat), np.append(self.met, np.zeros(len(learn), np.int64))
        self.tick += 1
        self.met[at] = self.tick
        return at

    def _prune(self) -> None:
        """Long pieces (a text without spaces may be one) aren't kept; of too many, those met last are."""
        keep = np.flatnonzero(pc.binary_length(self.known).to_numpy() <= LONG)
        if len(keep) > LIMIT:
            keep = np.sort(keep[np.argpartition(-self.met[keep], LIMIT // 2)[: LIMIT // 2]])
        if len(keep) < len(self.known):
            self.known, self.met = self.known.take(pa.array(keep)), self.met[keep]
            self.flat, self.n = _gather(self.flat, self.first[keep], self.n[keep]), self.n[keep]
            self.first = np.cumsum(self.n) - self.n

    def encode(self, texts: pa.Array, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last one, ids of each text and ``end`` behind them, offsets of the rows), slice by slice. Null: the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        off, _ = _parts(texts)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE // self.part, "right")) - 1)
            yield lo, hi, *self._slice(texts.slice(lo, hi - lo), end)
            lo = hi

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Pieces in order; how many stand before each of ``starts``."""
        cuts = bounds(data, starts, self._marks(data))
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)), np.searchsorted(cuts, starts)

    def rest(self) -> None:
        """A task has ended: its worker process keeps the table for the operator's next one."""
        trim_memory(column_runs)

    def _slice(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, data = _parts(texts)
        ids, before = np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        if len(data):
            pieces, row = self._pieces(data, starts)
            pieces = pieces.dictionary_encode()
            at = self._find(pieces.dictionary)[pieces.indices.to_numpy()]
            n = self.n[at]
            ids = _gather(self.flat, self.first[at], n)
            before = np.append(0, np.cumsum(n))[row]
            self._prune()
        ids = np.insert(ids, np.repeat(before[1:], len(end)), np.tile(end, len(texts)))
        return ids, before + np.arange(len(before)) * len(end)


def _whole(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes whose run isn't cut: beyond ASCII, or where a contraction or a special token may start. Strings start at ``starts``."""
    out = np.zeros(len(data), bool)
    out[:-1] = (data[:-1] == 39) & (CLASS[data[1:]] == LETTER) | (data[:-1] == 60) & (data[1:] == 124)
    out[starts[starts > 0] - 1] = False  # the next byte is another string's
    out |= data >= 128
    return out


class WordRuns(ByteRuns):
    part = 2

    def __init__(self, path: str):
        self.words = PieceIds(path)
        spec = json.load(open(path, encoding="utf-8"))
        if not self.words.drops or any(t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
            raise ValueError("unknown kind of tokenizer file")
        self._empty()

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        kind = CLASS[data]
        word = kind != WHITE
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = starts[starts < len(data)]
        first[at] = word[at]
        places = np.flatnonzero(first)
        if len(places):
            plain = np.zeros(len(data), bool)
            plain[places[0] :] = np.repeat(~np.logical_or.reduceat(_whole(data, starts), places), np.diff(places, append=len(data)))
            first[1:] |= plain[1:] & word[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
            data = np.where(plain, LOWER[data], data)
            places = np.flatnonzero(first)
        rank = np.zeros(len(data) + 1, np.int32)  # bytes that aren't white space before each place
        np.cumsum(word, dtype=np.int32, out=rank[1:])
        off = rank[np.append(places, len(data))]
        return pa.StringArray.from_buffers(len(places), pa.py_buffer(off), pa.py_buffer(data[word])), np.searchsorted(places, starts)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        off, data = _parts(pieces)
        odd = np.logical_or.reduceat(_whole(data, off), off[:-1])
        ids = self.words.spell(pieces.filter(pa.array(~odd)).to_pylist()) + self.words.learn(pieces.filter(pa.array(odd)).to_pylist())
        place = np.argsort(odd, kind="stable")  # the piece that each of ``ids`` belongs to
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, own = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        first[place], own[place] = np.cumsum(n) - n, n
        return np.frombuffer(b"".join(ids), np.int32), first, own

    def rest(self) -> None:
        self.words.old = {}
        super().rest()


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` values from each ``first`` on, one after another."""
    stop = np.cumsum(n)
    return flat[np.repeat(first - stop + n, n) + np.arange(n.sum())]


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes, of a string array without nulls."""
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return off - off[0], np.frombuffer(data or b"", np.uint8)[off[0] : off[-1]]


@kept
def byte_runs(path: str) -> ByteRuns:
    return ByteRuns(path)


@kept
def column_runs(path: str) -> ByteRuns:
    """By the kind of the file."""
    return ByteRuns(path) if fits(path) else WordRuns(path)
