"""Vectorised hashing of the words of whole Arrow text columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 never puts those bytes inside another character. A word's
hash is a polynomial over its bytes modulo 2**64 (Rabin-Karp, from prefix sums), finished by a 64-bit mixer. All work
is done on slices of bounded size, so memory follows the slice (about 30 bytes a byte of text) or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 256 << 10
_rng = np.random.Generator(np.random.PCG64(977))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _ROLL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a slice's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= SLICE_BYTES + 1:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most ``max_bytes``, or one longer row. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    ws = _WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    word = ~ws
    first = word.copy()
    first[1:] &= ws[:-1] | edge[1:-1]
    last = word
    last[:-1] &= ws[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    v = _BYTE[_LOWER[data] if lower else data]
    v *= powers(_BASE, len(data))
    np.cumsum(v, out=sums[1:])
    h = sums[ends] - sums[starts]
    h *= powers(inverse(_BASE), len(data))[starts]
    return mix(h), np.searchsorted(starts, off)


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``width`` words inside one text, its first word's index), by a rolling polynomial over word hashes."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * powers(_ROLL, n), out=sums[1:])
    w = sums[width:] - sums[:-width]
    w *= powers(inverse(_ROLL), n)[: len(w)]
    ends = np.repeat(first[1:], np.diff(first))[: len(w)]
    at = np.flatnonzero(np.arange(width, n + 1) <= ends)
    return mix(w[at]), at


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending 64-bit values as gaps of as many whole bytes as the largest gap needs."""
    if not len(h):
        return b"\x08"
    gaps = np.diff(h, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def cut_points(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the 64-bit space starts in ascending ``h``, with its length at the end."""
    edges = np.array([((k << 64) + parts - 1) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
