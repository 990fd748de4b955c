"""The byte-level encoder by columns against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tideloom.llm import bpe, byte_runs

BYTE, WORD = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("word_bpe_49k.json")
END = np.array([0, 7], np.int32)
BITS = ["a", "b", "s", "S", " ", " ", "\n", "\t", "'", "'s", "'ll", "1", "²", "é", "à", "\xa0", "\x85", " ", "　", " ", " ", "…", "“", "あ", "<|endoftext|>", "<|", "|>", ".", "!", "\x1c", "\x00", "🎉", "Ⅷ", "٣", "\r", "́"]


def ids(enc: byte_runs.ByteRuns, texts: list) -> list[list[int]]:
    out = []
    for lo, hi, flat, off in enc.encode(pa.array(texts, pa.string()), END):
        assert lo == len(out) and len(off) == hi - lo + 1
        out += [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    return out


@pytest.mark.parametrize("limit, part", [(600_000, 8 << 20), (50, 300)])
def test_equals_library(monkeypatch, limit, part):
    """Any mix of white space, contractions, scripts and special tokens, also across texts, with a table and slices that are too small."""
    monkeypatch.setattr(byte_runs, "LIMIT", limit)
    monkeypatch.setattr(byte_runs, "SLICE", part)
    rng, enc = random.Random(3), byte_runs.ByteRuns(BYTE)
    texts = ["<|endof", "text|>", None, "", " ", "a ", " b", "x \n<|endoftext|>  y", "\n", "\nx", "don't 'S " + "a" * 900]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert ids(enc, texts) == [[*enc.tok.encode(t or "", add_special_tokens=False).ids, 0, 7] for t in texts]
    assert ids(enc, []) == [] and ids(enc, [None]) == [[0, 7]]


def test_asks_once(monkeypatch):
    """A piece that recurs, in one slice or in a later one, is given to the library once."""
    enc, asked = byte_runs.ByteRuns(BYTE), []
    ask = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda texts: asked.append(sum(map(len, texts))) or ask(texts))
    texts = ["the same words, again: 1234 times\n" * 400] * 50
    assert ids(enc, texts) == ids(enc, texts) and sum(asked) < 100
    assert not byte_runs.fits(WORD) and byte_runs.fits(BYTE)


def test_table_is_bounded(monkeypatch):
    """Neither long texts without a space nor many distinct pieces stay in the table."""
    monkeypatch.setattr(byte_runs, "LIMIT", 200)
    monkeypatch.setattr(byte_runs, "SLICE", 4000)
    enc = byte_runs.ByteRuns(BYTE)
    texts = [chr(0x4E00 + i) * 5000 for i in range(8)] + [f"w{i}é" for i in range(5000)]
    assert ids(enc, texts) == [[*enc.tok.encode(t, add_special_tokens=False).ids, 0, 7] for t in texts]
    assert len(enc.known) <= 200 and enc.known.nbytes + enc.flat.nbytes < 200 * 100
