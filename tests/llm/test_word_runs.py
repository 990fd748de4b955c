"""Ids worked out by columns are the library's, whatever stands side by side, and recurring pieces are asked once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tideloom.llm import byte_runs
from tideloom.llm.bpe import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
BITS = ["a", "Z", "the", "The", "1", "23", "'", "'s", "'S", "''re", "'LL", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "\x00", "\x7f", ".", "--", "é", "É", "H̱",
        "ẖ", "̱", "İ", "Σ", "ΑΣ", "ß", "K", "ſ", "٣", "中文", "🙂", "﻿", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "|"]


@pytest.fixture
def runs():
    return byte_runs.WordRuns(PATH)


def check(runs, texts):
    want = [e.ids + [0] for e in runs.words.tok.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]
    got = []
    for lo, hi, flat, off in runs.encode(pa.array(texts, pa.string()), np.array([0], np.int32)):
        assert lo == len(got)
        got += [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
        assert len(got) == hi
    for t, g, w in zip(texts, got, want, strict=True):
        assert g == w, repr(t)


@pytest.mark.parametrize("small", [False, True])
def test_random_mixes(runs, monkeypatch, small):
    if small:
        monkeypatch.setattr(byte_runs, "SLICE", 300)
        monkeypatch.setattr(byte_runs, "LIMIT", 40)
    rng = random.Random(6)
    check(runs, [None, "", " ", "\n\n", "\xa0", "x" * 300, *BITS, *("".join(rng.choices(BITS, k=rng.randint(1, 9))) for _ in range(4000)), None])
    check(runs, ["", None, " "])
    check(runs, [])


def test_pieces_are_asked_once(runs, monkeypatch):
    asked = []
    spell = runs.words.spell
    monkeypatch.setattr(runs.words, "spell", lambda words: asked.extend(words) or spell(words))
    check(runs, ["Some words, some WORDS. 12"] * 50)
    check(runs, ["words some"])
    assert sorted(asked) == [",", ".", "1", "2", "some", "words"]
