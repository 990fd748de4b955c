"""What a worker process holds: one operator's tables, and a chunk's hashes few times over."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tideloom.llm import byte_runs, piece_ids, substring_dedup
from tideloom.llm.bpe import tokenizer_path
from tideloom.llm.shared import trim_memory
from tideloom.llm.wordhash import pack_sorted, unpack_sorted, window_hashes, word_hashes


def peak(run, *args):
    """(result, most bytes that it took at once)."""
    tracemalloc.start()
    out = run(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(5000)]
    return [" ".join(rng.choices(words, k=2000)) for _ in range(500)]


def test_the_next_operator_drops_tables():
    piece_ids.piece_ids(tokenizer_path("word_bpe_49k.json")).encode(["some words"])
    tok = piece_ids.piece_ids(tokenizer_path("word_bpe_49k.json"))
    tok.rest()
    assert tok is piece_ids.piece_ids(tokenizer_path("word_bpe_49k.json"))  # kept for the operator's next task
    byte_runs.byte_runs(tokenizer_path("byte_bpe_50k.json"))
    trim_memory(byte_runs.byte_runs)
    assert (piece_ids.piece_ids.cache_info().currsize, byte_runs.byte_runs.cache_info().currsize) == (0, 1)
    substring_dedup._send(20, [0], "text")(pa.table({"text": ["a b"], "_chunk": [0], "_order": [0]}))
    assert byte_runs.byte_runs.cache_info().currsize == 0


def test_a_chunk_is_hashed_in_bounded_memory(texts):
    table = pa.table({"text": texts, "_chunk": [0] * len(texts), "_order": [0] * len(texts)})
    send = substring_dedup._send(20, [7, 8, 9], "text")
    send(table.slice(0, 200))  # powers are kept
    sent, most = peak(send, table)
    windows = sum(len(t.split()) - 19 for t in texts)
    assert most < 8 * windows * 2.6 + (4 << 20)
    got = np.concatenate([unpack_sorted(b) for b in sent["_blob"].to_pylist()])
    want = np.unique(np.concatenate([window_hashes(*word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])), 20)[0] for t in texts]))
    assert sent["_bucket"].to_pylist() == [7, 8, 9] and (got == want).all()


def test_repeats_are_found_in_bounded_memory():
    rng = np.random.default_rng(4)
    found = [rng.integers(0, 300_000, 100_000).astype(np.uint64) for _ in range(5)]
    h = np.concatenate(found)
    distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    earlier = rng.random(len(distinct)) < 0.2
    got, most = peak(substring_dedup._repeated, found, earlier)
    assert (got == (earlier[inverse] | (where[inverse] != np.arange(len(h))))).all() and most < 8 * len(h) * 3.5
    assert len(substring_dedup._repeated([], np.zeros(0, bool))) == 0 and pack_sorted(h[:0])
