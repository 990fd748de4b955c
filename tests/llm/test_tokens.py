"""BPE automaton, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tideloom.llm import bpe, packing, token_output
from tideloom.llm.piece_ids import PieceIds

WORD, BYTE = bpe.tokenizer_path("word_bpe_49k.json"), bpe.tokenizer_path("byte_bpe_50k.json")


def texts():
    rng = random.Random(2)
    out = [None, "", "  ", "Hello, wörld's 12 a_b", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "a \n<|endoftext|> \n b", "İstanbul ΣΑΣ ²³ ١٢ 日本語 é \x1c\x1d a\x85b\xa0c \n\n  \t x\r\n", "don't 'S 'LL " + "a" * 300 + " " + "!" * 99, "long " * 4000]
    out += ["".join(rng.choice("abehtrsnlo!.'\n\t ") for _ in range(200)) for _ in range(60)]
    return out + ["".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F300, 0x1F600)])) for _ in range(50)) for _ in range(60)]


def test_automaton_equals_library():
    lib, enc = Tokenizer.from_file(WORD), bpe.Encoder(WORD)
    for t in texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert enc.encode(t) == ids
        n, dec, text = enc.encode_text(t)
        assert (n, dec, text) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))


def test_automaton_by_hand():
    a = bpe.MergeAutomaton({"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}, [("a", "a"), ("a", "b")])
    assert a.spell("aaa") == ["aa", "a"] and a.spell("aaab") == ["aa", "ab"] and a.spell("ab") == ["ab"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_equal_library(path):
    lib = Tokenizer.from_file(path)
    for t, got in zip(texts(), PieceIds(path).encode(texts())):
        assert np.frombuffer(got, np.uint32).tolist() == lib.encode(t or "", add_special_tokens=False).ids


def frame(spark):
    return spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts())] , "doc_id long, text string, ids string").repartition(3)


def test_encode_documents(spark):
    lib = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark), WORD).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert hashlib.sha256(got[i * 3]["ids"].encode()).digest() == hashlib.sha256(" ".join(map(str, ids)).encode()).digest()


def test_token_files(spark, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    token_output.write_tokens(frame(spark), str(tmp_path / "t"), BYTE)
    got = {r["doc_id"]: r for r in token_output.with_crc(token_output.read_tokens(spark, str(tmp_path / "t")), ["doc_id", "start", "n_tokens"]).collect()}
    at = 0
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(got[i * 3])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert "ids" not in token_output.read_tokens(spark, str(tmp_path / "t"), ids=False).columns
    plan = token_output.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)" in plan


def test_packing(spark):
    lib = Tokenizer.from_file(WORD)
    out = packing.pack_documents(frame(spark), WORD, capacity=64).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in out}
    total = 0
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for p, s in enumerate(range(0, len(ids), 64)):
            r = pieces.pop((i * 3, p))
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()))
    assert not pieces
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(seqs) <= -(-total // 64) * 1.03 + 1


def test_crossover_is_a_partition():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 300)
    a, b = (packing.best_fit(sizes, rng.permutation(300), 100) for _ in range(2))
    c = packing.crossover(sizes, a, b, 100, rng)
    assert np.bincount(c, weights=sizes).max() <= 100
    assert packing.fitness(sizes, packing.evolve(sizes, [a, b], 100, 3), 100) <= min(packing.fitness(sizes, x, 100) for x in (a, b))


def test_genetic_step_beats_best_fit(monkeypatch):
    """Triples that fill a bin exactly: best-fit in decreasing order misses the bound, crossovers come nearer to it."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(26, 45, 120), rng.integers(26, 30, 120)
    sizes = np.concatenate([a, b, 100 - a - b])
    ran, cross = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *x: ran.append(1) or cross(*x))
    plain = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 100)
    found = packing.evolve(sizes, [], 100, 1, population=8, births=150)
    assert np.bincount(found, weights=sizes).max() <= 100
    bins = [packing.fitness(sizes, x, 100)[0] for x in (plain, found)]
    assert ran and 120 <= bins[1] < bins[0], bins
    ran.clear()
    packing.evolve(np.array([10, 90, 50, 50]), [], 100, 1)  # as few bins as the tokens need: no birth
    assert not ran


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3 + [(None, None)], "doc_id long, text string")
    out = packing.pack_documents(df, WORD, capacity=4).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in out) == [(0, 1), (1, 4), (1, 4), (1, 4)]


def test_token_files_order_equal_and_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (2, "a a"), (None, "c"), (1, None), (2, "b")], "doc_id long, text string")
    token_output.write_tokens(df, str(tmp_path / "t"), BYTE)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_output.read_tokens(spark, str(tmp_path / "t")).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 3), (6, 2, 2), (8, 2, 2)]
