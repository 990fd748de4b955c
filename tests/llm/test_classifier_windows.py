"""Filters see every window of four bytes, wherever it begins."""

import random

import numpy as np

from tideloom.llm import quality_cnn as qc


def test_every_window_is_seen():
    rng = np.random.default_rng(6)
    zero = np.zeros(qc.FILTERS)
    net = qc.Network(rng.normal(0, 1, (4, 256, qc.FILTERS)), zero, zero, zero, 0.0)
    texts = [b"", b"a", b"abcd", b"xabcd", bytes(range(1, 256)), b"ab" * 200, *[rng.integers(1, 256, n, np.uint8).tobytes() for n in (121, 122, 123, 124, 125, 126, 127, 128, 129, 383)]]
    buf, halves = qc.padded(texts)
    half = qc.pooled(buf, *net.tables())
    at = 0
    for t, n in zip(texts, halves.tolist()):
        p = b"\0\0\0" + t + bytes(n * qc.HALF - len(t))
        for j in range(n):
            want = np.max([sum(net.weights[k, p[i + k]] for k in range(4)) for i in range(j * qc.HALF, (j + 1) * qc.HALF)], axis=0)
            assert np.allclose(half[at + j], want, atol=1e-4)
        at += n


def test_a_pattern_is_learned_in_both_alignments_at_once():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(4))
    texts, labels = [], []
    for i in range(400):
        body = (" ".join(word() for _ in range(12))).encode()
        labels.append(i % 2)
        texts.append(body[:30] + (b"#" if i % 2 else b"") + body[30:])  # always at an even byte
    net = qc.train(texts, labels, {0: 1.0, 1: 1.0})
    even, odd = (net.score([k + t for t, y in zip(texts, labels) if y], net.tables()) for k in (b"", b"a"))
    assert even.min() > 0.9 and odd.min() > 0.9 and net.score([t for t, y in zip(texts, labels) if not y], net.tables()).max() < 0.1
