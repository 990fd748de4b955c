"""Substring dedup, n-gram join and embedding dedup against brute force, with nulls, empties, repeats, long texts and odd columns."""

import random

import numpy as np
import pytest

from tideloom.llm import embedding_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, _chunk string, n_words string"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = text(25)
    docs = [None, "", "   ", "one", "one", "Two words", "two  WORDS", "é ü ñ x \x0b y", shared, shared.upper()]
    for i in range(n):
        t = text(rng.choice([5, 30, 80, 200]))
        if i % 3 == 0:
            t += "\n" + shared + " " + text(10)
        docs.append(t)
        if i % 4 == 0:  # near copies, some of near copies
            for _ in range(3):
                w = docs[-1].split(" ")
                w[rng.randrange(len(w))] = word()
                docs.append(" ".join(w))
        if i % 7 == 0:
            docs.append(t)
    docs.append(text(6000) + " " + shared)
    return list(enumerate(docs))


def windows_removed(rows, k):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = [x for x in (t or "").encode().split()]
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[i : i + k] = [True] * k
            seen.add(key)
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("window", [3, 20])
def test_substring_dedup(spark, window):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "keep", "clash") for d, t in rows], SCHEMA).repartition(3)
    out = substring_dedup.substring_dedup(docs, window=window)
    assert "n_words" in out.columns and dict(out.dtypes)["n_words"] == "bigint"
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}
    assert got == windows_removed(rows, window)


def test_substring_dedup_repeated_and_empty(spark):
    t = " ".join(map(str, range(30)))
    out = substring_dedup.substring_dedup(spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string"))
    assert sorted(r["n_removed"] for r in out.collect()) == [0, 30, 30]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def components(rows, n, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = (t or "").translate(low).encode().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * den >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("n,t,num,den", [(3, "0.9", 9, 10), (2, "0.5", 1, 2)])
def test_ngram_join(spark, n, t, num, den):
    rows = corpus(5)
    docs = spark.createDataFrame([(d, x, "keep", "clash") for d, x in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, n, t).collect()}
    assert got == components(rows, n, num, den)


def test_one_of_each_keeps_columns(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, t, "a"), (1, t, "b"), (2, "other text", "c"), (4, None, "d")], "doc_id long, text string, extra string")
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        base = rng.normal(size=16)
        for k in range(rng.integers(1, 9)):
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(c % 3)))
    for v, label in ((None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), ([1.0, None] + [1.0] * 14, 0), (rows[0][1], None), (rows[0][1][:8], 0), ([2 * x for x in rows[0][1]], 0), (rows[0][1], 0), ([], 1)):
        rows.append((len(rows), v, label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_embeddings(df).collect()}
    ok = {i: (np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    near = {i: {j for j in ok if j != i and ok[j][1] == ok[i][1] and len(ok[j][0]) == len(ok[i][0]) and ok[i][0] @ ok[j][0] / (np.linalg.norm(ok[i][0]) * np.linalg.norm(ok[j][0])) >= 0.93} for i in ok}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, ())), min(seen), min(seen) == i), i
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0
