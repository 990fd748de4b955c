from collections import Counter

import duckdb
import numpy as np

from tideloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, _h string, rank int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def got(spark, rows):
    out = hn.hard_negatives(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3))
    assert out.columns == NAMES
    return Counter(tuple(r) for r in out.collect())


def want(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    if rows:
        con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return Counter(con.execute(f"SELECT {', '.join(NAMES)} FROM ({hn.OP11_SQL})").fetchall())


def clustered(n, d, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.3 * rng.normal(size=d)], int(rng.integers(0, labels))) for i in range(n)]


def test_nulls_ties_repeats_and_hot_vectors(spark):
    rows = clustered(420, 8, 1)
    hot = rows[100][1]
    rows += [(1000 + i, hot, 1 + i % 2) for i in range(150)]  # a class of over KEEP rows with anchors of its own
    rows += [rows[200], rows[200], rows[300], (None, hot, 1), (None, rows[3][1], 2), (7000, None, 1), (7100, hot, None), (7200, [1.0, None], 1), (7300, [float("nan")] * 8, 1), (7400, [float("inf")] + [0.0] * 7, 2)]
    rows += [(7500 + 50 * i, [0.5, 0.25 * i], i % 2) for i in range(12)]  # vectors of another length
    rows += [(9000, [], 1), (9001, [], 1), (9100, [], 2), (9400, [0.0] * 8, 1)]
    found = got(spark, rows)
    assert found == want(rows)
    assert sum(found.values()) > 200


def test_no_rows_and_no_negatives(spark):
    assert not got(spark, [])
    assert not got(spark, [(0, [1.0, 0.0], 1), (100, [1.0, 0.5], 1)])


def test_bounds_discard_most_pairs_and_lose_none():
    rng = np.random.default_rng(3)
    centres = np.floor(256 * rng.normal(size=(40, 64)))
    q = centres[rng.integers(0, 40, 3000)] + np.floor(20 * rng.normal(size=(3000, 64)))
    turn = np.linalg.eigh(q.T @ q)[1][:, ::-1]
    labels = rng.integers(0, 4, 3000)
    a, r = hn.Turned(q[:60], turn), hn.Turned(q, turn)
    low, high = np.full(60, hn.LOW), np.full(60, hn.HIGH)
    who, row, score, verified = hn.search(a, r, (labels[:60], labels), np.arange(3000), (np.arange(60), low, high), False, 5)
    assert verified < 0.2 * 60 * 3000
    exact = (q[:60] @ q.T).astype(np.int64)
    for i in range(60):
        best = sorted((-exact[i, j], j) for j in range(3000) if labels[j] != labels[i])[:5]
        assert [(-int(s), int(j)) for s, j in zip(score[who == i], row[who == i])] == best


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**40 + 1, 3.0], [2.0**62, 2.0**62]])
    assert hn.integer_products(a, a[:, ::-1].copy()).tolist() == [6 * (2**40 + 1), hn.HIGH]
    assert hn.integer_products(np.zeros((2, 0)), np.zeros((2, 0))).tolist() == [0, 0]
