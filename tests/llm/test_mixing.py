import random
from collections import Counter, defaultdict

import duckdb

from tideloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, _hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def got(spark, rows, **how):
    out = mixing.mix(frame(spark, rows), **how)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in out.collect())


def want(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP12_SQL})").fetchall())


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, None]), rng.choice([None, "", " \t\n", "w " * rng.randint(1, 60)]), rng.choice(["a", "a", "a", "b", "B", None, f"s{i % 5}"])) for i in range(n)]


def check(found):
    """Whole documents, at most three times each; a source's words within half a document of its target."""
    by = defaultdict(list)
    for (_, size, total, target, taken), n in found.items():
        assert size == 0 and taken == 0 or size and taken % size == 0 and 0 <= taken <= 3 * size
        by[total, target] += [(size, taken)] * n
    for (total, target), docs in by.items():
        assert sum(s for s, _ in docs) % max(total, 1) == 0
        sources = sum(s for s, _ in docs) // max(total, 1) or 1
        assert abs(sum(t for _, t in docs) - sources * target) <= sources * (max(s for s, _ in docs) / 2 + 1e-6)


def test_against_a_sorted_running_sum(spark):
    rows = made(400, 1)
    found = got(spark, rows)
    assert found == want(rows)
    check(found)


def test_hot_repeated_row_is_split(spark):
    rows = [(7, "one two three", "hot")] * 300 + [(i, "a b c d", "cold") for i in range(20)] + [(i, "z " * 50, "mild") for i in range(30)]
    found = got(spark, rows)
    assert found == want(rows)
    check(found)
    assert len({k[4] for k in found if k[0] == 7 and k[1] == 3}) == 2  # some of the rows that are alike are taken once more


def test_sources_without_words_and_no_rows(spark):
    rows = [(1, "", "a"), (2, None, None), (3, " ", "b")]
    assert got(spark, rows) == want(rows) == Counter({(1, 0, 0, 0.0, 0): 1, (2, 0, 0, 0.0, 0): 1, (3, 0, 0, 0.0, 0): 1})
    assert not got(spark, [])


def test_targets_share_the_excess(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), ("d", 20), (None, 3)]
    d = spark.createDataFrame(rows, "_source string, _size long")
    found = {r[0]: r[2] for r in mixing.targets(d).collect()}
    size, weight = dict(rows), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    capped: set = set()
    while True:  # the contract's rounds
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(w for t, w in weight.items() if t not in capped) for s in size if s not in capped}
        over = {s for s, t in share.items() if t > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert all(abs(found[s] - share.get(s, 3 * size[s])) < 1e-9 for s in size)
