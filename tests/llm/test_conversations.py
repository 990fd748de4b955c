import itertools
import random

import duckdb
import pytest

from tideloom.llm import conversation_repair as cr
from tideloom.llm.oracles import OP13_SQL

SCHEMA = "conv_id long, turn long, role string, text string, _m string, cost long"


def want(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return sorted(con.execute(f"SELECT conv_id, {', '.join(cr.NAMES)} FROM ({OP13_SQL})").fetchall(), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in cr.repair(cr.damaged(df), **how).select("_conv", *cr.NAMES).collect()), key=str)


def made(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in [None, *range(conversations)]:
        for t in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = rng.choice(["a.", "b!", "c?\n", "no end", "", " \t", None, f"{t}.", "ünï. ", "d." * 40])
            rows += [(c, rng.choice([t, t, t, t + 3, None]), role, text)] * rng.choice([1, 1, 1, 1, 2, 3])
    return rows


@pytest.mark.parametrize("how", [{}, {"partitions": 2, "piece_rows": 2}])
def test_nulls_ties_repeats_and_cut_conversations(spark, how):
    rows = made(5, 40, 9)
    assert got(spark, rows, **how) == want(rows)


def test_one_hot_conversation_is_repaired_by_pieces(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}", "same.", "same."])) for t in range(400)] + made(6, 3, 4)
    assert got(spark, rows, piece_rows=20) == want(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def brute(rows):
    """Least (cost, audit) over all edits with at most two insertions between rows."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [[("K", r), ("R", "u"), ("R", "a"), ("D", "")] if keep else [("D", "")] for r, _, keep in rows]
    for edits in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            shape, audit, cost = ins[0], "I" * len(ins[0]), 5 * len("".join(ins))
            for (letter, c), (_, truncated, _), more in zip(edits, rows, ins[1:]):
                shape += c + more
                audit += letter + "I" * len(more)
                cost += {"K": 0, "R": 1, "D": 2}[letter] + (5 if truncated and letter != "D" else 0)
            body = shape[1:] if shape[:1] == "s" else shape
            if (not shape or body) and body == "ua" * (len(body) // 2) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_distances_and_walk_against_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(0, 4)
        rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.8) for _ in range(n)]
        chain = cr.Chain(range(n), [r for r, _, _ in rows], range(n), [(2 if t else 0) if keep else 1 for _, t, keep in rows], [1] * n)
        end = [0, cr.FAR, cr.FAR, 0]
        edits, q = chain.walk(end)
        assert q in cr.GOAL
        assert (chain.distances(end)[0] + chain.forced(), "".join(e[0] for e in edits)) == brute(rows)


def test_pieces_matrices_give_the_same_distances():
    rng = random.Random(2)
    rows = [rng.choice("suax") for _ in range(12)]
    whole = cr.Chain(range(12), rows, range(12), [0, 2] * 6, [1] * 12)
    left = [0, cr.FAR, cr.FAR, 0]
    for lo in (8, 4, 0):
        m = cr.Chain(range(4), rows[lo : lo + 4], range(4), [0, 2] * 2, [1] * 4).matrix()
        left = [min(m[4 * q + to] + left[to] for to in range(4)) for q in range(4)]
    assert [min(x, cr.FAR) for x in left] == whole.distances([0, cr.FAR, cr.FAR, 0])[:4]
