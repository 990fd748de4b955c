"""Raw call results of pools: words of 256 bits against Python's integers."""

import random

from pyspark.sql import functions as F

from tideloom.functions import scalars as sc
from tideloom.operators import pools


def hexes(*values):
    return "0x" + "".join(f"{v % (1 << 256):064x}" for v in values)


def test_words_are_exact(spark):
    rng = random.Random(5)
    values = [0, 1, (1 << 160) - 1, (1 << 128) - 1, 10**9, 10**9 - 1, 10**18, 10**45 + 1, *(rng.getrandbits(b) for b in (30, 32, 33, 63, 64, 96, 127, 128, 159, 160) for _ in range(20))]
    ticks = [0, -1, 887272, -887272, (1 << 23) - 1, -(1 << 23)]
    rows = [(str(v), str(v % (1 << 128)), ticks[i % 6], hexes(v, ticks[i % 6])) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "want string, low string, tick int, data string")
    got = d.withColumns({"a": sc.word_decimal(sc.word("data", 0), 160), "b": sc.word_decimal(sc.word("data", 0), 128), "t": sc.word_int(sc.word("data", 1), 24)})
    assert got.where("a <> want OR b <> low OR t <> tick OR a IS NULL OR b IS NULL OR t IS NULL").collect() == []


def test_bad_results_give_null(spark):
    d = spark.createDataFrame([(None,), ("",), ("0x",), ("0x12",), (hexes(1)[:-1],), (hexes(1).replace("1", "g"),)], "data string")
    assert d.select(sc.word_decimal(sc.word("data", 0), 160).alias("w")).where("w IS NOT NULL").count() == 0
    assert spark.createDataFrame([(hexes(7)[2:],), (hexes(7).upper().replace("0X", "0x"),)], "data string").select(sc.word_decimal(sc.word("data", 0), 160).alias("w")).collect() == [("7",), ("7",)]


def test_a_failed_pool_leaves_the_others(spark):
    price = hexes(1 << 96, -5, 0, 0, 0, 1)
    polls = spark.createDataFrame(
        [(1, 10, 11, [price, hexes(500), price, hexes(600)]), (2, 20, 21, [price[:100], hexes(500), price, hexes(600)]), (3, 30, 31, [price, None, price, hexes(6)]), (4, 40, 41, None), (5, 50, 51, []), (6, 60, 61, [price])],
        "block_number long, block_ts_ns long, received_ts_ns long, results array<string>")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "pool_index int, pool string")
    got = pools.pool_states(polls, dim)
    assert sorted(got.select("block_number", "pool", "sqrt_price_x96", "active_tick", "liquidity").collect()) == [
        (1, "a", str(1 << 96), -5, "500"), (1, "b", str(1 << 96), -5, "600"), (2, "b", str(1 << 96), -5, "600"), (3, "b", str(1 << 96), -5, "6")]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert pools.pool_states(polls.where(F.lit(False)), dim).count() == 0
