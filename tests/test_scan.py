"""Running values by buckets: the same as one ordered pass over each key, at any width of a bucket."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideloom.operators import cleaning, joins, scan


def table(spark, n=400):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i if i % 97 else None, rng.choice([None, rng.randrange(1000)])) for i in range(1, n)]
    return rows, spark.createDataFrame(rows, "k string, seq long, v long")


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("how", ["max", "min", "last", "sum"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_one_pass(spark, width, how, inclusive):
    rows, df = table(spark)
    rows = [r for r in rows if r[1] is not None]
    want, state = {}, {}
    for k, s, v in rows:
        old = state.get(k)
        new = old if v is None else v if old is None or how == "last" else old + v if how == "sum" else (max if how == "max" else min)(old, v)
        state[k] = new
        want[s] = new if inclusive else old
    got = scan.running(df.where("seq IS NOT NULL"), ["k"], ["seq"], width, F.col("v"), how, "m", inclusive)
    assert got.columns == ["k", "seq", "v", "m"]
    assert {r["seq"]: r["m"] for r in got.collect()} == want


def test_null_order_comes_first_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([("a", None, 9), ("a", 1, 3), ("a", 50, 4)], "k string, seq long, v long")
    got = {r["seq"]: r["m"] for r in scan.running(df, ["k"], ["seq"], 10, F.col("v"), "last", "m", False).collect()}
    assert got == {None: None, 1: 9, 50: 3}
    assert scan.running(df.limit(0), ["k"], ["seq"], 10, F.col("v"), "max", "m").collect() == []


def test_asof_join_over_buckets(spark):
    rng = random.Random(9)
    lefts = [(rng.choice("ab"), rng.randrange(-500, 500), i) for i in range(200)]
    rights = [(rng.choice("ab"), rng.randrange(-500, 500), i, i / 2) for i in range(60)]
    l, r = spark.createDataFrame(lefts, "k string, t long, i int"), spark.createDataFrame(rights, "k string, t long, s int, x double")
    want = {}
    for k, t, i in lefts:
        known = [(u, s, x) for kk, u, s, x in rights if kk == k and u <= t]
        want[i] = max(known)[2] if known else None
    for width in (1, 37, 10_000):
        got = joins.asof_join(l, r, ["k"], "t", "t", "s", bucket=width)
        assert {g["i"]: g["r_x"] for g in got.collect()} == want
    d = joins.asof_join(l.withColumn("t", F.col("t").cast("double")), r.withColumn("t", F.col("t").cast("double")), ["k"], "t", "t", "s", bucket=37)
    assert {g["i"]: g["r_x"] for g in d.collect()} == want


def test_cleaning_by_small_buckets(spark):
    rng = random.Random(3)
    rows = [("v", "s", i, 1000 + i * 10 + rng.randrange(-200, 200), rng.randrange(300)) for i in range(300)]
    df = spark.createDataFrame(rows, "venue string, symbol string, seq long, exchange_ts_ns long, update_id long")
    ts = ids = -math.inf
    fresh, new = [], []
    for _, _, i, t, u in rows:
        fresh += [i] * (t >= ts)
        new += [i] * (u > ids)
        ts, ids = max(ts, t), max(ids, u)
    assert sorted(r["seq"] for r in cleaning.drop_stale(df, bucket_rows=11).collect()) == fresh
    assert sorted(r["seq"] for r in cleaning.dedup_update_id(df, bucket_rows=11).collect()) == new
