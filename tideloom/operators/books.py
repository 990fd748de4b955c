"""Level-2 books: the state after all updates, best prices, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("venue", "symbol")


def levels(updates: DataFrame, key=KEY) -> DataFrame:
    """Live levels of each book: the newest update of each price since the last snapshot epoch; quantity 0 removes a level."""
    last = updates.groupBy(*key).agg(F.max("epoch").alias("_e"))
    u = updates.join(last, list(key)).where("epoch = _e")
    return u.groupBy(*key, "side", "price").agg(F.max_by("qty", "seq").alias("qty")).where("qty > 0")


def top(updates: DataFrame, key=KEY) -> DataFrame:
    """Best bid and ask with their quantities."""
    l = levels(updates, key)
    b, a = F.col("side") == "bid", F.col("side") == "ask"
    return l.groupBy(*key).agg(F.max(F.when(b, F.col("price"))).alias("bid"), F.min(F.when(a, F.col("price"))).alias("ask"), F.max_by("qty", F.when(b, F.col("price"))).alias("bid_qty"), F.min_by("qty", F.when(a, F.col("price"))).alias("ask_qty"))


def depth(updates: DataFrame, n: int = 32, key=KEY) -> DataFrame:
    """Arrays of the best ``n`` levels: bids falling, asks rising."""
    l = levels(updates, key).withColumn("_o", F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
    w = Window.partitionBy(*key, "side").orderBy("_o")
    l = l.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    s = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("_k", "price", "qty")))), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return l.groupBy(*key).agg(s("bid").alias("bids"), s("ask").alias("asks"))


def race_winners(arrivals: DataFrame, key=KEY, uid: str = "update_id", conn: str = "conn", ts: str = "received_ts_ns") -> DataFrame:
    """First arrivals of each update by connection: wins, share, and the one to cull (fewest wins)."""
    first = arrivals.groupBy(*key, uid).agg(F.min_by(conn, F.struct(ts, conn)).alias(conn))
    w = first.groupBy(conn).agg(F.count("*").alias("wins"))
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w.withColumn("share", F.col("wins") / F.sum("wins").over(total)).withColumn("cull", F.col("wins") == F.min("wins").over(total))
