"""Concentrated-liquidity pools: raw call results to pool states, states to synthetic quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc


CALLS_PER_POOL = 2  # price and tick, liquidity


def pool_states(polls: DataFrame, pools: DataFrame, price_words: int = 6) -> DataFrame:
    """State of each pool at each poll: sqrt_price_x96 and liquidity (decimal strings) and active_tick beside the columns of ``pools``.

    ``polls``: block_number, block_ts_ns, received_ts_ns and results, an array of hex strings with two calls a pool in the order of
    ``pools.pool_index``: (price, tick, ... of ``price_words`` words) and (liquidity). A pool whose calls failed or are cut short gives
    no row at that block; other pools of the block do. Words are read by native expressions, so a poll is one row-wise projection.
    """
    n = CALLS_PER_POOL
    at = F.explode(F.expr(f"CASE WHEN size(results) >= {n} THEN sequence(0, size(results) DIV {n} - 1) END")).alias("pool_index")
    d = polls.select("block_number", "block_ts_ns", "received_ts_ns", "results", at)
    d = d.withColumn("_price", F.get("results", F.col("pool_index") * n)).withColumn("_liq", F.get("results", F.col("pool_index") * n + 1)).drop("results")
    d = d.withColumns({"_w0": sc.word("_price", 0), "_w1": sc.word("_price", 1), "_we": sc.word("_price", price_words - 1), "_wl": sc.word("_liq", 0)})
    d = d.where("_w0 IS NOT NULL AND _w1 IS NOT NULL AND _we IS NOT NULL AND _wl IS NOT NULL")
    d = d.select(
        "block_number", "block_ts_ns", "received_ts_ns", "pool_index",
        sc.word_decimal(F.col("_w0"), 160).alias("sqrt_price_x96"), sc.word_int(F.col("_w1"), 24).cast("int").alias("active_tick"),
        sc.word_decimal(F.col("_wl"), 128).alias("liquidity"),
    )
    return d.join(pools, "pool_index")


def pool_quotes(states: DataFrame) -> DataFrame:
    """Bid, ask and in-range depth of pool states.

    ``states``: sqrt_price_x96 and liquidity as decimal strings, active_tick, tick_spacing, decimals0, decimals1, fee (millionths) and
    invert. The fee is taken on each side; depth is what the range of the active tick still holds on either side of the price.
    """
    s = states.withColumn("_p", sc.sqrt_price("sqrt_price_x96")).withColumn("_t", sc.tick_floor("active_tick", "tick_spacing"))
    s = s.withColumn("_lo", F.pow(F.lit(1.0001), F.col("_t") / 2)).withColumn("_hi", F.pow(F.lit(1.0001), (F.col("_t") + F.col("tick_spacing")) / 2)).withColumn("_l", F.expr("try_cast(liquidity AS DOUBLE)"))
    price = sc.pool_price(F.col("_p"), F.col("decimals0"), F.col("decimals1"), F.col("invert"))
    f = F.col("fee") / 1e6
    unit = F.pow(F.lit(10.0), F.when(F.col("invert"), F.col("decimals1")).otherwise(F.col("decimals0")))
    below = F.when(F.col("invert"), F.col("_hi") - F.col("_p")).otherwise(1 / F.col("_lo") - 1 / F.col("_p"))
    above = F.when(F.col("invert"), F.col("_p") - F.col("_lo")).otherwise(1 / F.col("_p") - 1 / F.col("_hi"))
    return s.withColumns({"bid": price * (1 - f), "ask": price * (1 + f), "bid_qty": F.col("_l") * below / unit, "ask_qty": F.col("_l") * above / unit}).drop("_p", "_t", "_lo", "_hi", "_l")
