"""Scalar expressions (built-in functions only, so they stay inside generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453
MS_PER_YEAR = 365.25 * 86_400_000


def mid(bid="bid", ask="ask") -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def microprice(bid="bid", ask="ask", bid_qty="bid_qty", ask_qty="ask_qty") -> Column:
    """Quantity-weighted price; NULL unless the quantities' sum is positive."""
    q = F.col(bid_qty) + F.col(ask_qty)
    return F.when(q > 0, (F.col(bid) * F.col(ask_qty) + F.col(ask) * F.col(bid_qty)) / q)


def spread(bid="bid", ask="ask") -> Column:
    return F.col(ask) - F.col(bid)


def spread_bps(bid="bid", ask="ask") -> Column:
    return F.when(mid(bid, ask) > 0, spread(bid, ask) / mid(bid, ask) * 1e4)


def relative_spread(bid="bid", ask="ask") -> Column:
    return F.when(mid(bid, ask) > 0, spread(bid, ask) / mid(bid, ask))


def half_spread_bps(bid="bid", ask="ask") -> Column:
    return spread_bps(bid, ask) / 2


def log_half_spread(bid="bid", ask="ask") -> Column:
    """Half of ln(ask / bid); NULL unless both are positive."""
    return F.when((F.col(bid) > 0) & (F.col(ask) > 0), (F.ln(ask) - F.ln(bid)) / 2)


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def decay(tau: Column, halflife: float | Column) -> Column:
    """2 ** (-tau / halflife); 1 where the halflife isn't positive."""
    h = F.lit(halflife) if not isinstance(halflife, Column) else halflife
    return F.when(h <= 0, F.lit(1.0)).otherwise(F.exp(-tau * LN2 / F.nullif(h, F.lit(0.0))))


def minute_of(ns: str) -> Column:
    return F.expr(f"`{ns}` DIV 60000000000")


def hour_utc(ms: str) -> Column:
    return F.hour(F.timestamp_millis(F.col(ms)))


def weekday_monday0(ms: str) -> Column:
    return F.weekday(F.timestamp_millis(F.col(ms)))


def latency_ms(later: str, earlier: str) -> Column:
    return (F.col(later) - F.col(earlier)) / 1e6


def to_double(x: str) -> Column:
    return F.expr(f"try_cast({x} AS DOUBLE)")


def fixed18(x: str) -> Column:
    """1e18 fixed-point strings to double."""
    return F.expr(f"try_cast({x} AS DOUBLE) / 1e18D")


def epoch_ns(x: str, unit: str) -> Column:
    """Exchange times in any of the feeds' units to epoch nanoseconds: s (fractional), ms, us, ns, rfc3339."""
    if unit == "rfc3339":
        return F.expr(f"unix_micros(try_to_timestamp({x})) * 1000")
    if unit == "s":
        return F.expr(f"CAST(round(try_cast({x} AS DOUBLE) * 1e6D) AS BIGINT) * 1000")
    return F.expr(f"try_cast({x} AS BIGINT) * {({'ms': 1_000_000, 'us': 1000, 'ns': 1})[unit]}")


def normalise_token(x: str) -> Column:
    """Wrapped tokens to their base asset."""
    u = F.upper(F.col(x))
    return F.when(u == "WETH", "ETH").when(u.isin("WBTC", "CBBTC"), "BTC").otherwise(u)


def fills_per_hour(n: str, elapsed_s: str) -> Column:
    return F.expr(f"CASE WHEN {elapsed_s} > 0 THEN {n} * 3600D / least({elapsed_s}, 3600D) END")


def one_decimal(x: str) -> Column:
    """A number as C prints it by %.1f: its exact binary value rounded half to even (Java rounds its shortest decimals half up).

    Ten times the fraction is the sum ``_s + _e`` of two doubles, exactly; from 9.2e18 on there is no fraction, and Java prints the digits.
    """
    a = f"abs({x})"
    f8, f2 = f"({a} - floor({a})) * 8D", f"({a} - floor({a})) * 2D"
    s = f"({f8} + {f2})"
    e = f"({f2} - ({s} - {f8}))"
    n = f"CAST(CASE WHEN abs({s} - rint({s})) = 0.5D AND {e} <> 0D THEN floor({s}) + IF({e} > 0D, 1, 0) ELSE rint({s}) END AS BIGINT)"
    return F.expr(f"CASE WHEN {a} < 9.2e18D THEN concat(IF({x} < 0D, '-', ''), floor({a}) + {n} DIV 10, '.', {n} % 10) ELSE format_string('%.1f', {x}) END")


def short_number(x: str) -> Column:
    """1234 -> 1.2K, 2500000 -> 2.5M; rounded as C's printf does."""
    v = F.expr(x)
    short = F.when(F.abs(v) >= 1e6, F.concat(one_decimal(f"({x}) / 1e6D"), F.lit("M"))).when(F.abs(v) >= 1e3, F.concat(one_decimal(f"({x}) / 1e3D"), F.lit("K")))
    return F.when(v.isNull(), "-").otherwise(short.otherwise(F.format_string("%.0f", F.rint(v))))


# concentrated liquidity -------------------------------------------------------------------------------------------------


def word(data: str, i: int) -> Column:
    """The i-th 256-bit word (64 hex digits) of a call's result, with or without 0x; NULL where the result ends before it or isn't hex."""
    found = F.regexp_extract(F.lower(data), f"^(?:0x)?[0-9a-f]{{{64 * i}}}([0-9a-f]{{64}})(?:[0-9a-f]{{2}})*$", 1)
    return F.nullif(found, F.lit(""))


def word_int(w: Column, bits: int) -> Column:
    """The low ``bits`` (at most 60, a multiple of 4) of a word as a two's complement number."""
    v = F.conv(F.right(w, F.lit(bits // 4)), 16, 10).cast("bigint")
    return F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)


def word_decimal(w: Column, bits: int) -> Column:
    """The low ``bits`` (a multiple of 32) of a word as an unsigned number in decimal digits, exact at any width.

    Horner's rule over 32-bit digits on an array of limbs below 10**9: a limb times 2**32 and its carry stay inside 64 bits.
    """
    parts = bits // 32
    limbs = -(-bits * 30103 // 100000 // 9) + 1
    digits = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.conv(F.substring(w, i * 8 + (65 - 8 * parts), F.lit(8)), 16, 10).cast("bigint"))
    empty = F.array().cast("array<bigint>")

    def times(acc: Column, digit: Column) -> Column:
        def limb(s: Column, d: Column) -> Column:
            v = d * F.lit(1 << 32) + s["carry"]
            carry = F.call_function("div", v, F.lit(1_000_000_000).cast("bigint"))
            return F.struct(carry.alias("carry"), F.concat(s["out"], F.array(v % 1_000_000_000)).alias("out"))

        return F.aggregate(acc, F.struct(digit.alias("carry"), empty.alias("out")), limb, lambda s: s["out"])

    zero = F.array_repeat(F.lit(0).cast("bigint"), limbs)
    got = F.aggregate(digits, zero, times)
    text = F.array_join(F.transform(F.reverse(got), lambda v: F.lpad(v.cast("string"), 9, "0")), "")
    return F.when(w.isNotNull(), F.regexp_replace(text, "^0+(?=.)", ""))


def sqrt_price(x96: str) -> Column:
    """A decimal string of up to 160 bits, divided by 2**96 in double precision."""
    return F.expr(f"try_cast({x96} AS DOUBLE) / {float(2**96)!r}D")


def tick_sqrt_price(tick: str) -> Column:
    return F.pow(F.lit(1.0001), F.col(tick) / 2)


def tick_floor(tick: str, spacing: str) -> Column:
    """Lower end of the tick's range; floor division, also below zero."""
    return F.expr(f"CAST(floor({tick} / CAST({spacing} AS DOUBLE)) AS INT) * {spacing}")


def pool_price(sqrt_p: Column, decimals0: Column, decimals1: Column, invert: Column) -> Column:
    p = sqrt_p * sqrt_p * F.pow(F.lit(10.0), decimals0 - decimals1)
    return F.when(invert, 1 / F.nullif(p, F.lit(0.0))).otherwise(p)
