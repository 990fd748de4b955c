"""Scalar formulas, symbol mappings and dimension joins over every tick: texts, pools and symbols are derived from the tick's own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import symbols as sym
from ..operators import joins as jn
from ..operators import pools, vol
from ..sources import feeds
from .common import r, rounded, sql, ticks

QUERIES, SQL = {}, {}


def q(name, fn, ctes, select, digits=6):
    QUERIES[name] = lambda s, d: rounded(fn(s, d), digits)
    SQL[name] = sql(ctes, select)


def case(n: int, values: list[str]) -> str:
    """One of the SQL expressions by the tick's number; both engines read it."""
    return f"CASE seq % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# Texts of numbers and times.
TEXTS = ["IF(seq % 5 = 0, 'x', CAST(bid AS STRING)) AS n", "IF(seq % 5 = 1, NULL, seq || '500000000000000000') AS x18",
         "CAST(exchange_ts_ns DIV 1000000 AS STRING) AS ms", "IF(seq % 5 = 2, '', (exchange_ts_ns DIV 1000000000) || '.25') AS sec",
         "IF(seq % 5 = 3, 'bad', date_format(timestamp_micros(exchange_ts_ns DIV 1000), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")) AS rfc"]
parsed = lambda s, d: ticks(s, d).selectExpr("seq", *TEXTS).select(
    "seq", sc.to_double("n").alias("n"), sc.fixed18("x18").alias("x18"), sc.epoch_ns("ms", "ms").alias("ms"), sc.epoch_ns("sec", "s").alias("sec"),
    sc.epoch_ns("rfc", "rfc3339").alias("rfc")).fillna(-1)
q("h8_parsing", parsed, [], f"""SELECT seq, {r("CASE WHEN seq % 5 = 0 THEN -1 ELSE bid END AS n", "CASE WHEN seq % 5 = 1 THEN -1 ELSE seq + 0.5::DOUBLE END AS x18")},
  exchange_ts_ns // 1000000 * 1000000 AS ms, CASE WHEN seq % 5 = 2 THEN -1 ELSE exchange_ts_ns // 1000000000 * 1000000000 + 250000000 END AS sec,
  CASE WHEN seq % 5 = 3 THEN -1 ELSE exchange_ts_ns END AS rfc FROM ticks""")
TOKENS = case(6, ["'WETH'", "'cbBTC'", "'WBTC'", "'sol'", "'tok' || (seq % 100)", "'weth'"])
q("h10_tokens", lambda s, d: ticks(s, d).selectExpr("seq", f"{TOKENS} AS t").select("seq", sc.normalise_token("t").alias("base")), [],
  f"SELECT seq, CASE upper(t) WHEN 'WETH' THEN 'ETH' WHEN 'WBTC' THEN 'BTC' WHEN 'CBBTC' THEN 'BTC' ELSE upper(t) END AS base FROM (SELECT seq, {TOKENS} AS t FROM ticks)")

# A pool a tick: price k / 2**20, fixed point with 96 bits as decimal digits.
K = "(524288 + (seq * 7919) % 1572864)"
SPACING, D0, D1, FEE = case(4, ["10", "60", "1", "200"]), case(3, ["6", "12", "18"]), case(2, ["18", "6"]), case(4, ["3000", "500", "100", "10000"])
X96 = f"CAST(CAST({K} AS DECIMAL(10,0)) * CAST('75557863725914323419136' AS DECIMAL(25,0)) AS STRING) AS sqrt_price_x96"
ONE = [X96, f"{SPACING} AS tick_spacing", f"{D0} AS decimals0", f"{D1} AS decimals1", f"{FEE} AS fee", "seq % 2 = 0 AS invert"]
pool_math = lambda s, d: ticks(s, d).selectExpr("seq", *ONE, "CAST(seq % 20001 - 10000 AS INT) AS active_tick").select(
    "seq", F.log10(sc.sqrt_price("sqrt_price_x96")).alias("sqrt_price"), sc.tick_floor("active_tick", "tick_spacing").alias("tick_lower"),
    F.log10(sc.tick_sqrt_price("active_tick")).alias("tick_price"),
    F.log10(sc.pool_price(sc.sqrt_price("sqrt_price_x96"), F.col("decimals0"), F.col("decimals1"), F.col("invert"))).alias("price"))
ONE_SQL = f"pl AS (SELECT seq, {K} / 1048576.0::DOUBLE AS p, {SPACING} AS sp, {D0} AS d0, {D1} AS d1, {FEE} AS fee, seq % 2 = 0 AS inv, 1000000000.0::DOUBLE + seq AS l FROM ticks)"
q("h9_pool_math", pool_math, [ONE_SQL], f"""SELECT seq, (floor((seq % 20001 - 10000) / sp::DOUBLE)::INT * sp)::INT AS tick_lower,
  {r('log10(p) AS sqrt_price', '(seq % 20001 - 10000) / 2.0 * log10(1.0001::DOUBLE) AS tick_price', 'CASE WHEN inv THEN -1 ELSE 1 END * (2 * log10(p) + d0 - d1) AS price')} FROM pl""")
TICK = f"CAST(floor(2 * ln({K} / 1048576D) / ln(1.0001D)) AS INT) AS active_tick"
one_pool = lambda s, d: pools.pool_quotes(ticks(s, d).selectExpr("seq", *ONE, TICK, "CAST(1000000000 + seq AS STRING) AS liquidity").withColumn("decimals1", F.col("decimals0")))
q("h9_pool_quotes", lambda s, d: one_pool(s, d).selectExpr("seq", "bid", "ask", "bid_qty * pow(10D, decimals0 - 6) AS bid_qty", "ask_qty * pow(10D, decimals0 - 6) AS ask_qty"),
  [ONE_SQL, "lw AS (SELECT *, floor(floor(2 * ln(p) / ln(1.0001::DOUBLE)) / sp) * sp AS t0 FROM pl)",
   "pq AS (SELECT *, pow(1.0001, t0 / 2.0) AS lo, pow(1.0001, (t0 + sp) / 2.0) AS hi, CASE WHEN inv THEN 1 / (p * p) ELSE p * p END AS price FROM lw)"],
  "SELECT seq, " + r("price * (1 - fee / 1e6) AS bid", "price * (1 + fee / 1e6) AS ask", "l * CASE WHEN inv THEN hi - p ELSE 1 / lo - 1 / p END / 1e6 AS bid_qty",
                     "l * CASE WHEN inv THEN p - lo ELSE 1 / p - 1 / hi END / 1e6 AS ask_qty") + " FROM pq")

# Volatility parameters.
q("l3_static_vol", lambda s, d: ticks(s, d).selectExpr("seq", "0.1D + seq % 100 / 100D AS ann_vol").withColumn("h", vol.static_h_per_ms(F.col("ann_vol")))
  .select("seq", "ann_vol", (F.col("h") * 1e12).alias("h_scaled"), vol.h_to_ann_vol(F.col("h")).alias("back")), ["av AS (SELECT seq, 0.1::DOUBLE + seq % 100 / 100.0::DOUBLE AS v FROM ticks)"],
  f"SELECT seq, {r('v AS ann_vol', 'v * v / (365.25 * 86400000) * 1e12 AS h_scaled', 'v AS back')} FROM av")
q("l11_annualise", lambda s, d: ticks(s, d).selectExpr("seq", "-(seq % 7) / 2D AS log_var", "1 + seq % 3 / 4D AS season")
  .select("seq", "log_var", "season", vol.annualise(F.col("log_var"), F.col("season"), 5.0).alias("ann_vol")),
  ["lv AS (SELECT seq, -(seq % 7) / 2.0::DOUBLE AS log_var, 1 + seq % 3 / 4.0::DOUBLE AS season FROM ticks)"], f"SELECT seq, {r('log_var + 0.0 AS log_var', 'season', 'sqrt(exp(log_var) * season * 525960.0 / 5) AS ann_vol')} FROM lv")
by_group = lambda s, d: ticks(s, d).selectExpr("venue || '-' || seq % 50 AS grp", "bid_qty", "ask_qty").groupBy("grp")
reseeded = lambda s, d: vol.reseed(by_group(s, d).agg((F.avg("bid_qty") / 10).alias("ann_vol")), by_group(s, d).agg((F.max("ask_qty") / 10).alias("ann_vol")).where("grp LIKE '%7'"))
q("l12_reseed", lambda s, d: reseeded(s, d).select("grp", "ann_vol", (F.col("h_per_ms") * 1e12).alias("h")),
  ["g AS (SELECT venue || '-' || seq % 50 AS grp, avg(bid_qty) / 10 AS a, max(ask_qty) / 10 AS b FROM ticks GROUP BY ALL)", "v AS (SELECT grp, CASE WHEN grp LIKE '%7' THEN b ELSE a END AS v FROM g)"],
  f"SELECT grp, {r('v AS ann_vol', 'v * v / (365.25 * 86400000) * 1e12 AS h')} FROM v")

# Fees, groups, members.
LISTED = [case(3, ["'okx'", "'binance'", "'none'"]) + " AS venue",
          "CASE WHEN seq % 2 = 0 THEN 'spot' ELSE 'perp' END AS itype", "'S' || seq % 10 AS symbol"]
OVER = [("okx", "perp", "S1", 1.0, 0.5)]
q("f10_fees", lambda s, d: sym.with_fees(ticks(s, d).selectExpr("seq", *LISTED), sym.fees(s), s.createDataFrame(OVER, "venue string, itype string, symbol string, taker_bps double, maker_bps double")),
  [f"ls AS (SELECT seq, {', '.join(LISTED)} FROM ticks)",
   "fe AS (SELECT * FROM (VALUES ('okx', 'spot', 10.0::DOUBLE, 8.0::DOUBLE), ('okx', 'perp', 5.0, 2.0), ('binance', 'spot', 10.0, 10.0), ('binance', 'perp', 5.0, 2.0)) v(venue, itype, t, m))"],
  """SELECT seq, ls.venue, ls.itype, symbol, CASE WHEN ls.venue = 'okx' AND ls.itype = 'perp' AND symbol = 'S1' THEN 1.0 ELSE t END AS taker_bps,
  CASE WHEN ls.venue = 'okx' AND ls.itype = 'perp' AND symbol = 'S1' THEN 0.5 ELSE m END AS maker_bps FROM ls LEFT JOIN fe ON ls.venue = fe.venue AND ls.itype = fe.itype""")
QUOTED = ["venue", "'B' || (seq % 7 + CASE WHEN seq % 10 = 0 THEN 1000 + seq ELSE 0 END) AS base", case(4, ["'USDT'", "'USDC'", "'ETH'", "'BTC'"]) + " AS quote"]
q("f11_groups", lambda s, d: jn.discover_groups(ticks(s, d).selectExpr(*QUOTED).withColumn("symbol", F.concat_ws("_", "base", "quote"))),
  [f"sy AS (SELECT DISTINCT {', '.join(QUOTED)} FROM ticks)"],
  """SELECT base AS grp, venue, base || '_' || quote AS symbol, n AS n_members, CASE WHEN quote NOT IN ('USDT', 'USDC', 'USD') THEN quote END AS reprice_group
  FROM (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM sy) WHERE n >= 2""")
MEMBER = "'G' || seq % 40 AS grp"
VOLUME = "CASE WHEN venue = 'error' THEN NULL WHEN venue = 'signup' THEN 0 ELSE sum(bid_qty) END"
members = lambda s, d: ticks(s, d).selectExpr(MEMBER, "venue", "bid_qty").groupBy("grp", "venue").agg(F.expr(VOLUME).cast("double").alias("vol_24h"))
MEMQ = f"m AS (SELECT {MEMBER}, venue, ({VOLUME})::DOUBLE AS vol_24h FROM ticks GROUP BY 1, 2)"
LARGEST = "max(vol_24h) OVER (PARTITION BY grp)"
q("f12_liquidity_factor", lambda s, d: jn.liquidity_factor(members(s, d)), [MEMQ],
  f"SELECT grp, venue, vol_24h, {r(f'CASE WHEN coalesce({LARGEST}, 0) > 0 THEN pow({LARGEST} / CASE WHEN vol_24h > 0 THEN vol_24h ELSE 0.01 * {LARGEST} END, 0.75) ELSE 1 END AS vol_adj')} FROM m")
q("f13_member_rank", lambda s, d: jn.rank_members(members(s, d)), [MEMQ],
  "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vol_24h DESC NULLS LAST, venue)::INT AS rank FROM m")

# Volumes of ticker objects by each venue's rules.
RAW = case(5, ["'{\"symbol\":\"B' || seq % 50 || 'USDT\",\"volume\":\"' || seq || '.5\"}'", "'{\"instId\":\"B' || seq % 50 || '-USDT-SWAP\",\"vol24h\":\"900\",\"volCcy24h\":\"' || seq || '\"}'",
               "'{\"instId\":\"B' || seq % 50 || '-USDT\",\"vol24h\":\"' || seq || '\"}'", "'{\"coin\":\"B' || seq % 50 || '\",\"dayNtlVlm\":\"' || seq || '\",\"markPx\":\"50\"}'", "'{}'"])
KINDS = [f"{case(5, [chr(39) + v + chr(39) for v in ('binance', 'okx', 'okx', 'hyperliquid', 'bybit')])} AS venue", f"{case(5, [chr(39) + v + chr(39) for v in ('spot', 'perp', 'spot', 'perp', 'perp')])} AS itype"]
SYMBOL = case(5, ["'B' || seq % 50 || 'USDT'", "'B' || seq % 50 || '-USDT-SWAP'", "'B' || seq % 50 || '-USDT'", "'B' || seq % 50", "''"])
q("a12_volumes", lambda s, d: feeds.volumes(ticks(s, d).selectExpr(*KINDS, f"{RAW} AS raw")), [],
  f"SELECT {', '.join(KINDS)}, {SYMBOL} AS symbol, {r(case(5, ['seq + 0.5::DOUBLE', 'seq::DOUBLE', 'seq::DOUBLE', 'seq / 50.0::DOUBLE', 'NULL']) + ' AS vol_24h')} FROM ticks WHERE seq % 5 <> 4")


# Registry of the bases that the ticks name; it holds at most sym.MAX_SYMBOLS symbols, so no more names than that are fetched.
def registry(s, d):
    names = ticks(s, d).select(F.upper("venue").alias("base")).distinct().orderBy("base").limit(sym.MAX_SYMBOLS + 1)
    return sym.registry(s, [x["base"] for x in names.collect()])


REG = """ba AS (SELECT base AS n, row_number() OVER (ORDER BY base) - 1 AS i FROM (SELECT DISTINCT upper(venue) AS base FROM ticks)),
reg AS (SELECT ((b.i * 5 + q.i) * 2 + t.i)::INT AS symbol_id, t.n || '-' || b.n || '-' || q.n AS canonical, t.n AS itype, b.n AS base, q.n AS quote FROM ba b,
(VALUES (0, 'USDT'), (1, 'USDC'), (2, 'USD'), (3, 'ETH'), (4, 'WETH')) q(i, n), (VALUES (0, 'SPOT'), (1, 'PERP')) t(i, n))"""
q("n1_registry", registry, [REG], "SELECT * FROM reg")
q("n1_aliases", lambda s, d: sym.aliases(registry(s, d)), [REG],
  "SELECT itype, unnest([canonical, base || quote, base || '-' || quote, base || '/' || quote, base || '_' || quote]) AS alias, symbol_id FROM reg")
NAMED = case(4, ["'PERP_' || upper(venue) || '_USDT'", "'SPOT_' || upper(venue) || '_USDC'", "upper(venue) || '_USD'", "'PERP_XXX_USD'"])
q("n2_resolve", lambda s, d: sym.resolve(ticks(s, d).selectExpr("seq", f"{NAMED} AS name"), registry(s, d)).withColumn("symbol_id", F.coalesce("symbol_id", F.lit(-1))), [REG],
  f"""SELECT seq, {NAMED} AS name, coalesce(symbol_id, -1) AS symbol_id FROM ticks LEFT JOIN reg ON seq % 4 <> 3 AND base = upper(venue) AND quote = {case(4, ["'USDT'", "'USDC'", "'USD'", "''"])}
  AND itype = CASE WHEN seq % 4 = 1 THEN 'SPOT' ELSE 'PERP' END""")

# Native symbols by venue and type, base B<n> of the tick; {b} is the base. Then what they stand for.
NATIVE = [("binance", "spot", "{b}BUSD", "{b}", "BUSD"), ("binance", "perp", "eth{b}usdt", "ETH{b}", "USDT"), ("kraken", "perp", "PI_XBTUSD", "BTC", "USD"), ("kucoin", "perp", "XBTUSDTM", "BTC", "USDT"),
          ("okx", "perp", "{b}-USDT-SWAP", "{b}", "USDT"), ("coinbase", "perp", "{b}-PERP-INTX", "{b}", "USD"), ("hibachi", "perp", "{b}/USDT-P", "{b}", "USDT"),
          ("nado", "perp", "{b}-PERP_USDT0", "{b}", "USDT"), ("mexc", "perp", "{b}_USDT", "{b}", "USDT"), ("okx", "spot", "BROKEN", None, None)]
DEN = [("binance", "perp", "PERP_{b}_USDT", "{b}USDT"), ("kraken", "perp", "BTC_USD", "PI_XBTUSD"), ("kucoin", "perp", "PERP_{b}_USDT", "{b}USDTM"),
       ("okx", "perp", "{b}_USDT", "{b}-USDT-SWAP"), ("coinbase", "spot", "SPOT_{b}_USD", "{b}-USD"), ("hotstuff", "perp", "{b}_USDT", "{b}-PERP")]


def column(rows, i: int) -> str:
    """The i-th field of the row that a tick's number picks, as an SQL expression."""
    return case(len(rows), ["NULL" if x[i] is None else f"replace('{x[i]}', '{{b}}', 'B' || seq % 90)" for x in rows])


def listed(rows, names: str) -> list[str]:
    return [f"{column(rows, i)} AS {n}" for i, n in enumerate(names.split())]


q("n3_normalize", lambda s, d: sym.normalize(ticks(s, d).selectExpr("seq", *listed(NATIVE, "venue itype native"))), [f"nv AS (SELECT seq, {', '.join(listed(NATIVE, 'venue itype native base quote'))} FROM ticks)"],
  "SELECT *, upper(itype) || '_' || base || '_' || quote AS normalized FROM nv")
q("n3_denormalize", lambda s, d: sym.denormalize(ticks(s, d).selectExpr("seq", *listed(DEN, "venue itype normalized"))), [], f"SELECT seq, {', '.join(listed(DEN, 'venue itype normalized native'))} FROM ticks")
PAIRS = [("{b}_USDT", "{b}", "USDT"), ("SPOT_{b}_USD", "{b}", "USD"), ("{b}", None, None), ("A_{b}_C_D", None, None)]
q("n4_parse_normalized", lambda s, d: ticks(s, d).selectExpr("seq", *listed(PAIRS, "n")).select("seq", "n", sym.parse_normalized("n").alias("p")).select("seq", "n", "p.base", "p.quote"), [],
  f"SELECT seq, {', '.join(listed(PAIRS, 'n base quote'))} FROM ticks")
