"""Fair price and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buffers
from ..operators import fairprice as fp
from ..operators import stats as st
from . import model_sql as ms
from .common import HOUR_NS, KEY, drop_symbol, r, rounded, sql, ticks

QUERIES, SQL = {}, {}


def q(name, fn, ctes=None, select=None, recursive=False, digits=6):
    QUERIES[name] = lambda s, d: rounded(drop_symbol(fn(s, d)), digits)
    if select:
        SQL[name] = sql(ctes or [], select, recursive)


#: Members: venue, group, bias, noise variance, weight, liquidity factor.
MEMBERS = [("click", "SYM", "G1", 0.0, 1e-4, 1.0, 1.0), ("view", "SYM", "G1", 0.01, 2e-4, 2.0, 1.5), ("purchase", "SYM", "G1", -0.02, 3e-4, 0.5, 2.0), ("signup", "SYM", "G2", 0.0, 1e-4, 1.0, 1.0), ("error", "SYM", "G2", 0.03, 1e-4, 1.0, 1.0)]
members = lambda s: s.createDataFrame(MEMBERS, "venue string, symbol string, grp string, bias double, noise_var double, gg_weight double, vol_adj double").withColumn("reprice_group", F.lit(None).cast("string")).withColumn("invert_reprice", F.lit(False))
obs = lambda s, d: fp.observations(ticks(s, d), members(s))
MEMQ = "mb AS (SELECT * FROM (VALUES ('click', 'G1', 0.0::DOUBLE, 1e-4::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('view', 'G1', 0.01, 2e-4, 2.0, 1.5), ('purchase', 'G1', -0.02, 3e-4, 0.5, 2.0), ('signup', 'G2', 0.0, 1e-4, 1.0, 1.0), ('error', 'G2', 0.03, 1e-4, 1.0, 1.0)) v(venue, grp, bias, noise_var, w, adj)), ob AS (SELECT grp, ticks.venue, seq, exchange_ts_ns AS t, ln((bid + ask) / 2) AS lm, ln(ask / bid) / 2 AS hs, bias, noise_var, w, adj, bid, ask, bid_qty, ask_qty FROM ticks JOIN mb ON ticks.venue = mb.venue WHERE bid > 0 AND ask > 0)"
GG = """bk AS (SELECT grp, venue, (t - 1) // 3600000000000 AS b, arg_max({'t': t, 'lm': lm, 'nv': hs * hs, 'bias': bias, 'w': w}, seq) AS m, count(*) AS n FROM ob GROUP BY ALL),
gr AS (SELECT grp, venue, unnest(range(min(b), (SELECT max(b) FROM bk) + 1)) AS b FROM bk GROUP BY grp, venue),
cf AS (SELECT gr.grp, gr.venue, (gr.b + 1) * 3600000000000 AS snap_ts_ns, last_value(m IGNORE NULLS) OVER (PARTITION BY gr.grp, gr.venue ORDER BY gr.b ROWS UNBOUNDED PRECEDING) AS m, n FROM gr LEFT JOIN bk ON gr.grp = bk.grp AND gr.venue = bk.venue AND gr.b = bk.b),
ag AS (SELECT *, (snap_ts_ns - m.t) / 1e6 AS age, m.w * pow(2, -((snap_ts_ns - m.t) / 1e6) / 7200000.0) AS wt FROM cf WHERE (snap_ts_ns - m.t) / 1e6 <= 21600000.0),
fr AS (SELECT grp, snap_ts_ns, sum(wt * (m.lm - m.bias)) / sum(wt) AS y, sum(wt * wt * m.nv) / pow(sum(wt), 2) + greatest(min(age), 0) * 1e-9 AS p, coalesce(sum(n), 0)::INT AS n FROM ag GROUP BY ALL HAVING abs(sum(wt)) > 1e-30)"""
gg = lambda s, d: fp.gonzalo_granger(obs(s, d), HOUR_NS, 21_600_000.0, 7_200_000.0, 1e-9)
VOL = "sqrt(1e-9 * 365.25 * 86400000) * 100"
q("g2_gonzalo_granger", gg, [MEMQ, GG], f"SELECT grp, snap_ts_ns, {r('y AS log_fair_price', 'p', 'exp(y + p / 2) AS fair_price', 'sqrt(p) * 1e4 AS uncertainty_bps', VOL + ' AS vol_ann_pct', digits=5)}, n AS n_ticks_used FROM fr", digits=5)
QUERIES["g7_output"], SQL["g7_output"] = QUERIES["g2_gonzalo_granger"], SQL["g2_gonzalo_granger"]
for mode, e in (("InstantSpread", "greatest(hs * hs, 1e-6)"), ("Static", "noise_var")):
    q(f"g3_noise_{mode.lower()}", lambda s, d, m=mode: obs(s, d).select("grp", "venue", "seq", (fp.noise_var(m, 1e-3, 1.5, True) * 1e4).alias("noise")), [MEMQ], f"SELECT grp, venue, seq, {r(f'greatest(pow(sqrt({e}) * adj, 2), 1e-6) * 2.25 * 1e4 AS noise')} FROM ob")
EWM = ["ok AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY t, seq) AS k FROM ob)",
       "ew AS (SELECT venue, seq, t, t AS t0, k, hs AS s FROM ok WHERE k = 1 UNION ALL SELECT o.venue, o.seq, o.t, e.t0, o.k, (1 - d) * o.hs + d * e.s FROM ew e JOIN (SELECT *, 0 AS z FROM ok) o ON o.venue = e.venue AND o.k = e.k + 1, LATERAL (SELECT pow(2, -((o.t - e.t) / 1e6) / greatest(least((o.t - e.t0) / 1e6, 36000000.0), 1.0)) AS d))"]
q("g4_spread_ewma", lambda s, d: fp.spread_ewma(obs(s, d), 36_000_000.0).select("venue", "seq", (F.col("ewma_half_spread") * 1e4).alias("half")), [MEMQ, *EWM], f"SELECT venue, seq, {r('s * 1e4 AS half')} FROM ew", True)
rep = lambda s, d: fp.reprice(obs(s, d).where("grp = 'G2'").withColumn("reprice_group", F.when(F.col("venue") == "error", F.lit("G1"))).withColumn("invert_reprice", F.col("seq") % 2 == 0), gg(s, d).where("grp = 'G1'")).select("venue", "seq", "log_mid")
q("g5_reprice", rep, [MEMQ, GG, "e AS (SELECT o.venue, o.seq, CASE WHEN o.seq % 2 = 0 THEN f.y - o.lm ELSE o.lm + f.y END AS lm FROM (SELECT * FROM ob WHERE venue = 'error') o ASOF JOIN (SELECT * FROM fr WHERE grp = 'G1') f ON o.t >= f.snap_ts_ns)"], f"SELECT venue, seq, {r('lm AS log_mid')} FROM ob WHERE venue = 'signup' UNION ALL SELECT venue, seq, {r('lm AS log_mid')} FROM e")
FQ = "fq AS (SELECT o.*, f.y, f.p, exp(f.y + o.bias + f.p / 2) AS fv FROM ob o ASOF LEFT JOIN fr f ON o.grp = f.grp AND o.t >= f.snap_ts_ns)"
quotes = lambda s, d: fp.fair_quotes(ticks(s, d), members(s), gg(s, d), 1e-9, 60_000.0)
EDGES = ["fv AS fair_at_venue", "(fv - bid) / fv * 1e4 AS edge_bid_bps", "(ask - fv) / fv * 1e4 AS edge_ask_bps", "((bid + ask) / 2 - fv) / fv * 1e4 AS edge_mid_bps", "sqrt(p + 1e-9 * 60000) * 1e4 AS uncertainty_bps"]
q("g8_fair_quote", lambda s, d: quotes(s, d).drop("ts_ns", "bid", "ask", "bid_qty", "ask_qty"), [MEMQ, GG, FQ], f"SELECT grp, venue, seq, {r(*EDGES, digits=4)} FROM fq", digits=4)
q("g9_history", lambda s, d: fp.history(gg(s, d), 20).select("grp", "snap_ts_ns", "rn", "fair_price"), [MEMQ, GG], f"SELECT grp, snap_ts_ns, row_number() OVER (PARTITION BY grp ORDER BY snap_ts_ns DESC)::INT AS rn, {r('exp(y + p / 2) AS fair_price')} FROM fr QUALIFY rn <= 20")
q("i3_fair_table", lambda s, d: fp.fair_table(quotes(s, d), 1_706_745_600_000_000_000, 1e-9).drop("highlight"), [MEMQ, GG, FQ, "lq AS (SELECT * FROM fq QUALIFY row_number() OVER (PARTITION BY venue ORDER BY t DESC, seq DESC) = 1), lt AS (SELECT *, ((bid + ask) / 2 - fv) / fv * 1e4 AS em, (ask - bid) / (ask + bid) * 1e4 AS hb, (1706745600000000000 - t) / 1e6 AS age FROM lq)"], f"SELECT grp, venue, {r('fv AS fair_at_venue', 'em AS edge_mid_bps', 'hb AS half_spread_bps', 'greatest(abs(em) - hb, 0) AS trade_edge_bps', 'age AS age_ms', 'sqrt(p + 1e-9 * 60000 + 1e-9 * age) * 1e4 AS venue_uncertainty_bps', digits=3)} FROM lt", digits=3)
q("i2_feed_health", lambda s, d: buffers.latest(ticks(s, d)).select(*KEY, ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4).alias("spread_bps"), F.when((F.col("received_ts_ns") - F.col("exchange_ts_ns")) / 1e6 < 100_000, (F.col("received_ts_ns") - F.col("exchange_ts_ns")) / 1e6).alias("latency_ms"), (F.lit(1_706_745_600_000_000_000) - F.col("received_ts_ns") > 5_000_000_000).alias("stale")), ["l AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY venue ORDER BY exchange_ts_ns DESC, seq DESC) = 1)"], f"SELECT venue, {r('(ask - bid) / ((ask + bid) / 2) * 1e4 AS spread_bps', 'CASE WHEN (received_ts_ns - exchange_ts_ns) / 1e6 < 100000 THEN (received_ts_ns - exchange_ts_ns) / 1e6 END AS latency_ms')}, 1706745600000000000 - received_ts_ns > 5000000000 AS stale FROM l")
KF = (1e-9, 1e-12, 1e-4)  # price and bias variance per millisecond, initial bias variance
kalman = lambda s, d, step=HOUR_NS, rows="snaps": fp.kalman(obs(s, d), step, *KF, rows=rows)
SNAP = f"SELECT grp, snap_ts_ns, {r('y AS log_fair_price', 'p', 'p_pre', 'p_pre_fwd', 'tau_fwd_ms', 'exp(y + p / 2) AS fair_price', 'sqrt(p) * 1e4 AS uncertainty_bps', VOL + ' AS vol_ann_pct', digits=5)}, n AS n_ticks_used, last AS last_tick_ts_ns FROM ks"
q("g1_kalman", lambda s, d: kalman(s, d).drop("biases"), [MEMQ, *ms.kalman(HOUR_NS, *KF)], SNAP, True, digits=5)
q("g6_predict_only", lambda s, d: kalman(s, d, HOUR_NS // 4).where("n_ticks_used = 0").drop("biases"), [MEMQ, *ms.kalman(HOUR_NS // 4, *KF)], SNAP + " WHERE n = 0", True, digits=5)
TICK = ["log_mid", "tau_ms", "q", "p_pre", "innovation", "s", "gain", "y_post", "p_post"]
q("a19_innovations", lambda s, d: kalman(s, d, rows="ticks"), [MEMQ, *ms.kalman(HOUR_NS, *KF)], f"SELECT grp, snap_ts_ns, tick_ts_ns, member_idx, {r(*TICK, digits=5)} FROM kt", True, digits=5)
q("g11_gg_bias", lambda s, d: fp.gg_bias(obs(s, d).select("grp", *KEY, "seq", "ts_ns", "log_mid", "bias"), gg(s, d), 3_600_000.0).select("grp", "venue", "seq", "bias_ewma"), [MEMQ, GG, *ms.GG_BIAS], f"SELECT grp, venue, seq, {r('b AS bias_ewma')} FROM ge", True)
q("e26_kalman_members", lambda s, d: st.member_report(kalman(s, d, rows="ticks").select("grp", "snap_ts_ns", F.concat_ws("-", "grp", "member_idx").alias("venue"), "log_mid", "s"), kalman(s, d).select("grp", "snap_ts_ns", F.col("log_fair_price").alias("y"))),
  [MEMQ, *ms.kalman(HOUR_NS, *KF), "kn AS (SELECT grp, snap_ts_ns, y, lead(y) OVER (PARTITION BY grp ORDER BY snap_ts_ns) AS nx FROM ks), kj AS (SELECT kt.grp || '-' || member_idx AS venue, s, log_mid - y AS e, nx - y AS d FROM kt JOIN kn ON kt.grp = kn.grp AND kt.snap_ts_ns = kn.snap_ts_ns)"],
  f"SELECT venue, count(*) AS n, {r('avg(e) AS bias_error', 'var_samp(e) / avg(s) AS noise_ratio', 'regr_slope(d, e) AS edge_beta', 'avg(CASE WHEN e <> 0 AND d <> 0 THEN (sign(e) = sign(d))::INT END) AS hit_rate', digits=4)} FROM kj GROUP BY venue", True, digits=4)
EWS = ["ew AS (SELECT venue, seq, t, t AS t0, k, adj, hs AS s FROM ok WHERE k = 1 UNION ALL SELECT o.venue, o.seq, o.t, e.t0, o.k, o.adj, (1 - d) * o.hs + d * e.s FROM ew e JOIN (SELECT *, 0 AS z FROM ok) o ON o.venue = e.venue AND o.k = e.k + 1, LATERAL (SELECT pow(2, -((o.t - e.t) / 1e6) / greatest(least((o.t - e.t0) / 1e6, 36000000.0), 1.0)) AS d))"]
q("g3_noise_ewmaspread", lambda s, d: fp.spread_ewma(obs(s, d), 36_000_000.0).select("grp", "venue", "seq", (fp.noise_var("EwmaSpread", 1e-3, 1.5, True) * 1e4).alias("noise")), [MEMQ, EWM[0], *EWS], f"SELECT mb.grp, ew.venue, seq, {r('greatest(pow(sqrt(greatest(s * s, 1e-6)) * ew.adj, 2), 1e-6) * 2.25 * 1e4 AS noise')} FROM ew JOIN mb ON ew.venue = mb.venue", True)
