"""Joins, windows, cross-section, validation and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import joins as jn
from ..operators import stats as st
from . import model_sql as ms
from .common import HOUR_NS, KEY, SNAPS_SQL, drop_symbol, r, rounded, snaps, sql, ticks

QUERIES, SQL = {}, {}


def q(name, fn, ctes=None, select=None, recursive=False, digits=6):
    QUERIES[name] = lambda s, d: rounded(drop_symbol(fn(s, d)), digits)
    if select:
        SQL[name] = sql(ctes or [], select, recursive)


W = lambda: Window.partitionBy(*KEY).orderBy("snap_ts_ns")
lm = lambda s, d: snaps(s, d).withColumn("log_mid", F.ln("midquote")).withColumn("rel_spread", F.col("spread") / F.col("midquote")).withColumn("grp", F.lit("G"))
LM = "lm AS (SELECT *, ln(midquote) AS log_mid, spread / midquote AS rel_spread FROM snaps)"
RET = "rt AS (SELECT venue, snap_ts_ns, log_return AS x, row_number() OVER (PARTITION BY venue ORDER BY snap_ts_ns) - 1 AS p FROM snaps WHERE log_return IS NOT NULL)"
q("f1_lag_return", lambda s, d: snaps(s, d).select(*KEY, "snap_ts_ns", "log_return").where("log_return IS NOT NULL"), [SNAPS_SQL], f"SELECT venue, snap_ts_ns, {r('log_return')} FROM snaps WHERE log_return IS NOT NULL")
q("f2_interval_extremes", lambda s, d: snaps(s, d).select(*KEY, "snap_ts_ns", "mid_high", "mid_low"), [SNAPS_SQL], f"SELECT venue, snap_ts_ns, {r('mid_high', 'mid_low')} FROM snaps")
q("f3_forward_diff", lambda s, d: snaps(s, d).select(*KEY, "snap_ts_ns", (F.lead("midquote", 5).over(W()) - F.col("midquote")).alias("diff")), [SNAPS_SQL], f"SELECT venue, snap_ts_ns, {r('lead(midquote, 5) OVER (PARTITION BY venue ORDER BY snap_ts_ns) - midquote AS diff')} FROM snaps")
q("f5_moving_average", lambda s, d: snaps(s, d).select(*KEY, "snap_ts_ns", F.avg("midquote").over(W().rowsBetween(-9, 0)).alias("ma")), [SNAPS_SQL], f"SELECT venue, snap_ts_ns, {r('avg(midquote) OVER (PARTITION BY venue ORDER BY snap_ts_ns ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma')} FROM snaps")
q("f7_asof_lookup", lambda s, d: jn.asof_join(ticks(s, d).where("venue = 'click'").select("symbol", "seq", "exchange_ts_ns"), ticks(s, d).where("venue = 'view'").select("symbol", "exchange_ts_ns", "seq", "bid"), ["symbol"], "exchange_ts_ns", "exchange_ts_ns", "seq").select("symbol", "seq", "r_seq", "r_bid").where("r_seq IS NOT NULL"), [], f"SELECT a.seq, b.seq AS r_seq, {r('b.bid AS r_bid')} FROM (SELECT * FROM ticks WHERE venue = 'click') a ASOF JOIN (SELECT * FROM ticks WHERE venue = 'view') b ON a.exchange_ts_ns >= b.exchange_ts_ns")
tk = lambda s, d: ticks(s, d).withColumn("snap_ts_ns", (F.expr(f"exchange_ts_ns DIV {HOUR_NS}") + 1) * HOUR_NS)
q("f8_join_snapshots", lambda s, d: jn.join_on_snapshot(tk(s, d).select("venue", "symbol", "seq", "snap_ts_ns"), st.cross_section(lm(s, d)).select("snap_ts_ns", "median")), [SNAPS_SQL, LM, "cs AS (SELECT snap_ts_ns, quantile_cont(log_mid, 0.5) AS median FROM lm GROUP BY ALL HAVING count(DISTINCT venue) >= 2)"], f"SELECT t.venue, t.seq, cs.snap_ts_ns, {r('median')} FROM ticks t JOIN cs ON cs.snap_ts_ns = (t.exchange_ts_ns // 3600000000000 + 1) * 3600000000000")
q("f9_last_per_member", lambda s, d: jn.last_per(tk(s, d).select("venue", "symbol", "seq", "snap_ts_ns"), ["venue", "snap_ts_ns"], ["seq"]), [], "SELECT venue, max(seq) AS seq, (exchange_ts_ns // 3600000000000 + 1) * 3600000000000 AS snap_ts_ns FROM ticks GROUP BY ALL")
gaps = lambda s, d: snaps(s, d).withColumn("x", F.when(F.col("n_ticks") > 0, F.col("midquote"))).withColumn("x", F.when(F.expr("snap_ts_ns DIV 3600000000000 % 3 = 0"), None).otherwise(F.col("x"))).select(*KEY, "snap_ts_ns", "x")
q("f14_forward_fill", lambda s, d: jn.forward_fill(gaps(s, d), ["x"], KEY, "snap_ts_ns"), [SNAPS_SQL, "g AS (SELECT venue, snap_ts_ns, CASE WHEN n_ticks > 0 AND snap_ts_ns // 3600000000000 % 3 <> 0 THEN midquote END AS x FROM snaps)"], f"SELECT venue, snap_ts_ns, {r('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY venue ORDER BY snap_ts_ns ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY venue ORDER BY snap_ts_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x')} FROM g")
q("f15_train_test", lambda s, d: jn.split_at_median(ticks(s, d), "exchange_ts_ns").groupBy("venue", "part").agg(F.count("*").alias("n")), [], "SELECT venue, CASE WHEN exchange_ts_ns <= (SELECT quantile_cont(exchange_ts_ns::DOUBLE, 0.5) FROM ticks) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM ticks GROUP BY ALL")
q("f16_bar_expansion", lambda s, d: jn.expand_bars(snaps(s, d).select(*KEY, "snap_ts_ns"), snaps(s, d).groupBy(*KEY, F.expr(f"snap_ts_ns DIV {6 * HOUR_NS} * {6 * HOUR_NS}").alias("bar")).agg(F.avg("midquote").alias("m")), 6 * HOUR_NS, KEY, "snap_ts_ns", "bar"), [SNAPS_SQL], f"SELECT venue, snap_ts_ns, {r('avg(midquote) OVER (PARTITION BY venue, snap_ts_ns // 21600000000000) AS m')} FROM snaps")

CS = "cs AS (SELECT snap_ts_ns, quantile_cont(v, 0.5) AS median, avg(v) AS mean, count(*) AS n_venues FROM (SELECT snap_ts_ns, venue, avg(log_mid) AS v FROM lm GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2), rs AS (SELECT lm.*, cs.median, log_mid - cs.median AS residual FROM lm JOIN cs ON lm.snap_ts_ns = cs.snap_ts_ns)"
q("e15_cross_median", lambda s, d: st.cross_section(lm(s, d)), [SNAPS_SQL, LM, CS], f"SELECT snap_ts_ns, {r('median', 'mean')}, n_venues FROM cs")
VENUES = ["click", "error", "purchase", "signup", "view"]
q("e15_pivot", lambda s, d: st.cross_section_pivot(lm(s, d), VENUES), [SNAPS_SQL, LM], "SELECT snap_ts_ns, " + r(*[f"avg(log_mid) FILTER (venue = '{v}') AS {v}" for v in VENUES]) + " FROM lm GROUP BY snap_ts_ns")
q("e16_rulers", lambda s, d: st.rulers(lm(s, d), least=100), [SNAPS_SQL, LM, CS], f"SELECT venue, count(residual) AS n, {r('avg(residual) AS bias', 'greatest(var_samp(residual) - pow(quantile_cont(rel_spread, 0.5), 2) / 12, 1e-12) AS noise_var')} FROM rs GROUP BY venue HAVING count(residual) >= 100")
q("e17_residual_moments", lambda s, d: st.residual_moments(lm(s, d)), [SNAPS_SQL, LM, CS], f"SELECT venue, count(residual) AS n, {r('avg(residual) AS bias', 'greatest(var_pop(residual), 1e-14) AS noise_var')} FROM rs GROUP BY venue HAVING count(residual) >= 51")
q("e18_autocov_noise", lambda s, d: st.noise_by_autocov(snaps(s, d), "log_return", KEY, ["snap_ts_ns"]), [SNAPS_SQL, RET, "a AS (SELECT venue, x, lead(x) OVER (PARTITION BY venue ORDER BY p) AS y FROM rt), b AS (SELECT venue, count(*) AS n, greatest(-2 * covar_pop(x, y), 0) AS nv, var_pop(x) AS v FROM a GROUP BY venue)"], f"SELECT venue, n, {r('nv AS noise_var', 'greatest(v - nv, 1e-12) AS signal_var')} FROM b")
AC = "mm AS (SELECT venue, avg(x) AS m FROM rt GROUP BY venue), cx AS (SELECT rt.venue, p, x - m AS x FROM rt JOIN mm ON rt.venue = mm.venue), s0 AS (SELECT venue, count(*) AS n, sum(x * x) AS s0 FROM cx GROUP BY venue), ac AS (SELECT s0.venue, k.k AS lag, n, (SELECT coalesce(sum(a.x * b.x), 0) FROM cx a JOIN cx b ON a.venue = b.venue AND a.p = b.p + k.k WHERE a.venue = s0.venue) / s0.s0 AS acf FROM s0, range(1, 11) k(k))".replace("s0 AS (SELECT venue, count(*)", "sq AS (SELECT venue, count(*)").replace("s0.venue", "sq.venue").replace("FROM s0,", "FROM sq,").replace("/ s0.s0", "/ sq.s0")
q("e19_acf", lambda s, d: st.acf(snaps(s, d), "log_return", 10, KEY, ["snap_ts_ns"]), [SNAPS_SQL, RET, AC], f"SELECT venue, lag::INT AS lag, {r('acf')} FROM ac")
q("e19_acf_fft", lambda s, d: st.acf_fft(snaps(s, d), "log_return", 10, KEY, ["snap_ts_ns"]), [SNAPS_SQL, RET, AC], f"SELECT venue, lag::INT AS lag, {r('acf')} FROM ac")
q("e19_halflife", lambda s, d: st.acf_halflife(st.acf(snaps(s, d), "log_return", 10, KEY, ["snap_ts_ns"]), KEY), [SNAPS_SQL, RET, AC], "SELECT venue, min(CASE WHEN acf < 0.5 THEN lag END)::INT AS halflife FROM ac GROUP BY venue")
q("e20_ljung_box", lambda s, d: st.ljung_box(snaps(s, d), "log_return", 10, KEY, ["snap_ts_ns"]).drop("p_value"), [SNAPS_SQL, RET, AC], f"SELECT venue, n, {r('n * (n + 2) * sum(acf * acf / (n - lag)) AS q')} FROM ac GROUP BY venue, n", digits=4)
SQL["e20_ljung_box"] = SQL["e20_ljung_box"].replace(", 6) AS q", ", 4) AS q")
q("e21_variance_ratio", lambda s, d: st.variance_ratio(snaps(s, d), "log_return", [2, 5, 10], KEY, ["snap_ts_ns"]), [SNAPS_SQL, RET, "bs AS (SELECT venue, count(*) AS n, var_pop(x) AS v FROM rt GROUP BY venue), ch AS (SELECT rt.venue, k.q, p // k.q AS c, sum(x) AS s FROM rt, (VALUES (2), (5), (10)) k(q) GROUP BY ALL), cv AS (SELECT ch.venue, q, count(*) AS n_chunks, var_pop(s) AS vs, any_value(v) AS v FROM ch JOIN bs ON ch.venue = bs.venue WHERE (c + 1) * q < n GROUP BY ALL)"], f"SELECT venue, q, n_chunks, {r('vs / (q * v) AS vr')} FROM cv WHERE n_chunks >= 10 AND v > 0")
q("e22_ols", lambda s, d: st.ols(lm(s, d), "log_mid", "rel_spread", ["venue"]), [SNAPS_SQL, LM], f"SELECT venue, {r('regr_slope(log_mid, rel_spread) AS slope', 'regr_intercept(log_mid, rel_spread) AS intercept', 'regr_r2(log_mid, rel_spread) AS r2')}, regr_count(log_mid, rel_spread)::BIGINT AS n FROM lm GROUP BY venue", digits=4)
SQL["e22_ols"] = SQL["e22_ols"].replace(", 6) AS slope", ", 4) AS slope").replace(", 6) AS intercept", ", 4) AS intercept").replace(", 6) AS r2", ", 4) AS r2")
q("e23_moments", lambda s, d: st.moments(snaps(s, d), "log_return", ["venue"]), [SNAPS_SQL, RET, "m1 AS (SELECT venue, count(*) AS n, avg(x) AS m, var_samp(x) AS v, stddev_samp(x) AS sd FROM rt GROUP BY venue), m2 AS (SELECT m1.venue, any_value(n) AS n, any_value(m) AS m, any_value(v) AS v, any_value(sd) AS sd, avg(pow(x - m, 2)) AS c2, avg(pow(x - m, 3)) AS c3, avg(pow(x - m, 4)) AS c4 FROM rt JOIN m1 ON rt.venue = m1.venue GROUP BY m1.venue), m3 AS (SELECT *, c3 / pow(c2, 1.5) AS sk, c4 / (c2 * c2) AS ku FROM m2)"], f"SELECT venue, n, {r('m AS mean', 'v AS variance', 'ku AS kurtosis', 'sk AS skewness', 'm / (sd / sqrt(n)) AS t_stat', 'n / 6.0 * (sk * sk + pow(ku - 3, 2) / 4) AS jarque_bera', digits=4)} FROM m3", digits=4)
q("e24_coverage", lambda s, d: st.coverage(lm(s, d).withColumn("p", F.lit(0.5)), "log_mid", "p", [1, 5, 10], ["venue"], ["snap_ts_ns"], 0.1), [SNAPS_SQL, LM, "z AS (SELECT venue, 1 AS k, (lead(log_mid, 1) OVER w - log_mid) / sqrt(0.6) AS z FROM lm WINDOW w AS (PARTITION BY venue ORDER BY snap_ts_ns) UNION ALL SELECT venue, 5, (lead(log_mid, 5) OVER w - log_mid) / sqrt(1.0) FROM lm WINDOW w AS (PARTITION BY venue ORDER BY snap_ts_ns) UNION ALL SELECT venue, 10, (lead(log_mid, 10) OVER w - log_mid) / sqrt(1.5) FROM lm WINDOW w AS (PARTITION BY venue ORDER BY snap_ts_ns))"], f"SELECT venue, k, count(*) AS n, {r('avg((abs(z) < 1)::INT) AS within_1', 'avg((abs(z) < 2)::INT) AS within_2')} FROM z WHERE z IS NOT NULL GROUP BY venue, k HAVING count(*) >= 100")
q("e25_deciles", lambda s, d: st.decile_ratio(snaps(s, d).where("spread > 0"), "spread", "midquote", ["venue"]), [SNAPS_SQL, "e AS (SELECT venue, quantile_cont(spread, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM snaps WHERE spread > 0 GROUP BY venue), b AS (SELECT s.venue, spread, midquote, (least(greatest(len(list_filter(e.e, lambda x: x < s.spread)), 1), 10) - 1)::INT AS bin FROM snaps s JOIN e ON s.venue = e.venue WHERE spread > 0)"], f"SELECT venue, bin, count(*) AS n, {r('avg(midquote) / avg(spread) AS ratio', digits=4)} FROM b GROUP BY ALL", digits=4)
q("e26_member_report", lambda s, d: st.member_report(lm(s, d).select("venue", "snap_ts_ns", "log_mid").withColumn("s", F.lit(0.25)), st.cross_section(lm(s, d)).select("snap_ts_ns", F.col("median").alias("y")), step=HOUR_NS), [SNAPS_SQL, LM, CS, "g AS (SELECT snap_ts_ns, median AS y, lead(median) OVER (ORDER BY snap_ts_ns) AS n FROM cs), j AS (SELECT venue, log_mid - y AS e, n - y AS d FROM lm JOIN g ON lm.snap_ts_ns = g.snap_ts_ns)"], f"SELECT venue, count(*) AS n, {r('avg(e) AS bias_error', 'var_samp(e) / 0.25 AS noise_ratio', 'regr_slope(d, e) AS edge_beta', 'avg(CASE WHEN abs(e) > 0 AND abs(d) > 0 THEN (sign(e) = sign(d))::INT END) AS hit_rate', digits=4)} FROM j GROUP BY venue", digits=4)
RES = "g AS (SELECT snap_ts_ns, median AS y, lead(median) OVER (ORDER BY snap_ts_ns) AS n FROM cs), j AS (SELECT venue, log_mid - y AS e, n - y AS d FROM lm JOIN g ON lm.snap_ts_ns = g.snap_ts_ns WHERE n IS NOT NULL)"
R2 = "rr AS (SELECT venue, count(*) AS n, CASE WHEN count(*) < 100 THEN NULL WHEN regr_syy(d, e) < 1e-30 OR regr_sxx(d, e) <= 0 THEN 0 ELSE regr_r2(d, e) END AS r2 FROM j GROUP BY venue)"


def residual_r2(s, d):
    cross = st.cross_section(lm(s, d)).select("snap_ts_ns", F.col("median").alias("y"))
    return st.residual_r2(lm(s, d).select("venue", "snap_ts_ns", "log_mid"), cross, step=HOUR_NS)


q("m10_residual_r2", residual_r2, [SNAPS_SQL, LM, CS, RES, R2], f"SELECT venue, n, {r('r2')} FROM rr")
q("m10_residual_summary", lambda s, d: st.residual_summary(residual_r2(s, d)), [SNAPS_SQL, LM, CS, RES, R2], f"SELECT count(r2) AS n_members, {r('avg(r2) AS r2_mean', 'max(r2) AS r2_max')} FROM rr")
q("e27_block_error", lambda s, d: st.block_error(snaps(s, d).where("log_return IS NOT NULL").withColumn("r2", F.col("log_return") ** 2).withColumn("h", F.lit(0.5)), "h", "r2", 50, ["venue"], ["snap_ts_ns"]), [SNAPS_SQL, RET, "b AS (SELECT venue, p // 50 AS c, avg(x * x) AS v, count(*) AS m FROM rt GROUP BY ALL), n AS (SELECT venue, count(*) AS n FROM rt GROUP BY venue)"], f"SELECT b.venue, count(*) AS n_blocks, {r('avg(abs(0.5 - v) / v) AS tracking_error')} FROM b JOIN n ON b.venue = n.venue WHERE (c + 1) * 50 < n AND v > 0 GROUP BY b.venue")
q("e28_message_rate", lambda s, d: st.message_rate(ticks(s, d), KEY, "exchange_ts_ns", 24 * HOUR_NS), ["c AS (SELECT venue, exchange_ts_ns // 86400000000000 AS bucket, count(*) / 86400.0 AS rate FROM ticks GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY bucket) AS k FROM c)", "e AS (SELECT venue, bucket, rate, k, rate::DOUBLE AS w FROM k WHERE k = 1 UNION ALL SELECT k.venue, k.bucket, k.rate, k.k, 0.15 * k.rate + 0.85 * e.w FROM e JOIN k ON k.venue = e.venue AND k.k = e.k + 1)"], f"SELECT venue, bucket, {r('rate::DOUBLE AS rate', 'w AS ewma_rate')} FROM e", True)
q("e29_order_stats", lambda s, d: st.order_stats(ticks(s, d).withColumn("lat", (F.col("received_ts_ns") - F.col("exchange_ts_ns")) / 1e6), "lat", ["venue"]), ["l AS (SELECT venue, (received_ts_ns - exchange_ts_ns) / 1e6 AS x FROM ticks), o AS (SELECT venue, list_sort(list(x)) AS v, count(*) AS n FROM l GROUP BY venue)"], f"SELECT venue, n, {r('v[1] AS least', 'v[1] / 2 AS floor', 'v[least(floor(n * 0.5), n - 1)::INT + 1] AS p5', 'v[least(floor(n * 0.9), n - 1)::INT + 1] AS p9', 'v[least(floor(n * 0.99), n - 1)::INT + 1] AS p99', 'v[n] AS most')} FROM o")
QUERIES["a23_latency_probe"], SQL["a23_latency_probe"] = QUERIES["e29_order_stats"], SQL["e29_order_stats"]

rets = lambda s, d: snaps(s, d).withColumn("grp", F.col("venue")).select("grp", "snap_ts_ns", "log_return")
NOISE = "a AS (SELECT venue, x, lead(x) OVER (PARTITION BY venue ORDER BY p) AS y FROM rt), b AS (SELECT venue, greatest(-2 * covar_pop(x, y), 0) AS nv, var_pop(x) AS v FROM a GROUP BY venue)"
q("m2_garch_grid", lambda s, d: cal.garch_grid(rets(s, d)), [SNAPS_SQL, RET, NOISE, *ms.GARCH_GRID], f"SELECT venue AS grp, al AS alpha, be AS beta, {r('nll', digits=5)} FROM gn", True, digits=5)
q("m1_garch_best", lambda s, d: cal.garch_fit(rets(s, d), refine=False), [SNAPS_SQL, RET, NOISE, *ms.GARCH_GRID], f"SELECT venue AS grp, al AS alpha, be AS beta, {r('sv * (1 - al - be) AS omega', 'nv AS noise_var', 'nll', digits=5)} FROM gn QUALIFY row_number() OVER (PARTITION BY venue ORDER BY nll, al, be) = 1", True, digits=5)
q("m1_garch_fit", lambda s, d: cal.garch_fit(rets(s, d)))
q("m4_constant_vol", lambda s, d: cal.constant_vol(rets(s, d)), [SNAPS_SQL], f"SELECT venue AS grp, {r('var_pop(log_return) AS h')} FROM snaps GROUP BY venue")
q("m4_ewma_vol", lambda s, d: cal.ewma_vol(rets(s, d), 0.1).select("grp", "snap_ts_ns", "h"), [SNAPS_SQL, RET, "e AS (SELECT venue, snap_ts_ns, p, (x * x)::DOUBLE AS h FROM rt WHERE p = 0 UNION ALL SELECT rt.venue, rt.snap_ts_ns, rt.p, 0.1 * rt.x * rt.x + 0.9 * e.h FROM e JOIN rt ON rt.venue = e.venue AND rt.p = e.p + 1)"], f"SELECT venue AS grp, snap_ts_ns, {r('h')} FROM e", True)
RB = "c AS (SELECT venue, snap_ts_ns // 21600000000000 AS b, snap_ts_ns, sum(log_return) OVER (PARTITION BY venue, snap_ts_ns // 21600000000000 ORDER BY snap_ts_ns) AS c FROM snaps WHERE log_return IS NOT NULL), g AS (SELECT venue, b, greatest(max(c), 0) AS h, least(min(c), 0) AS l, arg_max(c, snap_ts_ns) AS c FROM c GROUP BY venue, b HAVING count(*) >= 3)"
q("m5_har_path", lambda s, d: cal.har_path(rets(s, d), 6 * HOUR_NS, 6, [1, 4], [0.5, 0.3], -0.2), [SNAPS_SQL, RB, *ms.HAR_PATH], f"SELECT s.venue AS grp, snap_ts_ns, {r('log_return', 'har_h')} FROM snaps s LEFT JOIN hf ON hf.venue = s.venue AND hf.b = snap_ts_ns // 21600000000000")
q("m6_observations", lambda s, d: cal.observations(lm(s, d).select("grp", "venue", "snap_ts_ns", "log_mid")), [SNAPS_SQL, LM, "o AS (SELECT venue, snap_ts_ns, log_mid, dense_rank() OVER (ORDER BY snap_ts_ns) - 1 AS step, lag(log_mid) OVER (PARTITION BY venue ORDER BY snap_ts_ns) AS pl FROM lm), n AS (SELECT *, max(CASE WHEN pl IS NULL OR log_mid <> pl THEN step END) OVER (PARTITION BY venue ORDER BY snap_ts_ns ROWS UNBOUNDED PRECEDING) AS ls FROM o)"], f"SELECT 'G' AS grp, venue, snap_ts_ns, {r('log_mid')}, step::INT AS step, greatest(step - ls, 0)::INT AS age FROM n")
obs = lambda s, d: cal.observations(lm(s, d).select("grp", "venue", "snap_ts_ns", "log_mid"))
rul = lambda s: s.createDataFrame([("G", v, 0.01 * i, 0.1) for i, v in enumerate(("click", "view", "purchase", "signup", "error"))], "grp string, venue string, bias double, noise_var double")
q("m8_em_rulers", lambda s, d: cal.fit_rulers_em(obs(s, d), 0.01))
STEPS = "o AS (SELECT venue, snap_ts_ns, log_mid, dense_rank() OVER (ORDER BY snap_ts_ns) - 1 AS step, lag(log_mid) OVER (PARTITION BY venue ORDER BY snap_ts_ns) AS pl FROM lm), n AS (SELECT *, max(CASE WHEN pl IS NULL OR log_mid <> pl THEN step END) OVER (PARTITION BY venue ORDER BY snap_ts_ns ROWS UNBOUNDED PRECEDING) AS ls FROM o)"
filt = [SNAPS_SQL, LM, STEPS, *ms.SMOOTHER]
q("m9_replay", lambda s, d: cal.replay(obs(s, d), rul(s), 0.01, width=128), filt, f"SELECT 'G' AS grp, step, {r('m AS y', 'p')} FROM sf", True)
q("m7_smoother", lambda s, d: cal.replay(obs(s, d), rul(s), 0.01, width=128, backward=True), filt, f"SELECT 'G' AS grp, step, {r('m AS y', 'p')} FROM sb", True)
q("m10_score", lambda s, d: st.score(snaps(s, d), "log_return", ["venue"], ["snap_ts_ns"]), [SNAPS_SQL, "sc0 AS (SELECT venue AS key, snap_ts_ns AS o, log_return AS x FROM snaps)", *ms.score("sc0", "sc")], f"SELECT key AS venue, {r(*ms.SCORES, digits=4)} FROM sc", digits=4)
MODELS = "md AS (SELECT 'filter' AS model, step, m FROM sf UNION ALL SELECT 'smoother', step, m FROM sb), sc0 AS (SELECT {'m': model, 'part': CASE WHEN step <= (SELECT quantile_cont(step, 0.5) FROM sf) THEN 'in' ELSE 'out' END} AS key, step AS o, m - lag(m) OVER (PARTITION BY model ORDER BY step) AS x FROM md)"
q("m11_model_table", lambda s, d: cal.compare({"filter": cal.replay(obs(s, d), rul(s), 0.01, width=128), "smoother": cal.replay(obs(s, d), rul(s), 0.01, width=128, backward=True)}), [*filt, MODELS, *ms.score("sc0", "sc")], f"SELECT 'G' AS grp, key.part AS part, key.m AS model, {r(*ms.SCORES, digits=4)} FROM sc", True, digits=4)
