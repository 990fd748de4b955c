"""Bars and volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as br
from ..operators import folds, vol
from ..operators.scan import DAY_MS
from ..sources import files
from . import model_sql as ms
from .common import BARS_SQL, BASE_MS, HOUR_NS, KEY, SNAPS_SQL, base_bars, drop_symbol, r, rounded, snaps, sql, ticks

QUERIES, SQL = {}, {}


def q(name, fn, ctes=None, select=None, recursive=False, digits=6):
    QUERIES[name] = lambda s, d: rounded(drop_symbol(fn(s, d)), digits)
    if select:
        SQL[name] = sql(ctes or [], select, recursive)


O = ["open", "high", "low", "close"]
q("d1_bars", base_bars, [BARS_SQL], f"SELECT venue, open_time_ms, {r(*O, 'volume')}, n_src FROM bars")
AGG = "SELECT venue, b * 21600000 AS open_time_ms, {o}, n_src FROM (SELECT venue, open_time_ms // 21600000 AS b, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close, sum(volume) AS volume, count(*)::INT AS n_src FROM bars GROUP BY ALL HAVING count(*) >= 6)".format(o=r(*O, "volume"))
q("d2_bars_target", lambda s, d: br.aggregate_bars(base_bars(s, d), 6, BASE_MS), [BARS_SQL], AGG)
WB = "WINDOW w AS (PARTITION BY venue ORDER BY open_time_ms ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), o AS (PARTITION BY venue ORDER BY open_time_ms)"
ROLL = f"rb AS (SELECT venue, open_time_ms AS t, lead(open_time_ms) OVER o AS n, first_value(open_time_ms) OVER w AS ot, first_value(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close, sum(volume) OVER w AS volume, (count(*) OVER w)::INT AS n_src FROM bars {WB})"
q("d3_rolled_bars", lambda s, d: br.rolled_bars(base_bars(s, d), 6, BASE_MS), [BARS_SQL, ROLL], f"SELECT venue, ot AS open_time_ms, {r(*O, 'volume')}, n_src FROM rb WHERE n // 21600000 > t // 21600000 AND t + 3600000 >= n // 21600000 * 21600000")
q("d4_virtual_head", lambda s, d: br.virtual_head(base_bars(s, d), 6), [BARS_SQL, ROLL], f"SELECT venue, t AS as_of_ms, ot AS open_time_ms, {r(*O)}, n_src FROM rb")
q("d5_bar_retention", lambda s, d: br.retain_bars(base_bars(s, d), 32).select(*KEY, "open_time_ms", "close"), [BARS_SQL], f"SELECT venue, open_time_ms, {r('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY venue ORDER BY open_time_ms DESC) <= 32")
CUT = 1_705_276_800_000
hist = lambda s, d: base_bars(s, d).where(F.col("open_time_ms") < CUT + 10 * BASE_MS).withColumn("close", F.col("close") + 1)
live = lambda s, d: base_bars(s, d).where(F.col("open_time_ms") >= CUT)
q("d6_warmup", lambda s, d: br.with_history(hist(s, d), live(s, d), 512).select(*KEY, "open_time_ms", "close"), [BARS_SQL], f"SELECT venue, open_time_ms, {r(f'CASE WHEN open_time_ms < {CUT} THEN close + 1 ELSE close END AS close')} FROM bars QUALIFY row_number() OVER (PARTITION BY venue ORDER BY open_time_ms DESC) <= 512")
q("d7_bar_status", lambda s, d: br.bar_status(base_bars(s, d)), [BARS_SQL], f"SELECT venue, count(*) - 1 AS n_completed, {r('arg_max(close, open_time_ms) AS last_close', '((SELECT max(open_time_ms) FROM bars) - max(open_time_ms)) / 1000.0 AS partial_age_s')}, true AS has_ticks FROM bars GROUP BY venue")
q("d9_return_bars", lambda s, d: br.return_bars(snaps(s, d), 6 * HOUR_NS, 6), [SNAPS_SQL, "c AS (SELECT venue, snap_ts_ns // 21600000000000 AS b, snap_ts_ns, sum(log_return) OVER (PARTITION BY venue, snap_ts_ns // 21600000000000 ORDER BY snap_ts_ns) AS c FROM snaps WHERE log_return IS NOT NULL), g AS (SELECT venue, b, greatest(max(c), 0) AS h, least(min(c), 0) AS l, arg_max(c, snap_ts_ns) AS c, count(*) AS n FROM c GROUP BY venue, b HAVING count(*) >= 3)"], f"SELECT venue, b * 21600000000000 AS bar_ts_ns, {r('greatest(0.5 * (h - l) * (h - l) - (2 * ln(2) - 1) * c * c, 0) AS gk')}, n FROM g")
by_venue = lambda df: df.drop("symbol", "n_src").withColumnRenamed("venue", "symbol")
q("a11_backfill_merge", lambda s, d: files.with_backfill(by_venue(live(s, d)), by_venue(hist(s, d))).select(F.col("symbol").alias("venue"), "open_time_ms", "close"), [BARS_SQL], f"SELECT venue, open_time_ms, {r(f'CASE WHEN open_time_ms < {CUT} THEN close + 1 ELSE close END AS close')} FROM bars")

P = vol.VolParams(
    target_min=6, f_h=[1 + 0.02 * h for h in range(24)], f_d=[1 + 0.1 * x for x in range(7)],
    har_ols={"intercept": -0.5, "betas": [0.3, 0.4, 0.2], "windows": [1, 6, 24]}, har_qlike={"intercept": -0.4, "betas": [0.5, 0.4], "windows": [1, 12]},
    garch={"omega": 0.05, "alpha": 0.1, "beta": 0.85, "scale_factor": 1.5, "last_h": 1.0, "cal_a": 0.1, "cal_b": 0.9},
)
SEAS = "sb AS (SELECT *, (1 + 0.02 * hour(make_timestamp(open_time_ms * 1000))) * (1 + 0.1 * (isodow(make_timestamp(open_time_ms * 1000)) - 1)) AS sf FROM gkb), db AS (SELECT *, gk / sf AS dgk, ln(close / open) / sqrt(sf) AS dr, row_number() OVER (PARTITION BY venue ORDER BY open_time_ms) AS k FROM sb)"
q("l1_gk", lambda s, d: base_bars(s, d).select(*KEY, "open_time_ms", vol.gk().alias("gk")), [BARS_SQL], f"SELECT venue, open_time_ms, {r('gk')} FROM gkb")
q("l2_gk_deseasoned", lambda s, d: base_bars(s, d).select(*KEY, "open_time_ms", vol.deseasoned_gk(P).alias("gk"), vol.deseasoned_log_return(P).alias("ret")), [BARS_SQL, SEAS], f"SELECT venue, open_time_ms, {r('dgk AS gk', 'dr AS ret')} FROM db")
EW = ["p AS (SELECT venue, snap_ts_ns, ln(midquote) AS lp, row_number() OVER (PARTITION BY venue ORDER BY snap_ts_ns) AS k FROM snaps)",
      "e AS (SELECT venue, snap_ts_ns, lp, k, 1e-12::DOUBLE AS h FROM p WHERE k = 1 UNION ALL SELECT p.venue, p.snap_ts_ns, p.lp, p.k, greatest(pow(2, -3600000.0 / 86400000.0) * e.h + (1 - pow(2, -3600000.0 / 86400000.0)) * pow(p.lp - e.lp, 2) / 3600000.0, 1e-14) FROM e JOIN p ON p.venue = e.venue AND p.k = e.k + 1)"]
q("l4_ewma_vol", lambda s, d: vol.ewma_vol_path(snaps(s, d), 86_400_000.0, 1e-12, 1e-14).select(*KEY, "snap_ts_ns", (F.col("h_per_ms") * 1e9).alias("h")), [SNAPS_SQL, *EW], f"SELECT venue, snap_ts_ns, {r('h * 1e9 AS h')} FROM e", True)
HL = "pow(2, -3600000.0 / 86400000.0)"
GE = [f"e AS (SELECT venue, open_time_ms, k, CASE WHEN gk > 0 THEN {HL} * -2.0 + (1 - {HL}) * ln(gk) ELSE -2.0 END::DOUBLE AS m, CASE WHEN gk > 0 THEN {HL} * 4.0 + (1 - {HL}) * pow(ln(gk), 2) ELSE 4.0 END::DOUBLE AS q FROM db WHERE k = 1 UNION ALL SELECT p.venue, p.open_time_ms, p.k, CASE WHEN p.gk > 0 THEN {HL} * e.m + (1 - {HL}) * ln(p.gk) ELSE e.m END, CASE WHEN p.gk > 0 THEN {HL} * e.q + (1 - {HL}) * pow(ln(p.gk), 2) ELSE e.q END FROM e JOIN db p ON p.venue = e.venue AND p.k = e.k + 1)"]
q("l5_gk_ewma", lambda s, d: vol.gk_ewma_path(base_bars(s, d), BASE_MS, 86_400_000.0, -2.0, -60.0).select(*KEY, "open_time_ms", "ewma_log_gk", "ewma_log_gk_sq"), [BARS_SQL, SEAS, *GE], f"SELECT venue, open_time_ms, {r('m AS ewma_log_gk', 'q AS ewma_log_gk_sq')} FROM e", True)
q("l5_gk_virtual", lambda s, d: vol.gk_virtual(snaps(s, d), s.createDataFrame([(v, "SYM", -2.0, 4.2) for v in ("click", "view", "purchase", "signup", "error")], "venue string, symbol string, ewma_log_gk double, ewma_log_gk_sq double"), 21_600_000, 86_400_000.0).select(*KEY, "snap_ts_ns", (F.col("h_per_ms") * 1e6).alias("h")),
  [SNAPS_SQL, "v AS (SELECT venue, snap_ts_ns, first_value(midquote) OVER w AS o, max(midquote) OVER w AS h, min(midquote) OVER w AS l, midquote AS c, count(*) OVER w AS n FROM snaps WINDOW w AS (PARTITION BY venue ORDER BY snap_ts_ns // 1000000 RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)), g AS (SELECT *, greatest(0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2), 0) AS gk FROM v WHERE n >= 2 AND venue IN ('click', 'view', 'purchase', 'signup', 'error')), z AS (SELECT venue, snap_ts_ns, pow(2, -0.25) * -2.0 + (1 - pow(2, -0.25)) * ln(gk) AS m, pow(2, -0.25) * 4.2 + (1 - pow(2, -0.25)) * pow(ln(gk), 2) AS q FROM g WHERE gk > 0)"], f"SELECT venue, snap_ts_ns, {r('exp(m + greatest(q - m * m, 0) / 2) / 21600000.0 * 1e6 AS h')} FROM z")
WIN = lambda n: f"CASE WHEN k >= {n} AND sum({{g}}) OVER (PARTITION BY venue ORDER BY open_time_ms ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) > 1e-300 THEN ln(sum({{g}}) OVER (PARTITION BY venue ORDER BY open_time_ms ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) END"
q("l6_har_features", lambda s, d: vol.har_features(base_bars(s, d), [6, 24]).select(*KEY, "open_time_ms", "log_rv_6", "log_rv_24"), [BARS_SQL, SEAS], f"SELECT venue, open_time_ms, {r(WIN(6).format(g='gk') + ' AS log_rv_6', WIN(24).format(g='gk') + ' AS log_rv_24')} FROM db")
QUERIES["f4_trailing_sum"], SQL["f4_trailing_sum"] = QUERIES["l6_har_features"], SQL["l6_har_features"]
HAR = {"intercept": -0.5, "betas": [0.4, 0.3], "windows": [6, 24]}
q("l6_har_predict", lambda s, d: vol.har_predict(vol.har_features(base_bars(s, d), [6, 24], P), HAR).where("log_pred IS NOT NULL").select(*KEY, "open_time_ms", "log_pred", vol.annualise(F.col("log_pred"), vol.seasonal(P), 60.0).alias("ann_vol")), [BARS_SQL, SEAS, f"h AS (SELECT venue, open_time_ms, sf, -0.5 + 0.4 * ({WIN(6).format(g='dgk')}) + 0.3 * ({WIN(24).format(g='dgk')}) AS lp FROM db)"], f"SELECT venue, open_time_ms, {r('lp AS log_pred', 'sqrt(exp(lp) * sf * (525960.0 / 60)) AS ann_vol')} FROM h WHERE lp IS NOT NULL")
GA = ["g AS (SELECT venue, open_time_ms, k, (0.05 + 0.1 * pow(dr * 1.5, 2) + 0.85)::DOUBLE AS h FROM db WHERE k = 1 UNION ALL SELECT p.venue, p.open_time_ms, p.k, 0.05 + 0.1 * pow(p.dr * 1.5, 2) + 0.85 * g.h FROM g JOIN db p ON p.venue = g.venue AND p.k = g.k + 1)"]
q("l7_garch", lambda s, d: vol.garch_path(base_bars(s, d), P).select(*KEY, "open_time_ms", "garch_h", "garch_log_var"), [BARS_SQL, SEAS, *GA], f"SELECT venue, open_time_ms, {r('h AS garch_h', '0.1 + 0.9 * ln(h / 2.25) AS garch_log_var')} FROM g", True)
q("l7_garch_final", lambda s, d: folds.last_state(base_bars(s, d).withColumn("x", vol.deseasoned_log_return(P) * 1.5), KEY, ["open_time_ms"], ["x"], folds.Garch(0.05, 0.1, 0.85, 1.0), 64 * DAY_MS).select(*KEY, F.col("_st_h").alias("garch_h")), [BARS_SQL, SEAS, *GA], f"SELECT venue, {r('arg_max(h, k) AS garch_h')} FROM g GROUP BY venue", True)
LG = ["e AS (SELECT venue, open_time_ms, k, CASE WHEN dgk > 0 THEN ln(dgk) END AS s FROM db WHERE k = 1 UNION ALL SELECT p.venue, p.open_time_ms, p.k, CASE WHEN p.dgk > 0 THEN CASE WHEN e.s IS NULL THEN ln(p.dgk) ELSE 0.5 * ln(p.dgk) + 0.5 * e.s END ELSE e.s END FROM e JOIN db p ON p.venue = e.venue AND p.k = e.k + 1)"]
q("l8_log_gk_ewma", lambda s, d: vol.log_gk_ewma_path(base_bars(s, d), P, 60.0).select(*KEY, "open_time_ms", "ewma_log_gk"), [BARS_SQL, SEAS, *LG], f"SELECT venue, open_time_ms, {r('s AS ewma_log_gk')} FROM e", True)
q("l9_realized", lambda s, d: vol.realized(base_bars(s, d), 60.0, 360).select(*KEY, "open_time_ms", "realized_vol"), [BARS_SQL, "v AS (SELECT venue, open_time_ms, avg(gk) OVER (PARTITION BY venue ORDER BY open_time_ms ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM gkb)"], f"SELECT venue, open_time_ms, {r('CASE WHEN x > 1e-300 THEN sqrt(x * (525960.0 / 60)) END AS realized_vol')} FROM v")
q("l10_predict", lambda s, d: vol.predict(base_bars(s, d), P, 60.0), [BARS_SQL, ROLL, *ms.PREDICT], f"SELECT venue, {ms.STATUS}, {r(*ms.PREDICTED)} FROM nw", True)
q("i4_vol_table", lambda s, d: vol.predict(base_bars(s, d), P, 60.0).join(br.bar_status(base_bars(s, d)).select(*KEY, "last_close"), KEY), [BARS_SQL, ROLL, *ms.PREDICT], f"SELECT venue, {ms.STATUS}, {r(*ms.PREDICTED, '(SELECT arg_max(close, open_time_ms) FROM bars WHERE bars.venue = nw.venue) AS last_close')} FROM nw", True)
