"""The models' recurrences as recursive SQL: Kalman filters, smoother, GARCH grid, volatility predictions, validation scores."""

from __future__ import annotations

DIMS = 4  # price and the biases of at most three members; missing members stay at 0


def _sym(name: str, i: int, j: int) -> str:
    return f"{name}{min(i, j)}{max(i, j)}"


def kalman(step_ns: int, h: float, h_bias: float, init: float, upto: str = "max(b)") -> list[str]:
    """Rows of ``kf``: the state after each tick (kind 0) and at each interval's end (kind 1), from ``ob`` (t, lm, hs, bias, noise_var).

    ``upto``: the last interval of a group, its last tick's by default."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    case = lambda f: "CASE ek " + " ".join(f"WHEN {k} THEN {f(k)}" for k in range(1, DIMS)) + " ELSE 0 END"
    grown = ", ".join(f"p{i}{j} + {(h_bias if i else h)!r} * tau AS q{i}{j}" if i == j else f"p{i}{j} AS q{i}{j}" for i, j in pairs)
    gains = ", ".join(f"{_sym('q', 0, j)} + {case(lambda k: _sym('q', k, j))} AS u{j}" for j in range(DIMS))
    spread = f"q00 + 2 * {case(lambda k: _sym('q', 0, k))} + {case(lambda k: _sym('q', k, k))} + env"
    state = ", ".join(f"CASE WHEN ekind = 0 THEN x{i} + u{i} / s1 * inn1 ELSE x{i} END AS x{i}" for i in range(DIMS))
    cover = ", ".join(f"CASE WHEN ekind = 0 THEN q{i}{j} - u{i} * u{j} / s1 ELSE q{i}{j} END AS p{i}{j}" for i, j in pairs)
    start = ", ".join(f"{0.0 if i != j else init}::DOUBLE AS p{i}{j}" if (i, j) != (0, 0) else "noise_var::DOUBLE AS p00" for i, j in pairs)
    return [
        "mk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY venue) AS k FROM (SELECT DISTINCT grp, venue, bias, noise_var FROM ob))",
        "mb1 AS (SELECT grp, " + ", ".join(f"coalesce(max(bias) FILTER (k = {k}), 0)::DOUBLE AS b{k}" for k in range(1, DIMS)) + " FROM mk GROUP BY grp)",
        f"tk AS (SELECT ob.grp, (t - 1) // {step_ns} AS b, t, mk.k, lm, hs * hs AS nv, seq FROM ob JOIN mk ON ob.grp = mk.grp AND ob.venue = mk.venue)",
        f"""ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY b, kind, t, k, seq) AS i FROM (SELECT grp, b, 0 AS kind, t, k, lm, nv, seq FROM tk
    UNION ALL SELECT grp, b, 1, (b + 1) * {step_ns}, 0, NULL, NULL, 0 FROM (SELECT grp, unnest(range(min(b), {upto} + 1)) AS b FROM tk GROUP BY grp)))""",
        f"""kf AS (SELECT ev.grp, 0::BIGINT AS i, -1 AS kind, ev.b, ev.t, ev.t AS past, ev.k, lm, (lm - bias)::DOUBLE AS x0, b1 AS x1, b2 AS x2, b3 AS x3, {start}, 0.0::DOUBLE AS ps, 0::BIGINT AS used, 0::BIGINT AS last, 0::BIGINT AS seen,
    0.0::DOUBLE AS tau, 0.0::DOUBLE AS pre, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS inn, 0.0::DOUBLE AS s, 0.0::DOUBLE AS gain FROM ev JOIN mk ON ev.grp = mk.grp AND ev.k = mk.k JOIN mb1 ON ev.grp = mb1.grp WHERE i = 1
  UNION ALL SELECT grp, i + 1, ekind, eb, et, et, ek, elm, {state}, {cover}, CASE WHEN ekind = 1 THEN q00 ELSE ps END, CASE WHEN ekind = 1 THEN 0 ELSE used + 1 END, past, used,
    tau1, CASE WHEN ekind = 1 THEN p00 ELSE q00 END, ps, inn1, s1, u0 / s1
  FROM (SELECT *, {spread} AS s1, elm - x0 - {case(lambda k: f'x{k}')} AS inn1, {gains} FROM (SELECT *, {grown.replace('* tau', '* tau1')} FROM (
    SELECT f.*, e.kind AS ekind, e.b AS eb, e.t AS et, e.k AS ek, e.lm AS elm, e.nv AS env, greatest((e.t - f.past) / 1e6, 0)::DOUBLE AS tau1 FROM kf f JOIN ev e ON e.grp = f.grp AND e.i = f.i + 1))))""",
        f"ks AS (SELECT grp, t AS snap_ts_ns, x0 AS y, p00 AS p, p0 AS p_pre, pre AS p_pre_fwd, tau AS tau_fwd_ms, seen AS n, last FROM kf WHERE kind = 1)",
        f"kt AS (SELECT grp, (b + 1) * {step_ns} AS snap_ts_ns, t AS tick_ts_ns, k - 1 AS member_idx, lm AS log_mid, tau AS tau_ms, {h!r} * tau AS q, pre AS p_pre, inn AS innovation, s, gain, x0 AS y_post, p00 AS p_post FROM kf WHERE kind = 0)",
    ]


#: Bias of each member against the fair price before each tick, from ``ob`` and ``fr`` (grp, snap_ts_ns, y); halflife one hour.
GG_BIAS = [
    "gb AS (SELECT o.grp, o.venue, o.seq, o.t, o.bias, o.lm - f.y AS res, row_number() OVER (PARTITION BY o.grp, o.venue ORDER BY o.t, o.seq) AS k FROM ob o ASOF JOIN fr f ON o.grp = f.grp AND o.t >= f.snap_ts_ns)",
    """ge AS (SELECT grp, venue, seq, t, k, 0.0::DOUBLE AS w, bias::DOUBLE AS b FROM gb WHERE k = 1
  UNION ALL SELECT grp, venue, eseq, et, k + 1, CASE WHEN a > 0 THEN a + (1 - a) * w ELSE w END, CASE WHEN a > 0 THEN b + a / (a + (1 - a) * w) * (res - b) ELSE b END
  FROM (SELECT g.*, e.seq AS eseq, e.t AS et, e.res, 1 - pow(2, -(greatest(e.t - g.t, 0) / 1e6) / 3600000.0) AS a FROM ge g JOIN gb e ON e.grp = g.grp AND e.venue = g.venue AND e.k = g.k + 1))""",
]

#: Scalar filter (``sf``) over steps with fixed rulers, from ``n`` (venue, step, ls, log_mid), and the backward pass (``sb``).
SMOOTHER = [
    "rl AS (SELECT * FROM (VALUES ('click', 0.0::DOUBLE), ('view', 0.01), ('purchase', 0.02), ('signup', 0.03), ('error', 0.04)) v(venue, bias))",
    "so AS MATERIALIZED (SELECT n.step, log_mid - bias AS z, 0.1 + 0.01 * greatest(n.step - ls, 0) AS r, row_number() OVER (ORDER BY n.step, n.venue) AS i FROM n JOIN rl ON n.venue = rl.venue)",
    """sr AS (SELECT i, step, z::DOUBLE AS x, r::DOUBLE AS v, z::DOUBLE AS mp, r::DOUBLE AS pp FROM so WHERE i = 1
  UNION ALL SELECT i, step, x + v1 / (v1 + r) * (z - x), v1 * (1 - v1 / (v1 + r)), mp1, pp1 FROM (SELECT o.i, o.step, o.z, o.r, f.x, f.v + CASE WHEN o.step > f.step THEN 0.01 ELSE 0 END AS v1,
    CASE WHEN o.step > f.step THEN f.x ELSE f.mp END AS mp1, CASE WHEN o.step > f.step THEN f.v + 0.01 ELSE f.pp END AS pp1 FROM sr f JOIN so o ON o.i = f.i + 1))""",
    "sf AS MATERIALIZED (SELECT step, arg_max(x, i) AS m, arg_max(v, i) AS p, arg_max(mp, i) AS mp, arg_max(pp, i) AS pp FROM sr GROUP BY step)",
    """sb AS (SELECT step, m, p, mp, pp FROM sf WHERE step = (SELECT max(step) FROM sf)
  UNION ALL SELECT f.step, f.m + f.p / b.pp * (b.m - b.mp), f.p + pow(f.p / b.pp, 2) * (b.p - b.pp), f.mp, f.pp FROM sb b JOIN sf f ON f.step = b.step - 1)""",
]


def score(src: str, to: str) -> list[str]:
    """acf_1, lb_q, p_value and variance ratios by ``key`` of a series ``src`` (key, o, x)."""
    return [
        f"{to}_rt AS MATERIALIZED (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS p FROM {src} WHERE x IS NOT NULL)",
        f"{to}_cx AS MATERIALIZED (SELECT key, p, x - avg(x) OVER (PARTITION BY key) AS x FROM {to}_rt)",
        f"{to}_sq AS (SELECT key, count(*) AS n, sum(x * x) AS s0 FROM {to}_cx GROUP BY key)",
        f"{to}_lg AS (SELECT a.key, k.k AS lag, sum(a.x * b.x) AS s FROM {to}_cx a, {to}_cx b, range(1, 11) k(k) WHERE a.key = b.key AND a.p = b.p + k.k GROUP BY ALL)",
        f"{to}_lb AS (SELECT l.key, max(s / s0) FILTER (lag = 1) AS acf_1, any_value(n) * (any_value(n) + 2) * sum(pow(s / s0, 2) / (n - lag)) AS lb_q FROM {to}_lg l JOIN {to}_sq q ON l.key = q.key GROUP BY l.key)",
        f"{to}_ch AS (SELECT key, q, p // q AS c, sum(x) AS s FROM {to}_rt, (VALUES (2), (5), (10)) k(q) GROUP BY ALL)",
        f"{to}_vr AS (SELECT c.key, q, var_pop(s) / (q * any_value(v)) AS vr FROM {to}_ch c JOIN (SELECT key, count(*) AS n, var_pop(x) AS v FROM {to}_rt GROUP BY key) b ON c.key = b.key WHERE (c + 1) * q < n AND v > 0 GROUP BY c.key, q HAVING count(*) >= 10)",
        f"{to} AS (SELECT l.key, acf_1, lb_q, exp(-lb_q / 2) * (1 + lb_q / 2 + pow(lb_q / 2, 2) / 2 + pow(lb_q / 2, 3) / 6 + pow(lb_q / 2, 4) / 24) AS p_value, max(vr) FILTER (q = 2) AS vr_2, max(vr) FILTER (q = 5) AS vr_5, max(vr) FILTER (q = 10) AS vr_10 FROM {to}_lb l LEFT JOIN {to}_vr v ON l.key = v.key GROUP BY ALL)",
    ]


SCORES = ["acf_1", "lb_q", "p_value", "vr_2", "vr_5", "vr_10"]

#: Likelihood of every point of the default grid, from ``rt`` (venue, x, p) and ``b`` (venue, nv, v).
GARCH_GRID = [
    "ba AS (SELECT venue, nv, greatest(v - nv, 1e-12) AS sv FROM b)",
    "gl AS (SELECT venue, nv, sv, i / 100.0::DOUBLE AS al, j / 100.0::DOUBLE AS be FROM ba, range(1, 16) a(i), range(80, 99) c(j) WHERE i / 100.0::DOUBLE + j / 100.0::DOUBLE < 0.9999)",
    """gp AS (SELECT venue, al, be, nv, sv, -1::BIGINT AS p, sv::DOUBLE AS h, 0.0::DOUBLE AS cost FROM gl
  UNION ALL SELECT g.venue, al, be, nv, sv, rt.p, sv * (1 - al - be) + al * greatest(x * x - nv, 0) + be * h, cost + ln(h + nv) + x * x / (h + nv) FROM gp g JOIN rt ON rt.venue = g.venue AND rt.p = g.p + 1)""",
    "gn AS (SELECT venue, al, be, any_value(nv) AS nv, any_value(sv) AS sv, 0.5 * arg_max(cost, p) AS nll FROM gp GROUP BY venue, al, be)",
]

#: HAR variance on six-hour return bars, from ``g`` (venue, b, h, l, c) of the return bars.
HAR_PATH = [
    "hg AS (SELECT venue, b, greatest(0.5 * (h - l) * (h - l) - (2 * ln(2) - 1) * c * c, 0) AS gk, row_number() OVER (PARTITION BY venue ORDER BY b) AS k FROM g)",
    "hs AS (SELECT venue, b, k, gk AS s1, sum(gk) OVER (PARTITION BY venue ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s4 FROM hg)",
    "hx AS (SELECT venue, b, lag(exp(-0.2 + 0.5 * CASE WHEN s1 > 0 THEN ln(s1) END + 0.3 * CASE WHEN k >= 4 AND s4 > 0 THEN ln(s4) END)) OVER (PARTITION BY venue ORDER BY b) AS x FROM hs)",
    "hf AS (SELECT venue, b, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY venue ORDER BY b ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY venue ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS har_h FROM hx)",
]


def _season(ms: str) -> str:
    return f"(1 + 0.02 * hour(make_timestamp({ms} * 1000))) * (1 + 0.1 * (isodow(make_timestamp({ms} * 1000)) - 1))"


def _trail(n: int) -> str:
    return f"sum(dg) OVER (PARTITION BY venue ORDER BY o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _har(intercept: float, parts: list[tuple[float, int]]) -> str:
    return f"{intercept}" + "".join(f" + {be} * CASE WHEN {_trail(n)} > 0 THEN ln({_trail(n)}) END" for be, n in parts)


#: Predictions at the newest bar, from ``bars`` and ``rb`` (rolled heads); six base bars of one hour make a bar.
PREDICT = [
    "dn AS (SELECT venue, b * 21600000 AS ot, open, high, low, close FROM (SELECT venue, open_time_ms // 21600000 AS b, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close FROM bars GROUP BY ALL HAVING count(*) >= 6))",
    "hd AS (SELECT venue, t, ot, open, high, low, close FROM rb QUALIFY row_number() OVER (PARTITION BY venue ORDER BY t DESC) = 1)",
    "se AS (SELECT venue, ot AS o, ot, open, high, low, close FROM dn UNION ALL SELECT venue, 1152921504606846976, ot, open, high, low, close FROM hd)",
    f"sx AS (SELECT *, greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0) AS gk, {_season('ot')} AS sf, row_number() OVER (PARTITION BY venue ORDER BY o) AS k FROM se)",
    "sy AS MATERIALIZED (SELECT *, gk / sf AS dg, ln(close / open) / sqrt(sf) * 1.5 AS rr FROM sx)",
    f"sz AS (SELECT venue, k, o, gk, {_har(-0.5, [(0.3, 1), (0.4, 6), (0.2, 24)])} AS ols, {_har(-0.4, [(0.5, 1), (0.4, 12)])} AS qlike FROM sy)",
    """sv AS (SELECT venue, k, (0.05 + 0.1 * rr * rr + 0.85)::DOUBLE AS h, CASE WHEN dg > 0 THEN ln(dg) END::DOUBLE AS e FROM sy WHERE k = 1
  UNION ALL SELECT y.venue, y.k, 0.05 + 0.1 * y.rr * y.rr + 0.85 * v.h, CASE WHEN y.dg > 0 THEN CASE WHEN v.e IS NULL THEN ln(y.dg) ELSE (1 - pow(2, -6)) * ln(y.dg) + pow(2, -6) * v.e END ELSE v.e END FROM sv v JOIN sy y ON y.venue = v.venue AND y.k = v.k + 1)""",
    f"nw AS (SELECT hd.venue, coalesce((SELECT count(*) FROM dn WHERE dn.venue = hd.venue), 0) AS n, {_season('hd.t')} * 525960.0 / 360 AS f, gk, ols, qlike, h, e FROM hd JOIN sz ON hd.venue = sz.venue AND sz.o = 1152921504606846976 JOIN sv ON sv.venue = sz.venue AND sv.k = sz.k)",
]
PREDICTED = [f"CASE WHEN n >= 23 THEN {x} END AS {c}" for c, x in (("har_ols", "sqrt(exp(ols) * f)"), ("har_qlike", "sqrt(exp(qlike) * f)"), ("garch", "sqrt(exp(0.1 + 0.9 * ln(h / 2.25)) * f)"), ("ewma", "sqrt(exp(e) * f)"), ("realized", "CASE WHEN gk > 0 THEN sqrt(gk * 525960.0 / 360) END"))]
STATUS = "n AS n_completed, CASE WHEN n >= 23 THEN 'Ok' ELSE 'InsufficientBars' END AS status"
