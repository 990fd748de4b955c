"""Volatility: Garman-Klass, seasonality, HAR, GARCH, EWMA, realized."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MS_PER_YEAR, hour_utc, weekday_monday0
from . import folds
from .scan import DAY_MS, DAY_NS

KEY = ("venue", "symbol")
MINUTES_PER_YEAR = 525_960.0
EWMA_HALFLIFE_MIN, RV_LOOKBACK_MIN = 60, 60


@dataclass
class VolParams:
    """HAR windows and betas, GARCH, and multiplicative seasonality by hour and weekday (Monday first)."""

    target_min: int = 5
    f_h: list[float] = field(default_factory=lambda: [1.0] * 24)
    f_d: list[float] = field(default_factory=lambda: [1.0] * 7)
    har_ols: dict | None = None  # {"intercept", "betas", "windows"}
    har_qlike: dict | None = None
    garch: dict | None = None  # {"omega", "alpha", "beta", "scale_factor", "last_h", "cal_a", "cal_b"}

    def max_window(self) -> int:
        return max([max(h["windows"], default=0) for h in (self.har_ols, self.har_qlike) if h] or [288])


def gk(o="open", h="high", l="low", c="close") -> Column:
    """max(0.5 ln(H/L)^2 - (2 ln 2 - 1) ln(C/O)^2, 0); 0 if a price isn't positive."""
    return F.expr(f"CASE WHEN {o} > 0 AND {h} > 0 AND {l} > 0 AND {c} > 0 THEN greatest(0.5D * power(ln({h} / {l}), 2) - (2 * ln(2D) - 1) * power(ln({c} / {o}), 2), 0D) ELSE 0D END")


def seasonal(p: VolParams, ms: str = "open_time_ms") -> Column:
    fh, fd = F.array(*map(F.lit, p.f_h)), F.array(*map(F.lit, p.f_d))
    return F.element_at(fh, hour_utc(ms) + 1) * F.element_at(fd, weekday_monday0(ms) + 1)


def deseasoned_gk(p: VolParams, ms: str = "open_time_ms") -> Column:
    s = seasonal(p, ms)
    return F.when(s > 0, gk() / s).otherwise(F.lit(0.0))


def deseasoned_log_return(p: VolParams, ms: str = "open_time_ms") -> Column:
    s = seasonal(p, ms)
    return F.when((s > 0) & (F.col("open") > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.col("open")) / F.sqrt(s)).otherwise(F.lit(0.0))


def static_h_per_ms(ann_vol: float) -> float:
    return ann_vol * ann_vol / MS_PER_YEAR


def h_to_ann_vol(h: Column) -> Column:
    return F.sqrt(h * MS_PER_YEAR)


def har_features(bars: DataFrame, windows: list[int], p: VolParams | None = None, key=KEY) -> DataFrame:
    """ln of trailing sums of (deseasonalised) Garman-Klass variance; NULL until a window is full or where a sum is 0."""
    w = Window.partitionBy(*key).orderBy("open_time_ms")
    b = bars.withColumn("gk", deseasoned_gk(p) if p else gk()).withColumn("_rn", F.row_number().over(w))
    for n in windows:
        s = F.sum("gk").over(w.rowsBetween(-(n - 1), 0))
        b = b.withColumn(f"log_rv_{n}", F.when((F.col("_rn") >= n) & (s > 0), F.ln(s)))
    return b.drop("_rn")


def har_predict(features: DataFrame, har: dict, out: str = "log_pred") -> DataFrame:
    if len(har["betas"]) != len(har["windows"]):
        raise ValueError("one beta for each window")
    x = F.lit(float(har["intercept"]))
    for b, n in zip(har["betas"], har["windows"]):
        x = x + F.lit(float(b)) * F.col(f"log_rv_{n}")
    return features.withColumn(out, x)


def annualise(log_var: Column, seasonal_now: Column | float, bar_min: float) -> Column:
    return F.sqrt(F.exp(log_var) * seasonal_now * (MINUTES_PER_YEAR / bar_min))


def realized(bars: DataFrame, bar_min: float, lookback_min: int = RV_LOOKBACK_MIN, key=KEY) -> DataFrame:
    """Annualised mean variance over the lookback's bars, the newest included; short histories use what there is."""
    n = max(int(lookback_min // bar_min), 1)
    f = Window.partitionBy(*key).orderBy("open_time_ms").rowsBetween(-(n - 1), 0)
    b = bars.withColumn("gk", gk())
    s = F.sum("gk").over(f) / F.count("*").over(f)
    return b.withColumn("realized_vol", F.when(s > 0, F.sqrt(s * (MINUTES_PER_YEAR / bar_min))))


def garch_path(bars: DataFrame, p: VolParams, key=KEY, bucket_ms: int = 64 * DAY_MS) -> DataFrame:
    """garch_h after each bar, and garch_log_var: calibrated log variance cal_a + cal_b ln(h / scale^2)."""
    g = p.garch
    b = bars.withColumn("_r", deseasoned_log_return(p) * g["scale_factor"])
    rec = folds.Garch(g["omega"], g["alpha"], g["beta"], g["last_h"])
    b = folds.scan(b, key, ["open_time_ms"], ["_r"], rec, {"garch_h": "double"}, bucket_ms)
    h = F.col("garch_h") / (g["scale_factor"] ** 2)
    return b.drop("_r").withColumn("garch_log_var", F.when(h > 0, g["cal_a"] + g["cal_b"] * F.ln(h)))


def log_gk_ewma_path(bars: DataFrame, p: VolParams, bar_min: float, key=KEY, bucket_ms: int = 64 * DAY_MS) -> DataFrame:
    b = bars.withColumn("_g", deseasoned_gk(p))
    rec = folds.LogGkEwma(EWMA_HALFLIFE_MIN / bar_min)
    out = folds.scan(b, key, ["open_time_ms"], ["_g"], rec, {"ewma_log_gk": "double"}, bucket_ms).drop("_g")
    return out.withColumn("ewma_log_gk", F.nanvl("ewma_log_gk", F.lit(None).cast("double")))


def ewma_vol_path(
    prices: DataFrame, halflife_ms: float, start: float, floor: float, key=KEY, price: str = "midquote", ts: str = "snap_ts_ns", bucket_ns: int = 8 * DAY_NS
) -> DataFrame:
    return folds.scan(prices, key, [ts], [price, ts], folds.EwmaVar(halflife_ms, start, floor), {"h_per_ms": "double"}, bucket_ns)


def gk_ewma_path(bars: DataFrame, bar_ms: float, halflife_ms: float, start: float, floor_log: float, floor_h: float = 0.0, key=KEY) -> DataFrame:
    b = bars.withColumn("gk", gk())
    return folds.path(b, key, ["open_time_ms"], ["gk"], lambda g: folds.gk_ewma(g, bar_ms, halflife_ms, start, floor_log, floor_h), {"ewma_log_gk": "double", "ewma_log_gk_sq": "double", "h_per_ms": "double"})


def gk_virtual(prices: DataFrame, state: DataFrame, window_ms: int, halflife_ms: float, floor_h: float = 0.0, key=KEY, price: str = "midquote", ts: str = "snap_ts_ns") -> DataFrame:
    """One virtual step on the rolling window of prices: ``state`` has (key, ewma_log_gk, ewma_log_gk_sq); all windows are native."""
    w = Window.partitionBy(*key).orderBy(F.expr(f"`{ts}` DIV 1000000")).rangeBetween(-window_ms, 0)
    b = prices.where(F.col(price) > 0).select(*key, ts, F.first(price).over(w).alias("open"), F.max(price).over(w).alias("high"), F.min(price).over(w).alias("low"), F.col(price).alias("close"), F.count("*").over(w).alias("n"))
    b = b.withColumn("gk", gk()).where("n >= 2 AND gk > 0").join(state, list(key))
    d = f"exp(-{float(window_ms)!r}D * ln(2D) / {float(halflife_ms)!r}D)"
    b = b.withColumn("_m", F.expr(f"{d} * ewma_log_gk + (1 - {d}) * ln(gk)")).withColumn("_q", F.expr(f"{d} * ewma_log_gk_sq + (1 - {d}) * power(ln(gk), 2)"))
    return b.withColumn("h_per_ms", F.expr(f"greatest(exp(_m + greatest(_q - _m * _m, 0D) / 2) / {float(window_ms)!r}D, {float(floor_h)!r}D)")).drop("_m", "_q")


def predict(bars: DataFrame, p: VolParams, base_min: float = 1.0, known: DataFrame | None = None, key=KEY) -> DataFrame:
    """All predictions of each key at its newest base bar, which is taken as the live one, with a status.

    ``bars`` are base bars; the target bars are their complete groups, the head is the last ``target`` base bars. ``known`` lists keys
    that should be there (others are UnknownSymbol, those without bars NoTicks).
    """
    from .bars import aggregate_bars, virtual_head

    target, base_ms = p.target_min, int(base_min * 60_000)
    bar_min = base_min * target
    head = virtual_head(bars, target, key)
    head = head.groupBy(*key).agg(F.max_by(F.struct("open_time_ms", "open", "high", "low", "close", "as_of_ms"), "as_of_ms").alias("_h")).select(*key, F.lit(1 << 60).alias("_o"), "_h.*")
    done = aggregate_bars(bars, target, base_ms, key)
    last = done.groupBy(*key).agg(F.count("*").alias("n_completed"))
    series = done.select(*key, F.col("open_time_ms").alias("_o"), "open_time_ms", "open", "high", "low", "close").unionByName(head.select(*key, "_o", "open_time_ms", "open", "high", "low", "close"))
    w = Window.partitionBy(*key).orderBy("_o")
    s = series.withColumn("_g", deseasoned_gk(p)).withColumn("_raw", gk())
    cols = {}
    for name, har in (("har_ols", p.har_ols), ("har_qlike", p.har_qlike)):
        if har:
            x = F.lit(float(har["intercept"]))
            for b, n in zip(har["betas"], har["windows"]):
                v = F.sum("_g").over(w.rowsBetween(-(n - 1), 0))
                x = x + float(b) * F.when(v > 0, F.ln(v))
            cols[name] = x
        else:
            cols[name] = F.lit(None).cast("double")
    n = max(int(RV_LOOKBACK_MIN // bar_min), 1)
    f = w.rowsBetween(-(n - 1), 0)
    cols["_rv"] = F.sum("_raw").over(f) / F.count("*").over(f)
    for c, e in cols.items():
        s = s.withColumn(c, e)
    s = s.withColumn("_r", deseasoned_log_return(p) * (p.garch["scale_factor"] if p.garch else 1.0))
    g = p.garch or {"omega": 0.0, "alpha": 0.0, "beta": 0.0, "last_h": 0.0}
    # one sequence a key: a key has a row a target bar, not a tick, and the windows above sort it anyway
    both = lambda r, x: (folds.garch(r, g["omega"], g["alpha"], g["beta"], g["last_h"]), folds.log_gk_ewma(x, EWMA_HALFLIFE_MIN / bar_min))
    s = folds.path(s, key, ["_o"], ["_r", "_g"], both, {"_gh": "double", "_eg": "double"})
    now = s.where(F.col("_o") == 1 << 60).join(last, list(key), "left").join(head.select(*key, "as_of_ms"), list(key)).withColumn("n_completed", F.coalesce("n_completed", F.lit(0)))
    sn = seasonal(p, "as_of_ms")
    ann = lambda lv: annualise(lv, sn, bar_min)
    enough = F.col("n_completed") + 1 >= p.max_window()
    garch_lv = F.when(F.col("_gh") > 0, p.garch["cal_a"] + p.garch["cal_b"] * F.ln(F.col("_gh") / p.garch["scale_factor"] ** 2)) if p.garch else F.lit(None).cast("double")
    pick = lambda e: F.when(enough, e)
    out = now.select(
        *key, "n_completed", pick(ann(F.col("har_ols"))).alias("har_ols"), pick(ann(F.col("har_qlike"))).alias("har_qlike"), pick(ann(garch_lv)).alias("garch"),
        pick(ann(F.nanvl("_eg", F.lit(None).cast("double")))).alias("ewma"), pick(F.when(F.col("_rv") > 0, F.sqrt(F.col("_rv") * (MINUTES_PER_YEAR / bar_min)))).alias("realized"),
        F.when(enough, F.lit("Ok")).otherwise("InsufficientBars").alias("status"),
    )
    if known is not None:
        out = known.select(*key).distinct().join(out, list(key), "left").withColumn("status", F.coalesce("status", F.lit("NoTicks")))
    return out


def reseed(params: DataFrame, new: DataFrame, on: str = "grp") -> DataFrame:
    """Parameter rows with the annual volatilities of ``new`` where it has them; h_per_ms follows."""
    n = new.select(on, F.col("ann_vol").alias("_v"))
    p = params.join(n, on, "left").withColumn("ann_vol", F.coalesce("_v", "ann_vol")).drop("_v")
    return p.withColumn("h_per_ms", F.col("ann_vol") * F.col("ann_vol") / MS_PER_YEAR)
