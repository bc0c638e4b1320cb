"""Per-stock features, declared in levels.

A level holds columns that only need the previous levels, so each level is one
projection and all its windows share one WindowExec chain. All levels use the
same partition (scode) and order (date): one exchange for the whole set.
Names starting with an underscore are helpers and are dropped at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalars import clip, div, flag, symmetric_growth, zero_to_null

EPS = 1e-6
YEAR_ROWS = 240
c = F.col


def moments(*names: str, ahead: bool = False) -> dict[str, tuple]:
    """Fields of ``FeatureSet.tiled``: means ``m0``, ``m1`` and summed products of deviations ``p00``, ``p01``, ``p11``."""
    fr = R.series().rowsBetween(1, 5) if ahead else R.series().rowsBetween(-4, 0)
    known = c(names[0]).isNotNull()
    for n in names[1:]:
        known = known & c(n).isNotNull()
    full = F.count(F.when(known, F.lit(1))).over(fr) >= 5
    out = {f"m{i}": ("mean", F.when(full, F.avg(n).over(fr))) for i, n in enumerate(names)}
    for i, x in enumerate(names):
        for j, y in enumerate(names[i:], i):
            spread = F.var_pop(x) if i == j else F.covar_pop(x, y)
            out[f"p{i}{j}"] = ((f"m{i}", f"m{j}"), F.when(full, spread.over(fr) * F.lit(5.0)))
    return out


def tiled_std(fs: FeatureSet, level: int, x: str, n: int) -> Column:
    """Sample deviation over 20 or 60 rows, ready at level + 3 or level + 5."""
    mid, wide = fs.tiled(level, f"dev_{x}", moments(x), wide=n == 60)
    return F.sqrt((wide if n == 60 else mid)["p00"] / F.lit(float(n - 1)))


class FeatureSet:
    """Ordered column specs by level; repeated helpers are registered once."""

    def __init__(self):
        self.levels: list[dict[str, Column]] = []
        self.where: dict[str, int] = {}

    def put(self, level: int, name: str, column: Column) -> Column:
        if name not in self.where:
            while len(self.levels) <= level:
                self.levels.append({})
            self.levels[level][name] = column
            self.where[name] = level
        elif self.where[name] > level:
            raise ValueError(f"{name} is needed at level {level} but defined at {self.where[name]}")
        return c(name)

    def roll(self, level: int, kind: str, x: str, n: int) -> Column:
        agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "std0": F.stddev_pop}[kind]
        return self.put(level, f"_{kind}_{x}_{n}", R.roll(agg, x, n))

    def tiled(self, level: int, name: str, fields: dict[str, tuple], ahead: bool = False, wide: bool = True) -> tuple[Column, Column | None]:
        """Statistics of 20 (ready at level + 3) and, if ``wide``, 60 rows (level + 5), made of those of 5 rows by shifts.

        A frame costs its length at each row, so only the 5-row frames are walked; a longer frame meets its tiles, which are
        columns of the rows 5, 10, 15 and 20, 40 away. ``fields`` names a rule and the 5-row statistic, null unless all rows
        are known, which makes every longer one null too: max, min, sum, mean, or (product, means of its factors) for summed
        products of deviations. Those merge around their means, so series without spread keep an exact zero.
        """
        shift = R.lead if ahead else R.lag

        def merged(parts: list[Column], rows: int) -> Column:
            out = {}
            for f, (rule, *_) in fields.items():
                v = [p[f] for p in parts]
                if rule in ("max", "min"):
                    known = v[0].isNotNull()
                    for x in v[1:]:
                        known = known & x.isNotNull()
                    out[f] = F.when(known, (F.greatest if rule == "max" else F.least)(*v))
                elif rule == "mean":
                    out[f] = v[0] + sum((x - v[0] for x in v[2:]), v[1] - v[0]) / F.lit(float(len(v)))
                else:
                    out[f] = sum(v[1:], v[0])
            for f, (rule, *_) in fields.items():
                if isinstance(rule, tuple):
                    a, b = rule
                    apart = [(p[a] - out[a]) * (p[b] - out[b]) for p in parts]
                    out[f] = out[f] + sum(apart[1:], apart[0]) * F.lit(float(rows))
            return F.struct(*[x.alias(f) for f, x in out.items()])

        tile = self.put(level, f"_{name}_5", F.struct(*[x.alias(f) for f, (_, x) in fields.items()]))
        mid = self.put(level + 2, f"_{name}_20", merged([tile, *[self.put(level + 1, f"_{name}_5_{k}", shift(tile, k)) for k in (5, 10, 15)]], 5))
        if not wide:
            return mid, None
        return mid, self.put(level + 4, f"_{name}_60", merged([mid, *[self.put(level + 3, f"_{name}_20_{k}", shift(mid, k)) for k in (20, 40)]], 20))

    @property
    def outputs(self) -> list[str]:
        return [n for lv in self.levels for n in lv if not n.startswith("_")]

    @property
    def helpers(self) -> list[str]:
        return [n for lv in self.levels for n in lv if n.startswith("_")]

    def apply(self, df: DataFrame, keep_helpers: bool = False) -> DataFrame:
        for level in self.levels:
            df = df.withColumns(level)
        return df if keep_helpers else df.drop(*self.helpers)



def vol_20d(fs: FeatureSet) -> Column:
    return fs.put(4, "Vol_20d", tiled_std(fs, 1, "Log_Return", 20))


def volatility_60(fs: FeatureSet) -> Column:
    return fs.put(7, "volatility_60", tiled_std(fs, 2, "_ret1", 60))


def beta_60(fs: FeatureSet) -> Column:
    pair = fs.tiled(2, "pair", moments("_ret1", "Market_Return"))[1]
    return fs.put(7, "Beta_60", div(pair["p01"], pair["p11"]))


def base_columns(fs: FeatureSet) -> None:
    fs.put(0, "_rn", R.row_no())
    fs.put(0, "_cf", R.ffill("close"))
    fs.put(0, "_pc", R.lag("close"))
    fs.put(0, "Log_Return", F.ln(div("close", R.lag("close"))))
    fs.put(1, "_ret1", R.pct_change("_cf"))


def trend(fs: FeatureSet) -> None:
    close, high, low, vol = c("close"), c("high"), c("low"), c("volume")
    base_columns(fs)
    fs.put(0, "ADX_14", c("_adx14"))
    means = {n: fs.roll(0, "avg", "close", n) for n in (5, 25, 75, 200)}
    for n in (5, 25, 75):
        fs.put(1, f"Dist_SMA{n}", div(close, means[n]) - 1)
    fs.put(1, "Dist_SMA5_25", div(means[5], means[25]) - 1)
    fs.put(1, "Dist_SMA25_75", div(means[25], means[75]) - 1)
    for n in (25, 75, 200):
        fs.put(1, f"ma_dev_{n}", div(close, means[n]) - 1)
    traded = fs.put(0, "_tpv5", R.roll(F.sum, (high + low + close) / F.lit(3.0) * vol, 5))
    vwap = fs.put(1, "_vwap5", div(traded, fs.roll(0, "sum", "volume", 5)))
    dev = fs.put(2, "Dist_VWAP_5", div(close - vwap, vwap))
    fs.put(3, "Dist_VWAP_Slope", R.diff(dev))
    fs.put(0, "vwap_dev", div(close, div("volume_p", F.when(vol == 0, 1.0).otherwise(vol))) - 1)
    move10 = fs.put(0, "_d10", R.diff("close", 10))
    fs.put(0, "_absd", F.abs(R.diff("close")))
    fs.put(2, "Efficiency_Ratio_10", div(F.abs(move10), fs.roll(1, "sum", "_absd", 10)))
    fs.put(1, "LinReg_Slope_10", move10 / F.lit(10.0))
    hist = fs.put(0, "MACD_Hist_Norm", div(c("_macd") - c("_signal"), close))
    fs.put(1, "MACD_Hist_Diff", R.diff(hist))
    for n in (5, 10):
        fs.put(1, f"MAE_{n}", div(fs.roll(0, "min", "low", n), close) - 1)
    for n in (60, 250):
        fs.put(1, f"Dist_High_{n}", div(close, fs.roll(0, "max", "high", n)))
    kijun = (fs.roll(0, "max", "high", 26) + fs.roll(0, "min", "low", 26)) / F.lit(2.0)
    fs.put(1, "Dist_Kijun", div(close - kijun, kijun))
    prev_high = fs.put(0, "_h1", R.lag("high"))
    fs.put(2, "New_High_Flag_3", flag(close > fs.put(1, "_max_h1_3", R.roll(F.max, prev_high, 3))))
    lo, hi = fs.roll(0, "min", "close", 120), fs.roll(0, "max", "close", 120)
    fs.put(1, "price_pos_120", div(close - lo, hi - lo))
    mid52 = fs.put(1, "_mid52", (fs.roll(0, "max", "high", 52) + fs.roll(0, "min", "low", 52)) / F.lit(2.0))
    cloud = fs.put(2, "_cloud", R.lag(mid52, 26))
    fs.put(3, "ichimoku_dist", div(close - cloud, cloud))


def momentum(fs: FeatureSet) -> None:
    op, close, high, low = c("open"), c("close"), c("high"), c("low")
    base_columns(fs)
    r = c("Log_Return")
    fs.put(1, "Downside_Run", R.roll(F.sum, F.when(r.isNotNull(), F.least(r, F.lit(0.0))), 5))
    skew = fs.put(1, "_skew20", R.roll_skew("Log_Return", 20))
    fs.put(2, "Return_Skewness_Diff", R.diff(skew))
    fs.put(1, "Return_Kurtosis", R.roll_kurt("Log_Return", 20))
    for name, k in (("3d", 3), ("5d", 5), ("10d", 10), ("20d", 20), ("6m", 120), ("12m", 240)):
        fs.put(1, f"Return_{name}", R.pct_change("_cf", k))
    fs.put(1, "Return_1d_Lag1", R.lag(r, 1))
    fs.put(1, "Return_1d_Lag2", R.lag(r, 2))
    fs.put(0, "RSI_9", c("_rsi9"))
    fs.put(0, "RSI_9_14_Diff", c("_rsi9") - c("_rsi14"))
    mid, sd = fs.roll(0, "avg", "close", 20), fs.roll(0, "std0", "close", 20)
    up, lo = mid + sd * 2, mid - sd * 2
    fs.put(1, "BB_Percent_B", div(close - lo, up - lo))
    fs.put(1, "BB_Bandwidth", div((up - lo) * 100, mid))
    span = high - low
    fs.put(0, "Body_Ratio", div(F.abs(close - op), span))
    fs.put(0, "Upper_Shadow_Ratio", div(high - F.greatest(close, op), span))
    fs.put(0, "Lower_Shadow_Ratio", div(F.least(close, op) - low, span))
    fs.put(0, "Intraday_Strength", div(close - op, span))
    fs.put(1, "Lower_Shadow_MA5", R.roll(F.avg, "Lower_Shadow_Ratio", 5))
    sign = fs.put(0, "_sgn", F.coalesce(F.signum(R.diff("close")), F.lit(0.0)))
    start = fs.put(1, "_start", F.when(~sign.eqNullSafe(R.lag(sign)), c("_rn")))
    begin = fs.put(2, "_begin", R.ffill(start))
    fs.put(3, "Streak", sign * (c("_rn") - begin + 1))
    fs.put(1, "Bullish_Ratio_20", R.roll(F.avg, flag(close > c("_pc")), 20))
    lo20, hi20 = fs.roll(0, "min", "low", 20), fs.roll(0, "max", "high", 20)
    fs.put(1, "Close_Position", div(close - lo20, hi20 - lo20))
    gap = fs.put(1, "Gap_Rate", div(op, c("_pc")) - 1)
    fs.put(2, "Gap_Abs", F.abs(gap))
    fs.put(1, "Large_Move_Count", R.roll(F.sum, flag(F.abs(r) > 0.03).cast("double"), 20))
    fs.put(1, "Range_Ratio_Long", div(fs.put(0, "_rng5", R.roll(F.avg, span, 5)), fs.put(0, "_rng20", R.roll(F.avg, span, 20))))
    fs.put(1, "Max_Gain_5", div(fs.roll(0, "max", "high", 5), close) - 1)
    levels = R.rci_levels("close", {f"RCI_{n}": n for n in (9, 26, 52)})
    for i, level in enumerate(levels):
        for name, column in level.items():
            fs.put(i, name, column)
    for n in (9, 26):
        fs.put(len(levels), f"RCI_{n}_Diff", R.diff(f"RCI_{n}"))
    mid25, sd25 = fs.roll(0, "avg", "close", 25), fs.roll(0, "std0", "close", 25)
    fs.put(1, "BB_Upper_Ratio", div(mid25 + sd25 * 2, mid25) - 1)
    fs.put(0, "momentum_12_1", div(R.lag("close", 20), R.lag("close", 260)) - 1)
    fs.put(0, "ret_intraday", div(close, op) - 1)
    fs.put(1, "win_rate_10d", R.roll(F.avg, flag(r > 0), 10))


def volatility(fs: FeatureSet) -> None:
    close = c("close")
    base_columns(fs)
    r = c("Log_Return")
    fs.put(0, "ATR_Ratio", div("_atr14", close))
    fs.put(0, "ATR_Squeeze", div("_atr5", "_atr20"))
    mid, sd = fs.roll(0, "avg", "close", 20), fs.roll(0, "std0", "close", 20)
    fs.put(1, "ATR_Squeeze_bb", div(div(sd * 4, mid + F.lit(1e-9)), c("_atr14") + F.lit(1e-9)))
    std20 = vol_20d(fs)
    fs.put(5, "hist_vol_20", std20)
    hv = fs.put(1, "HV_30", R.roll(F.stddev_samp, r, 30) * F.lit(math.sqrt(250)))
    fs.put(2, "HV_Slope", R.diff(hv, 5))
    fs.put(2, "Realized_Skew_20", fs.put(1, "_skew20", R.roll_skew("Log_Return", 20)))
    top = fs.roll(0, "max", "close", 14)
    fs.put(1, "_dd2", F.pow(F.lit(100.0) * div(close - top, top), 2))
    fs.put(3, "Ulcer_Index_14", F.sqrt(fs.roll(2, "sum", "_dd2", 14) / F.lit(14.0)))
    fs.put(0, "atr_chg_rate", div("_atr14", R.lag("_atr14")) - 1)
    fs.put(1, "high_52w_dist", div(close, fs.roll(0, "max", "close", 240)) - 1)
    fs.put(1, "downside_dev_60", R.roll(F.stddev_samp, F.when(r < 0, r).otherwise(F.lit(0.0)), 60))
    volatility_60(fs)


def volume(fs: FeatureSet) -> None:
    op, close, high, low, vol, vp = c("open"), c("close"), c("high"), c("low"), c("volume"), c("volume_p")
    base_columns(fs)
    r = c("Log_Return")
    logv = fs.put(0, "Volume_Log", F.log1p(vol))
    fs.put(1, "Abnormal_Volume", div(vp, fs.roll(0, "avg", "volume_p", 20)))
    fs.put(0, "_vf", R.ffill("volume"))
    fs.put(1, "Volume_Change", R.pct_change("_vf"))
    fs.put(1, "Volume_Slope_5", R.diff(logv, 5) / F.lit(5.0))
    fs.put(0, "Log_Trading_Cap", F.log1p(close * vol))
    typical = fs.put(0, "_tp", (high + low + close) / F.lit(3.0))
    step = fs.put(1, "_tpd", R.diff(typical))
    flow = typical * vol
    fs.put(2, "_pos14", R.roll(F.sum, F.when(step > 0, flow).when(step.isNotNull(), F.lit(0.0)), 14))
    fs.put(2, "_neg14", R.roll(F.sum, F.when(step < 0, flow).when(step.isNotNull(), F.lit(0.0)), 14))
    fs.put(3, "MFI_14", div(c("_pos14") * 100, c("_pos14") + c("_neg14")))
    fs.put(0, "_ln2", F.pow(F.ln(div(high, low)), 2))
    fs.put(1, "Volatility_Parkinson", F.sqrt(R.roll(F.avg, "_ln2", 14) / F.lit(4 * math.log(2))))
    fs.put(1, "Return_Volatility", R.roll(F.stddev_samp, r, 10))
    fs.put(1, "Vol_Ratio_5d", div(vol, fs.roll(0, "avg", "volume", 5)))
    hv = fs.put(1, "HV_30", R.roll(F.stddev_samp, r, 30) * F.lit(math.sqrt(250)))
    fs.put(2, "Vol_Ratio_HV", div(fs.put(1, "_hv5", R.roll(F.stddev_samp, r, 5)) * F.lit(math.sqrt(250)), hv))
    med = fs.put(0, "_vmed20", R.roll_median("volume", 20))
    spike = fs.put(1, "_spike", flag(vol > med * 3).cast("double"))
    fs.put(2, "Vol_Spike_Count_20", R.roll(F.sum, spike, 20))
    up = flag(close > op)
    fs.put(0, "_vup20", R.roll(F.sum, vol * up, 20))
    fs.put(0, "_vdn20", R.roll(F.sum, vol * (F.lit(1) - up), 20))
    fs.put(1, "Vol_Up_Down_Ratio", div("_vup20", c("_vdn20") + F.lit(1e-9)))
    fs.put(1, "Volume_MA_25", R.roll(F.avg, "Volume_Log", 25))
    fs.put(1, "amihud_illiq", div(F.abs(r), close * vol + F.lit(1e-9)))
    fs.put(1, "volume_p_MA5", fs.roll(0, "avg", "volume_p", 5))


def fundamental(fs: FeatureSet) -> None:
    close = c("close")
    fs.put(0, "turnover_ratio", div("volume", zero_to_null("shares_outstanding")))
    fs.put(0, "is_missing_eps", c("eps").isNull().cast("int"))
    fs.put(0, "EPS_Actual", R.ffill("eps"))
    age = F.datediff("date", "published_date")
    fs.put(0, "log_days_since_pub", F.coalesce(F.log1p(age.cast("double")), F.lit(0.0)))
    fs.put(0, "log_market_cap", F.ln(close * c("shares_outstanding")))
    shares = F.abs(c("shares_outstanding")) + F.lit(EPS)
    book = clip(div("equity", shares), 0.01, None)
    earned = F.coalesce(c("eps"), div("net_income", shares))

    def share_of(x, y):
        return clip(div(x, F.abs(c(y)) + F.lit(EPS)), -5.0, 5.0)

    fs.put(0, "accruals", share_of(c("net_income") - c("operating_cf"), "total_assets"))
    fs.put(0, "equity_ratio", share_of(c("equity"), "total_assets"))
    fs.put(0, "log_pbr", clip(F.ln(div(close, book)), -5.0, 5.0))
    fs.put(0, "earnings_yield", clip(div(earned, close + F.lit(EPS)), -5.0, 5.0))
    fs.put(0, "op_margin", share_of(c("operating_profit"), "sales"))
    fs.put(0, "roe", share_of(c("net_income"), "equity"))
    fs.put(0, "roa", share_of(c("net_income"), "total_assets"))
    fs.put(0, "revision_rate", clip(symmetric_growth(c("eps"), R.lag("eps", 20)), -5.0, 5.0))
    fs.put(0, "progress_rate", share_of(c("operating_profit"), "operating_profit_forecast"))
    for x in ("operating_profit", "sales", "eps"):
        now = fs.put(0, f"_f_{x}", R.ffill(x))
        fs.put(1, f"{x}_growth_yoy", clip(symmetric_growth(now, R.lag(now, YEAR_ROWS)), -3.0, 3.0))


def calendar(fs: FeatureSet) -> None:
    d = c("date")
    day, month, dow = F.dayofmonth(d), F.month(d), F.weekday(d)
    angle = dow.cast("double") * F.lit(2 * math.pi) / F.lit(6.0)   # divisor 6, as published
    fs.put(0, "Month_in_Quarter", month % 3)
    fs.put(0, "DayOfMonth", day)
    fs.put(0, "DayOfWeek", dow)
    fs.put(0, "Sin_DayOfWeek", F.sin(angle))
    fs.put(0, "Cos_DayOfWeek", F.cos(angle))
    fs.put(0, "Is_Gotobi", ((day % 5 == 0) | (day == 31)).cast("int"))
    fs.put(0, "Is_Month_End", (d == F.last_day(d)).cast("int"))
    fs.put(0, "Quarter", F.quarter(d))
    fs.put(0, "Is_Quarter_End", month.isin(3, 6, 9, 12).cast("int"))
    fs.put(0, "time_idx", F.datediff(d, F.min(d).over(R.series().rowsBetween(R.FIRST, 0))))


# Market names of the first segment, and name parts of the growth and standard segments
PRIME_NAMES = ["プライム", "東証PR", "東証1部", "東証一部"]
GROWTH_PARTS = ["グロース", "東証GR", "マザーズ", "東証マザ", "JQG", "JQグロース", "HCグロース"]
STANDARD_PARTS = ["スタンダード", "東証ST", "東証2部", "東証二部", "JQ", "JQS", "JQスタンダード", "東証"]


def market_segment(name: Column) -> Column:
    """1 prime, 3 growth, 2 standard, 0 other; growth is tested before standard."""
    m = F.translate(F.trim(name), " 　", "")

    def has(parts):
        return m.rlike("|".join(parts))

    return F.when(m.isin(*PRIME_NAMES), 1).when(has(GROWTH_PARTS), 3).when(has(STANDARD_PARTS), 2).otherwise(0)


def market(fs: FeatureSet, horizon: int = 5) -> None:
    base_columns(fs)
    fs.put(0, "_mf", R.ffill("close_mkt"))
    beta_60(fs)
    fs.put(1, "RS_25", R.pct_change("_cf", 25) - R.pct_change("_mf", 25))
    fs.put(0, "market_segment", market_segment(c("market")))
    fs.put(0, "Market_Return_Future", R.ahead(F.sum, "Market_Return", horizon))


def margin(fs: FeatureSet) -> None:
    long, short = c("long_margin_trade_balance_share"), c("short_margin_trade_balance_share")
    fs.put(1, "margin_buy_impact", div(long, zero_to_null(fs.roll(0, "avg", "volume", 60))))
    ratio = fs.put(0, "margin_ratio", F.ln(div(long + 1, short + 1)))
    fs.put(1, "margin_ratio_delta_4w", R.diff(ratio, 20))


BLOCKS = {"trend": trend, "momentum": momentum, "volatility": volatility, "volume": volume,
          "fundamental": fundamental, "calendar": calendar, "market": market, "margin": margin}
# columns a block registers for others but does not publish itself
TARGET_HELPERS = ["Vol_20d", "Market_Return_Future"]


def feature_set(*blocks: str) -> FeatureSet:
    fs = FeatureSet()
    for b in blocks or BLOCKS:
        BLOCKS[b](fs)
    return fs
