"""Tradable-universe flags."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalars import div, flag, is_true

# Upper price bound (inclusive) -> tick size; above the last bound the tick is 500
TICKS = [(3000.0, 1), (5000.0, 5), (30000.0, 10), (50000.0, 50), (300000.0, 100)]
TOP_TICK = 500


@dataclass(frozen=True)
class Thresholds:
    """Universe limits; defaults are the published ones (prices and values in yen)."""
    tac_close: float = 500.0
    tac_adv: float = 5e8
    tac_tick_bps: float = 10.0
    tac_range: float = 0.01
    tac_noise: float = 5.0
    str_close: float = 200.0
    str_adv: float = 1e8
    str_noise: float = 8.0
    stop_return: float = 0.15
    outlier_sigmas: float = 3.0


def tick_size(price: Column) -> Column:
    """Right-closed price bands; no tick for prices <= 0."""
    out = F.when(price <= 0, F.lit(None).cast("double"))
    for bound, tick in TICKS:
        out = out.when(price <= bound, F.lit(float(tick)))
    return out.when(price.isNotNull(), F.lit(float(TOP_TICK)))


def intrinsic_metrics(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    close = F.col("close")
    df = df.withColumn("_fc", R.ffill("close"))
    df = df.withColumns({
        "filt_Turnover": close * F.col("volume"),
        "filt_Return": R.pct_change("_fc"),
        "filt_Tick_Sensitivity": div(tick_size(close), close) * F.lit(10000.0),
        "filt_Median_ADV_20": R.roll_median("volume_p", 20),
        "filt_ATR_Ratio": R.roll(F.avg, div(F.col("high") - F.col("low"), close), 20),
    })
    return df.withColumn("filt_Is_Stop_Day", is_true(F.abs("filt_Return") > t.stop_return)).drop("_fc")


def candidate_flags(df: DataFrame, t: Thresholds = Thresholds(), keep_metrics: bool = False) -> DataFrame:
    """is_candidate_tac / is_candidate_str from the intrinsic metrics."""
    df = df.withColumn("_std", R.roll(F.stddev_samp, "filt_Return", 20))
    df = df.withColumn("_out", flag(F.abs("filt_Return") > F.col("_std") * F.lit(t.outlier_sigmas)).cast("double"))
    c = F.col
    df = df.withColumns({"filt_Noise_Score": R.roll(F.sum, "_out", 60), "_prev_stop": R.lag("filt_Is_Stop_Day")})
    tac = ((c("close") >= t.tac_close) & (c("filt_Median_ADV_20") >= t.tac_adv) & (c("filt_Tick_Sensitivity") <= t.tac_tick_bps)
           & (c("filt_ATR_Ratio") >= t.tac_range) & (c("filt_Noise_Score") <= t.tac_noise)
           & ~c("filt_Is_Stop_Day") & ~c("_prev_stop"))
    strat = (c("close") >= t.str_close) & (c("filt_Median_ADV_20") >= t.str_adv) & (c("filt_Noise_Score") <= t.str_noise)
    df = df.withColumns({"is_candidate_tac": is_true(tac), "is_candidate_str": is_true(strat)}).drop("_std", "_out", "_prev_stop")
    return df if keep_metrics else df.drop(*[x for x in df.columns if x.startswith("filt_")])


def _quarter(day: dt.date) -> str:
    return f"{day.year}Q{(day.month + 2) // 3}"


def buffered_flags(history: DataFrame, chunk_start: str, chunk_end: str | None = None, lookback_days: int = 180,
                   t: Thresholds = Thresholds()) -> DataFrame:
    """Flags for one new chunk of a written, quarter-partitioned panel, from the chunk and a calendar lookback.

    The bounds are literals on ``quarter`` (whole partitions are skipped) and ``date``; only the rows
    between them are read, and metrics and flags are computed from those.
    """
    first = dt.date.fromisoformat(chunk_start) - dt.timedelta(days=lookback_days)
    d = history.where((F.col("quarter") >= F.lit(_quarter(first))) & (F.col("date") >= F.lit(first)))
    if chunk_end:
        last = dt.date.fromisoformat(chunk_end)
        d = d.where((F.col("quarter") <= F.lit(_quarter(last))) & (F.col("date") < F.lit(last)))
    out = candidate_flags(intrinsic_metrics(d.drop("quarter"), t), t)
    return out.where(F.col("date") >= F.lit(chunk_start).cast("date"))
