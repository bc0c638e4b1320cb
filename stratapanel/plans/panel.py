"""The time-series panel: bars joined with every other input, one row per (scode, date)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursion import with_indicators
from ..functions.rolling import pct_change
from ..operators.asof import Side, asof_join, asof_joins
from ..operators.features import TARGET_HELPERS, feature_set
from ..operators.targets import target_set
from ..operators.universe import Thresholds, intrinsic_metrics
from ..sources import loaders as L
from ..sources.loaders import FINANCIAL_VALUES

# columns that windows of targets and metrics read
TARGET_INPUTS = ["scode", "date", "open", "high", "low", "close", "volume", "volume_p", "Market_Return", "Vol_20d", "Beta_60", "volatility_60"]
MARGIN_VALUES = ["long_margin_trade_balance_share", "short_margin_trade_balance_share"]

def sector_index(closes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Mean simple return per (date, sector); inner join on the sector master."""
    r = closes.withColumn("_ret", pct_change("close"))
    return r.join(symbols.select("scode", "sector33_code"), "scode").groupBy("date", "sector33_code").agg(
        F.avg("_ret").alias("sector_return"))


@dataclass
class Inputs:
    """Logical input tables; optional ones may be None."""
    bars: DataFrame
    symbols: DataFrame
    topix: DataFrame | None = None        # date, close_mkt, Market_* columns
    n225: DataFrame | None = None         # date, market_vol_change
    flows: DataFrame | None = None        # date, investor flow columns
    financials: DataFrame | None = None   # scode, published_date, values
    margin: DataFrame | None = None       # scode, available_date, balances
    shorts: DataFrame | None = None       # sector33_code, date, selling_volume_ratio
    sector_return: DataFrame | None = None


def min_history(df: DataFrame, rows: int = 250) -> DataFrame:
    """Keep stocks with at least ``rows`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("scode"))
    return df.withColumn("_rows", n).where(F.col("_rows") >= rows).drop("_rows")


def join_inputs(i: Inputs) -> DataFrame:
    """Dimension joins first, then one scan per stock for all as-of joins.

    Market series have one row per calendar day, sector tables one per sector and
    day, the master one per stock: Spark broadcasts them while their measured size
    is below its threshold and shuffles them beyond. As-of joins by stock share one
    exchange, which the result keeps.
    """
    d = i.bars.join(i.symbols, "scode", "left")
    for series in (i.topix, i.n225, i.flows):
        if series is not None:
            d = d.join(series, "date", "left")
    if i.sector_return is not None:
        d = d.join(i.sector_return, ["date", "sector33_code"], "left")
    if i.shorts is not None:
        d = asof_join(d, i.shorts, ["sector33_code"], "date", "date", ["selling_volume_ratio"], right_unique=True)
    sides = []
    if i.financials is not None:
        sides.append(Side(i.financials, "published_date", FINANCIAL_VALUES, "published_date"))
    if i.margin is not None:
        sides.append(Side(i.margin, "available_date", MARGIN_VALUES))
    return asof_joins(d, ["scode"], "date", sides) if sides else d


def time_series_panel(i: Inputs, min_rows: int = 250, thresholds: Thresholds = Thresholds(), with_targets: bool = True,
                      drop_incomplete: bool = True) -> DataFrame:
    """Every per-stock feature, target and universe metric; one row per (scode, date).

    All windows reuse the exchange by stock made in ``join_inputs``.
    """
    d = min_history(join_inputs(i), min_rows)
    d = with_indicators(d)
    d = feature_set().apply(d).drop("_macd", "_signal", "_rsi9", "_rsi14", "_atr5", "_atr14", "_atr20", "_adx14")
    # the windows of targets and metrics carry the finished features as one struct, not column by column
    done = [n for n in d.columns if n not in TARGET_INPUTS]
    d = d.select(*[n for n in d.columns if n in TARGET_INPUTS], F.struct(*done).alias("_done"))
    if with_targets:
        d = target_set().apply(d)
    d = intrinsic_metrics(d, thresholds)
    d = d.select(*[n for n in d.columns if n != "_done"], "_done.*").drop(*TARGET_HELPERS)
    if drop_incomplete:
        d = d.dropna(subset=["momentum_12_1", "Dist_SMA75", *(["Future_High_Str"] if with_targets else [])])
    return d


def proxy_inputs(p, flow_range: tuple[str, str | None] = ("1995-06-01", None)) -> Inputs:
    """Inputs derived from the test tables (``sources.proxy.Proxy``)."""
    return Inputs(
        bars=p.bars().join(p.markets(), "scode", "left"), symbols=p.symbols(),
        topix=L.topix_features(p.index_topix()), n225=L.n225_features(p.index_n225()),
        flows=L.flow_features(L.investor_types(p.raw, "1900-01-01"), *flow_range, until=p.bars().select("date")),
        financials=p.financials(), margin=L.available_after(p.margin()).drop("date"), shorts=p.shorts(),
        sector_return=sector_index(p.bars().select("scode", "date", "close"), p.symbols()))
