"""Loader functions: raw vendor tables to the logical inputs of the panel.

Every function takes a ``Reader``; filters and projections are plain
predicates, so they reach the parquet scan or the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import diff, ffill, lag, pct_change, roll, series
from ..functions.scalars import div, prefix_key, zero_to_null
from ..operators.asof import densify
from .tables import Reader

START = "2015-01-01"
PRO_MARKET = "TOKYO PRO MARKET"

# Vendor column -> logical column of the statements table
FINANCIAL_COLUMNS = {
    "DiscDate": "published_date", "FEPS": "eps", "BPS": "bps", "FDivAnn": "dps", "Sales": "sales",
    "OP": "operating_profit", "FOP": "operating_profit_forecast", "NP": "net_income", "TA": "total_assets",
    "Eq": "equity", "ShOutFY": "shares_outstanding", "CFO": "operating_cf",
}
FINANCIAL_VALUES = [c for c in FINANCIAL_COLUMNS.values() if c != "published_date"]


def since(df: DataFrame, column: str, start: str) -> DataFrame:
    return df.where(F.col(column) >= F.lit(start).cast("date"))


def all_symbols(read: Reader) -> DataFrame:
    """Stocks outside the professional market with their sector; unknown sectors dropped."""
    stocks = read("prices").where(F.col("market") != PRO_MARKET).select("scode").distinct()
    sectors = read("listings").select(prefix_key("Code").alias("scode"),
                                      F.col("Sector33Code").cast("string").alias("sector33_code")).distinct()
    return stocks.join(sectors, "scode", "left").dropna(subset=["sector33_code"])


def latest_symbols(read: Reader, excluded: tuple[str, ...] = ("0002",), other: str = "その他") -> DataFrame:
    d = read("code_list").where(~F.col("scode").isin(*excluded) & (F.col("market") != other))
    return d.select("scode").distinct().orderBy("scode")


def closes(read: Reader, start: str = START) -> DataFrame:
    return since(read("prices").where(F.col("mcode") == "T"), "date", start).select("date", "scode", "close")


def bars(read: Reader, symbols: list[str] | DataFrame | None = None, start: str = START) -> DataFrame:
    """Daily bars of the main market, optionally for a list or a table of stocks."""
    d = since(read("prices").where(F.col("mcode") == "T"), "date", start)
    if isinstance(symbols, DataFrame):
        d = d.join(symbols.select("scode").distinct(), "scode", "left_semi")
    elif symbols is not None:
        d = d.where(F.col("scode").isin(*symbols))
    return d.select("date", "scode", "market", "open", "high", "low", "close", "volume", "volume_p")


def index_close(read: Reader, name: str, start: str = START) -> DataFrame:
    return since(read(name), "date", start).select("date", "close")


def topix_features(index: DataFrame) -> DataFrame:
    """close_mkt, Market_Return, Market_Trend_Idx, Market_HV_20; one row per calendar day."""
    w = Window.orderBy("date")
    d = index.withColumn("Market_Return", F.ln(div("close", lag("close", 1, w))))
    return d.select("date", F.col("close").alias("close_mkt"), "Market_Return",
                    div("close", roll(F.avg, "close", 25, w)).alias("Market_Trend_Idx"),
                    roll(F.stddev_samp, "Market_Return", 20, w).alias("Market_HV_20"))


def n225_features(index: DataFrame) -> DataFrame:
    """market_vol_change: one-day change of the 20-day volatility."""
    w = Window.orderBy("date")
    d = index.withColumn("_ret", pct_change("close", 1, w))
    d = d.withColumn("_hv", roll(F.stddev_samp, "_ret", 20, w))
    return d.select("date", diff("_hv", 1, w).alias("market_vol_change"))


def sector_return(read: Reader, start: str = START) -> DataFrame:
    return since(read("sector_return"), "date", start).withColumn("sector33_code", F.col("sector33_code").cast("string"))


def stock_info(read: Reader) -> DataFrame:
    return read("code_list").select("scode", "sname", "close", "gyoshu")


def investor_types(read: Reader, start: str = START) -> DataFrame:
    return since(read("investor_types"), "PubDate", start).groupBy("PubDate").agg(
        F.sum("FrgnBuy").alias("Foreign_Net_Buy"), F.sum("IndBuy").alias("Individual_Net_Buy"))


def flow_features(flows: DataFrame, start: str = START, end: str | None = None, until: DataFrame | None = None) -> DataFrame:
    """Investor-flow columns on a gap-free calendar, which goes on to the last day of ``until``; one row per day."""
    w = Window.orderBy("date")
    d = densify(flows.withColumnRenamed("PubDate", "date"), "date", ["Foreign_Net_Buy", "Individual_Net_Buy"], start, end, until)
    z = {}
    for n in (60, 250):
        for kind, x in (("Foreign", "Foreign_Net_Buy"), ("Individual", "Individual_Net_Buy")):
            z[f"Market_{kind}_Z_{n}"] = div(F.col(x) - roll(F.avg, x, n, w), roll(F.stddev_samp, x, n, w))
    d = d.withColumns(z | {"overseas_flow_trend": roll(F.avg, "Foreign_Net_Buy", 20, w)})
    d = d.withColumns({"Market_Foreign_Diff": diff("Market_Foreign_Z_60", 5, w),
                       "flow_accel": F.col("overseas_flow_trend") - roll(F.avg, "overseas_flow_trend", 5, w)})
    return d.select("date", *z, "Market_Foreign_Diff", "overseas_flow_trend", "flow_accel")


def financials_raw(read: Reader, start: str = START) -> DataFrame:
    d = since(read("financials"), "DiscDate", start)
    return d.select(prefix_key("Code").alias("scode"), *[F.col(v).alias(n) for v, n in FINANCIAL_COLUMNS.items()])


def clean_financials(raw: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Fill every value forward per stock, default cash flow to 0, keep the last row per day.

    Filling runs before the duplicate check, so a repeated day keeps the newest
    known value of each column. Rows per stock are its publications.
    """
    w = series("scode", ["published_date", *(tie or [])])
    filled = {c: ffill(c, w) for c in FINANCIAL_VALUES}
    filled["operating_cf"] = F.coalesce(filled["operating_cf"], F.lit(0.0))
    newest = Window.partitionBy("scode").orderBy("published_date", *(tie or []))
    d = raw.withColumns(filled | {"_next": F.lead("published_date").over(newest)})
    last_of_day = F.col("_next").isNull() | (F.col("_next") != F.col("published_date"))
    return d.where(last_of_day).select("scode", "published_date", *FINANCIAL_VALUES)


def margin_weekly(read: Reader, start: str = START) -> DataFrame:
    d = since(read("margin_interest"), "date", start)
    value = {"LongVol": "long_margin_trade_balance_share", "ShrtVol": "short_margin_trade_balance_share"}
    return d.select("date", prefix_key("Code").alias("scode"),
                    *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(n) for v, n in value.items()])


def available_after(df: DataFrame, days: int = 4, ts: str = "date", out: str = "available_date") -> DataFrame:
    """Publication lag: the row may be used ``days`` calendar days after its date."""
    return df.withColumn(out, F.date_add(ts, days))


def short_selling_ratio(read: Reader, start: str = START) -> DataFrame:
    d = since(read("short_ratio"), "date", start)
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("SellExShortVa", "ShrtWithResVa", "ShrtNoResVa")}
    return d.select("date", F.col("S33").cast("string").alias("sector33_code"),
                    div(v["ShrtWithResVa"] + v["ShrtNoResVa"], zero_to_null(v["SellExShortVa"])).alias("selling_volume_ratio"))
