"""Logical input tables derived from the star-schema test tables.

Trades are ``lineitem`` rows: stock = supplier, sector = the supplier's nation,
day = ship date. Every derivation pre-aggregates on (key, day), so a stock with
a third of all trades still becomes at most one bar per day through map-side
combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import div, snap
from ..plans.staging import staged_path

TRADE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# Market segment names given to the proxy stocks, by nation key modulo 8
MARKETS = ["プライム", "東証 1部", "JQグロース", "スタンダード", "マザーズ", "東証二部", "TOKYO PRO MARKET", "その他"]


class Proxy:
    """Logical tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def trades(self) -> DataFrame:
        # one long orders the trades of a day, so open/close stay in a hash aggregate
        seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") % 1_000_000
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("scode"), F.col("l_shipdate").cast("date").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), seq.alias("seq"), *TRADE_COLS)

    def bars(self) -> DataFrame:
        p, key = F.col("p"), F.col("seq")
        return self.trades().groupBy("scode", "date").agg(
            F.min_by(p * (F.lit(1) - F.col("l_discount") / 2), key).alias("open"),
            F.max(p * (F.lit(1) + F.col("l_tax"))).alias("high"),
            F.min(p * (F.lit(1) - F.col("l_discount"))).alias("low"),
            F.max_by(p * (F.lit(1) + F.col("l_tax") / 2), key).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("volume_p"))

    def daily(self) -> DataFrame:
        """All that the inputs need of the trades, per stock and day: one pass over the fact table."""
        p, key, v, qty, flag = F.col("p"), F.col("seq"), F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_returnflag")
        line = F.col("l_linestatus")
        return self.trades().groupBy("scode", "date").agg(
            F.min_by(p * (F.lit(1) - F.col("l_discount") / 2), key).alias("open"), F.max(p * (F.lit(1) + F.col("l_tax"))).alias("high"),
            F.min(p * (F.lit(1) - F.col("l_discount"))).alias("low"), F.max_by(p * (F.lit(1) + F.col("l_tax") / 2), key).alias("close"),
            F.sum("l_quantity").alias("volume"), F.sum(v).alias("volume_p"), F.sum(p).alias("p_sum"), F.count(p).alias("p_n"),
            F.sum(v * (F.col("l_discount") - F.lit(0.02))).alias("profit"), F.sum("l_tax").alias("tax_sum"), F.count("l_tax").alias("tax_n"),
            F.sum(F.when(flag == "A", qty)).alias("long"), F.sum(F.when(flag == "R", qty)).alias("short"), F.sum(F.when(flag == "N", v)).alias("a"),
            F.sum(F.when((flag == "A") & (line == "F"), v)).alias("b"), F.sum(F.when((flag == "R") & (line == "O"), v)).alias("c"))

    def symbols(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("scode"), F.col("s_nationkey").cast("string").alias("sector33_code"))

    @staticmethod
    def market_name(nation_key: Column) -> Column:
        names = F.array(*[F.lit(m) for m in MARKETS])
        return F.element_at(names, (nation_key % len(MARKETS) + 1).cast("int"))

    def markets(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("scode"), self.market_name(F.col("s_nationkey")).alias("market"))

    def index_topix(self) -> DataFrame:
        return self.trades().groupBy("date").agg(F.avg("p").alias("close"))

    def index_n225(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            F.avg("o_totalprice").alias("close"))

    def investor_types(self) -> DataFrame:
        """Several rows per publication date; two priorities act as the two investor kinds."""
        week = F.date_trunc("week", F.col("o_orderdate")).cast("date")
        kind = F.col("o_orderpriority")
        return self.table("orders").select(
            F.date_add(week, 11).alias("PubDate"),
            F.when(kind == "1-URGENT", F.col("o_totalprice")).alias("FrgnBuy"),
            F.when(kind == "5-LOW", F.col("o_totalprice")).alias("IndBuy"))

    def financials_raw(self) -> DataFrame:
        """Monthly publications per stock; eps is missing every third month."""
        month = F.date_trunc("month", F.col("date")).cast("date")
        sales, shares = F.sum("l_extendedprice"), F.sum("l_quantity") * F.lit(100.0)
        g = self.trades().groupBy("scode", month.alias("m")).agg(
            sales.alias("sales"),
            F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.02))).alias("operating_profit"),
            (F.sum("l_extendedprice") * F.lit(3.0)).alias("total_assets"),
            F.avg("l_tax").alias("_tax"), shares.alias("shares_outstanding"))
        return self.published(g)

    @staticmethod
    def published(g: DataFrame) -> DataFrame:
        """Monthly sums as publications."""
        g = g.select(
            F.date_add(F.last_day("m"), 10).alias("published_date"), "scode", "sales", "operating_profit",
            (F.col("operating_profit") * F.lit(0.6)).alias("net_income"), "total_assets",
            (F.col("total_assets") * (F.lit(0.5) - F.col("_tax"))).alias("equity"), "shares_outstanding")
        g = g.withColumns({
            "eps": F.when(F.month(F.date_sub("published_date", 10)) % 3 != 0,
                          div("net_income", "shares_outstanding")),
            "bps": div("equity", "shares_outstanding"),
            "dps": div("net_income", "shares_outstanding") * F.lit(0.3),
            "operating_profit_forecast": F.when(F.month(F.date_sub("published_date", 10)) % 4 != 0,
                                                F.col("operating_profit") * F.lit(1.1)),
            "operating_cf": F.when(F.month(F.date_sub("published_date", 10)) % 2 == 0,
                                   F.col("net_income") * F.lit(0.8)),
        })
        return g

    def margin_weekly(self) -> DataFrame:
        week = F.date_add(F.date_trunc("week", F.col("date")).cast("date"), 4)
        qty = F.col("l_quantity")
        return self.trades().groupBy(week.alias("date"), "scode").agg(
            F.sum(F.when(F.col("l_returnflag") == "A", qty)).alias("LongVol"),
            F.sum(F.when(F.col("l_returnflag") == "R", qty)).alias("ShrtVol"))

    def short_ratio(self) -> DataFrame:
        v = F.col("l_extendedprice")
        per_stock = self.trades().groupBy("scode", "date").agg(
            F.sum(F.when(F.col("l_returnflag") == "N", v)).alias("a"),
            F.sum(F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), v)).alias("b"),
            F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), v)).alias("c"))
        return self.by_sector(per_stock)

    def by_sector(self, per_stock: DataFrame) -> DataFrame:
        return per_stock.join(self.symbols(), "scode").groupBy("date", F.col("sector33_code").alias("S33")).agg(
            F.sum("a").alias("SellExShortVa"), F.sum("b").alias("ShrtWithResVa"), F.sum("c").alias("ShrtNoResVa"))

    def scored(self) -> DataFrame:
        """One row per (user, day): score and the next day's value as the target."""
        from ..functions.rolling import lead, series
        daily = self.table("events").groupBy(
            F.col("user_id").alias("scode"), F.col("ts").cast("date").alias("date")).agg(
            F.avg("value").alias("value"), F.max((F.col("event_type") == "purchase").cast("int")).alias("label"),
            F.max("value").alias("hi"), F.min("value").alias("lo"))
        return daily.select("scode", "date", snap(div("value", F.lit(250.0)), 4).alias("score"), "label",
                            lead("value", 1, series()).alias("target"), "hi", "lo")

    # -- raw vendor shapes, for the loader functions ---------------------------------------

    @staticmethod
    def code4(key: Column) -> Column:
        return F.lpad(key.cast("string"), 4, "0")

    def raw(self, name: str) -> DataFrame:
        """Reader over vendor-shaped tables: prices, listings, code_list, topix, n225, ..."""
        c = F.col
        if name == "prices":
            m = self.markets()
            d = self.bars().join(m, "scode")
            return d.withColumns({"mcode": F.when(c("scode") % 10 == 9, F.lit("N")).otherwise(F.lit("T")),
                                  "scode": self.code4(c("scode"))})
        if name == "listings":
            return self.table("supplier").select(
                F.concat(self.code4(c("s_suppkey")), F.lit("0")).alias("Code"),
                F.when(c("s_nationkey") % 11 != 0, c("s_nationkey").cast("string")).alias("Sector33Code"))
        if name == "code_list":
            d = self.table("supplier").join(self.table("nation"), c("s_nationkey") == c("n_nationkey"))
            return d.select(self.code4(c("s_suppkey")).alias("scode"), c("s_name").alias("sname"),
                            self.market_name(c("s_nationkey")).alias("market"), c("s_acctbal").alias("close"),
                            c("n_name").alias("gyoshu"))
        if name == "topix":
            return self.index_topix()
        if name == "n225":
            return self.index_n225()
        if name == "investor_types":
            return self.investor_types()
        if name == "margin_interest":
            return self.margin_weekly().withColumn("Code", F.concat(self.code4(c("scode")), F.lit("0"))).drop("scode")
        if name == "short_ratio":
            return self.short_ratio()
        if name == "financials":
            from .loaders import FINANCIAL_COLUMNS
            d = self.financials_raw()
            return d.select(F.concat(self.code4(c("scode")), F.lit("0")).alias("Code"),
                            *[c(n).alias(v) for v, n in FINANCIAL_COLUMNS.items()])
        if name == "sector_return":
            from ..plans.panel import sector_index
            return sector_index(self.bars().select("scode", "date", "close"), self.symbols())
        raise KeyError(name)

    # -- logical inputs with the numeric stock key ------------------------------------------

    def financials(self) -> DataFrame:
        from .loaders import clean_financials
        return clean_financials(self.financials_raw())

    def margin(self) -> DataFrame:
        zero = F.lit(0.0)
        return self.margin_weekly().select(
            "date", "scode", F.coalesce("LongVol", zero).alias("long_margin_trade_balance_share"),
            F.coalesce("ShrtVol", zero).alias("short_margin_trade_balance_share"))

    def shorts(self) -> DataFrame:
        from .loaders import short_selling_ratio
        return short_selling_ratio(self.raw, "1900-01-01")


class DailyProxy(Proxy):
    """The same inputs from a written stock-day table, for jobs that need several of them: the fact table is read once."""

    def __init__(self, spark: SparkSession, root: str, path: str):
        super().__init__(spark, root)
        self.path = path

    @classmethod
    def stage(cls, p: Proxy) -> DailyProxy:
        path = staged_path(p.spark, "daily")
        p.daily().write.parquet(path)
        return cls(p.spark, p.root, path)

    def daily(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def bars(self) -> DataFrame:
        return self.daily().select("scode", "date", "open", "high", "low", "close", "volume", "volume_p")

    def index_topix(self) -> DataFrame:
        return self.daily().groupBy("date").agg(div(F.sum("p_sum"), F.sum("p_n")).alias("close"))

    def financials_raw(self) -> DataFrame:
        month = F.date_trunc("month", F.col("date")).cast("date")
        return self.published(self.daily().groupBy("scode", month.alias("m")).agg(
            F.sum("volume_p").alias("sales"), F.sum("profit").alias("operating_profit"), (F.sum("volume_p") * F.lit(3.0)).alias("total_assets"),
            div(F.sum("tax_sum"), F.sum("tax_n")).alias("_tax"), (F.sum("volume") * F.lit(100.0)).alias("shares_outstanding")))

    def margin_weekly(self) -> DataFrame:
        week = F.date_add(F.date_trunc("week", F.col("date")).cast("date"), 4)
        return self.daily().groupBy(week.alias("date"), "scode").agg(F.sum("long").alias("LongVol"), F.sum("short").alias("ShrtVol"))

    def short_ratio(self) -> DataFrame:
        return self.by_sector(self.daily().select("scode", "date", "a", "b", "c"))
