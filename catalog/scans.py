"""Scans, cleaning, joins and plain aggregates."""

from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions import scalars as S
from stratapanel.operators import sampling
from stratapanel.operators.asof import asof_join, densify
from stratapanel.plans import panel as P
from stratapanel.sources import loaders as L
from stratapanel.sources.proxy import Proxy

from . import sql as q
from .registry import query

C4 = "lpad(CAST({} AS VARCHAR), 4, '0')"
PRICES = f"prices AS (SELECT b.* EXCLUDE (scode), {C4.format('scode')} AS scode, market, CASE WHEN scode % 10 = 9 THEN 'N' ELSE 'T' END AS mcode FROM bars b JOIN markets USING (scode))"
RAWP = q.with_(q.BARS, q.MARKET_NAMES, PRICES)


def px(spark, d):
    return Proxy(spark, d)


@query("scan_symbols", "S-1 C-1 A-12", RAWP + f"""SELECT t.scode, l.sector33_code FROM (SELECT DISTINCT scode FROM prices WHERE market <> 'TOKYO PRO MARKET') t
 LEFT JOIN (SELECT DISTINCT left({C4.format('s_suppkey')} || '0', 4) AS scode, CASE WHEN s_nationkey % 11 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS sector33_code FROM supplier) l USING (scode)
 WHERE l.sector33_code IS NOT NULL""")
def _(spark, d):
    return L.all_symbols(px(spark, d).raw)


@query("scan_latest_symbols", "S-2 O-1", q.with_(q.MARKET_NAMES) + f"SELECT DISTINCT {C4.format('scode')} AS scode FROM markets WHERE {C4.format('scode')} NOT IN ('0002') AND market <> 'その他' ORDER BY 1")
def _(spark, d):
    return L.latest_symbols(px(spark, d).raw)


@query("scan_closes", "S-3", RAWP + f"SELECT date, scode, {q.r('close')} AS close FROM prices WHERE mcode = 'T' AND date >= DATE '1997-01-01'")
def _(spark, d):
    return S.rounded(L.closes(px(spark, d).raw, "1997-01-01"))


_BARCOLS = "date, scode, market, " + q.cols(["open", "high", "low", "close"]) + ", volume, " + q.r("volume_p", 2) + " AS volume_p"


def _bar_report(df):
    return S.rounded(df, {"volume_p": 2})


@query("scan_bars_for_list", "S-4", RAWP + f"SELECT {_BARCOLS} FROM prices WHERE mcode = 'T' AND date >= DATE '1996-06-01' AND scode IN ('0001','0003','0005','0008')")
def _(spark, d):
    return _bar_report(L.bars(px(spark, d).raw, ["0001", "0003", "0005", "0008"], "1996-06-01"))


@query("scan_bars_for_table", "S-4", RAWP + f"SELECT {_BARCOLS} FROM prices WHERE mcode = 'T' AND date >= DATE '1996-06-01' AND scode IN (SELECT {C4.format('s_suppkey')} FROM supplier WHERE s_acctbal > 2000)")
def _(spark, d):
    p = px(spark, d)
    chosen = p.table("supplier").where("s_acctbal > 2000").select(p.code4(F.col("s_suppkey")).alias("scode"))
    return _bar_report(L.bars(p.raw, chosen, "1996-06-01"))


TOPIX_COLS = ["close_mkt", "Market_Return", "Market_Trend_Idx", "Market_HV_20"]


@query("index_features", "S-5 F-1 F-2 F-3", q.with_(q.TRADES, q.TOPIX) + f"SELECT date, {q.cols(TOPIX_COLS)} FROM topix")
def _(spark, d):
    return S.rounded(L.topix_features(L.index_close(px(spark, d).raw, "topix", "1900-01-01")))


@query("index_volatility_change", "S-5 F-4", q.with_(q.N225) + f"SELECT date, {q.r('market_vol_change')} AS market_vol_change FROM n225")
def _(spark, d):
    return S.rounded(L.n225_features(L.index_close(px(spark, d).raw, "n225", "1900-01-01")))


@query("scan_sector_return", "S-6 J-4 J-6 A-2", q.with_(q.BARS, q.SYMBOLS, q.SECTOR_RETURN) + f"SELECT date, sector33_code, {q.r('sector_return')} AS sector_return FROM sector_return WHERE date >= DATE '1996-01-01'")
def _(spark, d):
    return S.rounded(L.sector_return(px(spark, d).raw, "1996-01-01"))


@query("scan_stock_info", "S-7", f"SELECT {C4.format('s_suppkey')} AS scode, s_name AS sname, s_acctbal AS close, n_name AS gyoshu FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    return L.stock_info(px(spark, d).raw)


@query("scan_investor_types", "S-8 A-1", q.with_(q.INVESTORS) + f"SELECT PubDate, {q.r('Foreign_Net_Buy', 2)} AS Foreign_Net_Buy, {q.r('Individual_Net_Buy', 2)} AS Individual_Net_Buy FROM investors WHERE PubDate >= DATE '1996-01-01'")
def _(spark, d):
    return S.rounded(L.investor_types(px(spark, d).raw, "1996-01-01"), 2)


FLOW_COLS = [f"Market_{k}_Z_{n}" for n in (60, 250) for k in ("Foreign", "Individual")] + ["Market_Foreign_Diff"]


def flow_sql(start: str, end: str) -> str:
    dw = q.DW
    z = ", ".join(f"{q.div(f'{x} - ' + q.roll('avg', x, n, dw), q.roll('stddev_samp', x, n, dw))} AS Market_{k}_Z_{n}"
                  for n in (60, 250) for k, x in (("Foreign", "Foreign_Net_Buy"), ("Individual", "Individual_Net_Buy")))
    return (f"days AS (SELECT CAST(d AS DATE) AS date FROM range(DATE '{start}', DATE '{end}' + 1, INTERVAL 1 DAY) t(d)), "
            f"flow0 AS MATERIALIZED (SELECT days.date, Foreign_Net_Buy, Individual_Net_Buy FROM days ASOF LEFT JOIN investors ON days.date >= investors.PubDate), "
            f"flow1 AS (SELECT *, {z}, {q.roll('avg', 'Foreign_Net_Buy', 20, dw)} AS overseas_flow_trend FROM flow0), "
            f"flows AS MATERIALIZED (SELECT *, Market_Foreign_Z_60 - lag(Market_Foreign_Z_60, 5) OVER ({dw}) AS Market_Foreign_Diff, overseas_flow_trend - {q.roll('avg', 'overseas_flow_trend', 5, dw)} AS flow_accel FROM flow1)")


FLOW_RANGE = ("1995-06-01", "2001-12-31")


@query("calendar_densify", "J-7", q.with_(q.INVESTORS, flow_sql(*FLOW_RANGE)) + f"SELECT date, {q.r('Foreign_Net_Buy', 2)} AS Foreign_Net_Buy, {q.r('Individual_Net_Buy', 2)} AS Individual_Net_Buy FROM flow0")
def _(spark, d):
    e = L.investor_types(px(spark, d).raw, "1900-01-01").withColumnRenamed("PubDate", "date")
    return S.rounded(densify(e, "date", ["Foreign_Net_Buy", "Individual_Net_Buy"], *FLOW_RANGE), 2)


@query("investor_flow_features", "F-5 F-6 F-7 F-8", q.with_(q.INVESTORS, flow_sql(*FLOW_RANGE)) + f"SELECT date, {q.cols(FLOW_COLS)}, {q.r('overseas_flow_trend', 2)} AS overseas_flow_trend, {q.r('flow_accel', 2)} AS flow_accel FROM flows")
def _(spark, d):
    f = L.flow_features(L.investor_types(px(spark, d).raw, "1900-01-01"), *FLOW_RANGE)
    return S.rounded(f, {"overseas_flow_trend": 2, "flow_accel": 2})


# the calendar goes on to the last bar, beyond the last publication
LATE_SQL = flow_sql("1995-06-01", "@").replace("DATE '@'", "(SELECT max(date) FROM bars)")


@query("flow_features_after_last_publication", "J-7 F-5 F-6 F-7 F-8", q.with_(q.BARS, q.INVESTORS, LATE_SQL) + f"SELECT date, {q.cols(FLOW_COLS)}, {q.r('overseas_flow_trend', 2)} AS overseas_flow_trend, {q.r('flow_accel', 2)} AS flow_accel FROM flows")
def _(spark, d):
    p = px(spark, d)
    f = L.flow_features(L.investor_types(p.raw, "1900-01-01"), "1995-06-01", until=p.bars().select("date"))
    return S.rounded(f, {"overseas_flow_trend": 2, "flow_accel": 2})


def _fin_cols(names):
    return ", ".join(f"{q.r(c, 4)} AS {c}" for c in names)


@query("scan_financials", "S-9", q.with_(q.TRADES, q.FIN_RAW) + f"SELECT {C4.format('scode')} AS scode, published_date, {_fin_cols(L.FINANCIAL_VALUES)} FROM fin_raw WHERE published_date >= DATE '1996-01-01'")
def _(spark, d):
    return S.rounded(L.financials_raw(px(spark, d).raw, "1996-01-01"), 4)


@query("clean_financials", "C-4 W-12 O-7", q.with_(q.TRADES, q.FIN_RAW) + f""", twice AS (
 SELECT *, 0 AS v FROM fin_raw UNION ALL SELECT * REPLACE (NULL::DOUBLE AS eps, sales * 2 AS sales), 1 AS v FROM fin_raw WHERE month(published_date) = 5),
 filled AS (SELECT scode, published_date, v, {', '.join((f"coalesce({q.ffill(c, 'PARTITION BY scode ORDER BY published_date, v')}, 0)" if c == 'operating_cf' else q.ffill(c, 'PARTITION BY scode ORDER BY published_date, v')) + f' AS {c}' for c in L.FINANCIAL_VALUES)} FROM twice)
 SELECT scode, published_date, {_fin_cols(L.FINANCIAL_VALUES)} FROM filled QUALIFY row_number() OVER (PARTITION BY scode, published_date ORDER BY v DESC) = 1""")
def _(spark, d):
    raw = px(spark, d).financials_raw().withColumn("v", F.lit(0))
    again = raw.where(F.month("published_date") == 5).withColumns(
        {"eps": F.lit(None).cast("double"), "sales": F.col("sales") * F.lit(2.0), "v": F.lit(1)})
    return S.rounded(L.clean_financials(raw.unionByName(again), ["v"]), 4)


@query("scan_margin_weekly", "S-10 C-13", q.with_(q.TRADES, q.MARGIN) + f"SELECT date, {C4.format('scode')} AS scode, long_margin_trade_balance_share, short_margin_trade_balance_share, date + 4 AS available_date FROM margin WHERE date >= DATE '1996-01-01'")
def _(spark, d):
    return L.available_after(L.margin_weekly(px(spark, d).raw, "1996-01-01"))


@query("scan_short_selling", "S-11 F-9", q.with_(q.TRADES, q.SYMBOLS, q.SHORTS) + f"SELECT date, sector33_code, {q.r('selling_volume_ratio')} AS selling_volume_ratio FROM shorts WHERE date >= DATE '1996-01-01'")
def _(spark, d):
    return S.rounded(L.short_selling_ratio(px(spark, d).raw, "1996-01-01"))


@query("count_rows_by_key", "S-12", "SELECT l_suppkey AS scode, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return px(spark, d).table("lineitem").groupBy(F.col("l_suppkey").alias("scode")).agg(F.count(F.lit(1)).alias("n"))


@query("min_history", "C-3", q.with_(q.BARS) + "SELECT scode, date, volume FROM bars QUALIFY count(*) OVER (PARTITION BY scode) >= 530")
def _(spark, d):
    return P.min_history(px(spark, d).bars(), 530).select("scode", "date", "volume")


@query("sanitize_block", "C-2", q.with_(q.BARS) + f", x AS (SELECT scode, date, CASE WHEN day(date) = 1 THEN 'Infinity'::DOUBLE WHEN day(date) = 2 THEN '-Infinity'::DOUBLE WHEN day(date) = 3 THEN 'NaN'::DOUBLE ELSE volume END AS v FROM bars) SELECT scode, date, CASE WHEN isfinite(v) THEN v::FLOAT END AS v FROM x")
def _(spark, d):
    day = F.dayofmonth("date")
    v = F.when(day == 1, float("inf")).when(day == 2, float("-inf")).when(day == 3, float("nan")).otherwise(F.col("volume"))
    return S.sanitize(px(spark, d).bars().select("scode", "date", v.alias("v")), ["v"])


@query("drop_warmup_cooldown", "C-5", q.with_(q.BARS) + f", x AS (SELECT scode, date, {q.lag('volume', 260)} AS past, {q.lead('volume', 60)} AS future FROM bars) SELECT * FROM x WHERE past IS NOT NULL AND future IS NOT NULL")
def _(spark, d):
    b = px(spark, d).bars()
    return b.select("scode", "date", R.lag("volume", 260).alias("past"), R.lead("volume", 60).alias("future")).dropna(subset=["past", "future"])


@query("ordered_column_dedup", "C-8", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, d):
    return px(spark, d).table("supplier").select(*S.ordered_columns(["s_suppkey", "s_name", "s_suppkey", "s_nationkey", "s_name"]))


@query("fill_sector_median", "C-10 A-10 X-11", q.with_(q.BARS, q.SYMBOLS) + f", x AS (SELECT b.scode, date, sector33_code, CASE WHEN (scode + day(date)) % 5 <> 0 THEN volume END AS v FROM bars b LEFT JOIN symbols USING (scode)) SELECT scode, date, {q.r('coalesce(v, median(v) OVER (PARTITION BY date, sector33_code))')} AS v FROM x")
def _(spark, d):
    return _median_fill(spark, d)


@query("fill_sector_median_split_groups", "C-10 A-10 X-11", q.with_(q.BARS, q.SYMBOLS) + f", x AS (SELECT b.scode, date, sector33_code, CASE WHEN (scode + day(date)) % 5 <> 0 THEN volume END AS v FROM bars b LEFT JOIN symbols USING (scode)) SELECT scode, date, {q.r('coalesce(v, median(v) OVER (PARTITION BY date, sector33_code))')} AS v FROM x")
def _(spark, d):
    return _median_fill(spark, d)


def _median_fill(spark, d):
    from stratapanel.operators.crosssection import fill_group_median
    p = px(spark, d)
    v = F.when((F.col("scode") + F.dayofmonth("date")) % 5 != 0, F.col("volume"))
    df = p.bars().join(p.symbols(), "scode", "left").select("scode", "date", "sector33_code", v.alias("v"))
    return S.rounded(fill_group_median(df, ["v"]).select("scode", "date", "v"))


@query("sample_stocks", "C-11 O-8", q.with_(q.BARS) + "SELECT scode, date, volume FROM bars WHERE scode IN (SELECT scode FROM (SELECT DISTINCT scode FROM bars) ORDER BY md5(scode || '|42'), scode LIMIT 7)")
def _(spark, d):
    return sampling.sample_keys(px(spark, d).bars(), "scode", 7, seed=42).select("scode", "date", "volume")


@query("sample_rows", "C-12 O-8", q.with_(q.BARS) + "SELECT scode, date, volume FROM bars ORDER BY md5(scode || '|' || date::VARCHAR || '|42'), scode, date LIMIT 1000")
def _(spark, d):
    return sampling.sample_rows(px(spark, d).bars(), ["scode", "date"], 1000, seed=42).select("scode", "date", "volume")


@query("prune_columns", "C-14", q.with_(q.BARS) + "SELECT scode, date, volume FROM bars")
def _(spark, d):
    df = px(spark, d).bars().withColumns({"filt_a": F.lit(1), "filt_b": F.lit(2)})
    df = df.drop(*[c for c in df.columns if c.startswith("filt_")])
    return df.drop("open", "high", "low", "close", "volume_p")


# -- joins ---------------------------------------------------------------------------------

@query("join_sector_left", "J-1", q.with_(q.BARS, q.SYMBOLS) + "SELECT b.scode, date, volume, sector33_code FROM bars b LEFT JOIN (SELECT * FROM symbols WHERE scode % 7 <> 0) s USING (scode)")
def _(spark, d):
    p = px(spark, d)
    return p.bars().join(p.symbols().where("scode % 7 <> 0"), "scode", "left").select("scode", "date", "volume", "sector33_code")


@query("join_market_series", "J-2", q.with_(q.BARS, q.TOPIX, q.N225) + f"SELECT b.scode, b.date, {q.r('close_mkt')} AS close_mkt, {q.r('market_vol_change')} AS market_vol_change FROM bars b LEFT JOIN topix USING (date) LEFT JOIN n225 USING (date)")
def _(spark, d):
    p = px(spark, d)
    out = p.bars()
    for s in (L.topix_features(p.index_topix()), L.n225_features(p.index_n225())):
        out = out.join(s, "date", "left")
    return S.rounded(out.select("scode", "date", "close_mkt", "market_vol_change"))


@query("join_sector_return", "J-3", q.with_(q.BARS, q.SYMBOLS, q.SECTOR_RETURN) + f"SELECT b.scode, b.date, {q.r('sector_return')} AS sector_return FROM bars b LEFT JOIN symbols USING (scode) LEFT JOIN sector_return USING (date, sector33_code)")
def _(spark, d):
    p = px(spark, d)
    df = p.bars().join(p.symbols(), "scode", "left").join(p.raw("sector_return"), ["date", "sector33_code"], "left")
    return S.rounded(df.select("scode", "date", "sector_return"))


ASOF_FIN = q.with_(q.BARS, q.FIN) + f"SELECT b.scode, b.date, f.published_date, {q.r('f.eps', 6)} AS eps, {q.r('f.shares_outstanding', 2)} AS shares_outstanding FROM bars b ASOF LEFT JOIN fin f ON b.scode = f.scode AND b.date >= f.published_date"


def _asof_fin(spark, d, **kw):
    p = px(spark, d)
    out = asof_join(p.bars().select("scode", "date"), p.financials(), ["scode"], "date", "published_date",
                    ["eps", "shares_outstanding"], keep_right_ts="published_date", **kw)
    return S.rounded(out, {"shares_outstanding": 2})


@query("asof_financials", "J-5", ASOF_FIN)
def _(spark, d):
    return _asof_fin(spark, d, left_unique=True, right_unique=True)


@query("asof_financials_time_blocks", "J-5", ASOF_FIN)
def _(spark, d):
    return _asof_fin(spark, d, left_unique=True, right_unique=True, block="year")


@query("asof_margin", "J-5 C-13", q.with_(q.BARS, q.MARGIN) + "SELECT b.scode, b.date, m.long_margin_trade_balance_share, m.short_margin_trade_balance_share FROM bars b ASOF LEFT JOIN (SELECT * EXCLUDE (date), date + 4 AS a FROM margin) m ON b.scode = m.scode AND b.date >= m.a")
def _(spark, d):
    p = px(spark, d)
    return asof_join(p.bars().select("scode", "date"), L.available_after(p.margin()), ["scode"], "date", "available_date",
                     ["long_margin_trade_balance_share", "short_margin_trade_balance_share"], left_unique=True, right_unique=True)


@query("asof_sector_shorts", "J-5", q.with_(q.BARS, q.SYMBOLS, q.SHORTS) + f", l AS (SELECT b.scode, b.date, sector33_code FROM bars b LEFT JOIN symbols USING (scode)) SELECT l.scode, l.date, {q.r('s.selling_volume_ratio')} AS selling_volume_ratio FROM l ASOF LEFT JOIN (SELECT date + 3 AS date, sector33_code, selling_volume_ratio FROM shorts) s ON l.sector33_code = s.sector33_code AND l.date >= s.date")
def _(spark, d):
    # many rows per (sector, date) on the left: resolved on distinct (sector, date), joined back
    p = px(spark, d)
    left = p.bars().join(p.symbols(), "scode", "left").select("scode", "date", "sector33_code")
    right = p.shorts().withColumn("date", F.date_add("date", 3))
    out = asof_join(left, right, ["sector33_code"], "date", "date", ["selling_volume_ratio"], right_unique=True)
    return S.rounded(out.select("scode", "date", "selling_volume_ratio"))


@query("counts_join_by_year", "J-9", "WITH f AS (SELECT year(l_shipdate) AS year, count(*) AS flagged FROM lineitem WHERE l_quantity > 49 AND year(l_shipdate) < 2000 GROUP BY 1), t AS (SELECT year(l_shipdate) AS year, count(*) AS total FROM lineitem GROUP BY 1) SELECT t.year::INTEGER AS year, total, coalesce(flagged, 0) AS flagged FROM t LEFT JOIN f USING (year)")
def _(spark, d):
    li = px(spark, d).table("lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity")
    hit = (F.col("l_quantity") > 49) & (F.col("year") < 2000)
    return li.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(hit, 1)).alias("flagged"))


@query("union_all_by_name", "O-4", "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT c_custkey AS k, c_name AS n FROM customer")
def _(spark, d):
    p = px(spark, d)
    a = p.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    return a.unionByName(p.table("customer").select(F.col("c_name").alias("n"), F.col("c_custkey").alias("k")))


@query("sort_desc_head", "O-2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def _(spark, d):
    return px(spark, d).table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("set_complement", "O-6", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, d):
    p = px(spark, d)
    return p.table("customer").join(p.table("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
