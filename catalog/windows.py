"""Window primitives, one query each."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions import recursion as rec
from stratapanel.functions import scalars as S
from stratapanel.operators import ranking as K
from stratapanel.operators.crosssection import sector_z
from stratapanel.sources.proxy import Proxy

from . import sql as q
from .registry import query

B = q.with_(q.BARS)


def _bars(spark, d):
    return Proxy(spark, d).bars()


def simple(name, ids, cols, stage=None, digits=6):
    """Register a query that adds columns to the bars; cols: name -> (Column factory, sql)."""
    sql_ctes, last = q.chain("bars", [{n: s for n, (_, s) in st.items()} for st in (stage or [])])
    sql = q.with_(q.BARS, sql_ctes) + "SELECT scode, date, " + ", ".join(
        f"{q.r(s, digits)} AS {n}" for n, (_, s) in cols.items()) + f" FROM {last}"

    @query(name, ids, sql)
    def run(spark, d):
        df = _bars(spark, d)
        for st in stage or []:
            df = df.withColumns({n: f() for n, (f, _) in st.items()})
        return S.rounded(df.select("scode", "date", *[f().cast("double").alias(n) for n, (f, _) in cols.items()]), digits)


LOGRET = {"r": (lambda: F.ln(S.div("close", R.lag("close"))), q.ln(q.div("close", q.lag("close"))))}
simple("lag_lead_diff", "W-1 W-2", {
    "lag1": (lambda: R.lag("close"), q.lag("close")), "lead5": (lambda: R.lead("close", 5), q.lead("close", 5)),
    "diff1": (lambda: R.diff("close"), f"close - {q.lag('close')}"),
    "diff20": (lambda: R.diff("close", 20), f"close - {q.lag('close', 20)}")})
GAPPY = {"x": (lambda: F.when(F.dayofmonth("date") % 7 != 0, F.col("close")),
               "CASE WHEN day(date) % 7 <> 0 THEN close END")}
simple("pct_change", "W-3", {
    "ret1": (lambda: R.pct_change("xf"), q.pct("xf")), "ret5": (lambda: R.pct_change("xf", 5), q.pct("xf", 5)),
    "ret60": (lambda: R.pct_change("xf", 60), q.pct("xf", 60))},
    stage=[GAPPY, {"xf": (lambda: R.ffill("x"), q.ffill("x"))}])
simple("rolling_sum_mean", "W-4", {
    "mean5": (lambda: R.roll(F.avg, "x", 5), q.roll("avg", "x", 5)),
    "mean25": (lambda: R.roll(F.avg, "close", 25), q.roll("avg", "close", 25)),
    "sum20": (lambda: R.roll(F.sum, "volume", 20), q.roll("sum", "volume", 20))}, stage=[GAPPY])
simple("rolling_min_max", "W-5", {
    "min5": (lambda: R.roll(F.min, "low", 5), q.roll("min", "low", 5)),
    "max60": (lambda: R.roll(F.max, "high", 60), q.roll("max", "high", 60))})
simple("rolling_std_var", "W-6", {
    "std20": (lambda: R.roll(F.stddev_samp, "r", 20), q.roll("stddev_samp", "r", 20)),
    "var60": (lambda: R.roll(F.var_samp, "r", 60), q.roll("var_samp", "r", 60))}, stage=[LOGRET])
simple("rolling_std_population", "W-7", {
    "std0_20": (lambda: R.roll_std0("close", 20), q.roll("stddev_pop", "close", 20))})
simple("rolling_beta", "W-8", {
    "beta60": (lambda: R.roll_beta("r", "rv", 60),
               f"CASE WHEN {q.over('count', 'r + rv', 60)} >= 60 THEN "
               f"covar_samp(r, rv) OVER ({q.W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) / nullif({q.over('var_samp', 'rv', 60)}, 0) END")},
    stage=[LOGRET, {"rv": (lambda: R.pct_change("volume"), q.pct("volume"))}])
simple("rolling_skew_kurtosis", "W-9", {
    "skew20": (lambda: R.roll_skew("r", 20), q.roll("skewness", "r", 20)),
    "kurt20": (lambda: R.roll_kurt("r", 20), q.roll("kurtosis", "r", 20))}, stage=[LOGRET])
simple("rolling_median", "W-10", {
    "median20": (lambda: R.roll_median("volume_p", 20), q.roll("median", "volume_p", 20)),
    "median5": (lambda: R.roll_median("x", 5), q.roll("median", "x", 5))}, stage=[GAPPY])
simple("rolling_product", "W-11", {
    "growth60": (lambda: R.roll_growth("rs", 60), q.roll("product", "1 + rs", 60))},
       stage=[LOGRET, {"rs": (lambda: F.col("r") * F.lit(0.01), "r * 0.01::DOUBLE")}])
simple("forward_fill", "W-12", {"filled": (lambda: R.ffill("x"), q.ffill("x"))}, stage=[GAPPY])
simple("forward_rolling", "W-13", {
    "max5": (lambda: R.ahead(F.max, "high", 5), q.ahead("max", "high", 5)),
    "min60": (lambda: R.ahead(F.min, "low", 60), q.ahead("min", "low", 60)),
    "sum5": (lambda: R.ahead(F.sum, "volume", 5), q.ahead("sum", "volume", 5))})
simple("cumulative_count", "W-17", {
    "seq": (lambda: R.row_no() - 1, f"row_number() OVER ({q.W}) - 1")})

RN = {"rn": (lambda: R.row_no(), f"row_number() OVER ({q.W})")}


def rci_sql(x: str, n: int) -> str:
    """Average rank by counting smaller and equal prices in the frame's list."""
    fr = f"OVER ({q.W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    lst = f"list({x}) {fr}"
    d2 = (f"list_sum(list_transform(v, lambda x, i: pow(i - (len(list_filter(v, lambda y: y < x)) "
          f"+ (len(list_filter(v, lambda y: y = x)) + 1) / 2.0), 2)))")
    return lst, f"CASE WHEN len(v) >= {n} THEN (1 - 6 * {d2} / ({n} * ({n} * {n} - 1.0))) * 100 END"


def _rank_correlation(n):
    lst, val = rci_sql("close", n)

    @query(f"rank_correlation_{n}", "W-15", q.with_(q.BARS) + f"SELECT scode, date, {q.r(val)} AS rci FROM (SELECT *, {lst} AS v FROM bars)")
    def _(spark, d):
        return S.rounded(R.with_rci(_bars(spark, d), "close", {"rci": n}).select("scode", "date", "rci"))


for _n in (9, 26, 52):
    _rank_correlation(_n)


@query("rank_correlation_with_ties", "W-15", q.with_(q.BARS) + f"SELECT scode, date, {q.r(rci_sql('x', 26)[1])} AS rci FROM (SELECT *, {rci_sql('x', 26)[0]} AS v FROM (SELECT *, round(volume / 10) AS x FROM bars))")
def _(spark, d):
    df = _bars(spark, d).withColumn("x", F.round(F.col("volume") / F.lit(10)))
    return S.rounded(R.with_rci(df, "x", {"rci": 26}).select("scode", "date", "rci"))


STREAK_SQL = q.with_(q.BARS) + f""", s0 AS (SELECT scode, date, sign(close - {q.lag('close')}) AS sg FROM bars),
s1 AS (SELECT *, CASE WHEN coalesce(sg, 0) = coalesce({q.lag('sg')}, 0) THEN 0 ELSE 1 END AS chg FROM s0),
s2 AS (SELECT *, sum(chg) OVER ({q.W}) AS run FROM s1)
SELECT scode, date, coalesce(sg, 0)::DOUBLE * row_number() OVER (PARTITION BY scode, run ORDER BY date) AS streak FROM s2"""


@query("signed_streak", "W-14", STREAK_SQL)
def _(spark, d):
    df = _bars(spark, d).withColumn("dc", R.diff("close"))
    return R.with_streak(df, "dc", "streak").select("scode", "date", F.col("streak").cast("double"))


def smooth_sql(base: str, series: list[tuple[str, str, int, float]], name: str) -> str:
    """Recursive CTE for several smoothers over ``base`` (scode, rn, inputs)."""
    def k(o): return f"k_{o}"
    init, step, sel = [], [], []
    for out, x, n, a in series:
        init += [f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS {k(out)}",
                 f"CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE {x} / {1 if n > 1 else 1} END AS y_{out}",
                 f"CASE WHEN {n} = 1 THEN {x} END AS {out}"]
        nxt = (f"CASE WHEN b.{x} IS NULL THEN e.y_{out} WHEN e.{k(out)} + 1 < {n} THEN e.y_{out} + b.{x} "
               f"WHEN e.{k(out)} + 1 = {n} THEN (e.y_{out} + b.{x}) / {float(n)}::DOUBLE "
               f"ELSE e.y_{out} + {a!r}::DOUBLE * (b.{x} - e.y_{out}) END")
        step += [f"e.{k(out)} + CASE WHEN b.{x} IS NULL THEN 0 ELSE 1 END", nxt,
                 f"CASE WHEN b.{x} IS NOT NULL AND e.{k(out)} + 1 >= {n} THEN {nxt} END"]
        sel.append(out)
    return (f"{name} AS (SELECT scode, rn, {', '.join(init)} FROM {base} WHERE rn = 1 UNION ALL "
            f"SELECT b.scode, b.rn, {', '.join(step)} FROM {name} e JOIN {base} b ON b.scode = e.scode AND b.rn = e.rn + 1)")


_dm_up, _dm_dn = f"(high - {q.lag('high')})", f"({q.lag('low')} - low)"
INDICATOR_CTES = f"""ib AS MATERIALIZED (SELECT scode, date, close, row_number() OVER ({q.W}) AS rn,
  CASE WHEN {q.lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) END AS tr,
  CASE WHEN {q.lag('close')} IS NOT NULL THEN CASE WHEN {_dm_up} > {_dm_dn} AND {_dm_up} > 0 THEN {_dm_up} ELSE 0 END END AS pdm,
  CASE WHEN {q.lag('close')} IS NOT NULL THEN CASE WHEN {_dm_dn} > {_dm_up} AND {_dm_dn} > 0 THEN {_dm_dn} ELSE 0 END END AS mdm,
  CASE WHEN {q.lag('close')} IS NOT NULL THEN greatest(close - {q.lag('close')}, 0) END AS gain,
  CASE WHEN {q.lag('close')} IS NOT NULL THEN greatest({q.lag('close')} - close, 0) END AS loss FROM bars),
""" + smooth_sql("ib", [("e12", "close", 12, 2 / 13), ("e26", "close", 26, 2 / 27), ("atr5", "tr", 5, 1 / 5),
                        ("atr14", "tr", 14, 1 / 14), ("atr20", "tr", 20, 1 / 20), ("g9", "gain", 9, 1 / 9), ("l9", "loss", 9, 1 / 9),
                        ("g14", "gain", 14, 1 / 14), ("l14", "loss", 14, 1 / 14), ("p14", "pdm", 14, 1 / 14), ("m14", "mdm", 14, 1 / 14)], "rec1") + f""",
ib2 AS MATERIALIZED (SELECT scode, rn, e12 - e26 AS macd, 100 * abs(p14 - m14) / nullif(p14 + m14, 0) AS dx, 100 * g9 / nullif(g9 + l9, 0) AS rsi9,
  100 * g14 / nullif(g14 + l14, 0) AS rsi14, atr5, atr14, atr20 FROM rec1),
""" + smooth_sql("ib2", [("signal", "macd", 9, 0.2), ("adx14", "dx", 14, 1 / 14)], "rec2") + """,
indicators AS MATERIALIZED (SELECT ib.scode, ib.date, macd, signal, rsi9, rsi14, atr5, atr14, atr20, adx14 FROM ib JOIN ib2 USING (scode, rn) JOIN rec2 USING (scode, rn))"""
IND = ["macd", "signal", "rsi9", "rsi14", "atr5", "atr14", "atr20", "adx14"]


def _smoothing(name, block):
    @query(name, "W-16", "WITH RECURSIVE " + q.BARS + ", " + INDICATOR_CTES
           + f" SELECT scode, date, {q.cols(IND, 4)} FROM indicators")
    def _(spark, d):
        df = rec.with_indicators(_bars(spark, d), block=block)
        return S.rounded(df.select("scode", "date", *[F.col(f"_{c}").alias(c) for c in IND]), 4)


_smoothing("recursive_smoothing", rec.BLOCK)
# a lean year of bars without prices now and then: the state stands over gaps, also across blocks
GAPS = "gbars AS (SELECT scode, date, CASE WHEN day(date) % 7 <> 3 THEN high END AS high, CASE WHEN day(date) % 7 <> 3 THEN low END AS low, CASE WHEN day(date) % 7 <> 3 AND day(date) <> 5 THEN close END AS close FROM bars), "


@query("recursive_smoothing_with_gaps", "W-16", "WITH RECURSIVE " + q.BARS + ", " + GAPS + INDICATOR_CTES.replace("FROM bars)", "FROM gbars)")
       + f" SELECT scode, date, {q.cols(IND, 4)} FROM indicators")
def _(spark, d):
    priced = F.dayofmonth("date") % 7 != 3
    bars = _bars(spark, d).withColumns({"high": F.when(priced, F.col("high")), "low": F.when(priced, F.col("low")),
                                        "close": F.when(priced & (F.dayofmonth("date") != 5), F.col("close"))})
    df = rec.with_indicators(bars, block=300)
    return S.rounded(df.select("scode", "date", *[F.col(f"_{c}").alias(c) for c in IND]), 4)


_smoothing("recursive_smoothing_short_blocks", 300)   # several blocks per stock: exercises the carry


@query("cumulative_product", "W-18", q.with_(q.TRADES, q.TOPIX_RAW)
       + f", t AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM topix_raw) SELECT date, {q.r('product(1 + r * 0.01::DOUBLE) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS equity FROM t")
def _(spark, d):
    w = Window.orderBy("date")   # one row per calendar day
    t = Proxy(spark, d).index_topix().withColumn("r", R.pct_change("close", 1, w))
    return S.rounded(t.select("date", F.product(F.lit(1.0) + F.col("r") * F.lit(0.01)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("equity")))


@query("top_n_per_group", "W-19 O-3", B + "SELECT date, scode, volume FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, scode) <= 5")
def _(spark, d):
    w = Window.partitionBy("date").orderBy(F.desc("volume"), "scode")
    # row_number <= n: Spark keeps at most n rows per group before the exchange (WindowGroupLimit)
    return _bars(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("date", "scode", "volume")


PCT_SQL = B + f"SELECT scode, date, {q.r(q.pctrank('volume', 'date'))} AS pct_volume, {q.r(q.pctrank('x', 'date'))} AS pct_x FROM (SELECT *, CASE WHEN day(date) % 7 <> 0 OR scode % 3 = 0 THEN close END AS x FROM bars)"


def _pct(df, **kw):
    df = df.withColumn("x", F.when((F.dayofmonth("date") % 7 != 0) | (F.col("scode") % 3 == 0), F.col("close")))
    out = K.average_ranks(df, ["volume", "x"], ["date"], **kw)
    return S.rounded(out.select("scode", "date", K.pct_rank("volume").alias("pct_volume"), K.pct_rank("x").alias("pct_x")))


@query("percent_rank_avg_ties", "W-20", PCT_SQL)
def _(spark, d):
    return _pct(_bars(spark, d))


@query("percent_rank_split_groups", "W-20", PCT_SQL)
def _(spark, d):
    # cells as in very large groups: one per about 8 distinct values
    return _pct(_bars(spark, d), spacing=8)


GAUSS_SQL = B + f", g AS (SELECT scode, date, {q.pctrank('volume', 'date')} AS pr FROM bars), g2 AS (SELECT *, {q.clip('pr', 1e-6, 1 - 1e-6)} AS pc, pr * (1 - 2e-6::DOUBLE) + 1e-6::DOUBLE AS pt FROM g) SELECT scode, date, {q.r(q.probit('pc'))} AS gauss_feature, {q.r(q.probit('pt') + ' / sqrt(2.0::DOUBLE)')} AS gauss_target FROM g2"


@query("gauss_rank", "W-21", GAUSS_SQL)
def _(spark, d):
    df = K.average_ranks(_bars(spark, d), ["volume"], ["date"]).withColumn("pr", K.pct_rank("volume"))
    df = df.withColumns({"pc": S.clip("pr", 1e-6, 1 - 1e-6), "pt": F.col("pr") * F.lit(1 - 2e-6) + F.lit(1e-6)})
    return S.rounded(df.select("scode", "date", S.probit("pc").alias("gauss_feature"),
                               (S.probit("pt") / F.lit(2 ** 0.5)).alias("gauss_target")))


def z_sql(x: str, by: str) -> str:
    p = f"OVER (PARTITION BY {by})"
    return (f"(CASE WHEN count(*) {p} <= 1 OR stddev_samp({x}) {p} = 0 THEN 0.0::DOUBLE "
            f"WHEN {x} IS NULL OR stddev_samp({x}) {p} IS NULL THEN NULL "
            f"ELSE least(greatest(({x} - avg({x}) {p}) / stddev_samp({x}) {p}, -3), 3) END)")


Z_SQL = q.with_(q.BARS, q.SYMBOLS) + f"SELECT scode, date, {q.r(z_sql('x', 'date, sector33_code'))} AS z FROM (SELECT b.*, sector33_code, CASE WHEN day(date) % 7 <> 0 THEN close END AS x FROM bars b LEFT JOIN symbols USING (scode))"


def _z(spark, d):
    p = Proxy(spark, d)
    df = p.bars().join(p.symbols(), "scode", "left").withColumn("x", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")))
    return S.rounded(sector_z(df, ["x"]).select("scode", "date", F.col("x_sector_z").alias("z")))


@query("group_zscore", "W-22", Z_SQL)
def _(spark, d):
    return _z(spark, d)


@query("group_zscore_joined_stats", "W-22", Z_SQL)
def _(spark, d):
    return _z(spark, d)


simple("efficiency_ulcer_moneyflow", "W-23", {
    "efficiency": (lambda: S.div(F.abs(R.diff("close", 10)), R.roll(F.sum, "ad", 10)),
                   q.div(f"abs(close - {q.lag('close', 10)})", q.roll("sum", "ad", 10))),
    "slope": (lambda: R.diff("close", 10) / F.lit(10.0), f"(close - {q.lag('close', 10)}) / 10.0"),
    "ulcer": (lambda: F.sqrt(R.roll(F.sum, "dd2", 14) / F.lit(14.0)), f"sqrt({q.roll('sum', 'dd2', 14)} / 14.0)"),
    "mfi": (lambda: F.lit(100.0) * S.div(R.roll(F.sum, "pos", 14), R.roll(F.sum, "pos", 14) + R.roll(F.sum, "neg", 14)),
            q.div(f"100 * {q.roll('sum', 'pos', 14)}", f"{q.roll('sum', 'pos', 14)} + {q.roll('sum', 'neg', 14)}"))},
    stage=[{"ad": (lambda: F.abs(R.diff("close")), f"abs(close - {q.lag('close')})"),
            "mx": (lambda: R.roll(F.max, "close", 14), q.roll("max", "close", 14)),
            "tp": (lambda: (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0), "(high + low + close) / 3.0")},
           {"dd2": (lambda: F.pow(F.lit(100.0) * S.div(F.col("close") - F.col("mx"), "mx"), 2), "pow(100 * (close - mx) / mx, 2)"),
            "pos": (lambda: F.when(R.diff("tp") > 0, F.col("tp") * F.col("volume")).when(R.diff("tp").isNotNull(), 0.0),
                    f"CASE WHEN tp > {q.lag('tp')} THEN tp * volume WHEN {q.lag('tp')} IS NOT NULL THEN 0 END"),
            "neg": (lambda: F.when(R.diff("tp") < 0, F.col("tp") * F.col("volume")).when(R.diff("tp").isNotNull(), 0.0),
                    f"CASE WHEN tp < {q.lag('tp')} THEN tp * volume WHEN {q.lag('tp')} IS NOT NULL THEN 0 END")}])
