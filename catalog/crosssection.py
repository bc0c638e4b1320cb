"""Targets, cross-sectional features and universe flags."""

from pyspark.sql import functions as F

from stratapanel.functions import scalars as S
from stratapanel.functions import rolling as R
from stratapanel.operators import crosssection as C
from stratapanel.operators import features as X
from stratapanel.operators import ranking as K
from stratapanel.operators import targets as T
from stratapanel.operators import universe as U
from stratapanel.operators.asof import asof_join
from stratapanel.plans.staging import staged_path
from stratapanel.sources import loaders as L
from stratapanel.sources import sinks
from stratapanel.sources.proxy import Proxy

from . import sql as q
from .features import R0
from .registry import query
from .windows import z_sql

lag, lead, roll, ahead, div, pct = q.lag, q.lead, q.roll, q.ahead, q.div, q.pct

# -- per-stock targets ---------------------------------------------------------------------
_B60 = f"OVER ({q.W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_F60 = f"OVER ({q.W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)"
TGT0 = [R0 | {"ret1": pct("close"), "nr": f"row_number() OVER ({q.W})::DOUBLE"},
        {"vol20": roll("stddev_samp", "r", 20), "v60": roll("stddev_samp", "ret1", 60),
         "beta": f"CASE WHEN count(ret1 + Market_Return) {_B60} >= 60 AND count(Market_Return) {_B60} >= 60 THEN covar_samp(ret1, Market_Return) {_B60} / nullif(var_samp(Market_Return) {_B60}, 0) END",
         "entry": lead("open"), "mk5": ahead("sum", "Market_Return", 5), "mk60": ahead("sum", "Market_Return", 60),
         "hi5": ahead("max", "high", 5), "lo5": ahead("min", "low", 5), "cl5": lead("close", 5),
         "hi60": ahead("max", "high", 60), "lo60": ahead("min", "low", 60), "cl60": lead("close", 60),
         "fvp": ahead("sum", "volume_p", 5), "fv": ahead("sum", "volume", 5),
         "cons": f"CASE WHEN count(close) {_F60} >= 60 THEN pow(corr(nr, close) {_F60}, 2) END",
         **{f"h{k}": lead("high", k) for k in range(1, 6)}, **{f"l{k}": lead("low", k) for k in range(1, 6)}},
        {"r5": div("cl5", "entry") + " - 1", "r60": div("cl60", "entry") + " - 1", "vol5": "vol20 * sqrt(5.0::DOUBLE)"}]


def tb_sql(up, dn):
    hits = " ".join(f"WHEN l{k} < entry * (1 - vol5 * {dn}::DOUBLE) THEN -1 WHEN h{k} > entry * (1 + vol5 * {up}::DOUBLE) THEN 1" for k in range(1, 6))
    return f"CASE {hits} ELSE 0 END"


TGT_CTES, TGT_LAST = q.chain("tb", TGT0, "tg")
TGT_BASE = q.with_(q.BARS, q.TOPIX) + ", tb AS MATERIALIZED (SELECT b.*, Market_Return FROM bars b LEFT JOIN topix USING (date)), " + TGT_CTES
TOUCH = f""", tgt AS MATERIALIZED (SELECT * FROM {TGT_LAST}), touch AS (SELECT a.scode, a.date,
  coalesce(min(CASE WHEN f.high > a.entry * (1 + a.vol20 * sqrt(60.0::DOUBLE)) THEN f.nr - a.nr END), 61) AS u,
  coalesce(min(CASE WHEN f.low < a.entry * (1 - a.vol20 * sqrt(60.0::DOUBLE)) THEN f.nr - a.nr END), 61) AS d
  FROM tgt a JOIN tgt f ON a.scode = f.scode AND f.nr > a.nr AND f.nr <= a.nr + 60 GROUP BY a.scode, a.date)"""
TGT_OUT = {
    "Entry_Price": "entry", "Future_High_Tac": "hi5", "Future_Low_Tac": "lo5", "Future_Close_Tac": "cl5", "Future_High_Str": "hi60",
    "Future_Low_Str": "lo60", "Future_Close_Str": "cl60", "target_tac_smoothed_return": "(fvp / (fv + 1e-9)) / entry - 1", "target_ret_5": "r5",
    "target_tac_vol_scaled_residual": "(r5 - beta * mk5) / (vol5 + 1e-6)", "target_ret_60": "r60",
    "target_str_risk_adj": "(r60 - beta * mk60) / (vol20 * sqrt(12.0::DOUBLE) + 1e-6)", "target_str_consistency": "cons",
    "target_str_vol_scale": "r60 / (v60 + 1e-6)"}


def target_frame(p: Proxy):
    t = L.topix_features(p.index_topix()).select("date", "Market_Return", "close_mkt")
    df = p.bars().join(F.broadcast(t), "date", "left")   # one row a day
    fs = X.FeatureSet()
    X.base_columns(fs)
    X.vol_20d(fs)
    X.beta_60(fs)
    X.volatility_60(fs)
    return fs.apply(df)


def _tgt_select(spark, d, names):
    df = T.target_set().apply(target_frame(Proxy(spark, d)))
    return S.rounded(df.select("scode", "date", *[F.col(n).cast("double") for n in names]))


@query("price_targets", "G-1 G-2 G-3 G-4 G-5 G-6 G-8 G-9 G-10 G-11 W-13", TGT_BASE + f" SELECT scode, date, {', '.join(f'{q.r(s)} AS {n}' for n, s in TGT_OUT.items())} FROM {TGT_LAST}")
def _(spark, d):
    return _tgt_select(spark, d, list(TGT_OUT))


@query("tactical_barriers", "G-7", TGT_BASE + " SELECT scode, date, " + ", ".join(f"({tb_sql(*w)})::DOUBLE AS target_tac_tb_strategy_{n}" for n, w in T.TACTICAL_BARRIERS.items()) + f" FROM {TGT_LAST}")
def _(spark, d):
    return _tgt_select(spark, d, [f"target_tac_tb_strategy_{n}" for n in T.TACTICAL_BARRIERS])


@query("strategic_barrier", "G-12", TGT_BASE + TOUCH + " SELECT t.scode, t.date, (CASE WHEN hi60 IS NULL OR entry IS NULL OR vol20 IS NULL THEN NULL WHEN u = 61 AND d = 61 THEN 0 WHEN u < d THEN 1 ELSE -1 END)::DOUBLE AS target_str_triple_barrier FROM tgt t LEFT JOIN touch USING (scode, date)")
def _(spark, d):
    return _tgt_select(spark, d, ["target_str_triple_barrier"])


# -- cross-sectional targets ---------------------------------------------------------------
XS_SQL = TGT_BASE.replace("WITH ", "WITH ", 1) + f""", {q.SYMBOLS}, {q.SECTOR_RETURN},
 x0 AS MATERIALIZED (SELECT t.scode, t.date, r5, r60, mk5, sector33_code, sector_return FROM {TGT_LAST} t LEFT JOIN symbols USING (scode) LEFT JOIN sector_return USING (date, sector33_code)),
 x1 AS MATERIALIZED (SELECT *, {ahead('sum', 'sector_return', 5)} AS sec5, {q.pctrank('r5', 'date')} AS k5, {q.pctrank('r60', 'date')} AS k60 FROM x0),
 x2 AS (SELECT *, k5 * (1 - 2e-6::DOUBLE) + 1e-6::DOUBLE AS kp FROM x1)
 SELECT scode, date, {q.r('k5')} AS target_tac_rank, {q.r(q.probit('kp') + ' / sqrt(2.0::DOUBLE)')} AS target_tac_gauss_rank, {q.r('r5 - 0.5::DOUBLE * (mk5 + sec5)')} AS target_tac_linear_residual,
 CASE WHEN r5 > sec5 THEN 1 ELSE 0 END AS target_tac_sector_relative, {q.r('k60')} AS target_str_rank, {q.r('r60 - avg(r60) OVER (PARTITION BY date, sector33_code)')} AS target_str_peer_alpha FROM x2"""
XS_COLS = ["target_tac_rank", "target_tac_gauss_rank", "target_tac_linear_residual", "target_tac_sector_relative", "target_str_rank", "target_str_peer_alpha"]


def _xs(spark, d, **kw):
    p = Proxy(spark, d)
    df = T.target_set().apply(target_frame(p)).join(p.symbols(), "scode", "left")
    df = df.join(F.broadcast(p.raw("sector_return")), ["date", "sector33_code"], "left")   # one row a day and sector
    df = df.select("scode", "date", "sector33_code", "sector_return", "Market_Return", "target_ret_5", "target_ret_60")
    return S.rounded(T.cross_sectional_targets(df, **kw).select("scode", "date", *XS_COLS))


@query("cross_sectional_targets", "G-13 G-14 G-15 G-16 G-17 G-18 X-7", XS_SQL)
def _(spark, d):
    return _xs(spark, d)


@query("cross_sectional_targets_split_groups", "G-13 G-14 G-15 G-16 G-17 G-18", XS_SQL)
def _(spark, d):
    return _xs(spark, d, spacing=8)


# -- orthogonalised target -----------------------------------------------------------------
OMIN = 14
_t = [["s00", "s01", "s02"], ["s01", "s11", "s12"], ["s02", "s12", "s22"]]


def det_sql(m):
    return (f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})"
            f" + {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))")


_swap = [[[f"t{i}" if j == k else _t[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
ORTH_SQL = q.with_(q.BARS, q.FIN, q.TOPIX_RAW) + f""",
 mk0 AS (SELECT date, {pct('close', 1, q.DW)} AS mr FROM topix_raw), mk AS (SELECT *, {roll('var_samp', 'mr', 60, q.DW)} AS mv FROM mk0),
 reg AS (SELECT s_suppkey AS scode, CAST(n_regionkey AS VARCHAR) AS sector33_code FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 o0 AS (SELECT b.scode, b.date, close, bps, shares_outstanding, sector33_code, mr, mv, {pct('close', 1, 'PARTITION BY b.scode ORDER BY b.date')} AS ret
  FROM bars b ASOF LEFT JOIN fin f ON b.scode = f.scode AND b.date >= f.published_date LEFT JOIN reg ON reg.scode = b.scode LEFT JOIN mk ON mk.date = b.date),
 o1 AS (SELECT *, {lead('close', 60)} / close - 1 AS y, {roll('stddev_samp', 'ret', 60)} AS vol, {q.ln('close * shares_outstanding')} AS x1, {q.ln('close / bps')} AS x2,
  CASE WHEN {q.over('count', 'ret + mr', 60)} >= 60 THEN covar_samp(ret, mr) {_B60} END / nullif(mv, 0) AS x0 FROM o0),
 o2 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM o1 WHERE y IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND sector33_code IS NOT NULL),
 o3 AS (SELECT scode, date, vol, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY date, sector33_code) AS {v}' for v in ('y', 'x0', 'x1', 'x2'))} FROM o2 WHERE n >= {OMIN}),
 o4 AS (SELECT *, {', '.join(f'sum(x{i}*x{j}) OVER (PARTITION BY date) AS s{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum(x{i}*y) OVER (PARTITION BY date) AS t{i}' for i in range(3))} FROM o3),
 o5 AS (SELECT *, y - ({' + '.join(f'({det_sql(_swap[k])}) / nullif({det_sql(_t)}, 0) * x{k}' for k in range(3))}) AS e FROM o4),
 o6 AS (SELECT *, {q.clip('e / nullif(vol, 0)', -5, 5)} AS adj FROM o5), o7 AS (SELECT *, {q.pctrank('adj', 'date')} AS k FROM o6)
 SELECT date, scode, {q.r('e', 5)} AS raw_resid, {q.r('k')} AS target_reg, CASE WHEN k >= 0.8 THEN 1 ELSE 0 END AS target_cls FROM o7"""


@query("orthogonal_target", "G-19 J-5 A-11 W-8", ORTH_SQL)
def _(spark, d):
    p = Proxy(spark, d)
    region = p.table("supplier").join(p.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("scode"), F.col("n_regionkey").cast("string").alias("sector33_code"))
    df = asof_join(p.bars().select("scode", "date", "close"), p.financials(), ["scode"], "date", "published_date",
                   ["bps", "shares_outstanding"], left_unique=True, right_unique=True).join(region, "scode", "left")
    return S.rounded(T.orthogonal_target(T.orthogonal_inputs(df, p.index_topix()), min_obs=OMIN), {"raw_resid": 5})


# -- sector-relative, z-score and rank features ----------------------------------------------
SEC_SQL = q.with_(q.BARS, q.SYMBOLS, q.SECTOR_RETURN, q.TOPIX, q.SHORTS) + f""",
 b0 AS MATERIALIZED (SELECT b.*, sector33_code, sector_return, selling_volume_ratio, Market_Return FROM bars b LEFT JOIN symbols USING (scode) LEFT JOIN sector_return USING (date, sector33_code)
  LEFT JOIN shorts USING (date, sector33_code) LEFT JOIN topix USING (date)), b1 AS (SELECT *, {q.ln(div('close', lag('close')))} AS r FROM b0)
 SELECT scode, date, {q.r(roll('avg', 'sector_return', 5))} AS Sector_Momentum_5d, {q.r(div('close', 'sector_return'), 2)} AS Sector_Rel, {q.r('r - sector_return')} AS Rel_Sector_Return_1d,
 {q.r(f"{roll('sum', 'r', 5)} - {roll('sum', 'sector_return', 5)}")} AS Rel_Sector_Return_5d, {q.r(f"ln({roll('product', '1 + sector_return', 60)} - {roll('product', '1 + Market_Return', 60)})")} AS log_strength,
 {q.r('selling_volume_ratio')} AS sector_short_sell_ratio, {q.r(ahead('sum', 'sector_return', 5))} AS Sector_Return_Future FROM b1"""


@query("sector_relative_features", "X-1 X-2 X-3 X-4 X-5 X-6 X-7", SEC_SQL.replace("ln(" + roll('product', '1 + sector_return', 60), "ln(" + roll('product', '1 + sector_return', 60)))
def _(spark, d):
    p = Proxy(spark, d)
    df = p.bars().join(p.symbols(), "scode", "left").join(p.raw("sector_return"), ["date", "sector33_code"], "left")
    df = df.join(p.shorts(), ["date", "sector33_code"], "left")
    df = df.join(L.topix_features(p.index_topix()).select("date", "Market_Return"), "date", "left")
    df = df.withColumn("Log_Return", F.ln(S.div("close", R.lag("close"))))
    out = C.sector_relative(df)
    cols = ["Sector_Momentum_5d", "Sector_Rel", "Rel_Sector_Return_1d", "Rel_Sector_Return_5d",
            F.ln("sector_rel_strength_60").alias("log_strength"), "sector_short_sell_ratio", "Sector_Return_Future"]
    return S.rounded(out.select("scode", "date", *cols), {"Sector_Rel": 2})


ZSET = {"ma_dev_25": f"close / {roll('avg', 'close', 25)} - 1", "Return_20d": pct("close", 20), "Return_6m": pct("close", 120),
        "high_52w_dist": f"close / {roll('max', 'close', 240)} - 1"}
Z_SQL = q.with_(q.BARS, q.SYMBOLS) + f", z0 AS MATERIALIZED (SELECT b.scode, date, sector33_code, {', '.join(f'{s} AS {n}' for n, s in ZSET.items())} FROM bars b LEFT JOIN symbols USING (scode)) SELECT scode, date, {q.r('Return_20d')} AS Return_20d, {', '.join(q.r(z_sql(n, 'date, sector33_code')) + f' AS {n}_sector_z' for n in ZSET)} FROM z0"


def _zf(spark, d):
    p = Proxy(spark, d)
    df = p.bars().join(p.symbols(), "scode", "left")
    df = df.withColumns({"ma_dev_25": S.div("close", R.roll(F.avg, "close", 25)) - 1, "Return_20d": R.pct_change("close", 20),
                         "Return_6m": R.pct_change("close", 120), "high_52w_dist": S.div("close", R.roll(F.max, "close", 240)) - 1})
    out = C.z_features(df.select("scode", "date", "sector33_code", *ZSET))
    return S.rounded(out.select("scode", "date", "Return_20d", *[f"{n}_sector_z" for n in ZSET]))


@query("sector_z_features", "X-8", Z_SQL)
def _(spark, d):
    return _zf(spark, d)


# every scored column, each from a series of its own
Z_ALL = [n for n in C.Z_COLUMNS if n not in ("log_pcfr", "div_yield", "RSI_14")]
Z_FORMULAS = {n: [pct("close", i + 1), f"close / {roll('avg', 'close', i + 3)} - 1", f"ln(volume_p + {i})"][i % 3] for i, n in enumerate(Z_ALL)}


def _z_series(i, w=None):
    return [R.pct_change("close", i + 1, w), S.div("close", R.roll(F.avg, "close", i + 3, w)) - 1, F.ln(F.col("volume_p") + i)][i % 3]


def _with_series(df, names, w=None):
    # logarithms last: before the windows they would travel with the rows
    df = df.withColumns({n: _z_series(i, w) for i, n in enumerate(names) if i % 3 < 2})
    return df.withColumns({n: _z_series(i, w) for i, n in enumerate(names) if i % 3 == 2})


@query("sector_z_all_columns", "X-8", q.with_(q.BARS, q.SYMBOLS) + f", z0 AS MATERIALIZED (SELECT b.scode, date, sector33_code, {', '.join(f'{s} AS {n}' for n, s in Z_FORMULAS.items())} FROM bars b LEFT JOIN symbols USING (scode)) "
       f"SELECT scode, date, {', '.join(q.r(n) + f' AS {n}' for n in Z_ALL if n in C.Z_KEPT)}, {', '.join(q.r(z_sql(n, 'date, sector33_code')) + f' AS {n}_sector_z' for n in Z_ALL)} FROM z0")
def _(spark, d):
    p = Proxy(spark, d)
    # a task holds the stocks of few sectors: what it sends of their statistics is a fraction of its rows
    own = ["sector33_code", "scode"]
    df = p.bars().select("scode", "date", "close", "volume_p").join(p.symbols(), "scode", "left").repartitionByRange(*own)
    df = _with_series(df, Z_ALL, R.series(own))
    return S.rounded(C.z_features(df.select("scode", "date", "sector33_code", *Z_ALL)).drop("sector33_code"))


MASK = "volume >= 20 AND close >= 1500"
G_ALL = {f"g{i}": s for i, s in enumerate(list(Z_FORMULAS.values())[:12])}


@query("gauss_rank_many_columns", "X-9 W-21", q.with_(q.BARS) + f""", g0 AS MATERIALIZED (SELECT scode, date, volume, close, {', '.join(f'{s} AS {n}' for n, s in G_ALL.items())} FROM bars),
 g1 AS (SELECT scode, date, {', '.join(f'CASE WHEN {MASK} THEN {n} END AS {n}' for n in G_ALL)} FROM g0), g2 AS (SELECT scode, date, {', '.join(q.pctrank(n, 'date') + f' AS {n}' for n in G_ALL)} FROM g1),
 g3 AS (SELECT scode, date, {', '.join(q.clip(n, 1e-6, 1 - 1e-6) + f' AS {n}' for n in G_ALL)} FROM g2), g4 AS (SELECT scode, date, {', '.join(q.probit(n) + f' AS {n}' for n in G_ALL)} FROM g3)
 SELECT scode, date, {', '.join(q.r(f"coalesce({q.ffill(n)}, 0)") + f' AS {n}' for n in G_ALL)} FROM g4""")
def _(spark, d):
    df = _with_series(Proxy(spark, d).bars().select("scode", "date", "close", "volume", "volume_p"), G_ALL)
    mask = S.is_true((F.col("volume") >= 20) & (F.col("close") >= 1500))
    return S.rounded(C.gauss_rank_features(df, list(G_ALL), mask).select("scode", "date", *G_ALL))


GR_SQL = q.with_(q.BARS) + f""", g0 AS MATERIALIZED (SELECT scode, date, volume, close, {pct('close', 20)} AS a, volume_p AS b FROM bars),
 g1 AS (SELECT *, CASE WHEN {MASK} THEN a END AS ma, CASE WHEN {MASK} THEN b END AS mb FROM g0),
 g2 AS (SELECT *, {q.pctrank('ma', 'date')} AS pa, {q.pctrank('mb', 'date')} AS pb FROM g1), g3 AS (SELECT *, {q.clip('pa', 1e-6, 1 - 1e-6)} AS ca, {q.clip('pb', 1e-6, 1 - 1e-6)} AS cb FROM g2),
 g4 AS (SELECT *, {q.probit('ca')} AS ga, {q.probit('cb')} AS gb FROM g3)
 SELECT scode, date, {q.r(f"coalesce({q.ffill('ga')}, 0)")} AS a, {q.r(f"coalesce({q.ffill('gb')}, 0)")} AS b FROM g4"""


def _gr(spark, d, spacing=250_000):
    df = Proxy(spark, d).bars().withColumns({"a": R.pct_change("close", 20), "b": F.col("volume_p")})
    mask = S.is_true((F.col("volume") >= 20) & (F.col("close") >= 1500))
    return S.rounded(C.gauss_rank_features(df, ["a", "b"], mask, spacing=spacing).select("scode", "date", "a", "b"))


@query("gauss_rank_features", "X-9 X-10 W-21", GR_SQL)
def _(spark, d):
    return _gr(spark, d)


@query("gauss_rank_features_split_groups", "X-9 W-21", GR_SQL)
def _(spark, d):
    return _gr(spark, d, 8)


# -- universe -----------------------------------------------------------------------------
# proxy prices are not yen: literal limits that pass a good share of the rows
LIMITS = U.Thresholds(tac_close=800.0, tac_adv=50000.0, tac_tick_bps=10.0, tac_range=0.02, tac_noise=2.0, str_close=500.0,
                      str_adv=30000.0, str_noise=3.0, stop_return=2.0)
_TICK = "CASE WHEN close <= 0 THEN NULL " + " ".join(f"WHEN close <= {b} THEN {t}" for b, t in U.TICKS) + f" ELSE {U.TOP_TICK} END"
UNI_CTES = f"""u0 AS MATERIALIZED (SELECT *, close * volume AS filt_Turnover, {pct('close')} AS filt_Return, ({_TICK}) / close * 10000 AS filt_Tick_Sensitivity,
 {roll('median', 'volume_p', 20)} AS filt_Median_ADV_20, {roll('avg', '(high - low) / close', 20)} AS filt_ATR_Ratio FROM bars),
 u1 AS (SELECT *, coalesce(abs(filt_Return) > {LIMITS.stop_return}, false) AS filt_Is_Stop_Day, {roll('stddev_samp', 'filt_Return', 20)} AS sd FROM u0),
 u2 AS (SELECT *, CASE WHEN abs(filt_Return) > 3 * sd THEN 1 ELSE 0 END AS outl, {lag('filt_Is_Stop_Day')} AS ps FROM u1),
 u3 AS (SELECT *, {roll('sum', 'outl', 60)}::DOUBLE AS filt_Noise_Score FROM u2),
 uni AS MATERIALIZED (SELECT *, coalesce(close >= {LIMITS.tac_close} AND filt_Median_ADV_20 >= {LIMITS.tac_adv} AND filt_Tick_Sensitivity <= 10 AND filt_ATR_Ratio >= {LIMITS.tac_range}
  AND filt_Noise_Score <= {LIMITS.tac_noise} AND NOT filt_Is_Stop_Day AND NOT ps, false) AS is_candidate_tac,
  coalesce(close >= {LIMITS.str_close} AND filt_Median_ADV_20 >= {LIMITS.str_adv} AND filt_Noise_Score <= {LIMITS.str_noise}, false) AS is_candidate_str FROM u3)"""
UCOLS = ["filt_Turnover", "filt_Return", "filt_Tick_Sensitivity", "filt_Median_ADV_20", "filt_ATR_Ratio", "filt_Noise_Score"]
UDIG = {"filt_Turnover": 2, "filt_Median_ADV_20": 2}


@query("universe_flags", "U-1 U-2 U-3 U-4 U-5 U-6 U-7 U-8 U-9", q.with_(q.BARS, UNI_CTES) + f"SELECT scode, date, {', '.join(f'{q.r(n, UDIG.get(n, 6))} AS {n}' for n in UCOLS)}, filt_Is_Stop_Day, is_candidate_tac, is_candidate_str FROM uni")
def _(spark, d):
    df = U.candidate_flags(U.intrinsic_metrics(Proxy(spark, d).bars(), LIMITS), LIMITS, keep_metrics=True)
    return S.rounded(df.select("scode", "date", *UCOLS, "filt_Is_Stop_Day", "is_candidate_tac", "is_candidate_str"), UDIG)


@query("buffered_universe_flags", "U-10", q.with_(q.BARS, UNI_CTES) + "SELECT scode, date, is_candidate_tac, is_candidate_str FROM uni WHERE date >= DATE '2000-01-01'")
def _(spark, d):
    # the proxy trades about one day in five: the lookback covers 80 rows after two years
    out = staged_path(spark, "bars") + "/bars"
    sinks.write_panel(Proxy(spark, d).bars(), out)
    return U.buffered_flags(spark.read.parquet(out), "2000-01-01", lookback_days=1200, t=LIMITS).select("scode", "date", "is_candidate_tac", "is_candidate_str")
