"""End-to-end panels, sinks, models and the flagship query."""

import os
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions import scalars as S
from stratapanel.operators import audit as A
from stratapanel.operators import domain as D
from stratapanel.operators import models as M
from stratapanel.operators import ranking as K
from stratapanel.operators import splits as T
from stratapanel.operators.crosssection import sector_z
from stratapanel.operators.universe import Thresholds
from stratapanel.plans import master as MP
from stratapanel.plans import panel as P
from stratapanel.plans import training as J
from stratapanel.plans.staging import checkpointed, staged, staged_path
from stratapanel.sources import sinks, tables
from stratapanel.sources.proxy import DailyProxy, Proxy

from . import sql as q
from .crosssection import LIMITS, UNI_CTES
from .features import R0
from .registry import query
from .scans import flow_sql
from .training import FIXED_PLAN, FIXED_ROWS, FS, SAMPLES, axis, emb, training_samples
from .windows import z_sql


def px(spark, d):
    return Proxy(spark, d)


LEAD_CTES, LEAD_LAST = q.chain("lb", [R0 | {"Dist_SMA25": f"close / {q.roll('avg', 'close', 25)} - 1"}, {"hist_vol_20": q.roll("stddev_samp", "r", 20)},
                                      {"z": z_sql("Dist_SMA25", "date, sector33_code")}, {"k": q.pctrank("Dist_SMA25", "date")}], "ld")


@query("daily_leaders", "W-1 W-4 W-6 W-19 W-20 W-22", q.with_(q.BARS, q.SYMBOLS, "lb AS (SELECT b.*, sector33_code FROM bars b LEFT JOIN symbols USING (scode))", LEAD_CTES)
       + f"SELECT date, scode, sector33_code, {q.r('r')} AS Log_Return, {q.r('Dist_SMA25')} AS Dist_SMA25, {q.r('hist_vol_20')} AS hist_vol_20, {q.r('z')} AS Dist_SMA25_sector_z, {q.r('k')} AS pct_rank FROM {LEAD_LAST} "
       "WHERE Dist_SMA25 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY Dist_SMA25 DESC, scode) <= 5")
def _(spark, d):
    p = px(spark, d)
    df = p.bars().join(p.symbols(), "scode", "left")
    df = df.withColumns({"Log_Return": F.ln(S.div("close", R.lag("close"))), "Dist_SMA25": S.div("close", R.roll(F.avg, "close", 25)) - 1})
    df = df.withColumn("hist_vol_20", R.roll(F.stddev_samp, "Log_Return", 20))
    df = sector_z(df, ["Dist_SMA25"])
    df = K.average_ranks(df, ["Dist_SMA25"], ["date"]).withColumn("pct_rank", K.pct_rank("Dist_SMA25"))
    w = Window.partitionBy("date").orderBy(F.desc("Dist_SMA25"), "scode")
    best = df.where(F.col("Dist_SMA25").isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn <= 5")
    return S.rounded(best.select("date", "scode", "sector33_code", "Log_Return", "Dist_SMA25", "hist_vol_20", "Dist_SMA25_sector_z", "pct_rank"))


# the proxy's values are far below the yen limits: the ranking universe is cut at proxy quantiles
def _broad():
    return (F.col("volume_p") >= 30000.0) & (F.col("close") >= 500.0)


@query("time_series_panel", "S-13 C-3 C-5 J-1 J-2 J-3 J-5 C-2 " + " ".join(f"F-{i}" for i in range(10, 128)))
def _(spark, d):
    return P.time_series_panel(P.proxy_inputs(DailyProxy.stage(px(spark, d))), thresholds=LIMITS)


_INVESTOR_DAYS = flow_sql("1995-06-01", "@").replace("DATE '@'", "(SELECT max(date) FROM bars)")
_ND = f"OVER ({q.W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
PANEL_CTES = q.with_(q.BARS, q.SYMBOLS, q.TOPIX, q.N225, q.INVESTORS, _INVESTOR_DAYS, q.SECTOR_RETURN, q.SHORTS, q.FIN, q.MARGIN) + f""",
 j0 AS (SELECT b.*, sector33_code, Market_Return, market_vol_change, Market_Foreign_Z_60, sector_return FROM bars b LEFT JOIN symbols USING (scode) LEFT JOIN topix USING (date)
  LEFT JOIN n225 USING (date) LEFT JOIN flows USING (date) LEFT JOIN sector_return USING (date, sector33_code)),
 j1 AS (SELECT j0.*, selling_volume_ratio FROM j0 ASOF LEFT JOIN shorts s ON j0.sector33_code = s.sector33_code AND j0.date >= s.date),
 j2 AS (SELECT j1.*, f.published_date, f.eps, f.shares_outstanding FROM j1 ASOF LEFT JOIN fin f ON j1.scode = f.scode AND j1.date >= f.published_date),
 j3 AS MATERIALIZED (SELECT j2.*, m.l, m.s FROM j2 ASOF LEFT JOIN (SELECT scode, date + 4 AS a, long_margin_trade_balance_share AS l, short_margin_trade_balance_share AS s FROM margin) m
  ON j2.scode = m.scode AND j2.date >= m.a),
 j4 AS MATERIALIZED (SELECT *, {q.pct('close')} AS ret1, {q.pct('close', 20)} AS Return_20d, close / {q.roll('avg', 'close', 25)} - 1 AS Dist_SMA25, {q.roll('avg', 'close', 75)} AS m75,
  {q.lag('close', 20)} / {q.lag('close', 260)} - 1 AS momentum_12_1, {q.ahead('max', 'high', 60)} AS Future_High_Str, ln((l + 1) / (s + 1)) AS margin_ratio, {q.ffill('eps')} AS EPS_Actual,
  ln(close * shares_outstanding) AS log_market_cap, {q.div(q.lead('close', 5), q.lead('open'))} - 1 AS r5, {q.div(q.lead('close', 60), q.lead('open'))} - 1 AS r60 FROM j3),
 j5 AS (SELECT *, CASE WHEN count(ret1 + Market_Return) {_ND} >= 60 AND count(Market_Return) {_ND} >= 60 THEN covar_samp(ret1, Market_Return) {_ND} / nullif(var_samp(Market_Return) {_ND}, 0) END AS Beta_60 FROM j4),
 ts AS MATERIALIZED (SELECT * FROM j5 WHERE momentum_12_1 IS NOT NULL AND m75 IS NOT NULL AND Future_High_Str IS NOT NULL)"""
PANEL_COLS = {"Dist_SMA25": 6, "momentum_12_1": 6, "Future_High_Str": 6, "Beta_60": 6, "margin_ratio": 6, "EPS_Actual": 9, "market_vol_change": 6,
              "Market_Foreign_Z_60": 6, "sector_return": 6, "selling_volume_ratio": 6, "log_market_cap": 6}


@query("time_series_panel_values", "S-13 J-1 J-2 J-3 J-5 C-3 C-5", PANEL_CTES + " SELECT scode, date, sector33_code, published_date, " + ", ".join(f"{q.r(c, n)} AS {c}" for c, n in PANEL_COLS.items()) + " FROM ts")
def _(spark, d):
    # the whole panel plan, reported on a few columns of every source
    df = P.time_series_panel(P.proxy_inputs(DailyProxy.stage(px(spark, d))), thresholds=LIMITS)
    return S.rounded(df.select("scode", "date", "sector33_code", "published_date", *PANEL_COLS), PANEL_COLS)


def _staged_master(spark, d):
    # stage boundary: the time-series panel is written once, as its stocks lie, and the cross-section reads it
    return MP.master_panel(P.time_series_panel(P.proxy_inputs(DailyProxy.stage(px(spark, d))), thresholds=LIMITS), LIMITS, _broad())


MASTER_CTES = PANEL_CTES + ", " + UNI_CTES.replace("FROM u0)", "FROM (SELECT u0.* FROM u0 JOIN ts USING (scode, date)))") + f""",
 k0 AS (SELECT *, CASE WHEN volume_p >= 30000 AND close >= 500 THEN Return_20d END AS mr FROM ts), k1 AS (SELECT *, {q.pctrank('mr', 'date')} AS pr FROM k0),
 k2 AS (SELECT *, {q.clip('pr', 1e-6, 1 - 1e-6)} AS pc FROM k1), k3 AS MATERIALIZED (SELECT *, {q.probit('pc')} AS g FROM k2)"""


@query("master_panel_values", "S-14 C-9 C-10 X-9 X-11 G-13 G-18 U-8 U-9", MASTER_CTES + f""" SELECT scode, date, is_candidate_tac, is_candidate_str,
 {q.r('coalesce(k3.log_market_cap, median(k3.log_market_cap) OVER (PARTITION BY date, sector33_code))')} AS log_market_cap, {q.r(q.pctrank('r5', 'date'))} AS target_tac_rank,
 {q.r('r60 - avg(r60) OVER (PARTITION BY date, sector33_code)')} AS target_str_peer_alpha, {q.r(f"coalesce({q.ffill('g')}, 0)::FLOAT", 4)} AS Return_20d,
 {q.r('Future_High_Str / entry')} AS Future_High_Str FROM k3 JOIN uni USING (scode, date) JOIN (SELECT scode, date, {q.lead('open')} AS entry FROM bars) e USING (scode, date)""")
def _(spark, d):
    df = _staged_master(spark, d)
    return S.rounded(df.select("scode", "date", "is_candidate_tac", "is_candidate_str", "log_market_cap", "target_tac_rank",
                               "target_str_peer_alpha", "Return_20d", "Future_High_Str"), {"Return_20d": 4})


@query("master_panel", "S-14 C-9 X-1 X-8 X-9 X-11 U-8 U-9")
def _(spark, d):
    return _staged_master(spark, d)


@query("quarter_dataset_roundtrip", "S-12 S-13", q.with_(q.BARS) + "SELECT year(date) || 'Q' || quarter(date) AS quarter, count(*) AS n, count(DISTINCT scode) AS stocks FROM bars GROUP BY 1")
def _(spark, d):
    out = staged_path(spark, "sink") + "/bars"
    sinks.write_panel(px(spark, d).bars().select("scode", "date", "close"), out)
    return tables.dataset_reader(spark, out.rpartition("/")[0])("bars").groupBy("quarter").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scode").alias("stocks"))


def _smooth(b):
    return b.withColumn("mean_20", R.roll(F.avg, "close", 20)).select("scode", "date", "mean_20")


@query("quarter_append", "S-13 U-10", q.with_(q.BARS) + f"""SELECT quarter, count(*) AS n, {q.r('sum(mean_20)', 2)} AS total, any_value(quarter < '1998Q3') AS kept FROM
 (SELECT year(date) || 'Q' || quarter(date) AS quarter, {q.roll('avg', 'close', 20)} AS mean_20 FROM bars) GROUP BY quarter""")
def _(spark, d):
    """Written up to a day in the middle of a quarter, the rest appended: old quarters keep their files."""
    b = checkpointed(px(spark, d).bars().select("scode", "date", "close"))
    root = staged_path(spark, "append")
    raw, out, cut = f"{root}/raw", f"{root}/out", "1998-08-12"
    sinks.write_panel(b.where(F.col("date") < cut), raw)
    sinks.write_panel(_smooth(b.where(F.col("date") < cut)), out)
    files = lambda: spark.read.parquet(out).select("quarter", F.input_file_name().alias("f")).distinct().groupBy("quarter").agg(
        F.sort_array(F.collect_list("f")).alias("files"))
    before = checkpointed(files())
    # the proxy trades about one day in five: the lookback covers 20 rows
    sinks.append_period(b.where(F.col("date") >= cut), raw, out, _smooth, cut, 500)
    same = files().join(before.withColumnRenamed("files", "old"), "quarter", "left")
    kept = same.select("quarter", F.coalesce(F.col("files") == F.col("old"), F.lit(False)).alias("kept"))
    g = spark.read.parquet(out).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.sum("mean_20").alias("total"))
    return S.rounded(g.join(kept, "quarter"), {"total": 2})


@query("jdbc_monthly_orders", "S-16", """SELECT date_trunc('month', o_orderdate)::DATE AS month, n_name AS nation, count(*) AS n, sum(o_totalprice)::DOUBLE AS total, min(o_orderkey) AS first_key
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY 1, 2""".replace("sum(o_totalprice)::DOUBLE", q.r("sum(o_totalprice)", 2)))
def _(spark, d):
    """Tables written to a database and read back: orders by one task a month, the price filter done by the database."""
    p = px(spark, d)
    url, props = _database(spark)
    tables.write_jdbc(p.table("nation").select("n_nationkey", "n_name"), url, "nation", props, "n_name VARCHAR(40)")
    tables.write_jdbc(p.table("customer").select("c_custkey", "c_nationkey"), url, "customer", props)
    tables.write_jdbc(p.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice"), url, "orders", props)
    read = tables.jdbc_reader(spark, url, props, {"orders": tables.month_predicates('"o_orderdate"', "1995-01-01", "1998-08-01")})
    o = read("orders").where(F.col("o_totalprice") > 1000)
    j = o.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.trunc("o_orderdate", "month").alias("month"), F.rtrim("n_name").alias("nation")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderkey").alias("first_key"))
    return S.rounded(g, {"total": 2})


def _database(spark):
    """An in-memory database in this JVM, which ships with Spark; a server's address takes its place on a cluster."""
    system = spark._jvm.java.lang.System
    system.setProperty("derby.stream.error.file", os.path.join(tempfile.gettempdir(), f"derby-{os.getpid()}.log"))
    return f"jdbc:derby:memory:orders{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("csv_report_roundtrip", "S-15", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    out = staged_path(spark, "sink") + "/report"
    g = px(spark, d).table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_report(g, out)
    return spark.read.csv(out, header=True, schema="flag string, n bigint")


@query("schema_contract", "K-5 S-14", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    t = px(spark, d).table("supplier")
    A.require_columns(t, ["s_suppkey", "s_name"], "supplier")
    return t.select("s_suppkey", "s_name")


# -- models --------------------------------------------------------------------------------
SMALL = M.BoostParams(rounds=3, step=0.2, depth=3, min_rows=20)
MODEL_FEATURES = ["r1", "r5", "dist", "vol"]


def _model_panel(spark, d):
    b = px(spark, d).bars()
    df = b.withColumns({"r1": R.pct_change("close"), "r5": R.pct_change("close", 5), "dist": S.div("close", R.roll(F.avg, "close", 25)) - 1,
                        "vol": F.log1p("volume"), "target": S.clip(S.div(R.lead("close", 5), "close") - 1, -3.0, 3.0)})
    return df.select("scode", "date", *MODEL_FEATURES, "target").where(F.col("target").isNotNull())


def _fitted(spark, d, k=2):
    # boosting reads its rows once per round: both inputs are materialised first
    folds = staged(T.purged_kfold(axis(spark, d), k, 0.01), "folds")
    panel = staged(_model_panel(spark, d), "panel")
    return M.fold_scores(panel, folds, list(range(k)), MODEL_FEATURES, "target", SMALL)


@query("gbt_fold_scores", "M-1 M-2")
def _(spark, d):
    return _fitted(spark, d)[0].select("fold", "side", "scode", "date", "target", "score")


@query("gbt_importance", "M-4")
def _(spark, d):
    return M.top_importances(M.importance_table(spark, _fitted(spark, d)[1], MODEL_FEATURES))


def _job(spark, d, plan, folds):
    """The training job on the candidates' samples, with features that they carry."""
    s = training_samples(spark, d).withColumns({"dist": S.div("close", "open") - 1, "span": S.div("high", "low") - 1, "vol": F.log1p("volume"), "ret": F.col("score")}).drop("score")
    rows = J.training_rows(s.where(F.col("target").isNotNull()), plan)
    return s, J.train(rows, folds, JOB_FEATURES, "target", D.TAC, SMALL)


JOB_FEATURES = ["dist", "span", "vol", "ret"]


@query("training_job_phases", "M-1 M-2 T-7", FIXED_ROWS + " SELECT 0::INTEGER AS fold, phase, count(*) AS n, count(*) AS n_scored, true AS ic_in_range FROM scored WHERE target IS NOT NULL GROUP BY phase")
def _(spark, d):
    """Fit on the train phase; all three phases scored and measured."""
    t = staged(_job(spark, d, FIXED_PLAN, [0])[1].scored)
    n = t.groupBy("fold", "phase").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"))
    m = J.phase_metrics(t, "target").select("fold", "phase", (F.coalesce(F.abs("ic"), F.lit(0.0)) <= 1.0).alias("ic_in_range"))
    return n.join(m, ["fold", "phase"])


@query("training_job_ensemble", "M-2 M-3", SAMPLES + " SELECT count(*) AS rows_scored, 6::BIGINT AS models, true AS mean_in_range FROM samples")
def _(spark, d):
    """Six purged folds; every sample, known target or not, is scored by all six models."""
    s, t = _job(spark, d, J.SplitPlan(), list(range(6)))
    e = J.score_new(t, s.select("scode", "date", *JOB_FEATURES), JOB_FEATURES, ["scode", "date"])
    return e.agg(F.count(F.lit(1)).alias("rows_scored"), F.min("n_models").alias("models"), (F.max(F.abs("score")) < 10.0).alias("mean_in_range"))


@query("training_job_importance", "M-4 M-5", "SELECT unnest(['dist', 'span', 'vol', 'ret']) AS feature, 6::BIGINT AS folds, true AS average_in_range")
def _(spark, d):
    """Gain importances of six folds' models, summarised over folds."""
    t = _job(spark, d, J.SplitPlan(), list(range(6)))[1]
    s = M.importance_stability(M.importance_table(spark, t.models, JOB_FEATURES), list(range(6)))
    known = sum((F.col(f"fold_{k}").isNotNull().cast("long") for k in range(1, 6)), F.col("fold_0").isNotNull().cast("long"))
    return s.select("feature", known.alias("folds"), ((F.col("average") >= 0) & (F.col("average") <= 1)).alias("average_in_range"))


@query("ensemble_score", "M-3", q.with_(q.SCORED) + f", x AS (SELECT scode, date, score * (1 + f * 0.1::DOUBLE) AS score FROM scored, range(5) t(f) WHERE (scode + f) % 4 <> 0) SELECT scode, date, {q.r('avg(score)')} AS score, count(score) AS n_models FROM x GROUP BY 1, 2")
def _(spark, d):
    s = px(spark, d).scored().select("scode", "date", "score", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    s = s.where((F.col("scode") + F.col("fold")) % 4 != 0).withColumn("score", F.col("score") * (F.lit(1.0) + F.col("fold") * F.lit(0.1)))
    return S.rounded(M.ensemble_score(s, ["scode", "date"]))


@query("importance_stability", "M-5 A-13 O-2", f"WITH t AS (SELECT user_id % 3 AS fold, event_type AS feature, avg(value) AS importance FROM events GROUP BY 1, 2) SELECT feature, {', '.join(q.r(f'max(CASE WHEN fold = {k} THEN importance END)') + f' AS fold_{k}' for k in range(3))}, {q.r('avg(importance)')} AS average, {q.r('avg(importance) / stddev_samp(importance)', 4)} AS stability FROM t GROUP BY feature")
def _(spark, d):
    t = px(spark, d).table("events").groupBy((F.col("user_id") % 3).alias("fold"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("importance"))
    return S.rounded(M.importance_stability(t, [0, 1, 2]), {"stability": 4})
