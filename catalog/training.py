"""Thinning, splits, preprocessing, weights, metrics and audits."""

from itertools import combinations

from pyspark.sql import functions as F

from stratapanel.functions import rolling as R
from stratapanel.functions import scalars as S
from stratapanel.operators import audit as A
from stratapanel.operators import domain as D
from stratapanel.operators import evaluate as E
from stratapanel.operators import prep as P
from stratapanel.operators import splits as T
from stratapanel.operators import universe as U
from stratapanel.operators.thinning import thin_by_interval
from stratapanel.plans import training as J
from stratapanel.plans.staging import staged_path
from stratapanel.sources.proxy import Proxy

from . import sql as q
from .crosssection import LIMITS, TGT_BASE, TGT_LAST, UNI_CTES, target_frame
from .registry import query


def px(spark, d):
    return Proxy(spark, d)


# -- thinning ------------------------------------------------------------------------------
def thin_sql(src: str, days: int, name: str = "thin") -> str:
    """Greedy thinning as a recursive CTE: hop to the first day far enough from the last kept one."""
    return (f"{name} AS (SELECT scode, min(date) AS date FROM {src} GROUP BY scode UNION ALL "
            f"SELECT t.scode, (SELECT min(s.date) FROM {src} s WHERE s.scode = t.scode AND s.date >= t.date + {days}) AS date FROM {name} t "
            f"WHERE EXISTS (SELECT 1 FROM {src} s WHERE s.scode = t.scode AND s.date >= t.date + {days}))")


@query("thin_events", "T-1", "WITH RECURSIVE ev AS MATERIALIZED (SELECT DISTINCT user_id AS scode, CAST(ts AS DATE) AS date FROM events), " + thin_sql("ev", 5) + " SELECT scode, date FROM thin")
def _(spark, d):
    ev = px(spark, d).table("events").select(F.col("user_id").alias("scode"), F.col("ts").cast("date").alias("date")).distinct()
    return thin_by_interval(ev, 5)


@query("thin_bars", "T-1", "WITH RECURSIVE " + q.BARS + ", " + thin_sql("bars", 20) + " SELECT scode, date, volume FROM thin JOIN bars USING (scode, date)")
def _(spark, d):
    return thin_by_interval(px(spark, d).bars().select("scode", "date", "volume"), 20)


# -- splits --------------------------------------------------------------------------------
H = 5
AXIS = q.with_(q.BARS).rstrip() + f""", sess AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)),
 ends AS (SELECT a.date, b.date AS t1 FROM sess a JOIN sess b ON b.pos = a.pos + {H}),
 samples AS MATERIALIZED (SELECT scode, date, t1 FROM bars JOIN ends USING (date)),
 perday AS MATERIALIZED (SELECT date, max(t1) AS t1, row_number() OVER (ORDER BY date) - 1 AS pos FROM samples GROUP BY date),
 axis AS MATERIALIZED (SELECT p.pos::INTEGER AS pos, p.date, greatest(coalesce(x.pos, 0), p.pos)::INTEGER AS end_pos FROM perday p ASOF LEFT JOIN (SELECT date AS d, pos FROM perday) x ON p.t1 >= x.d)"""


def axis(spark, d):
    return T.split_axis(T.add_event_end(px(spark, d).bars().select("scode", "date"), H))


@query("event_ends", "T-2", AXIS + " SELECT scode, date, t1 FROM samples")
def _(spark, d):
    return T.add_event_end(px(spark, d).bars().select("scode", "date"), H)


@query("event_ends_on_calendar", "T-2", q.with_(q.BARS) + """, cal AS (SELECT CAST(x AS DATE) AS date, row_number() OVER (ORDER BY x) AS pos FROM range(
 (SELECT min(date) FROM bars)::TIMESTAMP, (SELECT max(date) FROM bars)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5)
 SELECT b.scode, b.date, e.date AS t1 FROM bars b JOIN cal c ON b.date = c.date JOIN cal e ON e.pos = c.pos + 3""")
def _(spark, d):
    p = px(spark, d)
    days = p.bars().agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence(F.date_sub("a", 30), F.date_add("b", 30), F.expr("interval 1 day"))).alias("date"))
    return T.add_event_end(p.bars().select("scode", "date"), 3, days.where(F.weekday("date") < 5))


@query("split_axis", "T-3 A-3", AXIS + " SELECT * FROM axis")
def _(spark, d):
    return axis(spark, d)


def folds_sql(tests: list[list[int]], k: int, pct: float) -> str:
    plan = " UNION ALL ".join(f"SELECT {i} AS fold, {b} AS block" for i, bl in enumerate(tests) for b in bl)
    return (f", blk AS MATERIALIZED (SELECT *, ntile({k}) OVER (ORDER BY pos) - 1 AS block FROM axis), "
            f"iv AS MATERIALIZED (SELECT block, min(pos) AS ts, max(end_pos) AS te, (SELECT round_even({pct} * count(*), 0) FROM axis) AS emb FROM blk GROUP BY block), "
            f"plan AS ({plan}), fold_rows AS MATERIALIZED (SELECT plan.fold, blk.pos, blk.date, blk.end_pos, bool_or(plan.block = blk.block) AS t, "
            f"bool_or((pos <= te AND end_pos >= ts) OR (pos > te AND pos <= te + emb)) AS o FROM plan JOIN iv ON iv.block = plan.block CROSS JOIN blk GROUP BY ALL), "
            f"folds AS MATERIALIZED (SELECT fold, CASE WHEN t THEN 'test' ELSE 'train' END AS side, pos, date, end_pos FROM fold_rows WHERE t OR NOT o)")


KFOLD = AXIS + folds_sql([[k] for k in range(6)], 6, 0.01)
CPCV = AXIS + folds_sql([list(x) for x in combinations(range(6), 2)], 6, 0.01)


@query("purged_kfold", "T-4", KFOLD + " SELECT * FROM folds")
def _(spark, d):
    return T.purged_kfold(axis(spark, d), 6, 0.01)


@query("combinatorial_purged_cv", "T-5", CPCV + " SELECT * FROM folds")
def _(spark, d):
    return T.cpcv(axis(spark, d), 6, 2, 0.01)


SEG = ", runs AS (SELECT *, pos - row_number() OVER (PARTITION BY fold, side ORDER BY pos) AS run FROM folds), segs AS MATERIALIZED (SELECT fold, side, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS days, min(date) AS start_date, max(date) AS end_date FROM runs GROUP BY fold, side, run)"


@query("segments", "T-6 A-9", CPCV + SEG + " SELECT * FROM segs")
def _(spark, d):
    return T.segments(T.cpcv(axis(spark, d), 6, 2, 0.01))


@query("fixed_holdout", "T-7", q.with_(q.BARS) + "SELECT scode, date, CASE WHEN date >= DATE '2000-06-01' THEN 'test' WHEN date >= DATE '1999-06-01' AND date < DATE '2000-06-01' - 40 THEN 'valid' WHEN date < DATE '1999-06-01' - 40 THEN 'train' END AS phase FROM bars")
def _(spark, d):
    return px(spark, d).bars().select("scode", "date", T.fixed_holdout(F.col("date"), "1999-06-01", "2000-06-01", 40).alias("phase"))


def _side(s, tag, mark):
    of = lambda x: f"max(CASE WHEN side = '{s}' THEN {x} END)"
    return (f"coalesce({of('days')}, 0)::INTEGER AS {tag}_days, coalesce({of('segs')}, 0)::INTEGER AS {tag}_segs, CAST({of('a')} AS VARCHAR) AS {tag}_start, "
            f"CAST({of('b')} AS VARCHAR) AS {tag}_end, coalesce({of('txt')}, '{mark}(empty)') AS {tag}_segments_str")


SUMMARY = CPCV + SEG + f""", texts AS (SELECT *, row_number() OVER (PARTITION BY fold, side ORDER BY start_pos) AS i, count(*) OVER (PARTITION BY fold, side) AS n,
  (CASE WHEN side = 'train' THEN 'TR' ELSE 'VA' END) || '[' || start_pos || '..' || end_pos || '](' || start_date || '..' || end_date || ')' AS t FROM segs),
 sides AS (SELECT fold, side, sum(days) AS days, count(*) AS segs, min(start_date) AS a, max(end_date) AS b,
  string_agg(CASE WHEN n <= 3 OR i <= 2 THEN t WHEN i = n THEN '... ' || t END, ' ' ORDER BY i) AS txt FROM texts GROUP BY fold, side),
 bins AS (SELECT x AS j, floor(x * n / 100.0) AS lo, greatest(floor((x + 1) * n / 100.0), floor(x * n / 100.0) + 1) AS hi FROM range(100) r(x), (SELECT count(*) AS n FROM axis)),
 cells AS (SELECT f.fold, j, max(CASE WHEN side = 'test' THEN 2 WHEN side = 'train' THEN 1 ELSE 0 END) AS m FROM (SELECT DISTINCT fold FROM folds) f CROSS JOIN bins
  LEFT JOIN folds ON folds.fold = f.fold AND pos >= lo AND pos < hi GROUP BY f.fold, j),
 lines AS (SELECT fold, string_agg(CASE m WHEN 2 THEN 'V' WHEN 1 THEN 'T' ELSE '.' END, '' ORDER BY j) AS timeline FROM cells GROUP BY fold)
 SELECT fold, {_side('train', 'train', 'TR')}, {_side('test', 'valid', 'VA')}, any_value(timeline) AS timeline FROM sides JOIN lines USING (fold) GROUP BY fold"""


@query("split_summary", "T-8 A-9", SUMMARY)
def _(spark, d):
    a = axis(spark, d)
    return T.split_summary(T.cpcv(a, 6, 2, 0.01), a)


@query("train_test_overlap", "T-9 O-5", CPCV + " SELECT count(*) AS shared FROM (SELECT fold, pos FROM folds WHERE side = 'train' INTERSECT SELECT fold, pos FROM folds WHERE side = 'test')")
def _(spark, d):
    f = T.cpcv(axis(spark, d), 6, 2, 0.01)
    train, test = (f.where(F.col("side") == s).select("fold", "pos") for s in ("train", "test"))
    return train.intersect(test).agg(F.count(F.lit(1)).alias("shared"))


@query("fold_membership", "J-8 O-6", KFOLD + " SELECT fold, side, scode, bars.date, volume FROM bars JOIN folds USING (date)")
def _(spark, d):
    p = px(spark, d)
    return T.rows_of_folds(p.bars().select("scode", "date", "volume"), T.purged_kfold(axis(spark, d), 6, 0.01)).select(
        "fold", "side", "scode", "date", "volume")


def flagged(spark, d):
    return U.candidate_flags(U.intrinsic_metrics(px(spark, d).bars(), LIMITS), LIMITS)


# -- the training job: its stages one after another ----------------------------------------
SAMPLES = "WITH RECURSIVE " + q.BARS + ", " + UNI_CTES + f""", cd AS MATERIALIZED (SELECT scode, date FROM uni WHERE is_candidate_tac),
 sess AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars WHERE date BETWEEN (SELECT min(date) FROM cd) AND (SELECT max(date) FROM cd))),
 ends AS (SELECT a.date, b.date AS t1 FROM sess a JOIN sess b ON b.pos = a.pos + {H}), ct AS MATERIALIZED (SELECT scode, date, t1 FROM cd JOIN ends USING (date)),
 {thin_sql('ct', 5, 'td')}, samples AS MATERIALIZED (SELECT scode, date, t1 FROM ct JOIN td USING (scode, date)),
 vals AS MATERIALIZED (SELECT scode, date, {q.pct('close')} AS score, {q.div(q.lead('close', 5), 'close')} - 1 AS target, {q.div(q.ahead('max', 'high', 5), q.lead('open'))} AS Future_High,
  {q.div(q.ahead('min', 'low', 5), q.lead('open'))} AS Future_Low, {q.div(q.lead('close', 5), q.lead('open'))} AS Future_Close FROM bars)"""
DAYS = AXIS[AXIS.index(", perday AS"):] if ", perday AS" in AXIS else AXIS[AXIS.index(" perday AS"):]
FIXED = "CASE WHEN date >= DATE '2000-06-01' THEN 'test' WHEN date >= DATE '1999-06-01' AND date < DATE '2000-06-01' - 40 THEN 'valid' WHEN date < DATE '1999-06-01' - 40 THEN 'train' END"
FIXED_PLAN = J.SplitPlan("fixed", valid_start="1999-06-01", test_start="2000-06-01", embargo_days=40)


def training_samples(spark, d):
    p = px(spark, d)
    entry = R.lead("open")
    df = flagged(spark, d).withColumns({
        "score": R.pct_change("close"), "target": S.div(R.lead("close", 5), "close") - 1, "Future_High_Tac": S.div(R.ahead(F.max, "high", 5), entry),
        "Future_Low_Tac": S.div(R.ahead(F.min, "low", 5), entry), "Future_Close_Tac": S.div(R.lead("close", 5), entry)})
    return J.training_samples(df, D.TAC, p.trades().select("date").distinct())   # the days with bars


def _samples_with(folds: str) -> str:
    return SAMPLES + "," + DAYS.lstrip(",") + folds


@query("training_rows", "T-1 T-2 T-4 C-6 J-8", _samples_with(folds_sql([[k] for k in range(6)], 6, 0.01))
       + " SELECT fold, CASE WHEN side = 'test' THEN 'valid' ELSE side END AS phase, scode, samples.date, t1 FROM samples JOIN folds USING (date)")
def _(spark, d):
    return J.training_rows(training_samples(spark, d), J.SplitPlan()).select("fold", "phase", "scode", "date", "t1")


@query("training_rows_combinatorial", "T-1 T-2 T-5 J-8", _samples_with(folds_sql([list(x) for x in combinations(range(6), 2)], 6, 0.01))
       + " SELECT fold, CASE WHEN side = 'test' THEN 'valid' ELSE side END AS phase, count(*) AS n, min(samples.date) AS first, max(t1) AS last_end FROM samples JOIN folds USING (date) GROUP BY 1, 2")
def _(spark, d):
    r = J.training_rows(training_samples(spark, d), J.SplitPlan("cpcv"))
    return r.groupBy("fold", "phase").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("t1").alias("last_end"))


FIXED_ROWS = SAMPLES + f", scored AS MATERIALIZED (SELECT 0 AS fold, {FIXED} AS phase, * FROM samples JOIN vals USING (scode, date) WHERE ({FIXED}) IS NOT NULL)"


@query("training_rows_fixed", "T-7 T-1 C-6", FIXED_ROWS + " SELECT fold::INTEGER AS fold, phase, scode, date, t1 FROM scored")
def _(spark, d):
    return J.training_rows(training_samples(spark, d), FIXED_PLAN).select("fold", "phase", "scode", "date", "t1")


@query("training_metrics_fixed_scores", "E-1 E-2 E-4 T-7", FIXED_ROWS + f""", rk AS (SELECT phase, {q.avgrank('target', 'phase')} AS a, {q.avgrank('score', 'phase')} AS b FROM scored WHERE target IS NOT NULL AND score IS NOT NULL)
 SELECT 0::INTEGER AS fold, phase, {q.r('rmse')} AS rmse, {q.r('ic')} AS ic FROM (SELECT phase, sqrt(avg(pow(target - score, 2))) AS rmse FROM scored GROUP BY 1) JOIN (SELECT phase, corr(a, b) AS ic FROM rk GROUP BY 1) USING (phase)""")
def _(spark, d):
    return S.rounded(J.phase_metrics(J.training_rows(training_samples(spark, d), FIXED_PLAN), "target"))


_FSTATS = ", ".join(f"{q.r(f'avg({c})')} AS {c}_mean, {q.r(f'stddev_samp({c})')} AS {c}_std, " + ", ".join(f"{q.r(f'quantile_cont({c}, {p})')} AS {c}_q{int(p * 100)}" for p in E.QUANTILES) for c in J.FUTURE)


@query("training_score_bins", "E-5 E-7 A-8", FIXED_ROWS + f""", tst AS MATERIALIZED (SELECT * FROM scored WHERE phase = 'test'),
 edges AS (SELECT list_distinct(quantile_cont(score, [{', '.join(str(i / 10) for i in range(11))}])) AS e FROM tst),
 binned AS (SELECT t.*, greatest(len(list_filter(e, lambda v: v < score)), 1)::INTEGER AS bin FROM tst t, edges WHERE score IS NOT NULL)
 SELECT bin, count(*) AS sample_count, {q.r('avg(target)')} AS target_mean, {_FSTATS} FROM binned GROUP BY bin""")
def _(spark, d):
    return S.rounded(J.score_bins(J.training_rows(training_samples(spark, d), FIXED_PLAN), "target", FIXED_PLAN))


# -- domains -------------------------------------------------------------------------------
@query("domain_filter", "C-6 C-9", TGT_BASE + f", {UNI_CTES} SELECT t.scode, t.date, {q.r('hi60 / entry')} AS Future_High, {q.r('lo60 / entry')} AS Future_Low, {q.r('cl60 / entry')} AS Future_Close FROM {TGT_LAST} t JOIN uni USING (scode, date) WHERE is_candidate_str")
def _(spark, d):
    from stratapanel.operators import targets
    df = D.normalize_future_prices(targets.target_set().apply(target_frame(px(spark, d))))
    df = df.join(flagged(spark, d).select("scode", "date", "is_candidate_tac", "is_candidate_str"), ["scode", "date"])
    return S.rounded(D.domain_filter(df, D.STR).select("scode", "date", "Future_High", "Future_Low", "Future_Close"))


@query("target_not_null", "C-7", q.with_(q.BARS, UNI_CTES) + f", x AS (SELECT *, {q.lead('volume', 5)} AS target_reg FROM uni) SELECT scode, date, target_reg AS target FROM x WHERE target_reg IS NOT NULL AND is_candidate_tac")
def _(spark, d):
    df = flagged(spark, d).withColumn("target_reg", R.lead("volume", 5))
    return D.target_not_null(df, "target_tac_rank", "is_candidate_tac").select("scode", "date", "target")


# -- preprocessing and weights -------------------------------------------------------------
DIMS = 64
EMB = "emb AS MATERIALIZED (SELECT vec_id, label, " + ", ".join(f"CASE WHEN (vec_id + {i}) % 9 <> 0 THEN embedding[{i + 1}]::DOUBLE END AS f{i}" for i in range(DIMS)) + " FROM embeddings)"
FS = [f"f{i}" for i in range(DIMS)]


def emb(spark, d):
    e = px(spark, d).table("embeddings")
    return e.select("vec_id", "label", *[F.when((F.col("vec_id") + i) % 9 != 0, F.col("embedding")[i].cast("double")).alias(f"f{i}") for i in range(DIMS)])


@query("prep_tree", "P-1", "WITH " + EMB + f" SELECT vec_id, {', '.join(f'{f}::FLOAT AS {f}' for f in FS)}, coalesce(CASE WHEN vec_id % 5 <> 0 THEN label END, -1)::INTEGER AS label FROM emb")
def _(spark, d):
    e = emb(spark, d).withColumn("label", F.when(F.col("vec_id") % 5 != 0, F.col("label")))
    return P.prep_tree(e, [*FS, "label", "f0"], ["label"], ["vec_id"])


@query("impute_median", "P-2", "WITH " + EMB + f" SELECT vec_id, {', '.join(q.r(f'coalesce({f}, (SELECT median({f}) FROM emb))') + f' AS {f}' for f in FS)} FROM emb")
def _(spark, d):
    e = emb(spark, d)
    return S.rounded(P.impute_median(e, P.fit_medians(e, FS, spacing=64), FS).select("vec_id", *FS))


@query("label_encode", "P-3", "WITH fit AS (SELECT DISTINCT coalesce(CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END, 'MISSING') AS label FROM customer WHERE c_mktsegment <> 'BUILDING'), codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM fit) SELECT c_custkey, coalesce(code, 0)::INTEGER AS seg FROM (SELECT *, coalesce(CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END, 'MISSING') AS l FROM customer) LEFT JOIN codes ON l = label")
def _(spark, d):
    c = px(spark, d).table("customer")
    x = c.select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")).alias("seg"), "c_mktsegment")
    return P.label_encode(x, P.fit_labels(x.where("c_mktsegment <> 'BUILDING'"), "seg"), "seg").select("c_custkey", "seg")


@query("standard_scale", "P-4", "WITH " + EMB + f" SELECT vec_id, {', '.join(q.r(f'({f} - (SELECT avg({f}) FROM emb)) / (SELECT stddev_pop({f}) FROM emb)') + f' AS {f}' for f in FS)} FROM emb")
def _(spark, d):
    e = emb(spark, d)
    return S.rounded(P.standard_scale(e, P.fit_scaler(e, FS), FS).select("vec_id", *FS))


@query("standard_scale_merged", "P-4", "WITH " + EMB + f" SELECT vec_id, {', '.join(q.r(f'({f} - (SELECT avg({f}) FROM emb)) / (SELECT stddev_pop({f}) FROM emb)') + f' AS {f}' for f in FS)} FROM emb")
def _(spark, d):
    # fitted on one half, written, and gone on with on the other half
    e = emb(spark, d)
    out = staged_path(spark, "scaler") + "/state"
    P.scaler_state(e.where("vec_id % 3 = 0"), FS).write.parquet(out)
    state = P.merge_states(spark.read.parquet(out), P.scaler_state(e.where("vec_id % 3 <> 0"), FS))
    return S.rounded(P.standard_scale(e, P.scaler_of(state, FS), FS).select("vec_id", *FS))


@query("sequence_windows", "P-5", q.with_(q.BARS) + f""", w AS (SELECT scode, date, {' , '.join(f'coalesce(lag(volume, {k}) OVER ({q.W}), 0) AS v{k}' for k in range(6))} FROM bars)
 SELECT scode, date, ({' + '.join(f'v{k} * {k + 1}' for k in range(6))})::DOUBLE AS weighted, 6::INTEGER AS width FROM w""")
def _(spark, d):
    s = P.sequence_windows(px(spark, d).bars(), ["volume"], 6)
    # position-weighted sum of the window: checks order and padding without comparing nested arrays
    terms = F.transform("sequence", lambda row, i: row[0].cast("double") * (F.lit(6) - i))
    return s.select("scode", "date", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("weighted"), F.size("sequence").alias("width"))


_LAGS = " + ".join(f"coalesce(lag({c}, {k}) OVER ({q.W}), 0)::FLOAT::DOUBLE * {(60 - k) * 2 + i}" for k in range(60) for i, c in enumerate(("close", "volume")))


@query("sequence_blocks_60", "P-5", q.with_(q.BARS) + f"SELECT scode, date, {q.r(_LAGS, 2)} AS weighted, 120::INTEGER AS width FROM bars")
def _(spark, d):
    """60-row windows of two features cut out of blocks; every place of every window counts in the sum."""
    w = P.windows_of(P.sequence_blocks(px(spark, d).bars(), ["close", "volume"], 60, 256), 2, 60)
    terms = F.transform("window", lambda x, i: x.cast("double") * (i + F.lit(2)))
    return S.rounded(w.select("scode", "date", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("weighted"), F.size("window").alias("width")), {"weighted": 2})


@query("sequence_windows_60", "P-5")
def _(spark, d):
    return P.sequence_windows(px(spark, d).bars(), ["close", "volume"], 60).select("scode", "date", "sequence")


@query("time_decay_weight", "P-6", KFOLD + f" SELECT fold, scode, bars.date, {q.r('pow(0.9999::DOUBLE, max(bars.date) OVER (PARTITION BY fold) - bars.date)', 8)} AS weight FROM bars JOIN folds USING (date) WHERE side = 'train'")
def _(spark, d):
    rows = T.rows_of_folds(px(spark, d).bars().select("scode", "date"), T.purged_kfold(axis(spark, d), 6, 0.01)).where("side = 'train'")
    return S.rounded(P.time_decay_weight(rows, by=["fold"]).select("fold", "scode", "date", "weight"), 8)


@query("size_weight", "P-7", q.with_(q.BARS) + f"SELECT scode, date, {q.r('1 / (1 + exp(-(ln(close * volume * 50000) - ln(1 + 30000000000.0::DOUBLE))))', 8)} AS weight, 1.0::DOUBLE AS flat FROM bars")
def _(spark, d):
    b = px(spark, d).bars()
    cap = F.ln(F.col("close") * F.col("volume") * F.lit(50000.0))
    return S.rounded(b.select("scode", "date", P.size_weight(cap, "STR").alias("weight"), P.size_weight(cap, "TAC").alias("flat")), 8)


# -- evaluation ----------------------------------------------------------------------------
SC = q.with_(q.SCORED)
FP = "sf AS MATERIALIZED (SELECT *, scode % 3 AS fold, CASE WHEN day(date) <= 20 THEN 'train' ELSE 'valid' END AS phase FROM scored)"


def sf(spark, d):
    return px(spark, d).scored().withColumns({"fold": F.col("scode") % 3, "phase": F.when(F.dayofmonth("date") <= 20, "train").otherwise("valid")})


METRICS = SC[:-1] + ", " + FP + f""", ok AS (SELECT * FROM sf WHERE target IS NOT NULL AND score IS NOT NULL), rk AS (SELECT fold, phase, {q.avgrank('target', 'fold, phase')} AS a, {q.avgrank('score', 'fold, phase')} AS b FROM ok),
 ic AS (SELECT fold, phase, corr(a, b) AS ic FROM rk GROUP BY ALL), rm AS (SELECT fold, phase, sqrt(avg(pow(target - score, 2))) AS rmse FROM sf GROUP BY ALL),
 ar AS (SELECT fold, phase, label, {q.avgrank('score', 'fold, phase')} AS k FROM sf), au AS (SELECT fold, phase, (sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM ar GROUP BY fold, phase)"""


@query("fold_metrics", "E-1 E-2 E-3 E-4", METRICS + f" SELECT fold, phase, {q.r('rmse')} AS rmse, {q.r('ic')} AS ic, {q.r('auc')} AS auc FROM rm JOIN ic USING (fold, phase) JOIN au USING (fold, phase)")
def _(spark, d):
    return S.rounded(E.fold_metrics(sf(spark, d), "target", "score", label="label", spacing=100))


@query("mean_valid_metric", "E-4", METRICS + f" SELECT {q.r('avg(ic)')} AS mean_ic FROM ic WHERE phase = 'valid'")
def _(spark, d):
    return S.rounded(E.mean_valid_metric(E.fold_metrics(sf(spark, d), "target", "score"), "ic"))


@query("quality_auc", "E-3", f"WITH x AS (SELECT quality, {q.avgrank('n_chars', '')} AS k FROM labels JOIN documents USING (doc_id)) SELECT {q.r('(sum(CASE WHEN quality = 1 THEN k END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality)))')} AS auc FROM x")
def _(spark, d):
    p = px(spark, d)
    x = p.table("labels").join(p.table("documents").select("doc_id", "n_chars"), "doc_id")
    return S.rounded(E.auc(x, "quality", "n_chars", [], 64))


EDGES = "edges AS (SELECT list_distinct(quantile_cont(score, [" + ", ".join(str(i / 10) for i in range(11)) + "])) AS e FROM scored)"
QB = SC[:-1] + ", " + EDGES + ", binned AS MATERIALIZED (SELECT s.*, greatest(len(list_filter(e, lambda v: v < score)), 1)::INTEGER AS bin FROM scored s, edges)"
STAT_COLS = ["hi", "lo"]
STATS = "count(*) AS sample_count, " + q.r("avg(target)") + " AS target_mean, " + ", ".join(
    f"{q.r(f'avg({c})')} AS {c}_mean, {q.r(f'stddev_samp({c})')} AS {c}_std, " + ", ".join(f"{q.r(f'quantile_cont({c}, {p})')} AS {c}_q{int(p * 100)}" for p in E.QUANTILES) for c in STAT_COLS)


@query("quantile_bins", "E-5", QB + " SELECT scode, date, bin, printf('%.4f - %.4f', min(score) OVER (PARTITION BY bin), max(score) OVER (PARTITION BY bin)) AS bin_label FROM binned")
def _(spark, d):
    b = E.quantile_bins(px(spark, d).scored(), "score", spacing=100)
    return b.join(E.quantile_bin_labels(b, "score"), "bin").select("scode", "date", "bin", "bin_label")


FB = SC[:-1] + ", binned AS MATERIALIZED (SELECT *, CASE WHEN score BETWEEN 0 AND 1 THEN greatest(len(list_filter([" + ", ".join(f"{i / 10!r}::DOUBLE" for i in range(11)) + "], lambda v: v < score)), 1) END::INTEGER AS bin FROM scored)"


@query("fixed_bins", "E-6", FB + " SELECT scode, date, bin, CASE WHEN bin IS NOT NULL THEN printf('%.1f - %.1f', (bin - 1) / 10.0::DOUBLE, bin / 10.0::DOUBLE) END AS label FROM binned")
def _(spark, d):
    b = E.fixed_bins(px(spark, d).scored(), "score")
    return b.select("scode", "date", "bin", F.when(F.col("bin").isNotNull(), E.fixed_bin_label(F.col("bin"))).alias("label"))


@query("bin_statistics", "E-7 A-8", QB + f" SELECT bin, {STATS} FROM binned GROUP BY bin")
def _(spark, d):
    b = E.quantile_bins(px(spark, d).scored(), "score")
    return S.rounded(E.bin_stats(b, "bin", "target", STAT_COLS, spacing=50))


@query("bin_statistics_fixed", "E-7 A-8", FB + f" SELECT bin, {STATS} FROM binned WHERE bin IS NOT NULL GROUP BY bin")
def _(spark, d):
    return S.rounded(E.bin_stats(E.fixed_bins(px(spark, d).scored(), "score"), "bin", "target", STAT_COLS))


@query("equity_curve", "E-8 W-18 W-19", SC + f", best AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, scode) <= 10), curve AS (SELECT date, avg(target / 1000.0::DOUBLE) AS x FROM best GROUP BY date) SELECT date, {q.r('x')} AS daily_return, {q.r('product(1 + x) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS equity FROM curve")
def _(spark, d):
    s = px(spark, d).scored().withColumn("target", F.col("target") / F.lit(1000.0))
    return S.rounded(E.equity_curve(s, "target", "score", 10))


# -- audits --------------------------------------------------------------------------------
def corr_sql(base: str, names: list[str], where: str = "") -> str:
    parts = []
    for a, b in combinations(names, 2):
        parts.append(f"SELECT '{a}' AS Feature_A, '{b}' AS Feature_B, corr(x, y) AS Correlation FROM (SELECT {q.avgrank(a, '')} AS x, {q.avgrank(b, '')} AS y FROM (SELECT * FROM {base} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")
    return " UNION ALL ".join(parts)


@query("high_corr_pairs", "K-1", q.with_(q.BARS) + ", ps AS (" + corr_sql("bars", ["open", "high", "low", "close", "volume", "volume_p"]) + f") SELECT Feature_A, Feature_B, {q.r('Correlation')} AS Correlation FROM ps WHERE Correlation >= 0.7")
def _(spark, d):
    b = px(spark, d).bars()
    return S.rounded(A.high_corr_pairs(b, ["open", "high", "low", "close", "volume", "volume_p"], ["scode", "date"], 0.7))


def _wide_emb(spark, d):
    e = px(spark, d).table("embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"g{i}") for i in range(64)])


WIDE_SQL = f"""WITH l AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
 k AS (SELECT vec_id, i, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS k FROM l),
 ps AS (SELECT 'g' || a.i AS Feature_A, 'g' || b.i AS Feature_B, corr(a.k, b.k) AS Correlation FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)
 SELECT Feature_A, Feature_B, {q.r('Correlation')} AS Correlation FROM ps WHERE Correlation >= 0.08"""


@query("high_corr_pairs_wide", "K-1", WIDE_SQL)
def _(spark, d):
    return S.rounded(A.high_corr_pairs(_wide_emb(spark, d), [f"g{i}" for i in range(64)], ["vec_id"], 0.08))


@query("high_corr_pairs_with_nulls", "K-1", "WITH " + EMB + ", ps AS (" + corr_sql("emb", FS[:5]) + f") SELECT Feature_A, Feature_B, {q.r('Correlation')} AS Correlation FROM ps WHERE Correlation >= 0.02")
def _(spark, d):
    return S.rounded(A.high_corr_pairs(emb(spark, d), FS[:5], ["vec_id"], 0.02))


GAPS = "gaps AS MATERIALIZED (SELECT scode, date, CASE WHEN day(date) = 3 THEN 'Infinity'::DOUBLE WHEN day(date) % 4 = 0 THEN NULL ELSE close END AS a, CASE WHEN scode % 9 = 0 THEN 'NaN'::DOUBLE ELSE volume END AS target_b FROM bars)"


def gaps(spark, d):
    return px(spark, d).bars().select("scode", "date", F.when(F.dayofmonth("date") == 3, float("inf")).when(F.dayofmonth("date") % 4 != 0, F.col("close")).alias("a"),
                                      F.when(F.col("scode") % 9 == 0, float("nan")).otherwise(F.col("volume")).alias("target_b"))


@query("missing_report", "A-6 K-2", q.with_(q.BARS, GAPS) + " SELECT year, column_name, type, nan_count, inf_count, " + q.r("100.0 * (nan_count + inf_count) / n") + " AS missing_rate_pct FROM (" + " UNION ALL ".join(
    f"SELECT year(date)::INTEGER AS year, '{c}' AS column_name, '{t}' AS type, count(*) FILTER ({c} IS NULL OR isnan({c})) AS nan_count, count(*) FILTER (isinf({c})) AS inf_count, count(*) AS n FROM gaps GROUP BY 1" for c, t in (("a", "feature"), ("target_b", "target"))) + ")")
def _(spark, d):
    return S.rounded(A.missing_report(gaps(spark, d), ["a"], ["target_b"]))


@query("missing_rows", "A-7 K-3", q.with_(q.BARS, GAPS) + " SELECT date, scode FROM gaps WHERE a IS NULL OR NOT isfinite(a)")
def _(spark, d):
    return A.missing_rows(gaps(spark, d), "a", ["date", "scode"])


@query("candidate_counts", "A-4 K-4", q.with_(q.BARS, UNI_CTES) + "SELECT year(date)::INTEGER AS year, sum(is_candidate_tac::BIGINT)::BIGINT AS is_candidate_tac, sum(is_candidate_str::BIGINT)::BIGINT AS is_candidate_str, count(*) AS total_rows FROM uni GROUP BY 1")
def _(spark, d):
    return A.candidate_counts(flagged(spark, d), ["is_candidate_tac", "is_candidate_str"])


@query("thinned_candidate_counts", "A-5 K-4 J-9", "WITH RECURSIVE " + q.BARS + ", " + UNI_CTES + ", ft AS MATERIALIZED (SELECT scode, date FROM uni WHERE is_candidate_tac), fs AS MATERIALIZED (SELECT scode, date FROM uni WHERE is_candidate_str), "
       + thin_sql("ft", 5, "tt") + ", " + thin_sql("fs", 20, "ts") + """ SELECT y.year, total_rows, is_candidate_tac_raw, is_candidate_str_raw, coalesce(a.n, 0) AS is_candidate_tac, coalesce(b.n, 0) AS is_candidate_str FROM
 (SELECT year(date)::INTEGER AS year, count(*) AS total_rows, sum(is_candidate_tac::BIGINT)::BIGINT AS is_candidate_tac_raw, sum(is_candidate_str::BIGINT)::BIGINT AS is_candidate_str_raw FROM uni GROUP BY 1) y
 LEFT JOIN (SELECT year(date) AS year, count(*) AS n FROM tt GROUP BY 1) a USING (year) LEFT JOIN (SELECT year(date) AS year, count(*) AS n FROM ts GROUP BY 1) b USING (year)""")
def _(spark, d):
    return A.thinned_candidate_counts(flagged(spark, d), {"is_candidate_tac": 5, "is_candidate_str": 20})
