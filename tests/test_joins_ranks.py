import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import evaluate as E
from stratapanel.operators import ranking as K
from stratapanel.operators.asof import Side, asof_join, asof_joins, densify
from stratapanel.operators.crosssection import fill_group_median, gauss_rank_features, sector_z
from stratapanel.operators.sampling import sample_keys, sample_rows
from stratapanel.operators.thinning import thin_by_interval

from .conftest import day


def frames(spark):
    left = spark.createDataFrame([("A", day(i)) for i in range(6)] + [("B", day(3))], "k string, d date")
    right = spark.createDataFrame([("A", day(1), 1.0, 0), ("A", day(3), None, 0), ("A", day(4), 4.0, 0), ("A", day(4), 5.0, 1)],
                                  "k string, t date, v double, tie int")
    return left, right


def test_asof_exact_before_none_and_repeated_key(spark):
    left, right = frames(spark)
    for kw in ({}, {"left_unique": True}, {"block": "week"}):
        out = asof_join(left, right, ["k"], "d", "t", ["v"], tie=["tie"], keep_right_ts="pub", **kw)
        got = {(r.k, r.d): (r.v, r.pub) for r in out.collect()}
        assert got[("A", day(0))] == (None, None) and got[("B", day(3))] == (None, None)
        assert got[("A", day(1))] == (1.0, day(1)) and got[("A", day(2))] == (1.0, day(1))
        assert got[("A", day(3))] == (None, day(3))          # a null value still counts as the latest row
        assert got[("A", day(4))] == (5.0, day(4)) and got[("A", day(5))] == (5.0, day(4))


def test_asof_joins_two_sides_one_exchange(spark):
    left, right = frames(spark)
    r1 = right.where("tie = 0").select("k", "t", "v")
    r2 = r1.select("k", F.date_add("t", 1).alias("u"), (F.col("v") * 2).alias("w"))
    out = asof_joins(left, ["k"], "d", [Side(r1, "t", ["v"]), Side(r2, "u", ["w"], "pub")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.k, r.d): (r.v, r.w) for r in out.collect()}
    assert got[("A", day(1))] == (1.0, None) and got[("A", day(2))] == (1.0, 2.0) and got[("A", day(5))] == (4.0, 8.0)


def test_densify_uses_publication_before_start(spark):
    e = spark.createDataFrame([(day(0), 1.0), (day(5), 2.0)], "date date, v double")
    got = [r.v for r in densify(e, "date", ["v"], str(day(3)), str(day(6))).orderBy("date").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0]


def skewed(spark, n=4000):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 6, n)), "i": np.arange(n),
                        "x": np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(size=n), 3))})
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))


def test_split_ranks_on_hot_group_and_hot_value(spark):
    pdf, df = skewed(spark)
    want = pdf.groupby("g")["x"].rank(method="average")
    for spacing in (3, 10, 100_000):
        got = K.average_ranks(df, ["x"], ["g"], spacing).select("i", "x__rank").toPandas().set_index("i").sort_index()
        assert np.allclose(got["x__rank"].astype(float), want, equal_nan=True)


def test_global_rank_without_group(spark):
    pdf, df = skewed(spark)
    got = K.average_ranks(df, ["x"], [], 20).select("i", "x__rank").toPandas().set_index("i").sort_index()
    assert np.allclose(got["x__rank"].astype(float), pdf["x"].rank(), equal_nan=True)


def test_ranks_of_extreme_and_clustered_values(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=300), 1 + rng.random(300) * 1e-12, [1.7e308, -1.7e308, 5e-324, 0.0, -0.0]]
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    got = K.average_ranks(df, ["x"], [], 10).select("i", "x__rank").toPandas().sort_values("i")["x__rank"].to_numpy()
    assert np.allclose(got, pd.Series(x).rank().to_numpy())


def test_building_rank_plans_starts_no_job(spark):
    _, df = skewed(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans-only", "none may start")
    K.average_ranks(df, ["x"], ["g"]), fill_group_median(df, ["x"], ["g"]), K.order_statistics(df, "x", ["g"], [0.5])
    sector_z(df, ["x"], ["g"])
    assert list(tracker.getJobIdsForGroup("plans-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_order_statistics_are_linear_quantiles(spark):
    pdf, df = skewed(spark)
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = K.order_statistics(df, "x", ["g"], probs, spacing=15).toPandas()
    for _, r in got.iterrows():
        assert np.isclose(r.q, pdf[pdf.g == r.g]["x"].quantile(probs[int(r.i)]))


def test_windows_stay_small_on_any_distribution(spark):
    rng = np.random.default_rng(7)
    for x in (np.r_[rng.random(20_000), 1e6, 1e12], rng.lognormal(0, 4, 20_000), rng.random(20_000) + 1e9, -rng.lognormal(0, 30, 20_000), np.r_[rng.random(9000) + 7, rng.random(9000) * 1e-9]):
        df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x})).withColumns({"g": F.lit(1), "ties": F.lit(1)})
        cut = K.with_part(df, "x", ["g"], ["ties"], 100)
        assert cut.groupBy("_o", "_c").count().agg(F.max("count")).first()[0] <= 200
        got = K.average_ranks(df, ["x"], [], 100)
        assert np.allclose(got.select("i", "x__rank").toPandas().sort_values("i")["x__rank"], pd.Series(x).rank())


def test_octaves_follow_values(spark):
    rng = np.random.default_rng(1)
    x = np.unique(np.r_[rng.normal(size=500), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0), 1.7976931348623157e308, np.inf, -np.inf, 0.0, -rng.lognormal(0, 50, 500)])
    got = np.array([r.k for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").select("i", K.octave(F.col("x")).alias("k")).orderBy("i").collect()])
    assert (np.diff(got) >= 0).all() and (got == 0).sum() == 1 and len(np.unique(got)) > 2000


def test_split_rank_never_sorts_a_whole_group(spark):
    _, df = skewed(spark)
    plan = K.rank_table(df, "x", ["g"], spacing=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "_c#" in plan and "RepartitionByExpression [g" in plan   # ranked by (group, octave, part)


def test_fold_metrics_equal_pandas(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"fold": rng.integers(0, 3, n), "phase": rng.choice(["train", "valid"], n), "s": np.round(rng.normal(size=n), 1), "t": np.round(rng.normal(size=n), 1),
                        "l": rng.integers(0, 2, n).astype(float)})
    pdf["t"] = pdf.t + pdf.s
    for c, share in (("s", 0.05), ("t", 0.1), ("l", 0.2)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    df = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in "stl"})
    for spacing in (10, 100_000):
        for r in E.fold_metrics(df, "t", "s", label="l", spacing=spacing).collect():
            g = pdf[(pdf.fold == r.fold) & (pdf.phase == r.phase)]
            ok, lab = g.dropna(subset=["s", "t"]), g.dropna(subset=["s", "l"])
            k, p = lab.s.rank(), (lab.l == 1)
            auc = (k[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())
            assert np.isclose(r.ic, ok.s.rank().corr(ok.t.rank())) and np.isclose(r.auc, auc) and np.isclose(r.rmse, ((ok.t - ok.s) ** 2).mean() ** 0.5)


def test_z_score_of_single_and_flat_groups(spark):
    df = spark.createDataFrame([(1, "s", 5.0), (2, "t", 3.0), (2, "t", 3.0), (3, "u", None), (3, "u", 1.0), (4, "v", 1.0), (4, "v", 3.0)],
                               "date int, sector33_code string, x double")
    got = sorted((r.date, r.x_sector_z) for r in sector_z(df, ["x"]).where("date <> 3").collect())
    assert got[:3] == [(1, 0.0), (2, 0.0), (2, 0.0)]
    assert np.allclose([z for d, z in got if d == 4], [-0.70710678, 0.70710678])


def test_median_fill(spark):
    pdf, df = skewed(spark)
    a = fill_group_median(df, ["x"], ["g"]).toPandas().sort_values("i")["x"].to_numpy()
    want = pdf["x"].fillna(pdf.groupby("g")["x"].transform("median")).to_numpy()
    assert np.allclose(a, want)


def test_gauss_rank_outside_universe_takes_last_score(spark):
    rows = [("A", day(0), 1.0, True), ("B", day(0), 2.0, True), ("A", day(1), 5.0, False), ("B", day(1), 1.0, True), ("C", day(1), 3.0, False)]
    df = spark.createDataFrame(rows, "scode string, date date, x double, ok boolean")
    got = {(r.scode, r.date): r.x for r in gauss_rank_features(df, ["x"], F.col("ok")).collect()}
    assert got[("A", day(1))] == got[("A", day(0))] and got[("C", day(1))] == 0.0
    assert abs(got[("A", day(0))]) < 1e-12   # rank 1 of 2 is 0.5


def test_thinning_greedy(spark):
    df = spark.createDataFrame([("A", day(i)) for i in (1, 3, 6, 7, 11)] + [("B", day(2))], "scode string, date date")
    got = sorted((r.scode, r.date) for r in thin_by_interval(df, 5).collect())
    assert got == [("A", day(1)), ("A", day(6)), ("A", day(11)), ("B", day(2))]
    assert thin_by_interval(df, 1).count() == 6


def test_samples_are_reproducible(spark):
    df = spark.range(0, 5000).withColumn("k", F.col("id") % 50)
    a, b = (sorted(r.id for r in sample_rows(df, ["id"], 100, seed=3).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 100
    keys = sample_keys(df, "k", 5, seed=3)
    assert keys.select("k").distinct().count() == 5 and keys.count() == 500


def test_refined_octaves_are_not_broadcast(spark):
    """Parts grow with the rows where ``spacing`` is small: they travel by exchange, whatever their number."""
    from stratapanel.operators.ranking import rank_table
    df = spark.range(400).select((F.col("id") % 3).alias("g"), (F.lit(1.0) + F.col("id") / F.lit(400.0)).alias("v"))
    ranked = rank_table(df, "v", ["g"], spacing=8)
    assert "strategy=broadcast" not in ranked._jdf.queryExecution().analyzed().toString()
    want = {}
    for g, v in sorted((r.g, r.v) for r in df.collect()):
        want[g, v] = sum(1 for k in want if k[0] == g) + 1.0
    assert {(r.g, r.v): r["rank"] for r in ranked.collect()} == want


def test_correlation_reads_written_ranks(spark, monkeypatch):
    """The correlation passes over its rows more than once: what it gets is a written table, not the ranking's plan."""
    from stratapanel.operators import audit
    seen = []
    corr = audit.Correlation.corr
    monkeypatch.setattr(audit.Correlation, "corr", lambda v, *a: (seen.append(v), corr(v, *a))[1])
    df = spark.range(300).select("id", (F.col("id") % 17).alias("a"), (F.col("id") % 17 * 2 + F.col("id") % 2).alias("b"), F.when(F.col("id") % 5 > 0, -F.col("id")).alias("c"))
    got = [(r.Feature_A, r.Feature_B, r.Correlation) for r in audit.high_corr_pairs(df, ["a", "b", "c"], ["id"], 0.9).collect()]
    pdf = df.toPandas()
    assert got == [("a", "b", pytest.approx(pdf.a.rank().corr(pdf.b.rank())))]
    assert "ranks-" in "".join(seen[0].inputFiles()) and "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_sector_scores_leave_wide_rows_in_place(spark):
    """Statistics of days and sectors are broadcast: the rows that take them are not exchanged, and their code does not grow by column."""
    names = [f"x{i}" for i in range(12)]
    df = spark.range(60).select((F.col("id") % 3).alias("date"), (F.col("id") % 2).cast("string").alias("sector33_code"),
                                *[(F.col("id") * (i + 1) % 7).cast("double").alias(n) for i, n in enumerate(names)])
    out = sector_z(df, names)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text and text.count("zip_with") == 1
    pdf = df.toPandas()
    for n in ("x0", "x11"):
        g = pdf.groupby(["date", "sector33_code"])[n]
        want = ((pdf[n] - g.transform("mean")) / g.transform("std")).clip(-3, 3)
        assert np.allclose(sorted(r[0] for r in out.select(f"{n}_sector_z").collect()), sorted(want))


def test_day_scores_in_place_equal_split_ones(spark):
    """The rows of a day travel once, unstacked, and no join brings scores back; values, ties and gaps as by split ranks."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"scode": np.repeat(np.arange(40), 9), "date": [day(i) for i in range(9)] * 40, "ok": rng.random(360) < 0.8})
    for n in "abc":
        pdf[n] = np.where(rng.random(360) < 0.2, np.nan, np.round(rng.normal(size=360), 1) + 0.0)
    df = spark.createDataFrame(pdf).withColumns({n: F.nanvl(n, F.lit(None)) for n in "abc"})
    out = gauss_rank_features(df, list("abc"), F.col("ok"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 2 and out.columns == df.columns   # by day, by stock
    got, want = (x.toPandas().sort_values(["scode", "date"]).reset_index(drop=True) for x in (out, gauss_rank_features(df, list("abc"), F.col("ok"), spacing=3)))
    pd.testing.assert_frame_equal(got, want)
    p = pdf.where(pdf.ok).groupby(pdf.date)["a"].rank(pct=True)
    from statistics import NormalDist
    score = p.clip(1e-6, 1 - 1e-6).map(NormalDist().inv_cdf, na_action="ignore").groupby(pdf.scode).ffill().fillna(0.0)
    assert np.allclose(got["a"], score)


def test_day_targets_in_one_exchange_equal_split_ones(spark):
    from stratapanel.operators.targets import cross_sectional_targets
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"scode": np.repeat(np.arange(30), 20), "date": [day(i) for i in range(20)] * 30, "sector33_code": np.repeat(["a", "b", None], 200)})
    for n in ("sector_return", "Market_Return", "target_ret_5", "target_ret_60"):
        pdf[n] = np.where(rng.random(600) < 0.1, np.nan, np.round(rng.normal(size=600), 1) + 0.0)
    df = spark.createDataFrame(pdf).withColumns({n: F.nanvl(n, F.lit(None)) for n in pdf.columns[3:]})
    out = cross_sectional_targets(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    a, b = (x.toPandas().sort_values(["scode", "date"]).reset_index(drop=True) for x in (out, cross_sectional_targets(df, spacing=3)))
    pd.testing.assert_frame_equal(a, b[list(a.columns)])
    assert np.allclose(a["target_tac_rank"], pdf.groupby("date")["target_ret_5"].rank(pct=True), equal_nan=True)


def test_rank_table_exchanges_values_once(spark, tmp_path):
    """Counts of values are used for the octaves, for their parts and for the ranks: one exchange by value, reused."""
    spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 700 * 1.5).alias("x")).write.parquet(f"{tmp_path}/t")
    out = K.rank_table(spark.read.parquet(f"{tmp_path}/t"), "x", ["g"])
    assert out.count() == len({(i % 3, i % 700) for i in range(3000)})
    text = out._jdf.queryExecution().executedPlan().toString()
    made = [line for line in text.splitlines() if "normalizenanandzero" in line]
    assert made and all("partial_count(1)" in line for line in made)   # all alike, so Spark reuses the first
