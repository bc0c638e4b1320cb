import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import audit, evaluate, models, prep, splits
from stratapanel.operators.domain import STR, TAC, domain_filter, target_not_null

from .conftest import day


def axis_of(spark, n, horizon=0):
    return spark.createDataFrame([(i, day(i), min(i + horizon, n - 1)) for i in range(n)], "pos int, date date, end_pos int")


def test_blocks_longer_first(spark):
    rows, _ = splits.with_blocks(axis_of(spark, 7), 3, 0.0)
    assert [r["count"] for r in rows.groupBy("block").count().orderBy("block").collect()] == [3, 2, 2]


@pytest.mark.parametrize("n,want", [(100, 1), (250, 2)])
def test_embargo_rounds_half_to_even(spark, n, want):
    _, ends = splits.with_blocks(axis_of(spark, n), 5, 0.01)
    assert {r.embargo for r in ends.collect()} == {want}


def brute(n, horizon, tests, k, pct):
    blocks = np.array_split(np.arange(n), k)
    t1 = np.minimum(np.arange(n) + horizon, n - 1)
    emb = int(round(pct * n))
    test = set(np.concatenate([blocks[b] for b in tests]))
    train = set(range(n)) - test
    for b in tests:
        s, e = blocks[b][0], t1[blocks[b]].max()
        train -= {i for i in train if i <= e and t1[i] >= s}
        train -= {i for i in train if e < i <= e + emb}
    return train, test


def test_purged_and_combinatorial_folds_match_brute_force(spark):
    from itertools import combinations
    ax = axis_of(spark, 103, 4)
    cases = [(splits.purged_kfold(ax, 5, 0.03), [[i] for i in range(5)]), (splits.cpcv(ax, 5, 2, 0.03), [list(c) for c in combinations(range(5), 2)])]
    for folds, tests in cases:
        splits.check_disjoint(folds)
        rows = folds.collect()
        for i, t in enumerate(tests):
            train, test = brute(103, 4, t, 5, 0.03)
            assert {r.pos for r in rows if r.fold == i and r.side == "train"} == train
            assert {r.pos for r in rows if r.fold == i and r.side == "test"} == test


def test_six_choose_two_folds_and_validation(spark):
    assert splits.cpcv(axis_of(spark, 30), 6, 2).select("fold").distinct().count() == 15
    for bad in (lambda: splits.purged_kfold(None, 1), lambda: splits.purged_kfold(None, 3, 1.0), lambda: splits.cpcv(None, 3, 3)):
        with pytest.raises(ValueError):
            bad()
    overlap = spark.createDataFrame([(0, "train", 1), (0, "test", 1)], "fold int, side string, pos int")
    with pytest.raises(ValueError):
        splits.check_disjoint(overlap)


def test_event_end_drops_off_calendar_and_tail(spark):
    df = spark.createDataFrame([("A", day(i)) for i in (0, 1, 2, 3, 4)], "scode string, date date")
    cal = spark.createDataFrame([(day(i),) for i in (-3, 0, 2, 3, 4, 9)], "date date")
    got = {r.date: r.t1 for r in splits.add_event_end(df, 2, cal).collect()}
    assert got == {day(0): day(3), day(2): day(4)}


def test_fixed_bins_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.7, 1.0, 1.5)], "s double")
    assert [r.bin for r in evaluate.fixed_bins(df, "s").collect()] == [1, 1, 7, 10, None]


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 50 + list(range(1, 51))], "s double")
    got = evaluate.quantile_bins(df, "s", 10, spacing=5).groupBy("bin").count().collect()
    assert len(got) == 6 and {r["bin"]: r["count"] for r in got}[1] == 50


def test_auc_with_ties_and_ic(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8), (0, 0.9)], "y int, s double").withColumn("t", F.col("s") * 2)
    # pairs (pos, neg): (.4,.1)=1 (.4,.4)=.5 (.4,.9)=0 (.8,.1)=1 (.8,.4)=1 (.8,.9)=0
    assert evaluate.auc(df, "y", "s", [], 2).first().auc == pytest.approx(3.5 / 6)
    assert evaluate.rank_ic(df, "t", "s", [], 2).first().ic == pytest.approx(1.0)


def test_equity_curve(spark):
    df = spark.createDataFrame([(day(0), "A", 0.9, 0.1), (day(0), "B", 0.8, 0.3), (day(0), "C", 0.1, -1.0), (day(1), "A", 0.5, 0.5)],
                               "date date, scode string, score double, target double")
    got = evaluate.equity_curve(df, "target", "score", 2).orderBy("date").collect()
    assert [round(r.equity, 10) for r in got] == [1.2, 1.8]


def test_prep_and_weights(spark):
    df = spark.createDataFrame([(1, 1.0, "b", day(0)), (2, None, "a", day(1)), (3, 3.0, None, day(2)), (4, float("inf"), "z", day(3))],
                               "i int, x double, c string, date date").withColumn("n", F.lit(None).cast("double"))
    out = prep.impute_median(df, prep.fit_medians(df, ["x", "n"]), ["x", "n"]).orderBy("i").collect()
    assert [r.x for r in out] == [1.0, 2.0, 3.0, 2.0] and {r.n for r in out} == {0.0}
    lab = prep.fit_labels(df.where("i < 4"), "c")
    assert {r.label: r.code for r in lab.collect()} == {"MISSING": 0, "a": 1, "b": 2}
    assert [r.c for r in prep.label_encode(df, lab, "c").orderBy("i").collect()] == [2, 1, 0, 0]
    seq = prep.sequence_windows(df.withColumn("scode", F.lit("A")).where("i < 4"), ["x"], 3).orderBy("i").collect()
    assert [[r[0] for r in s.sequence] for s in seq] == [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 3.0]]
    w = prep.time_decay_weight(df, 0.5).orderBy("i").collect()
    assert [r.weight for r in w] == [0.125, 0.25, 0.5, 1.0]
    half = df.select(prep.size_weight(F.log1p(F.lit(3e10)), "STR").alias("w"), prep.size_weight(F.lit(1.0), "TAC").alias("t")).first()
    assert half.w == pytest.approx(0.5) and half.t == 1.0
    sc = prep.standard_scale(df.where("i in (1, 3)"), prep.fit_scaler(df.where("i in (1, 3)"), ["x", "i"]), ["x", "i"])
    assert sorted(r.x for r in sc.collect()) == [-1.0, 1.0]


def test_domains_and_contract(spark):
    df = spark.createDataFrame([(True, False, 1.0, 2.0, None, 0.3)], "is_candidate_tac boolean, is_candidate_str boolean, Future_High_Tac double, Future_High_Str double, target_x double, target_reg double")
    assert "Future_High" in domain_filter(df, TAC).columns and domain_filter(df, STR).count() == 0
    assert target_not_null(df, "target_x", "is_candidate_tac").count() == 0
    assert target_not_null(df, "absent", "is_candidate_tac").first().target == 0.3
    with pytest.raises(ValueError, match="Month, RSI_14"):
        audit.require_columns(df, ["Month", "target_x", "RSI_14"])


def test_correlation_pairs_are_signed(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 3.0).alias("b"), (-F.col("id")).cast("double").alias("c"))
    got = audit.high_corr_pairs(df, ["a", "b", "c"], ["id"], 0.95, sample=150).collect()
    assert [(r.Feature_A, r.Feature_B) for r in got] == [("a", "b")]


def test_importance_stability_uses_folds_only(spark):
    t = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (0, "b", 5.0), (1, "b", 5.0)], "fold int, feature string, importance double")
    got = {r.feature: (r.average, r.stability) for r in models.importance_stability(t, [0, 1]).collect()}
    assert got["a"][0] == 2.0 and got["a"][1] == pytest.approx(2 / 2 ** 0.5) and got["b"] == (5.0, None)


def test_training_job_runs_stage_by_stage(spark):
    """Candidates, event ends, thinning, split: against the same steps one by one on a small panel."""
    import datetime as dt
    from stratapanel.operators import domain as D
    from stratapanel.plans import training as J
    start = dt.date(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), i % 3 > 0, float(i), float(i % 7)) for s in ("A", "B") for i in range(90)]
    df = spark.createDataFrame(rows, "scode string, date date, is_candidate_tac boolean, score double, target double")
    samples = J.training_samples(df, D.TAC, df.select("date").distinct())
    days = sorted(r.date for r in samples.where("scode = 'A'").collect())
    want, last = [], None
    for i in range(90):
        if i % 3 and i + 5 <= 89 and (last is None or i - last >= 5):
            want.append(start + dt.timedelta(days=i))
            last = i
    assert days == want
    got = {(r.fold, r.phase): r["count"] for r in J.training_rows(samples, J.SplitPlan(n_splits=3, pct_embargo=0.0)).groupBy("fold", "phase").count().collect()}
    assert set(got) == {(k, p) for k in range(3) for p in ("train", "valid")} and sum(got[k, "valid"] for k in range(3)) == samples.count()
    fixed = J.SplitPlan("fixed", valid_start="2024-02-01", test_start="2024-03-01", embargo_days=5)
    phases = {r.phase: (r.a, r.b) for r in J.training_rows(samples, fixed).groupBy("phase").agg({"date": "min", "t1": "max"}).toDF("phase", "a", "b").collect()}
    assert set(phases) == {"train", "valid", "test"} and phases["valid"][0] >= dt.date(2024, 2, 1) and phases["test"][0] >= dt.date(2024, 3, 1)
    m = {(r.fold, r.phase): r.ic for r in J.phase_metrics(J.training_rows(samples, fixed), "target").collect()}
    assert len(m) == 3


def test_candidates_are_written_once(spark):
    """Calendar, thinning and split read the written candidates, not the master's own plan again."""
    from stratapanel.operators import domain as D
    from stratapanel.plans import training as J
    master = spark.range(400).select((F.col("id") % 2).alias("scode"), F.date_add(F.lit(day(0)), (F.col("id") / 2).cast("int")).alias("date"),
                                     (F.col("id") % 3 > 0).alias("is_candidate_tac"))
    sessions = spark.createDataFrame([(day(i),) for i in range(-60, 200)], "date date")
    samples = J.training_samples(master, D.TAC, sessions)
    rows = J.training_rows(samples, J.SplitPlan(n_splits=3, pct_embargo=0.0))
    assert "Range (" in master._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.select("scode", "date").distinct().count() == samples.count()


@pytest.mark.parametrize("spacing", [8, 40, 100_000])
def test_few_quantiles_equal_pandas_without_exchanging_rows(spark, spacing):
    from stratapanel.operators.ranking import few_order_statistics
    rng = np.random.default_rng(11)
    x = np.r_[rng.normal(size=700), np.full(400, 1.25), 1 + rng.random(300) * 1e-9, [0.0, -0.0, 1e300, -1e300, 5e-324], np.full(60, np.nan)]
    pdf = pd.DataFrame({"g": np.arange(len(x)) % 3, "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    q = few_order_statistics(df, "x", ["g"], probs, spacing)
    got = {(r.g, r.i): r.q for r in q.collect()}
    assert len(got) == 15
    for (g, i), v in got.items():
        assert v == pytest.approx(pdf[pdf.g == g]["x"].quantile(probs[i]), rel=1e-12)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("strategy=broadcast") >= 2


def test_merged_scaler_states_equal_one_fit(spark):
    from pyspark.sql import functions as F
    from stratapanel.operators import prep as P
    df = spark.range(0, 500).select("id", (F.sin("id") * 1e6 + 1e9).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("b"), F.lit(None).cast("double").alias("c"))
    names = ["a", "b", "c"]
    parts = [P.scaler_state(df.where(w), names) for w in ("id < 10", "id >= 10 and id < 400", "id >= 400", "false")]
    merged = P.scaler_of(P.merge_states(*parts), names).first()
    whole = P.fit_scaler(df, names).first()
    for c in names:
        for k in ("mean", "std"):
            x, y = merged[f"{c}__{k}"], whole[f"{c}__{k}"]
            assert (x is None and y is None) or abs(x - y) <= 1e-9 * abs(y)


def test_appended_quarter_equals_full_run(spark, tmp_path):
    import datetime as dt
    from pyspark.sql import functions as F
    from stratapanel.functions import rolling as R
    from stratapanel.sources import sinks
    rows = [(s, dt.date(2023, 1, 2) + dt.timedelta(days=i), float((i * 7) % 11)) for s in ("A", "B") for i in range(400)]
    df = spark.createDataFrame(rows, "scode string, date date, x double")
    compute = lambda d: d.withColumn("m", R.roll(F.avg, "x", 5)).select("scode", "date", "m")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    sinks.write_panel(df.where("date < '2023-11-15'"), raw)
    sinks.write_panel(compute(df.where("date < '2023-11-15'")), out)
    before = set(spark.read.parquet(out).where("quarter < '2023Q4'").inputFiles())
    for _ in range(2):   # a repeated run changes nothing
        sinks.append_period(df.where("date >= '2023-11-15'"), raw, out, compute, "2023-11-15", 30)
        got = sorted(map(tuple, spark.read.parquet(out).select("scode", "date", "m").collect()), key=lambda r: (r[0], r[1]))
        assert got == sorted(map(tuple, compute(df).collect()), key=lambda r: (r[0], r[1]))
    old = {f for f in spark.read.parquet(out).inputFiles() if "quarter=2023Q4" not in f and "quarter=2024" not in f}
    assert old and old <= before | old and all(f in before for f in old)


def test_jdbc_reads_by_predicates_of_a_database(spark):
    from pyspark.sql import functions as F
    from catalog.reports import _database
    from stratapanel.sources import tables
    url, props = _database(spark)
    df = spark.range(0, 200).select("id", F.when(F.col("id") % 50 > 0, F.date_add(F.lit("2024-01-15").cast("date"), F.col("id").cast("int"))).alias("d"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    tables.write_jdbc(df, url, "t", props, "name VARCHAR(20)")
    parts = tables.month_predicates('"d"', "2024-02-01", "2024-05-01")
    read = tables.jdbc_reader(spark, url, props, {"t": parts})("t")
    assert read.rdd.getNumPartitions() == len(parts) and sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    plan = read.where("id > 100").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,100)" in plan.replace(" ", "") and read.where("id > 100").count() == 99


def test_blocks_hold_the_same_windows(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from stratapanel.operators import prep as P
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i % 9 == 4 else float(i + 1), float(-i)) for s, n in (("A", 25), ("B", 3), ("C", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "scode string, date date, x double, y double")
    want = {(r.scode, r.date): [v for row in r.sequence for v in row] for r in P.sequence_windows(df, ["x", "y"], 6).collect()}
    for block in (4, 8, 100):
        b = P.sequence_blocks(df, ["x", "y"], 6, block)
        assert {(r.scode, r.date): r.window for r in P.windows_of(b, 2, 6).collect()} == want
        assert b.agg(F.max(F.size("values"))).first()[0] <= 2 * (block + 5)
