import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.functions import recursion as rec
from stratapanel.functions import rolling as R
from stratapanel.functions import scalars as S

from .conftest import series_df, values


def test_roll_needs_full_non_null_frame(spark):
    df = series_df(spark, [1, 2, None, 4, 5, 6])
    assert values(df.withColumn("y", R.roll(F.sum, "x", 3)), "y") == [None, None, None, None, None, 15.0]


def test_ahead_excludes_current_row(spark):
    df = series_df(spark, [9, 1, 2, 3])
    assert values(df.withColumn("y", R.ahead(F.max, "x", 2)), "y") == [2.0, 3.0, None, None]


def test_streak(spark):
    df = series_df(spark, [5, 5, 6, 7, 6]).withColumn("d", R.diff("x"))
    assert values(R.with_streak(df, "d", "s"), "s") == [0.0, 0.0, 1.0, 2.0, -1.0]


def test_rci_with_ties_matches_average_ranks(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 5, 60).astype(float)
    got = values(R.with_rci(series_df(spark, v), "x", {"y": 9, "z": 4}), "y")
    t = np.arange(1, 10)
    want = pd.Series(v).rolling(9).apply(lambda w: (1 - 6 * np.sum((t - pd.Series(w).rank().values) ** 2) / (9 * 80)) * 100, raw=True)
    assert np.allclose(np.array(got[8:], float), want[8:])
    assert got[:8] == [None] * 8


def test_rci_null_in_frame(spark):
    got = values(R.with_rci(series_df(spark, [1, 2, None, 4, 5, 6, 5]), "x", {"y": 3}), "y")
    assert got[:5] == [None] * 5 and got[5] == pytest.approx(100.0)
    # 5, 6, 5 -> ranks 1.5, 3, 1.5
    assert got[6] == pytest.approx((1 - 6 * (0.25 + 1 + 2.25) / 24) * 100)


def test_skew_kurtosis_bias_correction(spark):
    v = np.random.default_rng(2).normal(size=40)
    df = series_df(spark, v).withColumns({"s": R.roll_skew("x", 20), "k": R.roll_kurt("x", 20)})
    assert np.allclose(np.array(values(df, "s")[19:], float), pd.Series(v).rolling(20).skew()[19:])
    assert np.allclose(np.array(values(df, "k")[19:], float), pd.Series(v).rolling(20).kurt()[19:])


@pytest.mark.parametrize("n", [4, 5])
def test_rolling_median(spark, n):
    v = np.random.default_rng(3).normal(size=30)
    got = values(series_df(spark, v).withColumn("m", R.roll_median("x", n)), "m")
    assert np.allclose(np.array(got[n - 1:], float), pd.Series(v).rolling(n).median()[n - 1:])


@pytest.mark.parametrize("block", [7, 2000])
def test_smoothing_equals_recursion(spark, block):
    v = [None, None] + list(np.random.default_rng(4).normal(5, 1, 60))
    n, alpha = 3, 0.99 if block == 7 else 0.3   # short blocks need a fast decay
    df = rec.smooth(series_df(spark, v), [("y", "x", n, alpha)], "scode", "date", block)
    want, seen, y = [], [], None
    for x in v:
        if x is None:
            want.append(None)
            continue
        seen.append(x)
        if len(seen) == n:
            y = sum(seen) / n
        elif len(seen) > n:
            y = y + alpha * (x - y)
        want.append(y if len(seen) >= n else None)
    got = values(df, "y")
    assert got[:4] == [None] * 4
    assert np.allclose(np.array(got[4:], float), np.array(want[4:], float), rtol=1e-12)


def test_smoothing_sorts_no_more_than_twice(spark):
    """One order for the row numbers and one for all smoothers: memory of a task does not grow with the number of inputs."""
    bars = spark.range(100).selectExpr("id % 3 AS scode", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS date", "id + 2.0D AS high", "id + 0.5D AS low", "id + 1.0D AS close")
    plan = rec.with_indicators(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 2 and plan.count("Exchange hashpartitioning") == 1


def test_smoothing_carries_over_blocks_with_few_inputs(spark):
    """Blocks of five rows that hold one input, or none at all: the state of the first block still counts in the last."""
    v = [100.0, 100.0, 100.0] + [None] * 13 + [0.0] + [None] * 6 + [0.0, 0.0]
    df = rec.smooth(series_df(spark, v), [("y", "x", 3, 0.1), ("z", "x", 2, 0.5)], "scode", "date", 5)
    assert [round(y, 9) for y in values(df, "y") if y is not None] == [100.0, 90.0, 81.0, 72.9]
    assert [z for z in values(df, "z") if z is not None] == [100.0, 100.0, 50.0, 25.0, 12.5]


def test_probit_matches_standard_library(spark):
    from statistics import NormalDist
    ps = [1e-12, 1e-6, 0.01, 0.05, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("z", S.probit("p"))
    for r in df.collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-12
    assert spark.createDataFrame([(0.5,)], "x double").select(S.erfinv("x")).first()[0] == pytest.approx(0.4769362762044699, abs=1e-14)


def test_clip_and_div_keep_null(spark):
    df = spark.createDataFrame([(None, 0.0), (9.0, 0.0), (-9.0, 2.0)], "a double, b double")
    rows = df.select(S.clip("a", -1.0, 1.0).alias("c"), S.div("a", "b").alias("d")).collect()
    assert [r.c for r in rows] == [None, 1.0, -1.0] and [r.d for r in rows] == [None, None, -4.5]


def test_rci_needs_no_frame_for_each_distance(spark):
    """Frames do not grow in number with the period, and gaps and ties stay exact."""
    v = [5, None, 3, 3, 8, 1, 1, None, 1, 4, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4]
    df = R.with_rci(series_df(spark, v), "x", {"a": 5, "b": 9, "c": 52})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("specifiedwindowframe") <= 16
    for name, n in (("a", 5), ("b", 9)):
        want = []
        for i in range(len(v)):
            f = v[max(0, i - n + 1):i + 1]
            if len(f) < n or None in f:
                want.append(None)
                continue
            rank = [sum(y < x for y in f) + (sum(y == x for y in f) + 1) / 2 for x in f]
            want.append(100 * (1 - 6 * sum((k + 1 - r) ** 2 for k, r in enumerate(rank)) / (n * (n * n - 1))))
        got = values(df, name)
        assert [g is None for g in got] == [w is None for w in want]
        assert all(abs(g - w) < 1e-9 for g, w in zip(got, want) if w is not None)


def test_long_frames_of_targets_are_tiled(spark):
    """Only the barrier's arrays walk 60 rows; statistics made of 5-row tiles equal plain frames, with gaps and without spread."""
    from stratapanel.operators import features as X
    from stratapanel.operators.targets import target_set
    from .conftest import day
    rng = np.random.default_rng(3)
    n = 200
    close = np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 100
    rows = []
    for s in ("A", "B"):
        for i in range(n):
            x = 7.3 if s == "B" else float(close[i])
            gap = s == "A" and i == 150
            m = None if s == "A" and i == 20 else float(rng.normal())
            rows.append((s, day(i), x, None if gap else x * 1.01, None if gap else x * 0.99, x, 10.0, 10.0 * x, m))
    df = spark.createDataFrame(rows, "scode string, date date, open double, high double, low double, close double, volume double, volume_p double, Market_Return double")
    fs = X.FeatureSet()
    X.base_columns(fs)
    X.vol_20d(fs), X.beta_60(fs), X.volatility_60(fs)
    base = fs.apply(df, keep_helpers=True)
    out = target_set().apply(base)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("specifiedwindowframe(RowFrame, 1, 60)") <= 2
    ahead = R.series().rowsBetween(1, 60)
    place = F.datediff("date", F.lit("2024-01-01")).cast("double")
    out = out.withColumns({
        "w1": R.roll(F.stddev_samp, "Log_Return", 20), "w2": R.roll_beta("_ret1", "Market_Return", 60), "w3": R.roll(F.stddev_samp, "_ret1", 60),
        "w4": R.ahead(F.max, "high", 60), "w5": R.ahead(F.min, "low", 60),
        "w6": F.when(F.count("close").over(ahead) >= 60, F.pow(F.corr(place, F.when(F.col("scode") == "A", F.col("close")).otherwise(place)).over(ahead), 2))})
    out = out.withColumn("w6", F.when(F.col("scode") == "A", F.col("w6")))   # corr itself fails on a flat series, where the target is null
    pairs = (("Vol_20d", "w1"), ("Beta_60", "w2"), ("volatility_60", "w3"), ("Future_High_Str", "w4"), ("Future_Low_Str", "w5"), ("target_str_consistency", "w6"))
    rows = out.select(*[n for p in pairs for n in p]).collect()
    for got, want in pairs:
        a, b = [r[got] for r in rows], [r[want] for r in rows]
        assert [x is None for x in a] == [x is None for x in b], got
        assert any(x is not None for x in a) and all(abs(x - y) < 1e-9 for x, y in zip(a, b) if x is not None), got
