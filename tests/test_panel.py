import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import compare
from stratapanel.functions import recursion as rec
from stratapanel.operators import features as X
from stratapanel.operators import targets as T
from stratapanel.operators import universe as U
from stratapanel.plans import panel as P
from stratapanel.sources import sinks, tables
from stratapanel.sources.proxy import Proxy

from .conftest import day, series_df, values

ROOT = "/root/testdata/sf0.001"
CHECKED = ["daily_leaders", "signed_streak", "recursive_smoothing_short_blocks", "percent_rank_split_groups", "fill_sector_median_split_groups",
           "asof_financials_time_blocks", "asof_sector_shorts", "trend_features", "fundamental_features", "strategic_barrier",
           "cross_sectional_targets_split_groups", "gauss_rank_features_split_groups", "universe_flags", "thin_bars",
           "combinatorial_purged_cv", "split_summary", "fold_metrics", "bin_statistics", "thinned_candidate_counts"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, ROOT).toArrow()
    want = compare.duck(ROOT).sql(entry.oracle_sql()[name]).to_arrow_table()
    assert compare.compare(got, want) == ""


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_market_segment(spark):
    names = {"東証 1部": 1, "プライム": 1, "JQグロース": 3, "マザーズ": 3, "JQ": 2, "東証　二部": 2, "東証": 2, "TOKYO PRO MARKET": 0, None: 0}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "m string, want int")
    for r in df.withColumn("got", X.market_segment(F.col("m"))).collect():
        assert r.got == r.want, r


def test_calendar_edges(spark):
    import datetime as dt
    days = [dt.date(2023, 2, 28), dt.date(2023, 12, 31), dt.date(2024, 2, 28)]
    df = spark.createDataFrame([("A", d) for d in days], "scode string, date date")
    got = {r.date: r for r in X.feature_set("calendar").apply(df).collect()}
    assert [got[d].Is_Month_End for d in days] == [1, 1, 0] and got[days[1]].Is_Gotobi == 1 and got[days[0]].DayOfWeek == 1


def test_ticks(spark):
    df = spark.createDataFrame([(x,) for x in (3000.0, 3000.5, 0.0, 400000.0, None)], "c double")
    assert [r.t for r in df.select(U.tick_size(F.col("c")).alias("t")).collect()] == [1.0, 5.0, None, 500.0, None]


def test_first_touch_prefers_loss(spark):
    df = spark.createDataFrame([(11.0, 8.0), (11.0, 9.5), (10.0, 9.5), (None, None)], "h double, l double")
    got = [r[0] for r in df.select(T.first_touch([(F.col("h"), F.col("l"))], F.lit(10.5), F.lit(9.0))).collect()]
    assert got == [-1, 1, 0, 0]


def test_features_do_not_look_ahead(spark):
    p = Proxy(spark, ROOT)
    fs = X.feature_set("trend", "momentum", "volatility", "volume")
    cut = "1999-06-30"
    full = fs.apply(rec.with_indicators(p.bars())).where(F.col("date") <= cut).select("scode", "date", *fs.outputs)
    short = fs.apply(rec.with_indicators(p.bars().where(F.col("date") <= cut))).select("scode", "date", *fs.outputs)
    rounded = [F.round(F.col(c).cast("double"), 9).alias(c) for c in fs.outputs]
    a, b = (d.select("scode", "date", *rounded).orderBy("scode", "date").toPandas() for d in (full, short))
    assert a.equals(b)


def test_history_gate(spark):
    df = spark.createDataFrame([("A", day(i)) for i in range(249)] + [("B", day(i)) for i in range(250)], "scode string, date date")
    assert P.min_history(df).select("scode").distinct().collect()[0].scode == "B"


def test_panel_has_one_exchange_by_stock(spark):
    p = Proxy(spark, ROOT)
    df = P.time_series_panel(P.proxy_inputs(p), with_targets=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    main = plan[:plan.index("Union")]   # from the result down to the union that feeds the per-stock scan
    assert main.count("Exchange") == 1 and main.count("Window") > 5


def test_quarter_dataset(spark, tmp_path):
    p = Proxy(spark, ROOT)
    sinks.write_panel(p.bars(), str(tmp_path / "bars"))
    back = tables.dataset_reader(spark, str(tmp_path))("bars")
    assert back.count() == p.bars().count() and "quarter" in back.columns
    pruned = back.where("quarter = '1998Q1'")
    assert "PartitionFilters: [isnotnull(quarter" in pruned._jdf.queryExecution().executedPlan().toString()


def test_jdbc_predicates_cover_every_date():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT DATE '2019-11-15' + i::INTEGER AS d FROM range(0, 200) r(i) UNION ALL SELECT NULL")
    parts = tables.month_predicates("d", "2020-01-01", "2020-03-31")
    assert sum(con.execute(f"SELECT count(*) FROM t WHERE {x}").fetchone()[0] for x in parts) == 201


def test_volume_ratio_of_a_day_without_volume(spark):
    from stratapanel.operators.features import feature_set
    vol = [10.0, 20.0, 30.0, 40.0, 50.0, 0.0] + [0.0] * 5
    rows = [("A", day(i), 1.0, 1.0, 1.0, 1.0, v, v) for i, v in enumerate(vol)]
    df = spark.createDataFrame(rows, "scode string, date date, open double, high double, low double, close double, volume double, volume_p double")
    got = [r.Vol_Ratio_5d for r in feature_set("volume").apply(df).orderBy("date").select("Vol_Ratio_5d").collect()]
    assert got[3] is None and got[4] == 50 / 30 and got[5] == 0.0 and got[9] is None   # a mean of 0 is null, a volume of 0 is 0


def test_staged_path_keeps_the_folder(spark, monkeypatch):
    from stratapanel.plans import staging
    monkeypatch.setattr(staging, "shared_folder", lambda _: "s3a://bucket/checks/")
    assert staging.staged_path(spark, "panel").startswith("s3a://bucket/checks/panel-")


def test_smoothing_stands_over_gaps(spark):
    from stratapanel.functions import recursion as rec
    df = rec.smooth(series_df(spark, [10.0, 10.0, 10.0, None, 10.0, 10.0]), [rec.ema("y", "x", 3)], "scode", "date")
    assert values(df, "y") == [None, None, 10.0, None, 10.0, 10.0]


def test_panel_reads_the_fact_table_once(spark):
    """All inputs of the whole job come from one written stock-day table; the plan has no scan of the fact table left."""
    import os

    import pytest
    from stratapanel.plans import panel as P
    from stratapanel.sources.proxy import DailyProxy, Proxy
    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        pytest.skip("no test tables")
    plain = Proxy(spark, root)
    staged = DailyProxy.stage(plain)
    assert plain.daily()._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    plan = P.time_series_panel(P.proxy_inputs(staged), min_rows=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "l_extendedprice" not in plan
    for name in ("index_topix", "financials_raw", "margin_weekly", "short_ratio", "bars"):
        a, b = (getattr(p, name)() for p in (plain, staged))
        keys = [c for c, t in a.dtypes if t != "double"]
        a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b[list(a.columns)], rtol=1e-9)


def test_target_windows_carry_features_as_one_struct(spark):
    df = P.time_series_panel(P.proxy_inputs(Proxy(spark, ROOT)), min_rows=1)
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().apply(0)
    assert len(df.columns) > 150 and node.output().size() < 80


def test_master_moves_wide_rows_neither_for_series_nor_for_statistics(spark):
    """What a stock's rows give joins the panel's own exchange; the cross-section joins broadcast tables of days and sectors only."""
    from stratapanel.plans import master as MP
    ts = P.time_series_panel(P.proxy_inputs(Proxy(spark, ROOT)), min_rows=1)
    series = MP.series_columns(ts)
    exchanges = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (ts, series)]
    assert exchanges[0] == exchanges[1]
    out = MP.cross_section(spark.createDataFrame([], series.schema))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == plan.count("strategy=broadcast") > 0
    assert "Quarter" in out.columns and {"Return_20d", "volatility_60_sector_z", "sector_rel_strength_60", *MP.META, *MP.TARGETS} <= set(out.columns)


def test_median_of_days_and_sectors(spark):
    from stratapanel.operators.crosssection import fill_group_median
    rows = [(0, "a", 1.0, None), (0, "a", 2.0, None), (0, "a", None, None), (0, None, 5.0, 1.0), (0, None, None, 2.0), (1, "a", None, 3.0)]
    df = spark.createDataFrame(rows, "date int, sector33_code string, x double, y double").coalesce(1)
    assert [(r.x, r.y) for r in fill_group_median(df, ["x", "y"]).collect()] == [(1.0, None), (2.0, None), (1.5, None), (5.0, 1.0), (5.0, 2.0), (None, 3.0)]
