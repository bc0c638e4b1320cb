"""Event ends and leak-free time splits.

All of this runs on the date axis (one row per distinct day) or on
folds x days, both bounded by the calendar; panel rows only join the result by
date.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join


def sessions_between(df: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(date, pos) of trading days inside the data's range; the data's own days by default."""
    days = (sessions if sessions is not None else df).select("date").where(F.col("date").isNotNull()).distinct()
    if sessions is not None:
        span = df.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
        days = days.join(F.broadcast(span), F.col("date").between(F.col("_lo"), F.col("_hi"))).select("date")
    return days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def add_event_end(df: DataFrame, horizon: int, sessions: DataFrame | None = None) -> DataFrame:
    """``t1`` = the session ``horizon`` after ``date``; rows off the calendar or past its end are dropped."""
    axis = sessions_between(df, sessions)
    w = Window.orderBy("date")
    ends = axis.select("date", F.lead("date", horizon).over(w).alias("t1")).where(F.col("t1").isNotNull())
    return df.join(ends, "date")   # calendar rows


def split_axis(samples: DataFrame) -> DataFrame:
    """(pos, date, end_pos): last axis day that any sample of the day still touches."""
    per_day = samples.groupBy("date").agg(F.max("t1").alias("t1"))
    w = Window.orderBy("date")
    axis = per_day.select("date", "t1", (F.row_number().over(w) - 1).alias("pos"))
    known = axis.select(F.col("date").alias("_d"), F.col("pos").alias("_end"))
    hit = asof_join(axis, known, [], "t1", "_d", ["_end"], right_unique=True, left_unique=True)
    return hit.select("pos", "date", F.greatest(F.coalesce("_end", F.lit(0)), F.col("pos")).alias("end_pos"))


def validate_split(n_splits: int, pct_embargo: float, n_test: int | None = None) -> None:
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    if not 0.0 <= pct_embargo < 1.0:
        raise ValueError("pct_embargo must be in [0, 1)")
    if n_test is not None and not 1 <= n_test < n_splits:
        raise ValueError("n_test must be in [1, n_splits)")


def with_blocks(axis: DataFrame, n_splits: int, pct_embargo: float) -> tuple[DataFrame, DataFrame]:
    """Axis rows with their block, and one row per block with its test interval and embargo end."""
    w = Window.orderBy("pos")
    rows = axis.withColumn("block", F.ntile(n_splits).over(w) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = rows.withColumn("_emb", F.bround(F.lit(pct_embargo) * n, 0).cast("int"))
    ends = rows.groupBy("block").agg(F.min("pos").alias("test_start"), F.max("end_pos").alias("test_end"),
                                     F.max("_emb").alias("embargo"))
    return rows.drop("_emb"), ends


def fold_rows(axis: DataFrame, folds: list[list[int]], n_splits: int, pct_embargo: float) -> DataFrame:
    """(fold, side, pos, date, end_pos) for folds given as lists of test blocks.

    A day trains in a fold if its interval misses every test interval and it does
    not start inside an embargo. Each day is exploded over folds x test blocks
    (settings, not data) and meets its interval by an equi join on the block.
    """
    rows, ends = with_blocks(axis, n_splits, pct_embargo)
    plan = F.array(*[F.struct(F.lit(i).alias("fold"), F.array(*[F.lit(b) for b in bl]).alias("tests"))
                     for i, bl in enumerate(folds)])
    wide = rows.select("*", F.inline(plan))
    in_test = F.array_contains("tests", F.col("block"))
    wide = wide.select("fold", "pos", "date", "end_pos", in_test.alias("in_test"), F.explode("tests").alias("block"))
    d = wide.join(ends, "block")
    hit = (F.col("pos") <= F.col("test_end")) & (F.col("end_pos") >= F.col("test_start"))
    wait = (F.col("pos") > F.col("test_end")) & (F.col("pos") <= F.col("test_end") + F.col("embargo"))
    g = d.groupBy("fold", "pos", "date", "end_pos").agg(
        F.bool_or("in_test").alias("_test"), F.bool_or(hit | wait).alias("_out"))
    side = F.when(F.col("_test"), "test").when(~F.col("_out"), "train")
    return g.select("fold", side.alias("side"), "pos", "date", "end_pos").where(F.col("side").isNotNull())


def purged_kfold(axis: DataFrame, n_splits: int, pct_embargo: float = 0.0) -> DataFrame:
    validate_split(n_splits, pct_embargo)
    return fold_rows(axis, [[k] for k in range(n_splits)], n_splits, pct_embargo)


def cpcv(axis: DataFrame, n_splits: int, n_test: int, pct_embargo: float = 0.0) -> DataFrame:
    """Combinatorial folds: every choice of ``n_test`` test blocks."""
    validate_split(n_splits, pct_embargo, n_test)
    return fold_rows(axis, [list(x) for x in combinations(range(n_splits), n_test)], n_splits, pct_embargo)


def fixed_holdout(date: Column, valid_start: str, test_start: str, embargo_days: int) -> Column:
    """train / valid / test by date; days inside an embargo get null."""
    v, t = F.to_date(F.lit(valid_start)), F.to_date(F.lit(test_start))
    return (F.when(date >= t, "test").when((date >= v) & (date < F.date_sub(t, embargo_days)), "valid")
            .when(date < F.date_sub(v, embargo_days), "train"))


def rows_of_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows once per fold and side they belong to (fold tables are calendar-sized)."""
    return panel.join(folds.select("fold", "side", "date"), "date")


def check_disjoint(folds: DataFrame) -> None:
    """Raise if any fold trains on a test day."""
    train, test = (folds.where(F.col("side") == s).select("fold", "pos") for s in ("train", "test"))
    if not train.intersect(test).isEmpty():
        raise ValueError("train and test share days")


def segments(folds: DataFrame) -> DataFrame:
    """Contiguous position runs per fold and side."""
    w = Window.partitionBy("fold", "side").orderBy("pos")
    runs = folds.withColumn("_run", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("fold", "side", "_run").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("days"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date")).drop("_run")


def timeline(folds: DataFrame, axis: DataFrame, width: int = 100) -> DataFrame:
    """(fold, timeline): V where a bin holds a test day, T a training day, else '.'.

    Bin j covers positions floor(j n / width) up to the next edge, at least one.
    """
    n = F.col("_n")
    sizes = axis.agg(F.count(F.lit(1)).cast("int").alias("_n"))
    lo = F.floor(F.col("_bin") * n / F.lit(width)).cast("int")
    hi = F.greatest(F.floor((F.col("_bin") + 1) * n / F.lit(width)).cast("int"), lo + 1)
    cells = sizes.select("_n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_bin"))
    cells = cells.select("_bin", F.explode(F.sequence(lo, hi - 1)).alias("pos"))
    mark = F.when(F.col("side") == "test", 2).otherwise(1)
    seen = folds.join(cells, "pos").groupBy("fold", "_bin").agg(F.max(mark).alias("_m"))
    marks = seen.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_m"))).alias("_map"))   # width entries

    def char(i):
        m = F.element_at("_map", i)
        return F.when(m == 2, "V").when(m == 1, "T").otherwise(".")

    return marks.select("fold", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), char), "").alias("timeline"))


def split_summary(folds: DataFrame, axis: DataFrame, width: int = 100) -> DataFrame:
    """One row per fold: days, segments, first and last dates, segment texts and a timeline."""
    seg = segments(folds)
    label = F.when(F.col("side") == "train", "TR").otherwise("VA")
    text = F.format_string("%s[%d..%d](%s..%s)", label, F.col("start_pos"), F.col("end_pos"), F.col("start_date").cast("string"),
                           F.col("end_date").cast("string"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start_pos", text.alias("t")))), lambda s: s["t"])
    n = F.size(parts)
    shown = F.when(n > 3, F.concat(F.slice(parts, 1, 2), F.array(F.lit("...")), F.slice(parts, n, F.lit(1)))).otherwise(parts)
    g = seg.groupBy("fold", "side").agg(
        F.sum("days").cast("int").alias("days"), F.count(F.lit(1)).cast("int").alias("segs"),
        F.min("start_date").alias("start"), F.max("end_date").alias("end"), F.array_join(shown, " ").alias("segments_str"))

    def of(side, x):
        return F.max(F.when(F.col("side") == side, F.col(x)))

    cols = []
    for side, tag, mark in (("train", "train", "TR"), ("test", "valid", "VA")):
        cols += [F.coalesce(of(side, "days"), F.lit(0)).alias(f"{tag}_days"), F.coalesce(of(side, "segs"), F.lit(0)).alias(f"{tag}_segs"),
                 of(side, "start").cast("string").alias(f"{tag}_start"), of(side, "end").cast("string").alias(f"{tag}_end"),
                 F.coalesce(of(side, "segments_str"), F.lit(f"{mark}(empty)")).alias(f"{tag}_segments_str")]
    table = g.groupBy("fold").agg(*cols)
    return table.join(timeline(folds, axis, width), "fold")
