"""Preprocessing fitted on a fold's training rows, and sample weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalars import div, finite
from .ranking import few_order_statistics, rank_table


def prep_tree(df: DataFrame, features: list[str], categorical: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Infinities to null, categories null -> -1 and int, the rest float."""
    cols = [F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) if c in categorical
            else finite(F.col(c).cast("double")).cast("float").alias(c) for c in dict.fromkeys(features)]
    return df.select(*keep, *cols)


def fit_medians(df: DataFrame, columns: list[str], by: list[str] = (), spacing: int = 250_000) -> DataFrame:
    """One row (per ``by``) with the exact median of every column.

    Columns are stacked into (name, value) and only the values around the medians are sorted; ``df`` is read three times,
    so it should be a written table.
    """
    keys = list(by) or ["_one"]
    d = df if by else df.withColumn("_one", F.lit(0))
    long = d.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(
        keys, list(columns), "_name", "_v")
    q = few_order_statistics(long, "_v", [*keys, "_name"], [0.5], spacing)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("q"))).alias(f"{c}__median") for c in columns])
    return wide.drop("_one")


def impute_median(df: DataFrame, medians: DataFrame, columns: list[str]) -> DataFrame:
    """Null and non-finite values take the fitted median; an all-null column becomes 0."""
    d = df.join(F.broadcast(medians), how="left")   # one row
    return d.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.col(f"{c}__median"), F.lit(0.0))
                          for c in columns}).drop(*[f"{c}__median" for c in columns])


def fit_labels(df: DataFrame, column: str, missing: str = "MISSING") -> DataFrame:
    """(label, code): position of each distinct text in sorted order, null counted as its own text."""
    labels = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("label")).distinct()
    return rank_table(labels, "label", []).select("label", F.col("below").cast("int").alias("code"))


def label_encode(df: DataFrame, labels: DataFrame, column: str, missing: str = "MISSING") -> DataFrame:
    """Replace texts by codes; texts not seen when fitting become 0."""
    m = labels.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    key = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    d = df.join(m, key == F.col("_label"), "left")
    return d.withColumn(column, F.coalesce("_code", F.lit(0))).drop("_label", "_code")


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations; partial aggregates merge across tasks."""
    return df.agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])


def scaler_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, m2) of the rows at hand: what a fit needs to go on from, m2 being the squared deviations' sum."""
    cells = df.agg(*[a for c in columns for a in (F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), F.var_pop(c).alias(f"{c}__var"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"),
                              (F.col(f"{c}__var") * F.col(f"{c}__n")).alias("m2")) for c in columns])
    return cells.select(F.inline(rows))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of the rows of all: a fit on a new quarter goes on from the written state of the earlier ones."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    w = Window.partitionBy("column")   # one row per state
    both = both.withColumns({"_n": F.sum("n").over(w), "_mean": div(F.sum(F.col("n") * F.col("mean")).over(w), F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(w))})
    shift = F.col("mean") - F.col("_mean")
    return both.groupBy("column").agg(F.max("_n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"))


def scaler_of(state: DataFrame, columns: list[str]) -> DataFrame:
    """The scaler (one row of means and population deviations) of a state."""
    def pick(c, x):
        return F.max(F.when(F.col("column") == c, x))
    return state.agg(*[a for c in columns for a in (pick(c, F.col("mean")).alias(f"{c}__mean"), pick(c, F.sqrt(div("m2", "n"))).alias(f"{c}__std"))])


def standard_scale(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std; a column without spread is only centred."""
    d = df.join(F.broadcast(scaler), how="left")   # one row
    def std(c):
        return F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std"))
    return d.withColumns({c: div(F.col(c) - F.col(f"{c}__mean"), std(c)) for c in columns}).drop(
        *[f"{c}__{s}" for c in columns for s in ("mean", "std")])


def sequence_windows(df: DataFrame, features: list[str], width: int = 60, by: str = "scode", ts: str = "date",
                     out: str = "sequence") -> DataFrame:
    """array<array<float>> of the last ``width`` feature rows, zero rows in front of short histories."""
    row = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features])
    got = F.collect_list(row).over(R.series(by, ts).rowsBetween(-(width - 1), 0))
    zero = F.array(*[F.lit(0.0).cast("float") for _ in features])
    df = df.withColumn("_got", got)
    return df.withColumn(out, F.concat(F.array_repeat(zero, F.lit(width) - F.size("_got")), F.col("_got"))).drop("_got")


def sequence_blocks(df: DataFrame, features: list[str], width: int = 60, block: int = 1024, by: str = "scode", ts: str = "date") -> DataFrame:
    """The windows of ``sequence_windows`` without repeating rows: (by, block, dates, values) with the features of up to ``block``
    rows and of the ``width - 1`` rows before them, flat and in order.

    A row is copied into the next block only where that one's windows reach back to it, so the exchange carries each row
    little more than once instead of ``width`` times, and no task holds more than a block. The first block starts with zero rows.
    """
    back = width - 1
    row = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features])
    d = df.select(by, ts, row.alias("_x"), (F.row_number().over(R.series(by, ts)) - 1).cast("long").alias("_i"))
    own, last = F.floor(F.col("_i") / block), F.floor((F.col("_i") + back) / block)
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    d = d.withColumn("_n", size).withColumn("block", F.explode(F.sequence(own, F.least(last, F.floor((F.col("_n") - 1) / block)))))
    g = d.groupBy(by, "block").agg(F.sort_array(F.collect_list(F.struct("_i", ts, "_x"))).alias("_rows"))   # at most block + width - 1
    zero = F.array_repeat(F.lit(0.0).cast("float"), back * len(features))
    flat = F.flatten(F.transform("_rows", lambda r: r["_x"]))
    inside = F.filter("_rows", lambda r: r["_i"] >= F.col("block") * block)
    pad = F.when(F.col("block") * block < back, F.slice(zero, 1, ((F.lit(back) - F.col("block") * block) * len(features)).cast("int"))).otherwise(F.array().cast("array<float>"))
    return g.select(by, "block", F.transform(inside, lambda r: r[ts]).alias("dates"), F.concat(pad, flat).alias("values"))


def windows_of(blocks: DataFrame, features: int, width: int = 60, by: str = "scode", ts: str = "date") -> DataFrame:
    """(by, ts, window): the flat window of each row, cut out of its block where it is used."""
    d = blocks.select(by, "values", F.posexplode("dates").alias("_k", ts))
    return d.select(by, ts, F.slice("values", F.col("_k") * features + 1, width * features).alias("window"))


def time_decay_weight(df: DataFrame, rate: float = 0.9999, by: list[str] = (), ts: str = "date",
                      out: str = "weight") -> DataFrame:
    """rate ^ days before the newest date (of the fold)."""
    newest = df.groupBy(*by).agg(F.max(ts).alias("_newest"))
    d = df.join(F.broadcast(newest), list(by)) if by else df.join(F.broadcast(newest))   # a row per fold
    return d.withColumn(out, F.pow(F.lit(rate), F.datediff("_newest", ts).cast("double"))).drop("_newest")


# Fixed value: market value at which the size weight is one half
SIZE_CENTER = 30_000_000_000


def size_weight(log_market_cap: Column, domain: str) -> Column:
    """1 for the tactical domain; a logistic curve in log market value for the strategic one."""
    if domain.upper() == "TAC":
        return F.lit(1.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(math.log1p(SIZE_CENTER)) - log_market_cap))
