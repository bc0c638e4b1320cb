"""Metrics, score bins and equity curves.

Rank metrics use the split rank table, so a phase with all rows of a panel is
ranked by many tasks; there is no window over a whole phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div
from .groups import join_back
from .ranking import SPACING, average_ranks, order_statistics, rank_table

QUANTILES = [0.05, 0.1, 0.5, 0.9, 0.95]


def rmse(target: Column, score: Column) -> Column:
    return F.sqrt(F.avg(F.pow(target - score, 2)))


def rank_ic(df: DataFrame, target: str, score: str, by: list[str], spacing: int = SPACING) -> DataFrame:
    """Spearman correlation over all complete rows of each group."""
    d = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).select(*by, target, score)
    r = average_ranks(d, [target, score], by, spacing)
    return r.groupBy(*by).agg(F.corr(f"{target}__rank", f"{score}__rank").alias("ic"))


def auc(df: DataFrame, label: str, score: str, by: list[str], spacing: int = SPACING) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    t = rank_table(d, score, by, spacing, extra={"pos": F.sum((F.col(label) == 1).cast("long"))})
    g = t.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("ties").alias("_n"), F.sum(F.col("rank") * F.col("pos")).alias("_r"))
    p, n = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return g.select(*by, div(F.col("_r") - p * (p + 1) / F.lit(2.0), p * n).alias("auc"))


def fold_metrics(df: DataFrame, target: str, score: str, by: list[str] = ("fold", "phase"), label: str | None = None,
                 spacing: int = SPACING) -> DataFrame:
    """rmse, ic (and auc) per fold and phase.

    The score is ranked once: its table carries, per distinct score, the rows with a target, the sum of their target ranks,
    and the labelled and positive rows; ``ic`` (over rows with target and score) and ``auc`` (over rows with label and score)
    both follow from its running sums.
    """
    by = list(by)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = F.col(target).isNotNull() & F.col(score).isNotNull()
    known = F.col(label).isNotNull() & F.col(score).isNotNull() if label else F.lit(False)
    d = df.select(*by, F.when(both, F.col(target)).alias("_t"), F.col(target).alias("_y"), F.col(score).alias("_s"),
                  (F.when(known, F.col(label) == 1) if label else F.lit(None).cast("boolean")).alias("_l"))
    d = average_ranks(d, ["_t"], by, spacing)
    # squares of the target's ranks are summed per row, so no second table is needed
    r = F.col("_t__rank")
    extra = {"k": F.sum(F.when(r.isNotNull(), one).otherwise(zero)), "rt": F.sum(r), "rt2": F.sum(r * r),
             "l": F.sum(F.when(F.col("_l").isNotNull(), one).otherwise(zero)), "p": F.sum(F.when(F.col("_l"), one).otherwise(zero))}
    t = rank_table(d, "_s", by, spacing, extra, ["k", "l"])
    c = F.col
    rs, rl = c("below_k") + (c("k") + 1) / F.lit(2.0), c("below_l") + (c("l") + 1) / F.lit(2.0)
    g = t.groupBy(*by).agg(
        F.sum("k").alias("k"), F.sum("rt").alias("rt"), F.sum("rt2").alias("rt2"), F.sum(rs * c("k")).alias("rs"), F.sum(rs * rs * c("k")).alias("rs2"),
        F.sum(rs * c("rt")).alias("rst"), F.sum("p").alias("p"), F.sum("l").alias("l"), F.sum(rl * c("p")).alias("rl"))
    n, p, q = c("k").cast("double"), c("p").cast("double"), (c("l") - c("p")).cast("double")
    cov, vs, vt = c("rst") - c("rs") * c("rt") / n, c("rs2") - c("rs") * c("rs") / n, c("rt2") - c("rt") * c("rt") / n
    out = [F.when((n > 0) & (vs > 0) & (vt > 0), cov / F.sqrt(vs * vt)).alias("ic")]
    if label:
        out.append(div(c("rl") - p * (p + 1) / F.lit(2.0), p * q).alias("auc"))
    return join_back(df.groupBy(*by).agg(rmse(F.col(target), F.col(score)).alias("rmse")), g.select(*by, *out), by)


def mean_valid_metric(metrics: DataFrame, name: str, phase: str = "valid") -> DataFrame:
    """Mean of a metric over the folds that produced one; null if none did."""
    return metrics.where(F.col("phase") == phase).agg(F.avg(name).alias(f"mean_{name}"))


def quantile_bins(df: DataFrame, score: str, n: int = 10, out: str = "bin", spacing: int = SPACING) -> DataFrame:
    """Equal-count bins 1..n by exact linear quantiles: right-closed, lowest included, equal edges merged."""
    probs = [i / n for i in range(n + 1)]
    q = order_statistics(df, score, [], probs, spacing)
    edges = q.agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda s: s["q"])).alias("_edges"))
    d = df.join(F.broadcast(edges))   # one row with n + 1 edges
    below = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    return d.withColumn(out, F.when(F.col(score).isNotNull(), F.greatest(below, F.lit(1)))).drop("_edges")


def fixed_bins(df: DataFrame, score: str, n: int = 10, out: str = "bin") -> DataFrame:
    """Equal-width bins on [0, 1]: right-closed, 0 included; outside is null."""
    edges = F.array(*[F.lit(i / n) for i in range(n + 1)])
    below = F.size(F.filter(edges, lambda e: e < F.col(score)))
    inside = (F.col(score) >= 0.0) & (F.col(score) <= 1.0)
    return df.withColumn(out, F.when(inside, F.greatest(below, F.lit(1))))


def quantile_bin_labels(df: DataFrame, score: str, bin_col: str = "bin") -> DataFrame:
    """(bin, bin_label): smallest and largest score of the bin, four decimals."""
    return df.groupBy(bin_col).agg(F.format_string("%.4f - %.4f", F.min(score), F.max(score)).alias("bin_label"))


def fixed_bin_label(bin_col: Column, n: int = 10) -> Column:
    return F.format_string("%.1f - %.1f", (bin_col - 1) / F.lit(float(n)), bin_col / F.lit(float(n)))


def bin_stats(df: DataFrame, bin_col: str, target: str, columns: list[str] = (), spacing: int = SPACING) -> DataFrame:
    """Count, mean target, and mean / sample std / exact quantiles of extra columns, in bin order."""
    d = df.where(F.col(bin_col).isNotNull())
    aggs = [F.count(F.lit(1)).alias("sample_count"), F.avg(target).alias("target_mean")]
    aggs += [a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    out = d.groupBy(bin_col).agg(*aggs)
    if columns:
        long = d.select(bin_col, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([bin_col], list(columns), "_name", "_v")
        q = order_statistics(long, "_v", [bin_col, "_name"], QUANTILES, spacing)
        wide = q.groupBy(bin_col).agg(*[
            F.max(F.when((F.col("_name") == c) & (F.col("i") == i), F.col("q"))).alias(f"{c}_q{int(p * 100)}")
            for c in columns for i, p in enumerate(QUANTILES)])
        out = join_back(out, wide, [bin_col])
    return out.orderBy(bin_col)


def equity_curve(df: DataFrame, target: str, score: str, top_n: int = 50, date: str = "date", tie: str = "scode") -> DataFrame:
    """Mean target of the day's best scores and its cumulative product.

    ``row_number() <= n`` lets Spark keep n rows per day and task before the
    exchange (WindowGroupLimit), so a large day is not sorted by one task. The
    running product is over one row per day.
    """
    w = Window.partitionBy(date).orderBy(F.desc_nulls_last(score), tie)
    best = df.select(date, tie, score, target).where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n)
    daily = best.groupBy(date).agg(F.avg(target).alias("daily_return"))
    line = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.product(F.lit(1.0) + F.col("daily_return")).over(line))
