"""Sample thinning: keep a row when enough days passed since the last kept row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import join_back


def kept_dates(df: DataFrame, days: int, by: str = "scode", ts: str = "date") -> DataFrame:
    """(by, ts) pairs that survive greedy thinning.

    Whether a day is kept depends on earlier decisions, so each key's distinct
    days (bounded by the calendar) are folded in order on the JVM.
    """
    pairs = df.select(by, F.col(ts).cast("date").alias(ts)).where(F.col(ts).isNotNull()).distinct()
    if days <= 1:
        return pairs

    def step(s, d):
        keep = s["last"].isNull() | (F.datediff(d, s["last"]) >= days)
        return F.when(keep, F.struct(d.alias("last"), F.concat(s["kept"], F.array(d)).alias("kept"))).otherwise(s)

    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept"))
    g = pairs.groupBy(by).agg(F.sort_array(F.collect_list(ts)).alias("_days"))
    return g.select(by, F.explode(F.aggregate("_days", start, step, lambda s: s["kept"])).alias(ts))


def thin_by_interval(df: DataFrame, days: int, by: str = "scode", ts: str = "date") -> DataFrame:
    """Rows of ``df`` on kept days; interval <= 1 keeps everything."""
    if days <= 1:
        return df
    return join_back(df, kept_dates(df, days, by, ts), [by, ts], "left_semi")
