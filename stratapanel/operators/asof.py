"""Backward as-of join and calendar densification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import join_back


def latest_per_key(right: DataFrame, by: list[str], ts: str, values: list[str], tie: list[str]) -> DataFrame:
    """One right row per (by, ts): the last one in ``tie`` order (else of its values), combined map-side."""
    payload = F.struct(*values)
    best = F.max_by(payload, F.struct(*(tie or values)))
    return right.groupBy(*by, ts).agg(best.alias("_r"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
              values: list[str], tie: list[str] | None = None, left_unique: bool = False,
              right_unique: bool = False, keep_right_ts: str | None = None,
              block: str | None = None) -> DataFrame:
    """Each left row gets ``values`` of the latest right row with right_ts <= left_ts.

    Both sides are tagged, united and scanned once per key in time order; right
    rows come first on equal times, so exact matches count and nothing from the
    future is seen. Non-unique sides are first reduced to distinct (by, ts):
    a sector with a third of all panel rows then contributes one row per day,
    and the result is joined back on (by, ts). ``block`` (a ``date_trunc`` unit)
    also cuts long keys into time blocks: the scan runs per (key, block) and a
    small carry table hands the last value over to the next blocks.
    """
    payload = [*values, *([keep_right_ts] if keep_right_ts else [])]
    if keep_right_ts:
        right = right.withColumn(keep_right_ts, F.col(right_ts))
    if right_unique:
        r = right.select(*by, F.col(right_ts).alias("_ts"), F.struct(*payload).alias("_r"))
    else:
        r = latest_per_key(right, by, right_ts, payload, tie or []).withColumnRenamed(right_ts, "_ts")
    r = r.where(F.col("_ts").isNotNull()).withColumn("_side", F.lit(0))
    if left_unique:
        rest = [c for c in left.columns if c not in by and c != left_ts]
        lt = left.select(*by, F.col(left_ts).alias("_ts"), F.struct(left_ts, *rest).alias("_l"))
    else:
        rest = []
        lt = left.select(*by, F.col(left_ts).alias("_ts")).where(F.col("_ts").isNotNull()).distinct()
        lt = lt.withColumn("_l", F.struct(F.col("_ts").alias(left_ts)))
    lt = lt.withColumn("_side", F.lit(1))
    u = r.unionByName(lt, allowMissingColumns=True)

    if block is None:
        w = Window.partitionBy(*by).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
        hit = u.withColumn("_v", F.last("_r", ignorenulls=True).over(w))
    else:
        u = u.withColumn("_blk", F.date_trunc(block, F.col("_ts")))
        w = Window.partitionBy(*by, "_blk").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
        ends = u.groupBy(*by, "_blk").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_ts"))).alias("_end"))
        wk = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*by, "_blk", F.last("_end", ignorenulls=True).over(wk).alias("_carry"))
        hit = join_back(u.withColumn("_in", F.last("_r", ignorenulls=True).over(w)), carry, [*by, "_blk"])
        hit = hit.withColumn("_v", F.coalesce("_in", "_carry"))
    found = hit.where(F.col("_side") == 1).select(
        *by, "_l.*", *[F.col(f"_v.{c}").alias(c) for c in payload])
    if left_unique:
        return found.select(*left.columns, *payload)
    return join_back(left, found, [*by, left_ts])


def calendar(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Every calendar day start..end (both may be aggregates of ``df``)."""
    return df.agg(start.alias("_s"), end.alias("_e")).select(
        F.explode(F.sequence("_s", "_e", F.expr("interval 1 day"))).alias(ts))


def densify(events: DataFrame, ts: str, values: list[str], start: str, end: str | None = None,
            until: DataFrame | None = None) -> DataFrame:
    """Daily series from ``start`` on; each day carries the latest row published by then.

    It ends at ``end``, or at the last day of the events or of ``until`` (one date
    column, such as the bars'), so days after the last publication stay filled.
    One row per calendar day: the single ordered scan is bounded by the calendar.
    """
    lo = F.to_date(F.lit(start))
    hi = F.to_date(F.lit(end)) if end else F.greatest(F.max(ts), lo)
    span = events.select(ts) if until is None else events.select(ts).union(until)
    days = calendar(span, ts, lo, hi)
    return asof_join(days, events, [], ts, ts, values, right_unique=True, left_unique=True)


@dataclass
class Side:
    """One right-hand table of ``asof_joins``: unique per (by, ts)."""
    df: DataFrame
    ts: str
    values: list[str]
    keep_ts: str | None = None


def asof_joins(left: DataFrame, by: list[str], left_ts: str, sides: list[Side]) -> DataFrame:
    """Several backward as-of joins on the same key with one exchange and one scan.

    ``left`` must be unique per (by, left_ts). The result stays partitioned by
    ``by``, so per-key windows that follow need no further exchange.
    """
    rest = [c for c in left.columns if c not in by and c != left_ts]
    u = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(len(sides)).alias("_side"), F.struct(left_ts, *rest).alias("_l"))
    for i, s in enumerate(sides):
        cols = [F.col(v) for v in s.values] + ([F.col(s.ts).alias(s.keep_ts)] if s.keep_ts else [])
        r = s.df.where(F.col(s.ts).isNotNull()).select(
            *by, F.col(s.ts).alias("_ts"), F.lit(i).alias("_side"), F.struct(*cols).alias(f"_r{i}"))
        u = u.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.select(*by, "_side", "_l", *[F.last(f"_r{i}", ignorenulls=True).over(w).alias(f"_v{i}") for i in range(len(sides))])
    out = []
    for i, s in enumerate(sides):
        out += [F.col(f"_v{i}.{v}").alias(v) for v in [*s.values, *([s.keep_ts] if s.keep_ts else [])]]
    return u.where(F.col("_side") == len(sides)).select(*by, "_l.*", *out)
