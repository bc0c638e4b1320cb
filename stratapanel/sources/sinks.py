"""Sinks: quarter-partitioned parquet datasets and CSV reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import checkpointed


def quarter_label(ts: str = "date"):
    return F.concat_ws("Q", F.year(ts), F.quarter(ts))


def write_panel(df: DataFrame, path: str, ts: str = "date", mode: str = "overwrite") -> None:
    """One dataset partitioned by quarter.

    ``rebalance`` lets AQE merge small and split oversized quarters, so neither
    many tiny files nor one huge writer task appears.
    """
    d = df.withColumn("quarter", quarter_label(ts)).hint("rebalance", "quarter")
    d.write.mode(mode).partitionBy("quarter").parquet(path)


def replace_quarters(df: DataFrame, path: str, ts: str = "date") -> None:
    """Writes only the quarters that ``df`` has; the dataset's other quarters keep their files."""
    d = df.withColumn("quarter", quarter_label(ts)).hint("rebalance", "quarter")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter").parquet(path)


def append_period(raw: DataFrame, raw_path: str, path: str, compute: Callable[[DataFrame], DataFrame], start: str, lookback_days: int,
                  ts: str = "date") -> None:
    """Adds rows from ``start`` on to a written raw dataset and to the one that ``compute`` derives from it.

    ``raw`` holds new rows only. What ``compute`` needs of the past is read from the written quarters of the last
    ``lookback_days`` (others are pruned); only quarters from the one of ``start`` on are written, with the rows of
    that quarter that were there before. Days that were written already from ``start`` on are replaced, so a run
    that broke off can be repeated.
    """
    spark = raw.sparkSession
    first = dt.date.fromisoformat(start)
    begin = dt.date(first.year, (first.month - 1) // 3 * 3 + 1, 1)   # the quarter is written whole
    since = begin - dt.timedelta(days=lookback_days)
    label = lambda day: f"{day.year}Q{(day.month + 2) // 3}"
    old = spark.read.parquet(raw_path).where((F.col("quarter") >= label(since)) & (F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(first))).drop("quarter")
    # a stage boundary: a dataset cannot be read while its quarters are replaced
    rows = checkpointed(old.unionByName(raw.where(F.col(ts) >= F.lit(first)).select(*old.columns)))
    replace_quarters(rows.where(F.col(ts) >= F.lit(begin)), raw_path, ts)
    replace_quarters(compute(rows).where(F.col(ts) >= F.lit(begin)), path, ts)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report as CSV with headers: one file where it is small, split by size where it is not."""
    df.hint("rebalance").write.mode(mode).csv(path, header=True)


def feature_names(df: DataFrame, not_features: list[str]) -> list[str]:
    """The dataset's schema is the feature list."""
    return [c for c in df.columns if c not in not_features]
