"""Group statistics next to their rows, for groups of any size.

Statistics come from a partially combined aggregate joined back: it has one row
per group, which AQE broadcasts or splits against, so no task ever holds a group.
Where groups are few by nature (days, or days and sectors: never more than the
calendar holds), their table is broadcast outright, so wide rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_back(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left", few: bool = False) -> DataFrame:
    """Null-safe equi join on ``keys`` keeping the left columns once; ``few``: ``other`` is bounded by the calendar and is broadcast."""
    o = other.select(*[F.col(k).alias(f"_jk_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_jk_{k}"))
        cond = c if cond is None else cond & c
    if cond is None:
        raise ValueError("keys must not be empty")
    return df.join(F.broadcast(o) if few else o, cond, how).drop(*[f"_jk_{k}" for k in keys])


def with_group_aggs(df: DataFrame, keys: list[str], aggs: dict[str, Column], source: DataFrame | None = None,
                    few: bool = False) -> DataFrame:
    """Add one column per aggregate of the row's group.

    ``source`` gives the rows to aggregate where an earlier, shorter plan has them too: a
    chain of joins back to its own start would double the plan at each link.
    """
    stats = (df if source is None else source).groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return join_back(df, stats, keys, few=few)
