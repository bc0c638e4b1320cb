"""Where tables come from: parquet folders or a JDBC database.

A ``Reader`` is any callable ``name -> DataFrame``; every loader function takes
one, so the same plan runs on files, a warehouse or a database.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[str], DataFrame]


def parquet_reader(spark: SparkSession, root: str) -> Reader:
    return lambda name: spark.read.parquet(f"{root}/{name}.parquet")


def dataset_reader(spark: SparkSession, root: str) -> Reader:
    """Partitioned dataset folders (the output of the sinks)."""
    return lambda name: spark.read.parquet(f"{root}/{name}")


def month_predicates(column: str, first: str, last: str) -> list[str]:
    """One half-open predicate per calendar month, for parallel JDBC reads.

    The ends are open, so rows before ``first`` or after ``last`` still fall in
    exactly one partition; null keys get a partition of their own.
    """
    y, m = int(first[:4]), int(first[5:7])
    ends = []
    while f"{y:04d}-{m:02d}" <= last[:7]:
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        ends.append(f"{y:04d}-{m:02d}-01")
    cuts = [f"{first[:7]}-01", *ends]
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < '{cuts[0]}'", *inner, f"{column} >= '{cuts[-1]}'", f"{column} IS NULL"]


def jdbc_reader(spark: SparkSession, url: str, properties: dict[str, str],
                predicates: dict[str, list[str]] | None = None, schema: str = "") -> Reader:
    """Database tables; tables with predicates are read by one task per predicate."""
    def read(name: str) -> DataFrame:
        table = f"{schema}.{name}" if schema else name
        parts = (predicates or {}).get(name)
        if parts:
            return spark.read.jdbc(url, table, predicates=parts, properties=properties)
        return spark.read.jdbc(url, table, properties=properties)
    return read


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], types: str = "", mode: str = "overwrite") -> None:
    """Table of a database; ``types`` names column types of the database where its own choice does not suit (key columns)."""
    out = df.write.mode(mode)
    if types:
        out = out.option("createTableColumnTypes", types)
    out.jdbc(url, table, properties=properties)
