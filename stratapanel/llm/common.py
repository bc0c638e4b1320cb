"""What the operators of this package share: staging in the shared folder, Arrow tasks, ids of folds, components."""

from __future__ import annotations

import ctypes
import gc
import importlib
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of its own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if folder:
            folder = folder.rstrip("/").rpartition("/")[0]
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir().rpartition("/")[0]
    return folder


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a stage boundary that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    out = df.write.mode("error")
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(schema).parquet(path)


_last: list[str] = []


def fresh(module: str) -> None:
    """Workers are used again by later stages: what another operator's module has cached is given back first."""
    if _last and _last[0] != module:
        for name, m in list(sys.modules.items()):
            if name.startswith("stratapanel.llm."):
                for f in list(vars(m).values()):
                    if hasattr(f, "cache_clear"):
                        f.cache_clear()
        trim()
    _last[:] = [module]


def trim() -> None:
    """Gives memory that is free inside the worker back to the machine: idle workers stay beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def task(module: str, function: str, **params) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that finds its code by name, so caches of a module live as long as the worker."""
    root = ROOT

    def run(batches):
        if root not in sys.path:
            sys.path.append(root)
        common = importlib.import_module("stratapanel.llm.common")
        common.fresh(module)
        yield from getattr(importlib.import_module(f"stratapanel.llm.{module}"), function)(batches, **params)
        common.trim()

    return run


def fold(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def flushed(rows: Iterable[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of bounded length."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield batch(kept, schema)
            kept = []
    if kept:
        yield batch(kept, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def texts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(columns ..., text as UTF-8 bytes) of each row, null text as empty bytes."""
    for b in batches:
        kept = [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]
        text = b.column(b.schema.get_field_index("text"))
        text = text.cast(pa.large_binary()) if pa.types.is_large_string(text.type) else text.cast(pa.binary())
        for *row, t in zip(*kept, text):
            yield (*row, t.as_py() or b"")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), the smallest node of each.

    Large-star and small-star rounds on written tables until the edges no longer change; every round moves at most
    the edges once per direction, stars are joined back by an aggregate, so no neighbourhood is gathered in a task.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a is not null and b is not null and a <> b")
                 .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # large star: each node hangs its larger neighbours on its smallest one
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node hangs itself and its smaller neighbours on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = staged(small, name)
        sums = [t.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for t in (now, after)]
        now = after
        if sums[0] == sums[1]:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
