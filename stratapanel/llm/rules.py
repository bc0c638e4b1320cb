"""Quality rules with robust multivariate outliers: minimum covariance determinant per language and source.

Counts of each whole text make one small row (a written table). Texts that pass the base rule give a vector of transformed
statistics. For each language and source the estimate looks for the ``share`` of rows whose covariance has the least
determinant: from two deterministic starts (medians and spreads; plain moments), concentration steps keep the rows nearest
to the present centre and estimate anew, over all rows, by plain aggregates. Distances are compared through a histogram of
fixed bins, so no group is gathered or sorted. The start with the smaller determinant wins; squared Mahalanobis distances
beyond ``cutoff`` are rejected.

Groups of fewer than ``least`` rows are estimated together per language, and what is left of those together; below that
nothing is rejected. Null language or source is a group of its own. Null text has no words and fails the base rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import flushed, staged, task, texts

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS), ("n_lines", pa.int64())])
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
NAMES = ["x0", "x1", "x2", "x3", "x4"]
FLOOR = [0.35, 0.08, 0.25, 0.12, 0.12]  # least spread of each statistic: below it differences say nothing about quality
BIN = 32                                # bins of a doubling of the squared distance


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    n = len(words)
    bare = text.translate(None, SPACE)
    chars = len(bare) if bare.isascii() else len(bare.decode())
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines, seen, dups = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        k = len(ids)
        windows = (a[:-2] * k + a[1:-1]) * k + a[2:] if k < 2_000_000 else np.unique(np.stack([a[:-2], a[1:-1], a[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.sort(windows)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.flatnonzero(np.isin(windows, twice))
            hit = np.zeros(n, bool)
            hit[at] = hit[at + 1] = hit[at + 2] = True
            repeat = int(hit.sum())
    return n, chars, symbols, dups, repeat, lines


def counted(batches):
    yield from flushed(((i, lang, source, *counts(t)) for i, lang, source, t in texts(batches, "doc_id", "lang", "source")), SCHEMA)


def estimate(frames, share: float):
    """Moments of kept rows -> centre, inverse covariance and log determinant, a row for each group and start."""
    d = len(NAMES)
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            n, s = r.n, np.array(r.sums)
            mean = s[:d] / n
            cov = np.zeros((d, d))
            cov[np.triu_indices(d)] = s[d:] / n
            cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
            cov = (cov + cov.T) / 2 / (share ** 0.7 if r.kept else 1.0)  # a core of the rows varies less than all of them
            values, vectors = np.linalg.eigh(cov / np.outer(FLOOR, FLOOR))
            values = np.maximum(values, 1.0)
            inverse = (vectors / values) @ vectors.T / np.outer(FLOOR, FLOOR)
            out.append((r.grp, r.start, mean.tolist(), inverse.ravel().tolist(), float(np.log(values).sum())))
        yield pd.DataFrame(out, columns=["grp", "start", "mean", "inverse", "logdet"])


MODEL = "grp string, start int, mean array<double>, inverse array<double>, logdet double"


def distance(p: str = ""):
    d = range(len(NAMES))
    diff = [F.col(p + x) - F.col(p + "mean")[i] for i, x in enumerate(NAMES)]
    return sum((F.col(p + "inverse")[i * len(NAMES) + j] * diff[i] * diff[j] for i in d for j in d), F.lit(0.0))


def moments(rows: DataFrame, kept: bool) -> DataFrame:
    d = range(len(NAMES))
    sums = [F.sum(x) for x in NAMES] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i in d for j in d if i <= j]
    return rows.groupBy("grp", "start").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).withColumn("kept", F.lit(kept))


def base(docs: DataFrame) -> DataFrame:
    """The counts of each row."""
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(
        task("rules", "counted"), f"doc_id long, lang string, source string, {', '.join(c + ' long' for c in COUNTS)}, n_lines long")


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 6) -> DataFrame:
    """The best estimate (grp, mean, inverse, logdet) of each group of ``rows`` (grp, x0 ...)."""
    def made(sums: DataFrame) -> DataFrame:
        return sums.mapInPandas(task("rules", "estimate", share=share), MODEL)

    middle = [F.percentile_approx(x, 0.5, 10_000).alias(f"m_{x}") for x in NAMES]
    centre = staged(rows.groupBy("grp").agg(*middle), "centres")   # written tables of a row a group: Spark knows their size
    apart = rows.join(centre, "grp").groupBy("grp").agg(*[F.first(f"m_{x}").alias(f"m_{x}") for x in NAMES],
                                                      *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 10_000).alias(f"s_{x}") for x in NAMES])
    zero = F.lit(0.0)
    spread = [F.greatest(F.lit(f), 1.4826 * F.col(f"s_{x}")) for f, x in zip(FLOOR, NAMES)]
    first = apart.select("grp", F.lit(0).alias("start"), F.array(*[F.col(f"m_{x}") for x in NAMES]).alias("mean"),
                         F.array(*[1 / (s * s) if i == j else zero for i, s in enumerate(spread) for j in range(len(NAMES))]).alias("inverse"), zero.alias("logdet"))
    model = staged(first.union(made(moments(rows.withColumn("start", F.lit(1)), False))), "mcd")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        near = both.join(model, ["grp", "start"]).withColumn("k", F.floor(BIN * F.log2(F.lit(1e-6) + distance())).cast("int"))
        bins = near.groupBy("grp", "start", "k").agg(F.count("*").alias("c"))
        w = Window.partitionBy("grp", "start")
        edge = (bins.withColumn("upto", F.sum("c").over(w.orderBy("k"))).withColumn("n", F.sum("c").over(w))
                .where(F.col("upto") >= share * F.col("n")).groupBy("grp", "start").agg(F.min("k").alias("edge")))
        edge = staged(edge, "edges")   # of known size too, so the rows of a common group are not dealt by it
        model = staged(made(moments(near.join(edge, ["grp", "start"]).where("k <= edge").select("grp", "start", *NAMES), True)), "mcd")
    return model.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("m")).select("grp", "m.*")


def vectors(table: DataFrame, p: str = "") -> DataFrame:
    """Adds the transformed statistics of the counts ``p``... and the name of the row's own group."""
    rate = lambda a, b: F.col(p + a) / F.greatest(F.col(p + b), F.lit(1))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))
    return table.withColumns({
        p + "x0": F.log(F.greatest(F.col(p + "n_words"), F.lit(1))), p + "x1": F.log(F.greatest(rate("word_chars", "n_words"), F.lit(0.5))),
        p + "x2": F.log1p(20 * rate("n_symbols", "n_words")), p + "x3": F.sqrt(rate("n_dup_lines", "n_lines")), p + "x4": F.sqrt(rate("n_repeat_words", "n_words")),
        p + "base_failed": F.expr(f"{p}n_words < 50 or 100 * {p}n_repeat_words > 50 * {p}n_words"), p + "g": F.concat_ws("/", name("lang"), name("source"))})


def models(table: DataFrame, share: float, least: int) -> DataFrame:
    """(g, mean, inverse) of each group of ``table``: its own estimate or that of the groups it is taken together with; a
    written table of one row a language and source, whose size Spark knows when it plans the join."""
    rows = table.where("not base_failed").withColumn("lang_", F.substring_index("g", "/", 1))
    own = rows.groupBy("g", "lang_").agg(F.count("*").alias("c0"))
    pooled = own.where(F.col("c0") < least).groupBy("lang_").agg(F.sum("c0").alias("c1"))
    groups = staged(own.join(pooled, "lang_", "left").select(
        "g", "c0", F.when(F.col("c0") >= least, F.col("g")).when(F.col("c1") >= least, F.concat("lang_", F.lit("/*"))).otherwise("*").alias("grp")), "groups")
    best = estimates(rows.join(groups, "g").select("grp", *NAMES), share)
    sizes = groups.groupBy("grp").agg(F.sum("c0").alias("n")).where(F.col("n") >= least)
    return staged(groups.join(best.join(sizes, "grp"), "grp").select("g", "mean", "inverse"), "models")


def judge(docs: DataFrame, cutoff: float = 60.0, share: float = 0.75, least: int = 60) -> DataFrame:
    """(doc_id, counts, base_failed, kept, distance) of each row of ``docs``."""
    table = staged(vectors(base(docs)), "counts")
    judged = table.join(models(table, share, least), "g", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")


def beside(batches):
    """Rows with all their columns and the counts behind them."""
    for b in batches:
        found = np.array([counts(t) for (t,) in texts(iter([b]))], np.int64).reshape(-1, len(COUNTS) + 1)
        schema = b.schema
        for c in [*COUNTS, "n_lines"]:
            schema = schema.append(pa.field("__rules_" + c, pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, k]) for k in range(found.shape[1]))], schema=schema)


def keep(docs: DataFrame, cutoff: float = 60.0, share: float = 0.75, least: int = 60) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    p = "__rules_"
    model = models(staged(vectors(base(docs)), "counts"), share, least).select(F.col("g").alias(p + "g"), F.col("mean").alias(p + "mean"), F.col("inverse").alias(p + "inverse"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(p + c, T.LongType()) for c in [*COUNTS, "n_lines"])])
    rows = vectors(docs.mapInArrow(task("rules", "beside"), schema), p)
    return rows.join(model, p + "g", "left").where(~F.col(p + "base_failed") & F.coalesce(distance(p) <= cutoff, F.lit(True))).select(*docs.columns)
