"""Approximate nearest neighbours by a hash-prefix forest.

Vectors get one more component so that the largest inner product is the smallest angle. A tree's hash string is a chain of
symbols, each the nearest signed axis after a random rotation; the strings of a tree, sorted, are its array. Where more rows than
two windows share a string (a dense cluster), the string goes on: with symbols of what is left of the rows when their mean is
taken away, as that alone decides there, and of the query itself, which asks with its row's own string besides. Runs of equal strings are read whole. Arrays are cut into blocks at quantiles; a query goes to the block of its string and both beside it. In a block it descends to its longest
prefix matches by binary search and takes a window of neighbours around them, each with the length of the common prefix. Then
all trees ascend together: candidates of the longest prefixes first, a whole length at a time, until the budget is reached.
Rows of an array carry the vector in one byte a component, which ranks candidates; the best go to exact scoring.

The window is ``reach * sqrt(n)`` rows a tree, so the work for a query grows with the root of the rows. Equal vectors are
indexed once and stand for all their rows. Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id; shorter vectors count as filled up with zeros. Ties go to the smaller id. With fewer candidates
than ``k`` all are returned.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import flushed, staged, task

BASE, MORE, AXES, SEED, SALTS, BLOCK, SHORT = 4, 5, 64, 77_003, 32, 25_000, 64
SYMBOLS = BASE + MORE     # 63 bits
LOW = (1 << 7 * MORE) - 1
HELD = 50_000             # sums of runs that a task holds before it passes them on
INDEX = pa.schema([("tree", pa.int32()), ("hash", pa.int64()), ("rep", pa.int64()), ("code", pa.binary()), ("scale", pa.float64())])
FOUND = pa.schema([("query", pa.int64()), ("rep", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int32())), ("near", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))])
SUMS = pa.schema([("tree", pa.int32()), ("hash", pa.int64()), ("n", pa.int64()), ("square", pa.float64()), ("sums", pa.list_(pa.float64()))])
PAIRS = pa.schema([("query", pa.int64()), ("rep", pa.int64())])
SCORED = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


@lru_cache(maxsize=2)
def rotations(trees: int, dim: int) -> np.ndarray:
    """Orthonormal columns for each tree and symbol, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :AXES] for _ in range(trees * SYMBOLS)])


def symbol(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    y = x @ rotation
    a = np.abs(y).argmax(1)
    return 2 * a + (y[np.arange(len(y)), a] > 0)


def strings(x: np.ndarray, trees: int) -> np.ndarray:
    """The first ``BASE`` symbols of rows, a column for each tree: symbols of 7 bits, the first highest."""
    rot = rotations(trees, x.shape[1])
    out = np.zeros((len(x), trees), np.int64)
    for t in range(trees):
        for s in range(BASE):
            out[:, t] = out[:, t] << 7 | symbol(x, rot[t * SYMBOLS + s])
    return out


def summed(batches, dim: int):
    """Sums of the rows of each long run, over (tree, hash, code, scale) rows."""
    kept: dict[tuple, list] = {}

    def out():
        for (t, h), (n, square, sums) in kept.items():
            yield t, h, n, square, sums.tolist()

    for b in batches:
        if not b.num_rows:
            continue
        tree, hash_ = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("tree", "hash"))
        x = decoded(b, dim)
        order = np.lexsort((hash_, tree))
        cuts = np.r_[0, np.flatnonzero((np.diff(tree[order]) != 0) | (np.diff(hash_[order]) != 0)) + 1, len(order)]
        for i, j in zip(cuts, cuts[1:]):
            part = x[order[i:j]]
            k = kept.setdefault((int(tree[order[i]]), int(hash_[order[i]])), [0, 0.0, 0.0])
            k[0], k[1], k[2] = k[0] + j - i, k[1] + float((part * part).sum()), k[2] + part.sum(0)
        if len(kept) >= HELD:
            yield from flushed(out(), SUMS)
            kept = {}
    yield from flushed(out(), SUMS)


def decoded(b: pa.RecordBatch, dim: int) -> np.ndarray:
    code = np.frombuffer(b"".join(b.column(b.schema.get_field_index("code")).to_pylist()), np.int8).reshape(b.num_rows, dim)
    return code * b.column(b.schema.get_field_index("scale")).to_numpy()[:, None]


def extended(batches, dim: int, trees: int, queries: bool):
    """Strings with the symbols that go on in long runs (rows with a ``center``), zeros elsewhere."""
    rot = rotations(trees, dim + 1)
    for b in batches:
        tree, hash_ = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("tree", "hash"))
        center = b.column(b.schema.get_field_index("center"))
        more = np.zeros(b.num_rows, np.int64)
        at = np.flatnonzero(~np.asarray(center.is_null())) if b.num_rows else []
        if len(at):
            part = b.take(pa.array(at))
            x = decoded(part, dim)
            lack = np.zeros(len(x))
            if not queries:
                x = x - np.asarray(part.column(part.schema.get_field_index("center")).flatten(), np.float64).reshape(len(x), dim)
                spread = part.column(part.schema.get_field_index("spread")).to_numpy()
                lack = np.sqrt(np.maximum(0, 1.5 * spread - (x * x).sum(1)))
            x = np.hstack([x, lack[:, None]])
            for t in np.unique(tree[at]):
                rows = np.flatnonzero(tree[at] == t)
                for s in range(MORE):
                    more[at[rows]] = more[at[rows]] << 7 | symbol(x[rows], rot[t * SYMBOLS + BASE + s])
        columns = [pa.array(hash_ << 7 * MORE | more) if f.name == "hash" else b.column(b.schema.get_field_index(f.name)) for f in INDEX]
        yield pa.RecordBatch.from_arrays(columns, schema=INDEX)


def vectors(column, dim: int) -> np.ndarray:
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    at = np.r_[0, np.cumsum(lengths)]
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at[i]:at[i + 1]]
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def indexed(batches, dim: int, trees: int, most: float, queries: bool):
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            x = vectors(part.column("embedding"), dim)
            # a row gets one more component, what its norm lacks to the longest; a query gets 0 there, and asks with its
            # row's own string too, which leads into the run of its own cluster
            lack = np.sqrt(np.maximum(0, most - (x * x).sum(1)))
            own = strings(np.hstack([x, lack[:, None]]), trees)
            both = [strings(np.hstack([x, np.zeros((len(x), 1))]), trees), own] if queries else [own]
            code, scale = coded(x)
            codes, rep = pa.array([c.tobytes() for c in code], pa.binary()), part.column("rep").cast(pa.int64())
            for t in range(trees):
                for k, h in enumerate(both):
                    new = np.flatnonzero(h[:, t] != both[0][:, t]) if k else np.arange(len(x))
                    at = pa.array(new)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), t, np.int32)), pa.array(h[new, t]), rep.take(at), codes.take(at), pa.array(scale[new])], schema=INDEX)


def descended(batches, window: int, dim: int):
    """Rows come by (tree, block), index rows and queries; gives the candidates of each query in each block."""
    def close(rows):
        index, asked = rows[0], rows[1]
        if not index or not asked:
            return
        h = np.array([r[0] for r in index], np.int64)
        order = np.argsort(h, kind="stable")
        h, rep = h[order], np.array([r[1] for r in index], np.int64)[order]
        code = np.frombuffer(b"".join(r[2] for r in index), np.int8).reshape(len(index), dim)[order].astype(np.float32)
        scale = np.array([r[3] for r in index])[order]
        out = []
        for hq, q, cq, sq in asked:
            lo = int(np.searchsorted(h, hq))
            hi = int(np.searchsorted(h, hq, "right"))
            wide = window * 2 if hq & LOW else window   # inside a long run
            a, b = max(0, lo - wide), min(len(h), hi + wide)
            apart = np.frexp((h[a:b] ^ hq).astype(np.float64))[1]
            prefix = SYMBOLS - -(-apart // 7)
            near = code[a:b] @ np.frombuffer(cq, np.int8).astype(np.float32) * scale[a:b] * sq
            top = np.lexsort((-near, -prefix))  # the best of each prefix length
            level = prefix[top]
            start = np.searchsorted(-level, -level)
            top = top[np.arange(len(top)) - start < SHORT]
            out.append((q, rep[a:b][top], prefix[top].astype(np.int32), near[top], np.bincount(prefix, minlength=SYMBOLS + 1)))
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)

    now, rows = None, ([], [])
    for b in batches:
        for tree, block, asks, *r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("tree", "block", "asks", "hash", "rep", "code", "scale"))):
            if (tree, block) != now:
                yield from close(rows)
                now, rows = (tree, block), ([], [])
            rows[asks].append(r)
    yield from close(rows)


def ascended(batches, budget: int):
    """Rows come by query: all trees ascend together, then the best by code are kept for exact scoring."""
    def close(query, rows):
        counts = np.sum([r[3] for r in rows], 0)
        level = SYMBOLS
        while level > 0 and counts[level:].sum() < budget:
            level -= 1
        rep, prefix, near = (np.concatenate([np.asarray(r[k]) for r in rows]) for k in range(3))
        keep = prefix >= level
        rep, near = rep[keep], near[keep]
        rep, first = np.unique(rep, return_index=True)
        near = near[first]
        best = rep[np.lexsort((rep, -near))[:SHORT]]
        best = np.union1d(best, [query])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query, np.int64)), pa.array(best)], schema=PAIRS)

    now, rows = None, []
    for b in batches:
        for q, *r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and q != now:
                yield close(now, rows)
                rows = []
            now = q
            rows.append(r)
    if rows:
        yield close(now, rows)


def scored(batches, dim: int):
    for b in batches:
        s = np.einsum("ij,ij->i", vectors(b.column("q"), dim), vectors(b.column("x"), dim)) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("rep"), pa.array(s, pa.float64())], schema=SCORED)


def long_runs(index: DataFrame, most: int, dim: int) -> DataFrame:
    """(tree, hash, center, spread) of strings that more than ``most`` rows share: their mean and mean squared distance from it."""
    runs = staged(index.groupBy("tree", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("tree", "hash"), "runs")
    parts = index.join(runs, ["tree", "hash"]).select("tree", "hash", "code", "scale").mapInArrow(
        task("ann", "summed", dim=dim), "tree int, hash long, n long, square double, sums array<double>")
    total = parts.groupBy("tree", "hash").agg(F.sum("n").alias("n"), F.sum("square").alias("square"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    center = F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)])
    out = total.select("tree", "hash", center.alias("center"), (F.col("square") / F.col("n")).alias("spread"))
    return staged(out.withColumn("spread", F.greatest(F.lit(0.0), F.col("spread") - F.aggregate("center", F.lit(0.0), lambda a, x: a + x * x))), "centers")


def search(table: DataFrame, asks: Column, k: int = 20, trees: int = 64, reach: float = 0.57) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``table`` (vec_id, embedding) where ``asks``
    holds, over all other rows."""
    spark = table.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", asks.alias("asks")).where(F.col("vec_id").isNotNull() & fine)
    reps = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max("asks").alias("asked"))
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    reps = staged(reps.withColumn("square", size), "vectors")
    members = rows.join(reps.select("embedding", "rep"), "embedding").select("rep", "vec_id", "asks").distinct()
    members = staged(members, "members")
    stats = reps.agg(F.count("*"), F.max("square"), F.max(F.size("embedding"))).first()
    if not stats[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count, most, dim = stats[0], stats[1], stats[2]
    window = max(64, math.ceil(reach * math.sqrt(count)))
    code = "tree int, hash long, rep long, code binary, scale double"
    first = {q: rows.select("rep", "embedding").repartition(n).mapInArrow(task("ann", "indexed", dim=dim, trees=trees, most=most, queries=q), code)
             for q, rows in ((False, reps), (True, reps.where("asked")))}
    first[False] = staged(first[False], "strings")
    centers = long_runs(first[False], 2 * window, dim)
    index, asked = (first[q].join(centers, ["tree", "hash"], "left").mapInArrow(task("ann", "extended", dim=dim, trees=trees, queries=q), code) for q in (False, True))
    index = staged(index, "index")
    blocks = max(1, count // BLOCK)
    edges = (index.groupBy("tree").agg(F.percentile_approx("hash", [(i + 1) / blocks for i in range(blocks - 1)], 20 * blocks).alias("edges"))
             if blocks > 1 else index.select("tree").distinct().withColumn("edges", F.array().cast("array<long>")))
    # found in two steps, so a row meets 2 * sqrt(blocks) edges
    stride = max(1, math.isqrt(blocks))
    edges = edges.withColumn("coarse", F.filter("edges", lambda e, i: i % stride == stride - 1))
    skipped = F.size(F.filter("coarse", lambda e: e < F.col("hash"))) * stride
    place = skipped + F.size(F.filter(F.slice("edges", skipped + 1, stride), lambda e: e < F.col("hash")))
    index = index.join(F.broadcast(edges), "tree").select("*", place.alias("block"), F.lit(0).alias("asks")).drop("coarse")  # trees * blocks edges
    asked = asked.join(F.broadcast(edges), "tree").withColumn("place", place)
    asked = asked.select("*", F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("block"), F.lit(1).alias("asks"))
    both = index.drop("edges").union(asked.drop("edges").select(*index.drop("edges").columns))
    found = both.repartition(max(n, min(trees * blocks, 4 * n)), "tree", "block").sortWithinPartitions("tree", "block").mapInArrow(
        task("ann", "descended", window=window, dim=dim), "query long, rep array<long>, prefix array<int>, near array<double>, counts array<long>")
    pairs = found.repartition(n, "query").sortWithinPartitions("query").mapInArrow(task("ann", "ascended", budget=4 * trees * window), "query long, rep long")
    scores = (pairs.join(reps.select("rep", F.col("embedding").alias("x")), "rep")
              .join(reps.select(F.col("rep").alias("query"), F.col("embedding").alias("q")), "query")
              .select("query", "rep", "q", "x").mapInArrow(task("ann", "scored", dim=dim), "query long, rep long, score double"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    scores = scores.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    # of equal vectors the k + 1 smallest ids can be wanted: found in salted parts, then overall
    salted = Window.partitionBy("rep", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    few = members.select("rep", "vec_id").distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (scores.join(few.select("rep", "vec_id"), "rep").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list")))  # at most k + 1
    own = members.where("asks").select(F.col("rep").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    kept = F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (own.join(lists, "query").select("query_id", F.posexplode(kept).alias("rank", "e"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"))
