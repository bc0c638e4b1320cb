"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of each whole text make one small row (a written table); everything after works on those. A fixed random map
turns them into ``RANDOM`` cosines whose inner products approximate a Gaussian kernel. Each task adds up its rows' normal
equations, tasks' sums are added in groups, and the driver solves one system of fixed size. A fifth of the training rows is
kept from the fit: their raw scores, counted in bins of fixed number, are calibrated by pooling adjacent violators.

Null text is empty. Null labels are left out. Repeated labels count each. Without labels of both kinds the score is the
share of good labels, or 1 where there is none. Null or repeated ids keep their rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import flushed, staged, task, texts

KINDS, RANDOM, SEED, BINS, GROUPS = 24, 320, 20_011, 2000, 16
STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])
SUMS = pa.schema([("g", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("raw", pa.float64())])
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_={}[]\\/+", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text; all are 0 for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * KINDS
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.lower().split(), text.split(b"\n")
    w = len(words)
    p = h[h > 0] / n
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    filled = [x for x in lines if x.strip()]
    long_ = max(map(len, words), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    letters = int(h[_UPPER].sum() + h[_LOWER].sum())
    return [math.log1p(n), math.log1p(w), (n - h[32] - h[10]) / max(w, 1), math.log1p(long_),
            h[_UPPER].sum() / max(letters, 1), letters / n, h[_DIGIT].sum() / n, h[_SYMBOLS].sum() / n, h[33] / n, h[124] / n,
            h[_STOPS].sum() / n, h[46] / max(w, 1), h[10] / n, h[128:].sum() / n, h[32] / n, float(-(p * np.log2(p)).sum()),
            len(kinds) / max(w, 1), max(kinds.values(), default=0) / max(w, 1), same / max(w, 1), pairs / max(w - 1, 1),
            len(set(filled)) / max(len(filled), 1), math.log1p(n / len(lines)), sum(1 for x in kinds.values() if x == 1) / max(len(kinds), 1),
            math.sqrt(sum(c * c for c in kinds.values())) / max(w, 1)]


def measured(batches):
    yield from flushed(((i, statistics(t)) for i, t in texts(batches, "doc_id")), STATS)


def projected(x: np.ndarray, mean: list[float], spread: list[float], width: float) -> np.ndarray:
    """Standardised statistics, their random cosines and a constant."""
    z = np.clip((x - np.array(mean)) / np.array(spread), -8, 8)
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / (width * math.sqrt(z.shape[1])), (z.shape[1], RANDOM))
    b = rng.uniform(0, 2 * math.pi, RANDOM)
    return np.hstack([math.sqrt(2 / RANDOM) * np.cos(z @ w + b), 0.1 * z, np.ones((len(z), 1))])


def matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def normal(batches, mean, spread, width):
    """One row a task: the sums of its rows' normal equations."""
    total, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        z = projected(matrix(b.column("x")), mean, spread, width)
        y = b.column("quality").to_numpy(zero_copy_only=False).astype(np.float64)
        zy = np.hstack([z, y[:, None]])
        total = zy.T @ zy if total is None else total + zy.T @ zy
        n += len(y)
    if total is not None:
        from pyspark import TaskContext
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([n], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], schema=SUMS)


def added(batches):
    totals: dict[int, list] = {}
    for b in batches:
        for g, n, s in zip(*(c.to_pylist() for c in b.columns)):
            t = totals.setdefault(g, [0, 0.0])
            t[0] += n
            t[1] = t[1] + np.frombuffer(s)
    yield from flushed(((g, n, np.asarray(s).tobytes()) for g, (n, s) in sorted(totals.items())), SUMS)


def isotonic(rows: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
    """Pools adjacent violators over (bin, rows, good rows): bin centres of the blocks and their shares."""
    blocks: list[list[float]] = []
    for k, n, good in sorted(rows):
        blocks.append([k * n, n, good])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a)]
    return [b[0] / b[1] for b in blocks], [b[2] / b[1] for b in blocks]


def bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1)


def scores(x: np.ndarray, mean, spread, width, beta, steps) -> tuple[np.ndarray, np.ndarray]:
    """(score, raw score) of rows of statistics; ``steps`` is the calibration, or the share of good labels without a model."""
    if beta is None or not len(x):
        return np.full(len(x), steps if beta is None else 0.0), np.zeros(len(x))
    raw = projected(x, mean, spread, width) @ np.array(beta)
    return np.clip(np.interp(bins(raw), *steps) if steps else raw, 0, 1), raw


def scored(batches, **params):
    for b in batches:
        score, raw = scores(matrix(b.column("x")) if b.num_rows else np.zeros((0, KINDS)), **params)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(raw, pa.float64())], schema=OUT)


def fit(stats: DataFrame, labels: DataFrame, train: Column, width: float, ridge: float) -> dict:
    """What ``scored`` needs: from a table of statistics and labels (doc_id, quality) where ``train`` holds."""
    known = staged(stats.join(labels.where(train & F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id"), "labelled")
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0
    rows = known.where(~part)
    x = [F.col("x")[i].cast("double") for i in range(KINDS)]
    sums = rows.agg(F.count("*"), F.sum("quality"), *[F.sum(c) for c in x], *[F.sum(c * c) for c in x]).first()
    n, good = sums[0] or 0, sums[1] or 0
    if not n or not good or good == n:
        return {"mean": [0.0] * KINDS, "spread": [1.0] * KINDS, "width": width, "beta": None, "steps": float(good / n) if n else 1.0}
    mean = [sums[2 + i] / n for i in range(KINDS)]
    spread = [math.sqrt(max(0.0, sums[2 + KINDS + i] / n - m * m)) or 1.0 for i, m in enumerate(mean)]
    params = {"mean": mean, "spread": spread, "width": width}
    each = rows.select("x", "quality").mapInArrow(task("quality", "normal", **params), "g int, n long, sums binary")
    few = each.repartition(GROUPS, "g").mapInArrow(task("quality", "added"), "g int, n long, sums binary").collect()  # at most GROUPS
    size = RANDOM + KINDS + 1
    a = sum(np.frombuffer(r["sums"]) for r in sorted(few, key=lambda r: r["g"])).reshape(size + 1, size + 1)
    params["beta"] = np.linalg.solve(a[:-1, :-1] + ridge * n * np.eye(size), a[:-1, -1]).tolist()
    # the label stands in the place of the id
    raw = known.where(part).select(F.col("quality").cast("long").alias("doc_id"), "x").mapInArrow(
        task("quality", "scored", steps=None, **params), "doc_id long, score double, raw double")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + 0.5) / 2 * BINS)))
    counts = raw.groupBy(bin_.alias("k")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("good")).collect()  # at most BINS
    both = 0 < sum(r["good"] for r in counts) < sum(r["n"] for r in counts)  # else too few rows to calibrate: raw scores stand
    return params | {"steps": isotonic([(r["k"], r["n"], r["good"]) for r in counts]) if both else None}


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(task("quality", "measured"), "doc_id long, x array<float>")


def classify(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, width: float = 0.7, ridge: float = 1e-4) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``. Learns from rows of ``labels`` (doc_id, quality) where
    ``train`` holds on doc_id."""
    stats = staged(measure(docs), "stats")
    out = stats.mapInArrow(task("quality", "scored", **fit(stats, labels, train, width, ridge)), "doc_id long, score double, raw double")
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def passed(batches, **params):
    for b in batches:
        if b.num_rows:
            raw = np.array([statistics(t) for (t,) in texts(iter([b]))], np.float32)
            yield b.filter(pa.array(scores(raw.astype(np.float64), **params)[0] >= 0.5))


def keep(docs: DataFrame, labels: DataFrame, train: Column, width: float = 0.7, ridge: float = 1e-4) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least 0.5."""
    model = fit(staged(measure(docs), "stats"), labels, train, width, ridge)
    return docs.mapInArrow(task("quality", "passed", **model), docs.schema)
