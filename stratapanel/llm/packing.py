"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token pieces of at most ``size``; only their lengths matter for packing, so the histogram of lengths
(at most ``size`` counts, whatever the corpus) is all that reaches the driver. The linear program has a variable for each
multiset of lengths that fits a sequence. Multiplicative weights solve it: lengths carry prices, a knapsack by dynamic
programming finds the best configurations at those prices, each length asks for its share of them, and lengths that got more
than their share become cheaper. Prices divided by the best configuration's are feasible in the dual, so each round gives a
lower bound on the number of sequences. Configurations of the mixture that are worth their price are taken as whole sequences,
the rest is priced anew, and what is left in the end is packed best-fit decreasing. The program is solved for every histogram;
its rest is priced anew only until the whole is within ``GAP`` of the bound. Pieces then learn their place by their rank within their length, computed in salted parts so that a length that most documents share
is not one task. A null text is one piece holding just the final id 0. Repeated and null ids keep their rows apart.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe
from .common import flushed, staged, task, texts

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
SALTS = 64
GAP = 0.001   # share over the lower bound at which a packing is good enough to stop


def pieces(batches, path: str, size: int):
    e = bpe.word_encoder(path)
    wide = e.dtype.itemsize == 4

    def rows():
        for doc_id, text in texts(batches, "doc_id"):
            ids = np.frombuffer(e.encode(text), e.dtype)
            ids = np.append(ids, np.zeros(1, e.dtype)) if wide else np.append(ids, np.zeros(1, e.dtype)).astype("<u4")
            for k, start in enumerate(range(0, len(ids), size)):
                part = ids[start:start + size]
                yield doc_id, k, start, len(part), zlib.crc32(part.tobytes())

    yield from flushed(rows(), PIECES)


def knapsack(size: int, lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray) -> Counter:
    """The configuration of greatest price that fits ``size``, using no length more often than it occurs.

    Copies of a length count as binary bundles. ``best[c]`` is the best price of capacity c."""
    best = np.zeros(size + 1)
    took: list[tuple[int, int, np.ndarray]] = []
    for n, price, count in zip(lengths.tolist(), prices.tolist(), counts.tolist()):
        left, bundle = min(count, size // n), 1
        while left > 0:
            b = min(bundle, left)
            with_it = best[:-b * n] + b * price if b * n <= size else None
            if with_it is not None:
                better = with_it > best[b * n:] + 1e-15
                if better.any():
                    flags = np.zeros(size + 1, bool)
                    flags[b * n:] = better
                    best = np.concatenate([best[:b * n], np.where(better, with_it, best[b * n:])])
                    took.append((n, b, flags))
            left -= b
            bundle *= 2
    config, c = Counter(), size
    for n, b, flags in reversed(took):
        if flags[c]:
            config[n] += b
            c -= n * b
    return config


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing over a histogram: each open sequence takes the longest piece that still fits. Equal sequences in a
    row are one entry, so the work follows the number of lengths, not of pieces."""
    order = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        order[n] = max(c, 0)
    out = []
    while order.any():
        room, config = size, Counter()
        while room > 0:
            fits = np.flatnonzero(order[:room + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = min(int(order[n]), room // n)
            config[n] += k
            order[n] -= k
            room -= k * n
        more = min(int(order[n] // c) for n, c in config.items())   # as often as it repeats
        for n, c in config.items():
            order[n] -= more * c
        out.append((config, 1 + more))
    return out


def worth(size: int, lengths: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """Best price of each capacity up to ``size``, any number of copies of each length (ascending)."""
    best = np.zeros(size + 1)
    for c in range(int(lengths[0]), size + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + prices[:k]).max())
    return best


def filled(best: np.ndarray, lengths: np.ndarray, prices: np.ndarray, lack: np.ndarray, first: int, room: int) -> dict[int, int]:
    """A configuration with length number ``first``: the best prices among lengths that still lack something; ties to the longer."""
    use = {first: 1}
    room -= int(lengths[first])
    while True:
        k = int(np.searchsorted(lengths, room, "right"))
        if not k:
            return use
        v = np.where(lack[:k] > 1e-9, best[room - lengths[:k]] + prices[:k], -1.0)
        j = int(k - 1 - np.argmax(v[::-1]))
        if v[j] < 0:
            return use
        use[j] = use.get(j, 0) + 1
        room -= int(lengths[j])


def weighed(size: int, lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, rounds: int, step: float = 0.5) -> tuple[np.ndarray, float, Counter]:
    """Multiplicative weights on the covering program: (log weights, lower bound, sequences of each configuration a round)."""
    mix: Counter = Counter()
    bound = float((counts * lengths).sum() / size)
    for _ in range(rounds):
        prices = lengths / size * np.exp(weights)
        best = worth(size, lengths, prices)
        prices, best = prices / best[size], best / best[size]
        bound = max(bound, float((counts * prices).sum()))
        got = np.zeros(len(lengths))
        for i in range(len(lengths) - 1, -1, -1):   # the longest ask first
            lack = counts[i] - got[i]
            if lack <= 1e-9 * counts[i]:
                continue
            use = filled(best, lengths, prices, counts - got, i, size)
            much = max(min((counts[j] - got[j]) / a for j, a in use.items()), lack / use[i] / 4)
            mix[tuple(sorted(use.items()))] += much / rounds
            for j, a in use.items():
                got[j] += a * much
        weights = np.clip(weights - step * (got / counts - 1), -2, 2)
    return weights, bound, mix


def rounded(histogram: dict[int, int], size: int, first: int = 60, later: int = 15, phases: int = 24) -> tuple[list[tuple[Counter, int]], float]:
    """(configurations with their times, lower bound): the program solved, whole sequences taken, the rest solved again until the
    sequences taken and the rest's best fit come within ``GAP`` of the bound; the phase with the fewest sequences counts."""
    lengths = np.array(sorted(histogram))
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    weights, slack, out, bound = np.zeros(len(lengths)), 0.002, Counter(), 0.0
    found, fewest = [], math.inf
    for phase in range(phases):
        at = np.flatnonzero(left)
        if not len(at) or slack > 0.1:
            break
        n, now = lengths[at], left[at].copy()
        weights[at], low, mix = weighed(size, n, now.astype(float), weights[at], later if phase else first)
        bound = bound if phase else low
        prices = n / size * np.exp(weights[at])
        prices /= worth(size, n, prices)[size]
        for config, much in sorted(mix.items(), key=lambda e: (-e[1], e[0])):
            if sum(a * prices[j] for j, a in config) >= 1 - slack:
                times = min(int(min(now[j] // a for j, a in config)), max(1, int(2 * much)))
                if times:
                    for j, a in config:
                        now[j] -= a * times
                    out[tuple((int(n[j]), a) for j, a in config)] += times
        if ((left[at] - now) * n).sum() < 0.15 * (left[at] * n).sum():   # little was worth its price: ask for less
            slack *= 1.7
        left[at] = now
        tail = best_fit({int(n): int(c) for n, c in zip(lengths, left)}, size)
        n_now = sum(out.values()) + made(tail)
        if n_now < fewest:
            found, fewest = repeated([(Counter(dict(c)), t) for c, t in out.items()] + tail), n_now
        if n_now <= math.ceil(bound * (1 + GAP) - 1e-9):
            break
    return found, bound


def repeated(configs: list[tuple[Counter, int]]) -> list[tuple[Counter, int]]:
    """Each configuration once, with all its times."""
    times: Counter = Counter()
    for config, k in configs:
        times[tuple(sorted(config.items()))] += k
    return [(Counter(dict(c)), k) for c, k in times.items()]


def covered(histogram: dict[int, int], size: int, rounds: int = 160, step: float = 0.5) -> list[tuple[Counter, int]]:
    """A whole solution by pricing with bounded copies: each round uses the best configuration several times at once. Better
    than ``rounded`` where no configuration fills a sequence and the program's prices settle slowly."""
    left = Counter({int(n): int(c) for n, c in histogram.items()})
    out: list[tuple[Counter, int]] = []
    lengths = np.array(sorted(left, reverse=True))
    counts = np.array([left[n] for n in lengths])
    where = {int(n): i for i, n in enumerate(lengths)}
    done, used = np.zeros(len(lengths)), Counter()
    kept: dict[frozenset, Counter] = {}
    for _ in range(rounds):
        # price of a piece: its weight falls with the share of its demand that is covered
        share = done / counts
        weights = np.exp(-(share - share.min()) / max(1e-9, step * max(share.mean(), 1e-9)))
        prices = lengths / size * (0.25 + weights)
        open_ = counts - done >= 1
        if not open_.any():
            break
        config = knapsack(size, lengths[open_], prices[open_], np.floor(counts - done)[open_].astype(np.int64))
        if not config:
            break
        at = np.array([where[n] for n in config])
        need = np.array([config[n] for n in config])
        room = ((counts[at] - done[at]) / need).min()
        whole = np.dot(counts - done, lengths) / size
        times = float(min(room, max(1.0, whole / 24)))
        times = max(1, int(times))
        done[at] += need * times
        key = frozenset(config.items())
        kept[key] = config
        used[key] += times
    for key, times in used.items():
        out.append((kept[key], times))
        for n, c in kept[key].items():
            left[n] -= c * times
    return repeated(out + best_fit(left, size))


def made(configs: list[tuple[Counter, int]]) -> int:
    return sum(k for _, k in configs)


def plan(histogram: dict[int, int], size: int) -> list[tuple[Counter, int]]:
    """Configurations with how many sequences each makes; together they hold every piece exactly once."""
    return bounded_plan(histogram, size)[0]


def bounded_plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[Counter, int]], float]:
    """(``plan``, lower bound on the sequences of any packing)."""
    left = {int(n): int(c) for n, c in histogram.items() if n != size and c}
    full = int(histogram.get(size, 0))
    whole = [(Counter({size: 1}), full)] if full else []
    if not left:
        return whole, float(full)
    found, bound = rounded(left, size)
    if made(found) > math.ceil(bound * 1.01):
        found = min(found, covered(left, size), key=made)
    return whole + found, full + bound


def placed(batches, slots):
    """Sequence and offset of pieces of (length, rank): ``slots[length]`` lists where ranks begin, the first sequence,
    copies in each sequence and the offset of the first copy."""
    schema = pa.schema(list(PIECES) + [pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
    for b in batches:
        length = b.column(b.schema.get_field_index("length")).to_numpy()
        rank = b.column(b.schema.get_field_index("__rank")).to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            begin, first, copies, offset = slots[int(n)]
            j = np.searchsorted(begin, rank[at], "right") - 1
            inside = rank[at] - begin[j]
            seq[at] = first[j] + inside // copies[j]
            off[at] = offset[j] + inside % copies[j] * n
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in PIECES] + [pa.array(seq), pa.array(off)], schema=schema)


def slots_of(configs: list[tuple[Counter, int]]) -> dict:
    found: dict[int, list] = {}
    first = 0
    for config, times in configs:
        offset = 0
        for n, c in sorted(config.items(), reverse=True):
            rows = found.setdefault(n, [])
            begin = rows[-1][4] if rows else 0
            rows.append((begin, first, c, offset, begin + c * times))
            offset += n * c
        first += times
    return {n: tuple(np.array(x, np.int64) for x in list(zip(*rows))[:4]) for n, rows in found.items()}


def pack(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    table = staged(docs.select("doc_id", "text").mapInArrow(task("packing", "pieces", path=path, size=size),
                   "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))
    parts = table.groupBy("length", salt.alias("__salt")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    histogram = {r["length"]: r["c"] for r in table.groupBy("length").agg(F.count("*").alias("c")).collect()}  # at most ``size`` rows
    slots = slots_of(plan(histogram, size))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (table.withColumn("__salt", salt).withColumn("__in", F.row_number().over(within) - 1)
              .join(parts, ["length", "__salt"]).withColumn("__rank", (F.col("__in") + F.col("__before")).cast("long")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(
        task("packing", "placed", slots=slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
