"""What filters remove in every order: a counting-Bloom prepass for repeats, then additive counts of failure masks.

Each text becomes one narrow row: its part, a mask of the conditions that it fails by itself, and a 128-bit hash. Hashes are
dealt to segments, each a counting Bloom sketch of fixed size; tasks add up the counters of their rows and the sketches of a
segment are merged. A text of which some counter stands at one is unique for certain. Only the others send their text through
an exchange, where the smallest id of each full text is found; every row of such a text but the one with that id repeats.
Masks are then counted per part, and all orders follow from the 32 counts of a part.

Conditions: A under ``least_words`` words; B 100 * distinct words < ``distinct`` * words; C 100 * ``[A-Z]`` > ``upper`` * code
points; D any of ``[#$%&*|]``; E the text equals that of a smaller id. Null text is empty, null source the empty string. A row
of null id repeats nothing, nothing repeats it, and it has no labels. Rows of one id and one text do not repeat each other.
Labels that occur several times for an id count as 1 if any is 1. Whole texts of any length are judged. Columns other than
``doc_id``, ``text`` and ``source`` are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import importlib
import math
import sys
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROOT, flushed, staged, task, texts

FILTERS = "ABCDE"
COUNTERS = 1 << 20        # of a segment, one byte each while they are merged, one bit afterwards
HASHES = 3
ROWS = COUNTERS // 8      # rows a segment is made for
HELD = 4_000_000          # counters that a task holds before it passes them on
BROADCAST = 64 << 20      # most bytes of merged sketches that are broadcast
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(128, 192))   # all bytes of a character but its first
_SIGNS = b"#$%&*|"
FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
SKETCH = pa.schema([("seg", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
BITS = pa.schema([("seg", pa.int64()), ("bits", pa.binary())])
REPEAT = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("text", pa.binary())])


def failures(text: bytes, least_words: int, distinct: int, upper: int) -> int:
    """Mask of A to D of a whole text."""
    words = text.split()
    n = len(words)
    mask = 1 if n < least_words else 0
    if 100 * len(set(words)) < distinct * n:
        mask |= 2
    if 100 * (len(text) - len(text.translate(None, _UPPER))) > upper * len(text.translate(None, _INNER)):
        mask |= 4
    if len(text.translate(None, _SIGNS)) < len(text):
        mask |= 8
    return mask


def digest(text: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def flagged(batches, least_words, distinct, upper):
    yield from flushed(((i, s or "", failures(t, least_words, distinct, upper), *digest(t)) for i, s, t in texts(batches, "doc_id", "source")), FLAGS)


def places(a: np.ndarray, b: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash and its ``HASHES`` counters there."""
    v = b.astype(np.uint64)
    step = (v >> np.uint64(20)) | np.uint64(1)
    at = np.stack([(v + np.uint64(k) * step) % np.uint64(COUNTERS) for k in range(HASHES)], 1)
    return np.mod(a, segments), at.astype(np.uint32)


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def partial(batches, segments):
    """Counters of a task's rows: places of each segment, each once, with counts of at most 255."""
    held, size = [], 0

    def out():
        seg, at = (np.concatenate(x) for x in zip(*held))
        key, count = np.unique(np.repeat(seg, HASHES) * COUNTERS + at.ravel(), return_counts=True)
        count = np.minimum(count, 255).astype(np.uint8)
        seg = key // COUNTERS
        cuts = np.flatnonzero(np.diff(seg)) + 1
        for s, p, c in zip(seg[np.concatenate([[0], cuts])], np.split((key % COUNTERS).astype(np.uint32), cuts), np.split(count, cuts)):
            yield int(s), p.tobytes(), c.tobytes()

    for batch in batches:
        if batch.num_rows:
            held.append(places(*numbers(batch, "a", "b"), segments))
            size += batch.num_rows * HASHES
        if size >= HELD:
            yield from flushed(out(), SKETCH, 64)
            held, size = [], 0
    if held:
        yield from flushed(out(), SKETCH, 64)


def merged(batches):
    """Sums of the counters of each segment, rows sorted by segment; one bit a counter: whether it is above one."""
    def out():
        now, sums = None, None
        for batch in batches:
            for seg, p, c in zip(*batch.columns):   # one piece at a time
                if seg.as_py() != now:
                    if now is not None:
                        yield now, np.packbits(sums > 1).tobytes()
                    now, sums = seg.as_py(), np.zeros(COUNTERS, np.uint16)
                at = np.frombuffer(p.as_py(), np.uint32)
                sums[at] = np.minimum(sums[at] + np.frombuffer(c.as_py(), np.uint8), 255)
        if now is not None:
            yield now, np.packbits(sums > 1).tobytes()
    yield from flushed(out(), BITS, 16)


def again(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all counters of each row are above one; ``bits`` starts at the row's segment."""
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def possible(batches, segments, sketch):
    """Rows (doc_id, a, b, ...) with a flag; ``sketch`` is the broadcast of all segments, one after the other."""
    bits = np.frombuffer(sketch.value, np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        seg, at = places(*numbers(batch, "a", "b"), segments)
        flag = again(bits, at + (seg * COUNTERS)[:, None]) & (~np.asarray(batch.column("doc_id").is_null()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flag)], names=[*batch.schema.names, "again"])


def sent(batches, segments, sketch):
    """Texts that may occur twice, with id and hash."""
    bits = np.frombuffer(sketch.value, np.uint8)

    def out():
        for i, t in texts(batches, "doc_id"):
            if i is not None:
                a, b = digest(t)
                seg, at = places(np.array([a]), np.array([b]), segments)
                if again(bits, at + (seg * COUNTERS)[:, None])[0]:
                    yield i, a, b, t
    yield from flushed(out(), REPEAT, 200)


def found(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of some hashes of a segment those that its bits allow to repeat."""
    t = left.select(["a", "b"])
    if not t.num_rows or not right.num_rows:
        return t.slice(0, 0)
    _, at = places(t.column("a").to_numpy(), t.column("b").to_numpy(), 1)
    return t.filter(pa.array(again(np.frombuffer(right.column("bits")[0].as_py(), np.uint8), at)))


def repeats(docs: DataFrame, rows: DataFrame, broadcast: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``again``, texts that may repeat as (doc_id, a, b, text)); ``rows`` is the table of ``flagged``.

    Merged sketches of up to ``broadcast`` bytes go to all tasks, so unique texts stay where they are. Larger ones meet the hashes
    segment by segment, and texts are chosen by a join on the hash of those that may repeat.
    """
    spark = docs.sparkSession
    segments = max(1, math.ceil(rows.count() / ROWS))
    sums = rows.select("a", "b").mapInArrow(task("filter_audit", "partial", segments=segments), "seg long, places binary, counts binary")
    bits = sums.repartition("seg").sortWithinPartitions("seg").mapInArrow(task("filter_audit", "merged"), "seg long, bits binary")
    if segments * (COUNTERS // 8) <= broadcast:
        kept = {r.seg: r.bits for r in bits.toLocalIterator()}
        sketch = spark.sparkContext.broadcast(b"".join(kept.get(s, bytes(COUNTERS // 8)) for s in range(segments)))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        flags = rows.mapInArrow(task("filter_audit", "possible", segments=segments, sketch=sketch), schema + ", again boolean")
        texts_ = docs.select("doc_id", "text").mapInArrow(task("filter_audit", "sent", segments=segments, sketch=sketch), "doc_id long, a long, b long, text binary")
        return flags, texts_
    hashes = rows.select("a", "b").distinct().withColumn("seg", F.pmod(F.col("a"), F.lit(segments)))
    split = F.pmod(F.col("b"), F.lit(16))   # a segment's hashes meet copies of its bits in tasks of bounded size
    copies = bits.select("seg", "bits", F.explode(F.expr("sequence(0L, 15L)")).alias("split"))
    hit = hashes.withColumn("split", split).groupBy("seg", "split").cogroup(copies.groupBy("seg", "split")).applyInArrow(
        found_task(), "a long, b long")
    hit = staged(hit, "possible")
    flags = rows.join(hit.withColumn("_hit", F.lit(True)), ["a", "b"], "left").withColumn("again", F.col("_hit").isNotNull() & F.col("doc_id").isNotNull()).drop("_hit")
    hashed = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(task("filter_audit", "hashed"), "doc_id long, a long, b long, text binary")
    return flags.select(*rows.columns, "again"), hashed.join(hit, ["a", "b"], "left_semi")


def found_task():
    root = ROOT

    def run(left, right):
        if root not in sys.path:
            sys.path.append(root)
        return importlib.import_module("stratapanel.llm.filter_audit").found(left, right)

    return run


def hashed(batches):
    yield from flushed(((i, *digest(t), t) for i, t in texts(batches, "doc_id")), REPEAT, 200)


def masks(docs: DataFrame, labels: DataFrame, least_words: int = 50, distinct: int = 65, upper: int = 5, broadcast: int = BROADCAST) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters that they fail (bit i for letter i), those labelled good, those labelled toxic."""
    rows = staged(docs.select("doc_id", "source", "text").mapInArrow(
        task("filter_audit", "flagged", least_words=least_words, distinct=distinct, upper=upper),
        "doc_id long, part string, mask int, a long, b long"), "flags")
    flags, sent_ = repeats(docs, rows, broadcast)
    first = sent_.groupBy("a", "b", "text").agg(F.min("doc_id").alias("doc_id")).select("a", "b", "doc_id", F.lit(True).alias("_first")).distinct()
    unique = flags.where(~F.col("again")).select("doc_id", "part", "mask")
    # the key holds the id, so the rows of a common text spread
    repeat = flags.where("again").join(first, ["a", "b", "doc_id"], "left").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("_first").isNull(), 16).otherwise(0)).alias("mask"))
    judged = unique.union(repeat)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("long")).alias(f"_{c}") for c in ("quality", "toxic")])
    zero = F.lit(0).cast("long")
    labelled = judged.where("doc_id is not null").join(known, "doc_id", "left").select(
        "part", "mask", F.coalesce("_quality", zero).alias("good"), F.coalesce("_toxic", zero).alias("toxic"))
    bare = judged.where("doc_id is null").select("part", "mask", zero.alias("good"), zero.alias("toxic"))
    return labelled.union(bare).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before, filter of the step) of all orders, filters as bits."""
    found_ = []
    for p in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(p):
            found_.append(("".join(FILTERS[x] for x in p), i + 1, before, f))
            before |= 1 << f
    return found_


def audit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per part, order of the filters and step; see the module for ``settings``.

    With S(X) the rows that fail none of X, a step of filter f after X removes S(X) - S(X and f). The 32 values of S of a part
    come from one aggregate over its masks; the 600 steps are a fixed list.
    """
    size = 1 << len(FILTERS)
    counts = masks(docs, labels, **settings)

    def left(name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(x) == 0, F.col(name))), F.lit(0)) for x in range(size)])

    parts = counts.groupBy("part").agg(left("n").alias("s"), left("good").alias("g"), left("toxic").alias("t"), F.array(*[
        F.coalesce(F.sum(F.when(F.col("mask") == (1 << f), F.col("n"))), F.lit(0)) for f in range(len(FILTERS))]).alias("only"))
    n = len(FILTERS)

    def share(f: int) -> Column:   # over all orders: how often the filters before f are just X
        total = F.lit(0).cast("long")
        for x in range(size):
            if not x >> f & 1:
                k = bin(x).count("1")
                total = total + (F.col("s")[x] - F.col("s")[x | 1 << f]) * math.factorial(k) * math.factorial(n - 1 - k)
        return total

    parts = parts.withColumn("share", F.array(*[share(f) for f in range(n)]))
    steps = F.expr("array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {i}, 'x', {x}, 'f', {f})" for o, i, x, f in orders()) + ")")
    each = parts.select("*", F.inline(steps))

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    x, after = F.col("x"), F.expr("x | shiftleft(1, f)")
    removed = at("s", x) - at("s", after)
    return each.select(
        "part", "filter_order", "step", at("s", after).alias("kept"), removed.alias("removed"),
        (F.col("s")[0] - at("s", F.expr("shiftleft(1, f)")) - removed).alias("redundant"), at("only", F.col("f")).alias("unique_fails"),
        (at("g", x) - at("g", after)).alias("good_lost"), (at("t", x) - at("t", after)).alias("toxic_lost"), at("share", F.col("f")).alias("shapley"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
 m AS (SELECT doc_id, part, (len(ws) < 50)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INTEGER
   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
   + 16 * coalesce(lo < doc_id, false)::INTEGER AS mask FROM w),
 l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
 c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
 o AS (SELECT a.c || b.c || g.c || h.c || i.c AS filter_order, [a.b, b.b, g.b, h.b, i.b] AS bits FROM f a, f b, f g, f h, f i WHERE a.b + b.b + g.b + h.b + i.b = 31
   AND len(list_distinct([a.b, b.b, g.b, h.b, i.b])) = 5),
 s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(step)),
 r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
   sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
   sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
 SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
   good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
