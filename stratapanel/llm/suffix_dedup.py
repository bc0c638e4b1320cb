"""Suffix-array dedup by external induced sorting, over shards that bring equal strings together.

Every string of ``depth`` bytes is assigned to the window minimum of the hashes of its grams: equal strings have equal
minima, so all starts of a string meet in the shard of its minimum, wherever they stand. Neighbouring starts of one minimum
form a run; its context (the run's bytes and the depth behind its last start) is what a shard needs. Contexts whose minimum
occurs once in the corpus hold nothing repeated (runs that hold it twice count as two) and go no further; equal contexts travel once, with their multiplicity.
A repeated string has the minimum at one place in all its copies, so it shares with them half of its other bytes before that
gram, or half behind it: a context that shares neither half with another of its minimum is dropped before the sort, too.

A shard's contexts are laid end to end, and their suffixes and common prefixes come from ``induced.suffixes``: queues of
suffix tuples and prefixes, on disk beyond a limit, through recursive induction. A start is repeated if its context has
copies or a neighbour in suffix order agrees on ``depth`` bytes. Covered bytes go back to their documents as spans.

A null text is empty: nothing removed. Strings are judged on the input. Rows are told apart by id and text, so repeated
rows are copies of each other and both lose what they share; null ids are treated as one id. Texts shorter than ``depth``
stay whole. No length is special: a long text has more contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import staged, task
from .induced import suffixes

GRAM, FLUSH, SHARD = 16, 2 << 20, 3 << 20
RUNS = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("len", pa.int64()), ("m", pa.int64()), ("inner", pa.int64()),
                 ("lh", pa.int32()), ("rh", pa.int32())])
RUNS_SQL = "key long, ctx long, did long, th long, start long, len long, m long, inner long, lh int, rh int"
SPANS = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on (positions near the end hold what the padding gives)."""
    n = len(data)
    padded = np.zeros(n + 32, np.uint8)
    padded[:n] = data
    words = np.empty(n + 16, np.uint64)
    for r in range(8):
        part = padded[r:r + (n + 16 - r + 7) // 8 * 8].view("<u8")
        words[r::8] = part[:len(words[r::8])]
    h = words[:n] * _A ^ (words[8:n + 8] * _B + (words[:n] >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours; the last w - 1 positions are not given."""
    m, span = h, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:len(h) - w + 1], m[w - span:w - span + len(h) - w + 1])


def halves(h: np.ndarray, key: np.ndarray, at: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bytes before and behind the first gram of each run's minimum, of half a string each; 0 where a run's
    context does not hold them. Of no use for runs that hold their minimum twice."""
    half = (depth - GRAM) // 2
    if half < GRAM:   # too short to tell: all runs of a minimum may share
        return np.ones(len(at), np.int32), np.ones(len(at), np.int32)
    wide, gram = np.arange(depth - GRAM + 1), np.empty(len(at), np.int64)
    for i in range(0, len(at), 2048):
        a = stop[i:i + 2048] - 1
        spots = np.minimum(a[:, None] + wide, len(h) - 1)
        gram[i:i + 2048] = a + (h[spots] == key[i:i + 2048, None]).argmax(1)
    steps = [*range(0, half - GRAM, GRAM), half - GRAM]

    def mixed(first, ok):
        out = np.zeros(len(at), np.int32)
        place, mix = first[ok], np.zeros(int(ok.sum()), np.uint64)
        for k in steps:
            mix = (mix ^ h[place + k]) * _B
            mix ^= mix >> np.uint64(31)
        out[ok] = (mix >> np.uint64(33)).astype(np.int32) | 1
        return out

    return mixed(gram - half, gram - half >= at), mixed(gram + GRAM, gram + GRAM + half <= stop - 1 + depth)


def run_rows(docs: list[tuple[int, int, bytes]], depth: int):
    """Runs of the documents, equal contexts of this block together; those beyond the first of a context come with m = 0."""
    data = np.frombuffer(b"".join(t for _, _, t in docs), np.uint8)
    if len(data) < depth:
        return None
    h = gram_hashes(data)
    low = window_min(h, depth - GRAM + 1)
    ends = np.cumsum([len(t) for _, _, t in docs])
    begins = np.r_[0, ends[:-1]]
    fresh = np.zeros(len(low) + 1, bool)
    fresh[1:len(low)] = low[1:] != low[:-1]
    limit = np.minimum(np.maximum(ends - depth + 1, begins), len(low))
    fresh[begins[begins < len(low)]] = True
    at = np.flatnonzero(fresh[:len(low)])
    doc = np.searchsorted(ends, at, "right")
    ok = at < limit[doc]
    stop = np.r_[at[1:], len(low)]
    at, stop, doc = at[ok], np.minimum(stop[ok], limit[doc[ok]]), doc[ok]
    if not len(at):
        return None
    view, seed = memoryview(data), 5
    ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b + depth - 1], seed) for a, b in zip(at.tolist(), stop.tolist())), np.uint64, len(at)).view(np.int64)
    key = low[at].view(np.int64)
    # a run that goes on behind its first minimum holds another, and may repeat a string within itself
    hits = np.r_[0, np.cumsum(h[:len(low)] == low)]
    inner = (hits[stop - 1] > hits[at]).astype(np.int64)
    lh, rh = halves(h, low[at], at, stop, depth)
    order = np.lexsort((ctx, key))
    k, c = key[order], ctx[order]
    lead = np.ones(len(k), bool)
    lead[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    count = np.diff(np.r_[np.flatnonzero(lead), len(k)])
    m = np.zeros(len(k), np.int64)
    m[lead] = count
    did, th = np.array([d for d, _, _ in docs], np.int64), np.array([t for _, t, _ in docs], np.int64)
    at, stop, doc = at[order], stop[order], doc[order]
    return [k, c, did[doc], th[doc], at - begins[doc], stop - at, m, inner[order], lh[order], rh[order]]


def runs(batches, depth: int):
    def made():
        docs, size = [], 0
        for b in batches:
            text = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            for did, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text):
                t = t.as_py() or b""
                if len(t) < depth:
                    continue
                docs.append((did, th, t))
                size += len(t)
                if size >= FLUSH:
                    yield run_rows(docs, depth)
                    docs, size = [], 0
        if docs:
            yield run_rows(docs, depth)

    for columns in made():
        if columns is not None:
            for i in range(0, len(columns[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 20_000]) for c in columns], schema=RUNS)


def shared(batches):
    """Rows come by key and context. Gives, of keys that occur more than once: a row with m > 0 (its multiplicity) for each
    distinct context that may hold repeats, and rows with m = 0 for further copies, which are repeated whole. Holds a block and
    one open key."""
    held = None

    def out(c):
        key, ctx, m = c[0], c[1], c[6]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_ctx = new_key | np.r_[True, ctx[1:] != ctx[:-1]]
        gk, gc = np.cumsum(new_key) - 1, np.cumsum(new_ctx) - 1
        total, copies = np.bincount(gk, m + c[7]), np.bincount(gc, m)
        may = (copies > 1) | (np.bincount(gk, c[7])[gk[new_ctx]] > 0)   # copies, or a run that may repeat a string within itself
        of = gk[new_ctx]
        for half in (c[8][new_ctx], c[9][new_ctx]):
            some = np.flatnonzero((half != 0) & (total[of] > 1))
            some = some[np.lexsort((half[some], of[some]))]
            same = (of[some][1:] == of[some][:-1]) & (half[some][1:] == half[some][:-1])
            may[some[1:][same]] = True
            may[some[:-1][same]] = True
        keep = may[gc] & (total[gk] > 1)
        c[6] = np.where(new_ctx, copies[gc], 0).astype(np.int64)
        rows = [x[keep] for x in c]
        for i in range(0, len(rows[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 20_000]) for x in rows], schema=RUNS)

    for b in batches:
        if not b.num_rows:
            continue
        c = [x.to_numpy() for x in b.columns]
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
        cut = int(np.searchsorted(c[0], c[0][-1]))  # the last key stays open
        if cut == 0 and len(c[0]) > 500_000:
            # a key of very many rows: fold the copies of what is held so far, give the further ones at once
            new = np.r_[True, c[1][1:] != c[1][:-1]]
            copies = np.bincount(np.cumsum(new) - 1, c[6]).astype(np.int64)
            rest = [x[~new] for x in c[:6]] + [np.zeros(int((~new).sum()), np.int64), *[x[~new] for x in c[7:]]]
            for i in range(0, len(rest[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 20_000]) for x in rest], schema=RUNS)
            c = [x[new] for x in c[:6]] + [copies, *[x[new] for x in c[7:]]]
        elif cut:
            yield from out([x[:cut] for x in c])
            c = [x[cut:] for x in c]
        held = c
    if held is not None:
        yield from out(held)


def repeats(contexts: list[tuple[bytes, int, int]], depth: int, **limits) -> list[list[tuple[int, int]]]:
    """Of contexts (bytes, starts, multiplicity): the runs of repeated starts of each, from the suffix order of them all."""
    begin = np.cumsum([0, *(len(c) + 1 for c, _, _ in contexts)])
    text = np.empty(int(begin[-1]), np.uint8)
    for (c, _, _), a in zip(contexts, begin):
        text[a:a + len(c)] = np.frombuffer(c, np.uint8)
        text[a + len(c)] = 0xFE  # no byte of UTF-8; suffixes that reach it are shorter than depth
    text += np.uint8(1)
    again = np.zeros(len(text) + 1, bool)
    tail = [-1]

    def wanted(pos, lcp):
        far = np.flatnonzero(lcp >= depth)
        again[pos[far]] = True
        again[np.where(far > 0, pos[far - 1], tail[0])] = True
        tail[0] = pos[-1]

    suffixes(text, depth, wanted, **limits)
    out = []
    for (c, n, m), a in zip(contexts, begin.tolist()):
        if m > 1:
            out.append([(0, n)])
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, again[a:a + n], False].astype(np.int8)))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def sorted_shards(batches, depth: int, shard: int):
    """Groups of whole keys, of about ``shard`` bytes or the one key's, are sorted together."""
    def close(rows):
        found = repeats([(r[4], r[3], r[5]) for r in rows], depth)
        spans = [(r[0], r[1], r[2] + x, r[2] + y + depth - 1) for r, f in zip(rows, found) for x, y in f]
        for i in range(0, len(spans), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans[i:i + 20_000])], schema=SPANS)

    rows, size, key = [], 0, None
    for b in batches:
        for k, *r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "did", "th", "start", "len", "body", "m"))):
            if k != key and size >= shard:
                yield from close(rows)
                rows, size = [], 0
            key = k
            rows.append(r)
            size += len(r[4])
    if rows:
        yield from close(rows)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching ones are one."""
    order = np.lexsort((b, a))
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], np.r_[b[:-1][new[1:]], b[-1]]


def cut(text: bytes, spans: list[tuple[int, int]] | None) -> tuple[bytes, int]:
    """What is left of a text and how many maximal runs go."""
    if not spans:
        return text, 0
    a, b = merged(*np.array([(s["a"], s["b"]) if isinstance(s, dict) else s for s in spans], np.int64).T)
    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
    return b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])), len(a)


def rows_of(batches):
    for b in batches:
        text = b.column(b.schema.get_field_index("text")).cast(pa.binary())
        for doc_id, t, s in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), text, b.column(b.schema.get_field_index("__spans"))):
            t = t.as_py() or b""
            yield doc_id, t, *cut(t, s.as_py())


def digested(batches):
    from .common import flushed
    yield from flushed(((i, len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for i, t, k, n in rows_of(batches)), DIGEST)


def with_spans(docs: DataFrame, depth: int = 200) -> DataFrame:
    """``docs`` (its columns keep their names) with ``__spans``: the covered byte spans of its text, null where none."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    did, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th")
    raw = docs.select(did, th, "text").mapInArrow(task("suffix_dedup", "runs", depth=depth), RUNS_SQL)
    table = staged(raw.repartition(n, "key").sortWithinPartitions("key", "ctx").mapInArrow(task("suffix_dedup", "shared"), RUNS_SQL), "runs")
    keyed = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64("text")})
    body = F.expr(f"substring(cast(__text as binary), cast(start + 1 as int), cast(len + {depth - 1} as int))")
    once = docs.select(did, th, F.col("text").alias("__text"))
    contexts = table.where("m > 0").join(once, ["did", "th"]).select(
        "key", "did", "th", "start", "len", body.alias("body"), "m")
    found = contexts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        task("suffix_dedup", "sorted_shards", depth=depth, shard=SHARD), "did long, th long, a long, b long")
    whole = table.where("m = 0").select("did", "th", F.col("start").alias("a"), (F.col("start") + F.col("len") + depth - 1).alias("b"))
    spans = found.union(whole).groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    spans = spans.withColumnRenamed("did", "__did").withColumnRenamed("th", "__th")
    return keyed.join(spans, ["__did", "__th"], "left").drop("__did", "__th")


def dedup_digest(docs: DataFrame, depth: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``."""
    cutting = with_spans(docs.select("doc_id", "text"), depth).select("doc_id", "text", "__spans")
    return cutting.mapInArrow(task("suffix_dedup", "digested"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def replaced(batches):
    """Rows without the span column, with the text that is left and its length; the others stay as they are."""
    for b in batches:
        schema = pa.schema([f for f in b.schema if f.name != "__spans"])
        at = [b.schema.get_field_index(f.name) for f in schema]
        spans = b.column(b.schema.get_field_index("__spans"))
        columns = {f.name: b.column(i) for f, i in zip(schema, at)}
        if spans.null_count < len(spans):
            text, sizes = [], []
            was = columns["text"].to_pylist()
            lengths = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(was)
            for t, s, n in zip(was, spans.to_pylist(), lengths):
                if s:
                    t = cut(t.encode(), s)[0].decode("utf-8", "ignore")
                    n = len(t)
                text.append(t)
                sizes.append(n)
            columns["text"] = pa.array(text, schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), schema=schema)


def cut_repeats(docs: DataFrame, depth: int = 200) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts lost their repeated bytes (and the rest of a character cut in
    the middle); ``n_chars``, where there is one, follows."""
    return with_spans(docs, depth).select(*docs.columns, "__spans").mapInArrow(task("suffix_dedup", "replaced"), docs.schema)
