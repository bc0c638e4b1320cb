"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word shingles, hashed to 64 bits. Sets travel as packed arrays, never a row a shingle:
chunks of documents send each token bucket their tokens, buckets count in how many documents each token occurs and send
back only those that occur in more than one (no other can be shared). A document's tokens in the order (frequency, token)
start with its unshared ones; if they fill its prefix, nothing can be similar to it. The rest of the prefix joins.

Candidates of a token pass three filters: length (sizes within the threshold), position (what can still match behind the
token) and suffix (sizes of 16 fixed parts of both sets bound their symmetric difference from below). A pair is verified
once, on the shared tokens of both documents, which hold their whole intersection.

A token that many documents share is not paired all with all: first its members meet one pivot of like length, then one
of the far end; linked members need no more pairs among themselves. Only pairs that are still in different components
follow, all of them, so no component is missed. Equal sets are one node throughout.

Rows with a null id are returned with a null component and take no part; a null or empty text, or one without words, is
an empty set, linked with nothing. Repeated rows of an id are returned each, by their own text: a node is a set, named by
a 64-bit hash of its digest, not an id, so two texts of one id are two nodes. Texts of any length are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, staged, task, texts

PARTS, FLUSH = 16, 1_000_000
CHUNKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int32()), ("n", pa.int64()),
                     ("digest", pa.binary()), ("parts", pa.binary()), ("tokens", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])
CHUNKED_SQL = "bucket int, chunk long, doc_id long, idx int, n long, digest binary, parts binary, tokens binary, owners binary, counts binary"
LISTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("parts", pa.list_(pa.int32())), ("first", pa.int64()),
                    ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary()), ("kind", pa.int32())])
LISTED_SQL = "doc_id long, n long, digest binary, parts array<int>, first long, prefix array<long>, tokens binary, kind int"
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 48) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; with fewer words the whole sequence is one."""
    words = text.lower().split()  # lower() and split() of bytes know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    n = len(words) - width + 1
    h = w[:n].copy()
    for k in range(1, width):
        h = h * _P + w[k:k + n]
    return np.unique(mixed(h))


def six(low: np.ndarray) -> bytes:
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    a = np.zeros((len(data) // 6, 8), np.uint8)
    a[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return a.view("<u8").ravel()


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def chunked(batches, width: int, buckets: int):
    """Rows of documents and, for each chunk and bucket, the packed tokens with the chunk-local owner of each."""
    from pyspark import TaskContext
    base = TaskContext.get().partitionId() << 32
    seq, size = 0, 0
    docs: list[tuple] = []
    sets: list[np.ndarray] = []
    seen: dict[bytes, int] = {}

    def flush():
        if docs:
            ids, idx, n, digest, parts = zip(*docs)
            yield record(CHUNKED, bucket=[i % buckets for i in idx], chunk=[base + seq] * len(docs), doc_id=ids, idx=idx, n=n, digest=digest, parts=parts)
        if sets:
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype="<u2"), [len(s) for s in sets])
            bucket = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, owner, bucket = h[order] & _LOW, owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            edges = [0, *cuts.tolist(), len(h)]
            for i in range(0, len(edges) - 1, 64):
                spans = list(zip(edges[i:i + 64], edges[i + 1:i + 65]))
                yield record(CHUNKED, bucket=[bucket[a] for a, _ in spans], chunk=[base + seq] * len(spans),
                             tokens=[six(h[a:b]) for a, b in spans], owners=[owner[a:b].tobytes() for a, b in spans])

    for doc_id, text in texts(batches, "doc_id"):
        s = shingles(text, width)
        digest, idx = b"", -1
        if len(s) and doc_id is not None:
            digest = xxhash.xxh3_128_digest(s.tobytes())
            idx = seen.get(digest, -1)
            if idx < 0:
                idx = seen[digest] = len(sets)
                sets.append(s)
                size += len(s)
        docs.append((doc_id, idx, len(s), digest, np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=PARTS).astype("<u4").tobytes()))
        if size >= FLUSH or len(sets) >= 60_000 or len(docs) >= 100_000:
            yield from flush()
            seq, size, docs, sets, seen = seq + 1, 0, [], [], {}
    yield from flush()


def runs(batches, key: str):
    """Rows as dicts, in runs of one key; rows come sorted by it."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r[key] != now:
                yield now, rows
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield now, rows


def frequent(batches):
    """Of each bucket: which tokens more than one document has, sent back to their chunks with their frequencies."""
    for bucket, rows in runs(batches, "bucket"):
        docs = [r for r in rows if r["tokens"] is None]
        if docs:
            yield record(CHUNKED, **{f.name: [r[f.name] for r in docs] for f in CHUNKED})
        rows = [r for r in rows if r["tokens"] is not None]
        if not rows:
            continue
        tokens = np.concatenate([from_six(r["tokens"]) for r in rows])
        _, where, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        counts = counts[where]
        at, out = 0, []
        for r in rows:
            m = len(r["owners"]) // 2
            c = counts[at:at + m]
            keep = np.flatnonzero(c > 1)
            if len(keep):
                out.append((r["chunk"], (tokens[at:at + m][keep] | np.uint64(bucket << 48)).astype("<u8").tobytes(),
                            np.frombuffer(r["owners"], "<u2")[keep].tobytes(), c[keep].astype("<u4").tobytes()))
            at += m
        for i in range(0, len(out), 64):
            chunk, t, o, c = zip(*out[i:i + 64])
            yield record(CHUNKED, bucket=[bucket] * len(chunk), chunk=chunk, tokens=t, owners=o, counts=c)


def listed(batches, num: int, den: int):
    """Of each chunk: its documents (kind 0), and the rare-first lists of those whose prefix has a shared token (kind 1)."""
    for _, rows in runs(batches, "chunk"):
        docs = [r for r in rows if r["tokens"] is None]
        yield record(LISTED, doc_id=[r["doc_id"] for r in docs], n=[r["n"] for r in docs], digest=[r["digest"] for r in docs], kind=[0] * len(docs))
        rows = [r for r in rows if r["tokens"] is not None]
        if not rows:
            continue
        owner = np.concatenate([np.frombuffer(r["owners"], "<u2") for r in rows])
        token = np.concatenate([np.frombuffer(r["tokens"], "<u8") for r in rows])
        count = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
        order = np.lexsort((token, count, owner))
        owner, token = owner[order], token[order]
        starts = np.flatnonzero(np.r_[True, np.diff(owner.astype(np.int32)) != 0])
        ends = np.r_[starts[1:], len(owner)]
        first = {r["idx"]: r for r in reversed(docs) if r["idx"] >= 0}
        out = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            r = first[int(owner[a])]
            n = r["n"]
            prefix = n - -(-num * n // den) + 1 - (n - (b - a))
            if prefix > 0:
                out.append((r["doc_id"], n, r["digest"], np.frombuffer(r["parts"], "<u4").astype(np.int32), n - (b - a),
                            token[a:a + prefix].astype(np.int64), token[a:b].tobytes(), 1))
        for i in range(0, len(out), 500):
            yield record(LISTED, **dict(zip(LISTED.names, zip(*out[i:i + 500]))))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def verified(batches, num: int, den: int):
    for b in batches:
        out = []
        for a, c, na, nb, ta, tb in zip(*(b.column(k).to_pylist() for k in ("a", "b", "na", "nb", "ta", "tb"))):
            both = len(np.intersect1d(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"), assume_unique=True))
            out.append(den * both >= num * (na + nb - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], schema=LINKS)


def digested(batches, width: int):
    """All columns of the rows, and the digest of each text's set, empty for an empty set."""
    for b in batches:
        found = [shingles(text, width) for text, in texts([b])]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in found], pa.binary())],
                                         names=[*b.schema.names, "__digest"])


def join(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``: documents link when their sets' Jaccard similarity is
    at least ``num / den``; the component is the smallest id that links reach."""
    return linked(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The rows of ``join`` with the digest of each row's set and the label of its component of sets."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(32_000, 4 * n)
    whole = docs.select("doc_id", "text").mapInArrow(task("ngram_join", "chunked", width=width, buckets=buckets), CHUNKED_SQL)
    back = whole.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(task("ngram_join", "frequent"), CHUNKED_SQL)
    lists = back.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(task("ngram_join", "listed", num=num, den=den), LISTED_SQL)
    table = staged(lists, "shingles", ["kind"])
    members = table.where("kind = 0").select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    nodes = members.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    nodes = nodes.withColumn("node", F.xxhash64("digest"))
    sets = (table.where("kind = 1").groupBy("digest").agg(F.first(F.struct("n", "parts", "first", "prefix", "tokens")).alias("s"))
            .join(nodes, "digest").select("node", "least", "s.*"))
    sets = staged(sets, "lists")
    entries = sets.select("node", "least", "n", "parts", "first", F.posexplode("prefix").alias("k", "token")).select(
        "token", "node", "least", "n", (F.col("first") + F.col("k")).alias("pos"), "parts")
    # tokens of one node pair nothing
    several = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    entries = staged(entries.join(several, "token"), "prefixes")

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs (a_*, b_*) that pass the three filters, each once."""
        total = F.col("a_n") + F.col("b_n")
        rest = 1 + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1
        apart = F.aggregate(F.zip_with("a_parts", "b_parts", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        return (pairs.where((num * F.greatest("a_n", "b_n") <= den * F.least("a_n", "b_n"))
                            & ((num + den) * rest >= num * total) & ((num + den) * apart <= (den - num) * total))
                .select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())

    def check(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        return staged(pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ta", "tb")
                      .mapInArrow(task("ngram_join", "verified", num=num, den=den), "a long, b long, linked boolean"), "pairs")

    columns = ["node", "n", "pos", "parts"]
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in columns]
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).alias("band")
    mates = entries.select("token", band, *side("b"))
    stars = []  # pivots go by id: the first of a group is mostly what its others were made from
    for pick, keys in ((F.min, ["token", "band"]), (F.max, ["token"])):
        pivots = entries.select("token", band, "least", *columns).groupBy(*keys).agg(pick(F.struct("least", *columns)).alias("p"), F.count("*").alias("c")).where("c > 1")
        pivots = pivots.select(*keys, *[F.col(f"p.{c}").alias(f"a_{c}") for c in columns])
        stars.append(mates.join(pivots, keys).where("a_node <> b_node"))
    tried = check(fitting(stars[0].select(*[f"{p}_{c}" for p in "ab" for c in columns]).union(stars[1].select(*[f"{p}_{c}" for p in "ab" for c in columns]))))
    links = tried.where("linked").select("a", "b")
    label = components(links)
    # what stands in different components and was not tried: all of it
    known = entries.join(label, "node", "left").select("token", *columns, F.coalesce("component", "node").alias("label"))
    mixed_ = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    known = known.join(mixed_, "token")
    cross = (known.select("token", *side("a"), F.col("label").alias("a_label")).join(known.select("token", *side("b"), F.col("label").alias("b_label")), "token")
             .where("a_node < b_node and a_label <> b_label"))
    late = check(fitting(cross).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    more = late.where("linked").select("a", "b")
    label = components(links.union(more)) if more.limit(1).count() else label
    # only sets that have links meet: a component's smallest id
    grouped = label.join(nodes, "node")
    grouped = grouped.select("digest", "component").join(grouped.groupBy("component").agg(F.min("least").alias("smallest")), "component")
    out = members.join(nodes.drop("node"), "digest", "left").join(grouped, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "least", "doc_id")).alias("component_id"),
                      "digest", F.col("component").alias("label"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the smallest id of their component; one row of each component
    stays. The row's own text decides where an id repeats; of rows without words that repeat an id and a text one stays.
    Rows without an id stay."""
    found = staged(linked(docs, width, num, den).drop("n_shingles"), "components")
    again = staged(found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select(F.col("doc_id").alias("__again")), "again")
    gone = staged(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    repeats = F.col("doc_id") == F.col("__again")
    once = docs.join(again, repeats, "left_anti").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # of rows that repeat an id: a set that is its component's smallest id, and the smallest such set
    stays = (found.join(again, repeats, "left_semi").where("digest is not null and component_id = doc_id")
             .groupBy("doc_id", F.coalesce(F.col("label").cast("string"), F.hex("digest")).alias("label")).agg(F.min("digest").alias("__stays")).select(F.col("doc_id").alias("__id"), "__stays"))
    stays = staged(stays, "stays")
    several = docs.join(again, repeats, "left_semi").dropDuplicates(["doc_id", "text"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    several = staged(several.mapInArrow(task("ngram_join", "digested", width=width), fields + ", __digest binary"), "several")
    empty = several.where(F.length("__digest") == 0)
    chosen = (several.join(stays, (F.col("doc_id") == F.col("__id")) & (F.col("__digest") == F.col("__stays")), "left_semi").dropDuplicates(["doc_id", "__digest"]))
    return once.union(empty.union(chosen).drop("__digest"))
