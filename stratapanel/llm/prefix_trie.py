"""The trie of rebuilt conversations by composable fingerprints.

A conversation c is rebuilt as the head of its base, c - c % ``span`` (remainder with the sign of c), of h = crc32(c) % ``heads``
turns, and its own turns after the first h. No rebuilt text is written. A turn is a symbol, two 64-bit hashes of (role, text).
Sequences of turns map to a monoid: (n, H) with (n, H) * (m, K) = (n + m, H + B^n K) modulo a prime, for three primes. Products of
heads and of own suffixes are running sums of the original turns; a prefix that spans both is composed of the two. Equal prefixes
have equal products, so nodes are groups of (depth, product).

Groups are verified: hashes are injective over the turns of the table (distinct turns and distinct hashes are counted), all members
of a group have the same last turn, and all come from the same group one turn shorter, which by induction makes the prefixes equal.
If any of this fails, all is done again with other hashes, so the result is exact. The last turn of a node stands at its base's
place ``depth`` if that is in the head, else at place depth - head + h of its smallest member.

A node's row is joined to nothing but its key: sums over subtrees are sums over members. Each node's weight hangs on the path of
its smallest member; a member adds to a node what hangs at or below that depth on its own path.

Turns are ordered by number, null first; turns of one number by hash, repeated rows all stay. Rows without a conversation id are
left out. Null role or text is empty. Long conversations and texts are whole; a conversation of any length is cut into blocks.
Columns other than ``conv_id``, ``turn``, ``role``, ``text`` are not read. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import flushed, staged, task

PRIMES = (2147483647, 2147483629, 2147483587)   # fixed values: primes below 2^31, so products fit 64 bits
BLOCK = 4096          # depths of one path that are summed by one task
CHUNK = 1 << 16       # bytes of joined ids that travel as one row
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "f", "g"]
IDS = pa.schema([("depth", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
ENDS = pa.schema([("depth", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("ends_sha256", pa.string())])


def bases(seed: int) -> list[int]:
    """One base for each prime."""
    return [int.from_bytes(hashlib.sha256(f"{seed},{i}".encode()).digest()[:8], "big") % (p - 1000) + 500 for i, p in enumerate(PRIMES)]


def power(base: int, p: int, exponent: Column) -> Column:
    """base^exponent mod p for exponents below 2^32: a table of 256 powers for each byte."""
    out = None
    for byte in range(4):
        step = pow(base, 256 ** byte, p)
        table = F.expr("array(" + ", ".join(f"{pow(step, k, p)}L" for k in range(256)) + ")")
        x = F.get(table, F.shiftright(exponent, 8 * byte).bitwiseAND(255).cast("int"))
        out = x if out is None else out * x % p
    return out


def residues(x1: Column, x2: Column) -> list[Column]:
    return [F.pmod(x, F.lit(p)) for x, p in zip((x1, x2, F.xxhash64(x1, x2)), PRIMES)]


def symbols(conversations: DataFrame, seed: int) -> DataFrame:
    """One narrow row per turn."""
    turn = (F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(2 * seed), *turn).alias("x1"), F.xxhash64(F.lit(2 * seed + 1), *turn).alias("x2"),
        F.octet_length(turn[1]).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))


def injective(conversations: DataFrame, turns: DataFrame) -> bool:
    """Whether different turns have different hashes."""
    each = conversations.where("conv_id is not null").select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return each.distinct().count() == turns.select("x1", "x2").distinct().count()


def placed(turns: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1) in the conversation and ``n``, its turns. Rows are dealt by ranges, so a long conversation is
    numbered by many tasks, and what stands before each range is added."""
    order = [F.col("turn").asc_nulls_first(), "x1", "x2", "row"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(turns.repartitionByRange(parts, "conv_id", *order).withColumn("blk", F.spark_partition_id()), "turns")
    sizes = cut.groupBy("conv_id", "blk").agg(F.count(F.lit(1)).alias("k"))
    line = Window.partitionBy("conv_id")
    sizes = sizes.select("conv_id", "blk", (F.sum("k").over(line.orderBy("blk")) - F.col("k")).alias("off"), F.sum("k").over(line).alias("n"))
    inside = cut.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "blk").orderBy(*order)))
    return inside.join(sizes, ["conv_id", "blk"]).select("conv_id", (F.col("off") + F.col("i")).alias("pos"), "n", "x1", "x2", "bytes")


def product(c: list[Column]) -> tuple[Column, Column]:
    """A product as two longs."""
    return (c[0] * F.lit(1 << 31) + c[1]), c[2]


def paths(turns: DataFrame, seed: int, span: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(one row per rebuilt turn, one row per conversation). A path row has depth, product (f, g), that of the prefix one turn
    shorter (pf, pg), the last turn's hashes and bytes, and whether the conversation ends here."""
    b = bases(seed)
    size = range(len(PRIMES))
    base = F.col("conv_id") - F.col("conv_id") % span
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    placed_ = staged(placed(turns), "placed")
    r = residues(F.col("x1"), F.col("x2"))
    convs = placed_.where("pos = 1").select("conv_id", "n", base.alias("base"), h.alias("h"))
    # products of the heads of bases: at most heads - 1 rows each
    line = Window.partitionBy("conv_id").orderBy("pos")
    head = placed_.where((F.col("conv_id") % span == 0) & (F.col("pos") < heads))
    head = head.withColumns({f"t{i}": r[i] * power(b[i], PRIMES[i], F.col("pos")) % PRIMES[i] for i in size})
    head = staged(head.select(F.col("conv_id").alias("base"), "pos", "x1", "x2", "bytes", *[F.col(f"t{i}") for i in size],
                              *[(F.sum(f"t{i}").over(line) % PRIMES[i]).alias(f"s{i}") for i in size]), "heads")
    lengths = head.groupBy("base").agg(F.max("pos").alias("m"))
    convs = convs.join(lengths, "base", "left").withColumn("k", F.least(F.coalesce("m", F.lit(0).cast("long")), "h")).drop("m")
    convs = convs.join(head.select("base", F.col("pos").alias("k"), *[F.col(f"s{i}").alias(f"h{i}") for i in size]), ["base", "k"], "left")
    zero = F.lit(0).cast("long")
    convs = staged(convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), zero)).alias("length"),
                                *[F.coalesce(f"h{i}", zero).alias(f"h{i}") for i in size]), "rebuilt")
    down = [F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(PRIMES[i])) for i in size]
    names = ["conv_id", "depth", "f", "g", "pf", "pg", "x1", "x2", "bytes", "last"]

    def row(depth: Column, full: list[Column], short: list[Column]) -> list[Column]:
        (f, g), (pf, pg) = product(full), product(short)
        made = [F.col("conv_id"), depth, f, g, pf, pg, F.col("x1"), F.col("x2"), F.col("bytes"), depth == F.col("length")]
        return [c.alias(n) for c, n in zip(made, names)]

    up = head.join(convs.select("conv_id", "base", "k", "length"), "base").where("pos <= k")
    up = up.select(*row(F.col("pos"), [F.col(f"s{i}") for i in size], down))
    # own suffixes: running sums in blocks of places, the blocks before added
    j = F.col("pos") - F.col("h")
    own = placed_.withColumn("h", h).where("pos > h").select(
        "conv_id", "pos", "x1", "x2", "bytes", F.floor((j - 1) / BLOCK).alias("blk"),
        *[(r[i] * power(b[i], PRIMES[i], j) % PRIMES[i]).alias(f"t{i}") for i in size])
    inside = Window.partitionBy("conv_id", "blk").orderBy("pos")
    own = own.withColumns({f"s{i}": F.sum(f"t{i}").over(inside) % PRIMES[i] for i in size})
    sums = own.groupBy("conv_id", "blk").agg(*[(F.sum(f"t{i}") % PRIMES[i]).alias(f"o{i}") for i in size])
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "blk", *[F.coalesce(F.sum(f"o{i}").over(before), zero).alias(f"o{i}") for i in size]).where("blk > 0")
    own = own.join(sums, ["conv_id", "blk"], "left").withColumns({f"s{i}": (F.col(f"s{i}") + F.coalesce(f"o{i}", zero)) % PRIMES[i] for i in size})
    own = own.join(convs, "conv_id")
    # the composition: head product, then the suffix product moved by the head's length

    def composed(x: list[Column]) -> list[Column]:
        return [(F.col(f"h{i}") + power(b[i], PRIMES[i], F.col("k")) * x[i]) % PRIMES[i] for i in size]

    own = own.select(*row(F.col("k") + j, composed([F.col(f"s{i}") for i in size]), composed(down)))
    return staged(up.union(own), "paths"), convs


def chunks(batches):
    """Sorted (node, id) rows as joined ids of bounded length."""
    def out():
        node, first, kept, size = None, 0, [], 0
        for b in batches:
            for *n, c in zip(*(x.to_pylist() for x in b.columns)):
                if n != node or size >= CHUNK:
                    if kept:
                        yield *node, first, ",".join(kept).encode()
                    node, first, kept, size = n, c, [], 0
                kept.append(str(c))
                size += len(kept[-1]) + 1
        if kept:
            yield *node, first, ",".join(kept).encode()
    yield from flushed(out(), IDS, 500)


def hashed(batches):
    """The hash of each node's chunks, which come sorted; one chunk is held at a time."""
    def out():
        node, h = None, None
        for b in batches:
            for *n, ids in zip(*(b.column(i) for i in (0, 1, 2, 4))):
                n = [x.as_py() for x in n]
                if n != node:
                    if node is not None:
                        yield *node, h.hexdigest()
                    node, h = n, hashlib.sha256(ids.as_py())
                else:
                    h.update(b",")
                    h.update(ids.as_py())
        if node is not None:
            yield *node, h.hexdigest()
    yield from flushed(out(), ENDS)


def id_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): sorted and joined in ranges, so only the bytes of a common node's ids meet."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.select(*NODE, "conv_id").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(
        task("prefix_trie", "chunks"), "depth long, f long, g long, first long, ids binary")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(task("prefix_trie", "hashed"), "depth long, f long, g long, ends_sha256 string")


def nodes(path: DataFrame) -> tuple[DataFrame, bool]:
    """(one row per node below the root, whether all groups are verified)."""
    out = staged(path.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("pf").alias("pf"), F.max("pg").alias("pg"),
        ((F.min("pf") == F.max("pf")) & (F.min("pg") == F.max("pg")) & (F.min("x1") == F.max("x1")) & (F.min("x2") == F.max("x2"))
         & (F.min("bytes") == F.max("bytes"))).alias("same")), "nodes")
    return out.drop("same"), not out.where("not same").head(1)


def below(path: DataFrame, node: DataFrame) -> DataFrame:
    """(node, saved_tokens, n_leaves): what hangs on members' paths at or below the node. ``node`` has ``weight`` and ``leaf``."""
    hung = node.select("conv_id", "depth", F.lit(None).cast("long").alias("f"), F.lit(None).cast("long").alias("g"), "weight", "leaf")
    zero = F.lit(0).cast("long")
    rows = path.select("conv_id", *NODE, zero.alias("weight"), zero.alias("leaf")).unionByName(hung).withColumn("blk", F.floor(F.col("depth") / BLOCK))
    # deepest first, a node's own weight before the row of its path
    line = Window.partitionBy("conv_id", "blk").orderBy(F.desc("depth"), F.col("f").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({"w": F.sum("weight").over(line), "l": F.sum("leaf").over(line)}).where("f is not null")
    blocks = hung.groupBy("conv_id", F.floor(F.col("depth") / BLOCK).alias("blk")).agg(F.sum("weight").alias("w"), F.sum("leaf").alias("l"))
    # a path's deepest block may hang nothing below others, so blocks are those of the path
    blocks = path.select("conv_id", F.floor(F.col("depth") / BLOCK).alias("blk")).distinct().join(blocks, ["conv_id", "blk"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("conv_id", "blk", F.sum("w").over(after).alias("w2"), F.sum("l").over(after).alias("l2")).where("w2 is not null or l2 is not null")
    sums = sums.join(later, ["conv_id", "blk"], "left")
    return sums.groupBy(*NODE).agg(F.sum(F.col("w") + F.coalesce("w2", zero)).alias("saved_tokens"), F.sum(F.col("l") + F.coalesce("l2", zero)).alias("n_leaves"))


def trie(conversations: DataFrame, span: int = 5, heads: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seed = 0
    while True:
        turns = staged(symbols(conversations, seed), "symbols")
        if injective(conversations, turns):
            path, convs = paths(turns, seed, span, heads)
            node, sound = nodes(path)
            if sound:
                break
        seed += 1
    zero = F.lit(0).cast("long")
    children = node.groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("pg").alias("g")).agg(F.count(F.lit(1)).alias("n_children"))
    node = node.join(children, NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "weight": (F.col("n_convs") - 1) * F.col("bytes")}).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    node = staged(node, "leaves")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    ends = path.where("last").select(*NODE, "conv_id").union(convs.where("length = 0").select(zero, zero, zero, "conv_id"))
    ends = staged(id_hashes(ends), "ends")
    upper = node.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("g").alias("pg"), F.col("conv_id").alias("_parent"))
    out = node.join(below(path, node), NODE).join(ends, NODE, "left").join(upper, ["depth", "pf", "pg"], "left")
    root = F.broadcast(top.select(F.col("conv_id").alias("_root")))   # one row
    out = out.crossJoin(root).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("_root")).otherwise(F.col("_parent")))
    sums = node.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("weight").alias("saved_tokens"))
    bare = ends.where("depth = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    first = top.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(bare)).select(   # one row each
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest(F.coalesce("n_leaves", zero), F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), "ends_sha256")
    return out.select(*first.columns).unionByName(first).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


SQL = r"""WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL
   SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
 crc AS (SELECT i, v FROM bits WHERE k = 8),
 t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
   FROM conversations WHERE conv_id IS NOT NULL),
 ids AS MATERIALIZED (SELECT DISTINCT conv_id FROM t),
 step AS (SELECT conv_id, conv_id::VARCHAR AS s, 4294967295::BIGINT AS c FROM ids UNION ALL
   SELECT conv_id, substr(s, 2), xor(step.c >> 8, crc.v) FROM step JOIN crc ON crc.i = xor(step.c, ord(substr(s, 1, 1))::BIGINT) & 255 WHERE s <> ''),
 h AS MATERIALIZED (SELECT conv_id, xor(c, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM step WHERE s = ''),
 own AS (SELECT h.conv_id, 0 AS side, pos, role, text FROM h JOIN t ON t.conv_id = h.base WHERE pos <= h UNION ALL SELECT h.conv_id, 1, pos, role, text FROM h JOIN t USING (conv_id) WHERE pos > h),
 o AS MATERIALIZED (SELECT conv_id, role, text, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth FROM own),
 p AS MATERIALIZED (SELECT conv_id, depth, b, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY d2) ) AS key
   FROM (SELECT x.conv_id, x.depth, x.b, y.role, y.text, y.depth AS d2 FROM o x JOIN o y ON y.conv_id = x.conv_id AND y.depth <= x.depth) GROUP BY conv_id, depth, b
   UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
 n AS MATERIALIZED (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM p GROUP BY depth, key),
 len AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
 e AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS x FROM p JOIN len USING (conv_id, depth) GROUP BY depth, key),
 up AS MATERIALIZED (SELECT c.depth, c.key, p.key AS pkey FROM n c JOIN p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
 k AS (SELECT depth - 1 AS depth, pkey AS key, count(*) AS n_children FROM up GROUP BY ALL),
 m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)),
 s AS (SELECT a.depth, a.key, sum((m.n_convs - 1) * m.b) AS saved, sum((m.n_children = 0)::INTEGER) AS leaves FROM m JOIN p a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.depth, a.key)
 SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
   coalesce(x, sha256('')) AS ends_sha256 FROM m JOIN s USING (depth, key) LEFT JOIN e USING (depth, key) LEFT JOIN up USING (depth, key) LEFT JOIN n q ON q.depth = m.depth - 1 AND q.key = up.pkey"""
