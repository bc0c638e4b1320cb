"""Conversation trie, filter audit and toxicity grammar against brute force and held-out labels."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import filter_audit, prefix_trie, queries, toxicity
from stratapanel.llm.common import fold

from .conftest import prose

TURNS = "conv_id long, turn long, role string, text string, depth int"


def brute_trie(rows, span=5, heads=9):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(c - (abs(c) % span) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = {}
    for k, m in members.items():
        under = [x for x in members if x[:len(k)] == k]
        ends = sorted(c for c in m if len(full[c]) == len(k))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[x] for x in under),
                               sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x),
                               hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def told(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def conversations(seed, n=60, most=14):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["ja", "nein", "é" * 3, "", None]) if t > 1 or rng.random() < 0.5 else "hello"))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(3) + [(None, 1, "user", "lost"), (200, None, None, None), (200, 5, "user", "x" * 200_000), (201, 1, "a", "bc"), (202, 1, "ab", "c")]
    rows += [(203, 7, "user", "same")] * 3   # repeated rows all count
    table = spark.createDataFrame([(*r, 1) for r in rows], TURNS)
    assert told(prefix_trie.trie(table)) == brute_trie(rows)
    assert prefix_trie.trie(table.where("false")).count() == 0


def test_trie_of_one_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(3000)]
    rows += [(c, t, "user", f"common {t}") for c in range(100, 400) for t in range(2)]
    assert told(prefix_trie.trie(spark.createDataFrame([(*r, 0) for r in rows], TURNS)).where("depth < 4 or depth > 2990")) == {
        k: v for k, v in brute_chain(rows).items() if k[1] < 4 or k[1] > 2990}


def brute_chain(rows):
    """As ``brute_trie``, for few deep nodes: sums by a walk instead of all pairs."""
    own = collections.defaultdict(list)
    for c, _, role, text in sorted(rows):
        own[c].append((role, text))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ids = collections.defaultdict(list), {c: [] for c in full}
    for c, turns in full.items():
        h = hashlib.sha256()
        for d in range(len(turns) + 1):
            if d:
                h.update(repr(turns[d - 1]).encode())
            ids[c].append((d, h.hexdigest()))
            members[ids[c][-1]].append(c)
    size = {k: len(full[m[0]][k[0] - 1][1].encode()) if k[0] else 0 for k, m in members.items()}
    up = {k: ids[min(m)][k[0] - 1] if k[0] else None for k, m in members.items()}
    kids = collections.Counter(up.values())
    leaves, saved = collections.Counter(), collections.Counter()
    for k in sorted(members, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * size[k]
        if up[k]:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    return {(min(m), k[0]): (min(members[up[k]]) if up[k] else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(
        ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == k[0])).encode()).hexdigest()) for k, m in members.items()}


def test_trie_starts_again_when_hashes_meet(spark, monkeypatch):
    rows = conversations(4, 20)
    table = spark.createDataFrame([(*r, 1) for r in rows], TURNS)
    real = prefix_trie.symbols
    tried = []

    def weak(t, seed):
        tried.append(seed)
        return real(t, seed) if seed else real(t, seed).withColumns({"x1": F.lit(1).cast("long"), "x2": F.lit(1).cast("long")})

    monkeypatch.setattr(prefix_trie, "symbols", weak)
    assert told(prefix_trie.trie(table)) == brute_trie(rows) and tried == [0, 1]


def test_power(spark):
    got = spark.createDataFrame([(x,) for x in (0, 1, 255, 256, 65_537, 4_294_967_295)], "e long").select("e", prefix_trie.power(12345, prefix_trie.PRIMES[1], F.col("e")).alias("p")).collect()
    assert all(r.p == pow(12345, r.e, prefix_trie.PRIMES[1]) for r in got)


def brute_audit(rows, labels):
    quality, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[s or ""].append(({k for k, v in fails.items() if v}, i in quality, i in toxic))
    out, total = {}, collections.Counter()
    for p, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[p, f] += len(gone)
                out[p, order, k + 1] = (len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs),
                                        sum(d[1] for d in gone), sum(d[2] for d in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("broadcast", [1 << 30, 0])
def test_audit(spark, broadcast):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.random()
        text = prose(i % 90, rng.choice([20, 60])) if kind < 0.5 else "SHOUT " * rng.randint(1, 80) if kind < 0.7 else prose(i, 60) + " #" if kind < 0.8 else "again and again " * 30
        rows.append((i, text, rng.choice(["a", "b", "", None])))
    rows += [(None, rows[0][1], "a"), (None, None, "b"), (3, rows[3][1], "a"), (3, rows[3][1], "a"), (900, None, "a"), (901, "", "c"), (902, " \n", "c"), (903, "Ärger é " * 90_000, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, s, t, 1, 2) for i, t, s in rows], "doc_id long, source string, text string, mask int, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, broadcast=broadcast).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, labels) and len(got) == 600 * 4
    assert filter_audit.audit(docs.where("false"), marks).count() == 0


def test_sketch_clears_unique_texts_only(spark, docs):
    rows = [(i, f"text {i}") for i in range(5000)] + [(9000 + i, f"text {i}") for i in range(50)]
    table = docs(rows).select("doc_id", "source", "text")
    flags = filter_audit.staged(table.mapInArrow(filter_audit.task("filter_audit", "flagged", least_words=50, distinct=65, upper=5),
                                                 "doc_id long, part string, mask int, a long, b long"), "flags")
    for broadcast in (1 << 30, 0):
        marked, sent = filter_audit.repeats(table, flags, broadcast)
        ids = {r.doc_id for r in marked.where("again").collect()}
        assert ids == {r.doc_id for r in sent.collect()} and {i for i, _ in rows if i < 50 or i >= 9000} <= ids and len(ids) < 400


def test_grammar():
    lex = toxicity.Lexicon({}, 10, 100)

    def sum_of(text):
        return toxicity.measure(text.encode(), lex)[0]

    plain, target = sum_of("such an idiot"), sum_of("you are such an idiot")
    assert plain > 0 and target == pytest.approx(1.5 * plain) and sum_of("idiot that you are") == pytest.approx(target)
    assert sum_of("you are not an idiot") == pytest.approx(0.2 * plain) and sum_of("not really all that often an idiot") == pytest.approx(plain)
    assert sum_of("the paper said idiot") == pytest.approx(0.5 * plain) and sum_of('the word "idiot" here') == pytest.approx(0.5 * plain)
    assert sum_of("the paper said. an idiot") == pytest.approx(plain) and sum_of("not. an idiot") == pytest.approx(plain)
    assert sum_of("kill time") == pytest.approx(0.3) and sum_of("kill you") == pytest.approx(1.5) and sum_of("you will be killed") == 0
    assert sum_of("") == 0 and sum_of("nothing here, you see") == 0


def test_composition_equals_running_one_after_the_other():
    a, b, c = toxicity.negation(), toxicity.reported(), toxicity.targeted()
    whole = a.then(b).then(c)
    rng = random.Random(1)
    for _ in range(200):
        s, states, w1, w2, out1, out2 = whole.start, [m.start for m in (a, b, c)], 1.0, 1.0, [], []
        for x in (rng.randrange(toxicity.DENIED) for _ in range(30)):
            s, o, w = whole.step(s, x)
            out1.append(o)
            w1 *= w
            for i, m in enumerate((a, b, c)):
                states[i], x, w = m.step(states[i], x)
                w2 *= w
            out2.append(x)
        assert out1 == out2 and w1 == pytest.approx(w2)


def test_toxicity(spark, docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words = prose(i, 80).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(80)] = rng.choice(["idiot", "zarquel", "zarquox", "zarquim"])   # a stem that no list knows
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    edge = [(None, "null id idiot"), (900, None), (901, ""), (902, " \n"), (903, "x"), (903, "x"), (904, "you idiot " * 60_000)]
    table = docs(rows + edge).withColumn("score", F.lit(1)).withColumn("toxic", F.lit(1))
    marks = spark.createDataFrame(labels + [(901, 0, None), (None, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(table, marks, fold(4) != 2, fold(4) == 2).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score == by[902].score == min(r.score for r in got) and by[904].predicted == 1
    none = toxicity.score(table, marks.where("false"), fold(4) != 2, fold(4) == 2).where("doc_id = 904").first()
    assert none.predicted == 1
    assert toxicity.score(table.where("false"), marks, fold(4) != 2, fold(4) == 2).count() == 0


def test_toxicity_on_tables(spark, sf):
    got = queries.op13_toxicity_grammar(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert r[0] < 0.1 and r[1] > 0.5
