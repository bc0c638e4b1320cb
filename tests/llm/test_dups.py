"""Joins, suffix order and nearest neighbours against brute force."""
import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import ann, common, ngram_join, suffix_dedup
from stratapanel.llm.induced import suffixes

from .conftest import prose


def edited(text: str, seed: int, n: int) -> str:
    words, rng = text.split(), random.Random(seed)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
    return " ".join(words)


def near_rows():
    base = [prose(i, 200) for i in range(6)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, edited(base[i % 4], i, 1 + i % 9)) for i in range(60)]
    rows += [(300 + i, base[0]) for i in range(30)] + [(400 + i, "common first line of many " + prose(50 + i, 40)) for i in range(40)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "Two  WORDS"), (6, "É é"), (7, "é É"), (None, base[0]), (8, base[5]), (8, base[5]), (9, prose(9, 30_000))]
    return rows


def brute_components(rows, num=3, den=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = [i for i in sets if i is not None and sets[i]]
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sets, label


@pytest.mark.parametrize("flush", [1_000_000, 700])
def test_join_equals_brute_force(spark, docs, flush, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    rows = near_rows()
    sets, label = brute_components(rows)
    got = ngram_join.join(docs(rows).withColumn("n", F.lit(1)).withColumn("digest", F.lit("x"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id])
    kept = ngram_join.keep_one(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({v for k, v in label.items() if k is not None})
    assert sum(r.doc_id is None for r in kept) == 1
    assert ngram_join.join(docs(rows).where("false")).count() == 0


def test_repeated_ids_go_by_their_own_text(spark, docs):
    a, b, c = (prose(900 + i, 200) for i in range(3))
    near = lambda t: edited(t, 1, 1)
    # id 20 has a text of its own and one near id 10's; its texts must not link 10 with 30 either
    rows = [(10, a), (20, near(a)), (20, b), (30, near(b)), (30, c), (40, c), (50, prose(990, 200)), (50, edited(prose(990, 200), 2, 1)), (60, ""), (60, " ")]
    kept = ngram_join.keep_one(docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id != 50) == sorted([(10, a), (20, b), (30, c), (60, ""), (60, " ")])
    assert sum(r.doc_id == 50 for r in kept) == 1
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.join(docs(rows)).collect())
    assert got == collections.Counter([(10, 10), (20, 10), (20, 20), (30, 20), (30, 30), (40, 30), (50, 50), (50, 50), (60, 60), (60, 60)])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(300):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label[k] == v for k, v in got.items()) and all(k in got for k, v in label.items() if v != k)


def test_suffix_order_of_small_texts():
    rng = random.Random(5)
    for _ in range(700):
        n, kinds = rng.randint(1, 60), rng.choice([1, 2, 3, 5])
        t = [rng.randint(1, kinds) for _ in range(n)]
        if rng.random() < 0.4:
            t = (t[:rng.randint(1, 8)] * 20)[:n]
            n = len(t)
        depth, runs = rng.choice([3, 8, 200]), []
        suffixes(np.array(t), depth, lambda p, v: runs.append((p, v)), memory=rng.choice([0, 100, 1 << 30]), base=rng.choice([0, 3, 10**6]))
        pos, lcp = np.concatenate([p for p, _ in runs])[::-1], np.concatenate([v for _, v in runs])[::-1]
        assert sorted(pos.tolist()) == list(range(n))
        for k in range(n - 1):
            a, b = t[pos[k]:], t[pos[k + 1]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert a[:depth] <= b[:depth] and min(same, depth) == lcp[k]


def brute_repeats(rows, depth):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k:k + depth] for _, t in texts for k in range(len(t) - depth + 1))
    out = []
    for i, t in texts:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - depth + 1):
            if seen[t[k:k + depth]] > 1:
                hit[k:k + depth] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~hit]) if len(t) else b""
        out.append((i, len(t), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("flush, shard", [(4 << 20, 12 << 20), (3000, 2000)])
def test_dedup_equals_brute_force(spark, docs, flush, shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    passage = prose(77, 60)
    rows = [(i, prose(i, 80) + passage + prose(1000 + i, 50)) for i in range(25)]
    rows += [(50, "word " * 900), (51, "a" * 3000), (52, "ab" * 700), (53, prose(3, 200)), (54, prose(3, 200)), (55, None), (56, ""), (57, "short"), (58, "é" * 300 + prose(4, 90)),
             (59, "x" + "é" * 300), (60, "z" * 199), (61, "z" * 200 + "\x00" * 250), (None, prose(3, 150)), (70, passage[:300]), (70, passage[:300]), (71, passage[50:249])]
    got = [tuple(r) for r in suffix_dedup.dedup_digest(docs(rows).withColumn("did", F.lit(0)).withColumn("spans", F.lit(0))).collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(rows, 200), key=repr)
    cut = suffix_dedup.cut_repeats(docs(rows))
    assert cut.columns == docs(rows).columns and cut.where("n_chars <> length(text)").count() == 0 and cut.count() == len(rows)
    assert suffix_dedup.dedup_digest(docs(rows).where("false")).count() == 0


def test_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[300:700] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [None] + [1.0] * 23),
                                                        (2080, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (2100, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    data = {i: np.array((v + [0.0] * 24)[:24], np.float64) for i, v in [*((i, v.tolist()) for i, v in enumerate(x)), (2100, [1.0, 2.0])]}
    hits = total = 0
    for q in [i for i in data if i % 20 == 0]:
        best = sorted((-float(data[q] @ v), i) for i, v in data.items() if i != q)[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(s - float(data[q] @ data[i])) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += sum(s >= -best[-1][0] - 1e-9 for _, _, s in mine)
        total += 20
    assert hits / total >= 0.9
    assert {r.query_id for r in got} == {i for i in data if i % 20 == 0}
    few = ann.search(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("noise", [0.05, 0.2])
def test_forest_in_a_dense_cluster(spark, noise):
    """Half of the rows, all distinct, in one cluster: recall of its queries and of the others against brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12_000, 64))
    x[:6000] = rng.normal(size=64) + noise * rng.normal(size=(6000, 64))
    x = x[rng.permutation(12_000)].astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    exact = x[::20].astype(np.float64) @ x.astype(np.float64).T
    exact[np.arange(600), np.arange(600) * 20] = -np.inf
    twentieth = np.sort(exact, 1)[:, -20]
    hits = got.assign(hit=got.score >= twentieth[got.query_id // 20] - 1e-9).groupby("query_id").hit.sum() / 20
    assert len(got) == 12_000 and hits.mean() >= 0.9
    dense = exact.max(1) > np.median(exact.max(1))
    assert hits.to_numpy()[dense].mean() >= 0.9 and hits.to_numpy()[~dense].mean() >= 0.9


def test_cut_repeats_with_clashing_columns(spark):
    """Columns of any name pass through, ``spans`` too."""
    same = prose(5, 80)
    rows = [(1, "ab" + same, "x", 7), (2, same + "cd", "y", 8), (3, None, None, None), (4, "", "z", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, a int")
    got = {r.doc_id: tuple(r) for r in suffix_dedup.cut_repeats(table, depth=60).collect()}
    assert got == {1: (1, "ab", "x", 7), 2: (2, "cd", "y", 8), 3: (3, None, None, None), 4: (4, "", "z", 9)}


def test_contexts_that_share_a_phrase_only_are_not_sorted():
    """Texts with one common phrase of 60 bytes hold no repeated string of 200; one pair of them shares 200 bytes around it."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    phrase = b"the same sixty bytes in each of the texts, and nothing besides"
    made = [rng.integers(97, 123, 400, dtype=np.uint8).tobytes() for _ in range(200)]
    docs = [(i, 0, t[:200] + phrase + t[200:]) for i, t in enumerate(made)]
    docs.append((200, 0, made[0][:20] + docs[7][2][130:330] + made[1][:20]))
    columns = suffix_dedup.run_rows(docs, 200)
    order = np.lexsort((columns[1], columns[0]))
    rows = pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], schema=suffix_dedup.RUNS)
    kept = pa.Table.from_batches(list(suffix_dedup.shared([rows])), suffix_dedup.RUNS)
    plain = [c.copy() for c in columns]
    plain[8][:] = 1   # as if all shared a half
    all_rows = pa.RecordBatch.from_arrays([pa.array(c[order]) for c in plain], schema=suffix_dedup.RUNS)
    whole = pa.Table.from_batches(list(suffix_dedup.shared([all_rows])), suffix_dedup.RUNS)

    def starts(table):
        body = [(docs[d][2][a:a + n + 199], n, m) for d, a, n, m in zip(*(table.column(c).to_pylist() for c in ("did", "start", "len", "m"))) if m]
        at = [(d, a) for d, a, m in zip(*(table.column(c).to_pylist() for c in ("did", "start", "m"))) if m]
        return {(d, a + i) for (d, a), f in zip(at, suffix_dedup.repeats(body, 200)) for x, y in f for i in range(x, y)}

    assert len(kept) < len(whole)
    assert starts(kept) == starts(whole) == {(7, 130), (200, 20)}
