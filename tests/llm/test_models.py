"""Classifiers, rules and language model: held-out accuracy and counts against brute force."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import language_id, lm_score, quality, queries, rules
from stratapanel.llm.common import fold

from .conftest import prose

EDGE = [(None, "null id text here"), (1, None), (2, ""), (3, " \n\t "), (4, "123 456 !!"), (5, "x"), (5, "x"), (6, "<|x|> é " * 20_000)]


def test_fold(spark):
    ids = [None, 0, 7, 123456789]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fold(7).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(b"" if i is None else str(i).encode()) % 7 for i in ids]


def test_language(spark, docs):
    small = {"aa": "the of and to in is that for with", "bb": "der die und das nicht mit ein von den", "cc": "le la de et les des une dans pour"}
    rng = random.Random(1)
    rows = [(100 + i, " ".join(rng.choice(small[lang].split()) for _ in range(rng.randint(15, 90))), lang, "s") for i in range(240) for lang in [rng.choice(sorted(small))]]
    table = docs(rows + [(*r, None, None) for r in EDGE]).withColumn("margin", F.lit(1))
    got = language_id.identify(table, fold(4) != 2, fold(4) == 2).collect()
    assert len(got) == len(rows) + len(EDGE)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got)
    none = language_id.identify(docs([(1, "text", None, None)]), fold(4) != 2, fold(4) == 2).collect()
    assert none[0].lang_pred == "und"
    assert language_id.identify(table.where("false"), fold(4) != 2, fold(4) == 2).count() == 0


def test_language_of_long_or_short_texts_is_learned(spark, docs):
    small = {"aa": "the of and to in is that for with", "bb": "der die und das nicht mit ein von den", "cc": "le la de et les des une dans pour"}
    size = {"aa": (3000, 6000), "bb": (2, 8), "cc": (20, 60)}
    rng = random.Random(5)
    draw = lambda lang, lo, hi: " ".join(rng.choice(small[lang].split()) for _ in range(rng.randint(lo, hi)))
    train = [(i, draw(lang, *size[lang]), lang) for i, lang in enumerate(sorted(small) * 40)]
    assert all(len(t) > 98_304 // 64 for _, t, lang in train if lang == "aa") and all(len(t) < 64 for _, t, lang in train if lang == "bb")
    table = docs([(i, t, lang, "s") for i, t, lang in train] + [(1000 + i, draw(lang, 30, 40), lang, "s") for i, lang in enumerate(sorted(small) * 10)])
    got = language_id.identify(table, F.col("doc_id") < 1000, F.col("doc_id") >= 1000, dict_bytes=12_288).where("held_out").collect()
    assert all(r.lang_pred == sorted(small)[(r.doc_id - 1000) % 3] for r in got) and len(got) == 30
    # a repeated id brings its sampled text only
    many = docs([(1, f"{draw('aa', 20, 30)} {k}", "aa", "s") for k in range(300)])
    model = language_id.sample(many, F.lit(True), 1024)
    assert 0 < len(model["aa"]) <= 1024
    assert set(language_id.sample(docs([(None, "x" * 100, "zz", "s")]), F.lit(True), 1024)) == {"zz"}


def test_language_accuracy_on_tables(spark, sf):
    got = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.9


def test_quality(spark, docs):
    good = [(i, prose(i, 60 + i % 50)) for i in range(0, 300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 50).split())) for i in range(150)] + [(2000 + i, "same word " * (20 + i % 30)) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(3, None), (None, 1), (99_999, 0)], "doc_id long, quality int")
    table = docs(good + bad + EDGE).withColumn("score", F.lit(2)).withColumn("x", F.lit(2))
    got = quality.classify(table, labels, fold(3) != 1, fold(3) == 1).collect()
    assert len(got) == len(good) + len(bad) + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: 1 for i, _ in good if i > 6} | {i: 0 for i, _ in bad}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    kept = quality.keep(table, labels, fold(3) != 1)
    assert kept.columns == table.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.predicted)
    one = quality.classify(docs(good), labels.where("quality = 1"), fold(3) != 1, fold(3) == 1).agg(F.min("score"), F.max("score")).first()
    none = quality.classify(docs(good), labels.where("false"), fold(3) != 1, fold(3) == 1).agg(F.min("score"), F.max("score")).first()
    assert tuple(one) == (1.0, 1.0) == tuple(none)
    assert quality.classify(table.where("false"), labels, fold(3) != 1, fold(3) == 1).count() == 0


def test_isotonic():
    rng = random.Random(0)
    rows = [(k, rng.randint(1, 9), 0) for k in range(50)]
    rows = [(k, n, rng.randint(0, n)) for k, n, _ in rows]
    x, y = quality.isotonic(rows)
    assert x == sorted(x) and all(a < b for a, b in zip(y, y[1:]))


def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, hit = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines, dups, earlier = text.split("\n"), 0, set()
    for line in lines:
        if re.search("[^\x20\x09-\x0D]", line):
            dups += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def test_rules(spark, docs):
    good = [(100 + i, prose(i, 80 + 3 * i % 200), "en" if i % 3 else None, "a" if i % 2 else "b") for i in range(400)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 90).split()), "en", "a") for i in range(30)] + [(2000 + i, "one line of it here\n" * 30, "en", "a") for i in range(5)]
    rows = good + bad + EDGE + [(7, "a\n\na\n \na b\xa0c\n\x1c\n\x1c", None, None), (8, "a b c a b c x a b c " * 9, "zz", "zz")]
    table = docs(rows).withColumn("mean", F.lit(0)).withColumn("grp", F.lit(0)).withColumn("g", F.lit(0))
    got = rules.judge(table).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        want = brute_counts(text[r.doc_id])
        assert tuple(r[1:6]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i, *_ in good) and not any(by[i].kept for i, *_ in bad)
    kept = rules.keep(table)
    assert kept.columns == table.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got if r.kept)
    assert rules.judge(table.where("false")).count() == 0


def test_estimate_ignores_outliers(spark):
    rng = np.random.default_rng(3)
    core = rng.normal([5, 1.6, 0, 0, 0], [1.0, 0.4, 0.5, 0.3, 0.3], (900, 5))
    far = rng.normal([9, 3, 4, 2, 2], 0.1, (150, 5))
    rows = [("g", *map(float, r)) for r in np.vstack([core, far])]
    model = rules.estimates(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")).first()
    d = lambda x: float((x - np.array(model["mean"])) @ np.array(model["inverse"]).reshape(5, 5) @ (x - np.array(model["mean"])))
    assert np.abs(np.array(model["mean"]) - core.mean(0)).max() < 0.15
    assert min(map(d, far)) > 60 > np.quantile([d(x) for x in core], 0.999)


@pytest.mark.parametrize("vocabulary, flush", [(1_500_000, 1_000_000), (3, 200)])
def test_scores(spark, docs, vocabulary, flush, monkeypatch):
    monkeypatch.setattr(lm_score, "FLUSH", flush)
    rng = random.Random(6)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(120)] + EDGE
    table = docs(rows).withColumn("idx", F.lit(0)).withColumn("words", F.lit(0))
    got = lm_score.score(table, fold(7) == 2, vocabulary=vocabulary).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    text = dict(rows)
    for r in got:
        t = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert lm_score.score(table.where("false"), fold(7) == 2).count() == 0
    untrained = lm_score.score(docs([(1, "a b")]).where("true"), F.lit(True)).first()
    assert (untrained.n_known, untrained.train_tokens) == (0, 0) and math.isclose(untrained.base_score, 0.0, abs_tol=1e-12)


def test_scores_do_not_depend_on_the_vocabulary(spark, docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(150)] + [(900 + i, "never seen words " * 9) for i in range(20)] + EDGE
    table, held = docs(rows), (fold(7) == 2) | F.col("doc_id").between(900, 919)
    whole, small, none = ({(r.doc_id, r.n_tokens): r for r in lm_score.score(table, held, vocabulary=v).collect()} for v in (1_500_000, 20, 0))
    for k, r in whole.items():
        for s in (small[k], none[k]):
            assert s[:-1] == r[:-1] and abs(s.score - r.score) < 0.05 * r.n_tokens + 0.01  # a code's step


def plain_scores(rows, held):
    """log10 probabilities of all texts by a plain interpolated trigram model; a text's first word has no context but the start."""
    d, start, end = lm_score.DISCOUNT, "<start>", "<end>"
    steps = {}
    for i, (doc_id, t) in enumerate(rows):
        words = [start, *(w.decode("utf-8") for w in (t or "").encode().lower().split()), end]
        steps[i] = [(words[j - 1] if j else start, words[j], words[j + 1]) for j in range(len(words) - 1)]
    train = [x for i, (doc_id, _) in enumerate(rows) if not held(doc_id) for x in steps[i]]
    one, n = collections.Counter(w for _, _, w in train), len(train)
    two, after = collections.Counter((v, w) for _, v, w in train), collections.Counter(v for _, v, _ in train)
    tri, ctx = collections.Counter(x for x in train if x[1] != start), collections.Counter((u, v) for u, v, _ in train if v != start)
    kinds2, kinds3 = collections.Counter(v for v, _ in two), collections.Counter((u, v) for u, v, _ in tri)
    out = []
    for i in range(len(rows)):
        total = 0.0
        for u, v, w in steps[i]:
            p = (one[w] + 1) / (n + len(one) + 1)
            if after[v]:
                p = max(two[v, w] - d, 0) / after[v] + d * kinds2[v] / after[v] * p
            if ctx[u, v]:
                p = max(tri[u, v, w] - d, 0) / ctx[u, v] + d * kinds3[u, v] / ctx[u, v] * p
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("vocabulary, most, hot", [(1_500_000, 4_000_000, 256), (1_500_000, 6, 256), (12, 6, 3), (12, 4_000_000, 0)])
def test_scores_equal_a_plain_trigram_model(spark, docs, vocabulary, most, hot, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT", hot or 0.1)  # 0.1: no word is common
    rng = random.Random(16)
    words = ["the"] * 210 + [f"w{i}" for i in range(20)] + [f"w{i}" for i in range(400)]  # a third of all words is one
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(1, None), (2, ""), (3, "the"), (None, "the the the the w1 the"), (5, "the w1 the"), (5, "the w1 the"), (6, "new words after the new the w399")]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    want = collections.defaultdict(list)
    for (i, t), s in zip(rows, plain_scores(rows, held)):
        want[i, len((t or "").split()) + 1].append(s)
    got = lm_score.score(docs(rows), fold(7) == 2, vocabulary=vocabulary, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        s = want[r.doc_id, r.n_tokens].pop()
        assert abs(r.score - s) < 0.1 * r.n_tokens ** 0.5 + 0.05, (r, s)  # codes of a step of 12 / 255


def test_trie_equals_plain_counts():
    rng = np.random.default_rng(2)
    n, words, ids = 4000, 12, 30
    v, u, w = (rng.integers(0, k, n) for k in (words, ids, ids))
    prior = np.full(ids, 1 / ids)
    trie = lm_score.Trie(words, v, u, w, prior)
    ctx, tri = collections.Counter(zip(v, u)), collections.Counter(zip(v, u, w))
    one, two = collections.Counter(v), collections.Counter(zip(v, w))
    kinds2, kinds3 = collections.Counter(a for a, _ in two), collections.Counter((a, b) for a, b, _ in tri)
    d = lm_score.DISCOUNT
    av, au, aw = np.repeat(np.arange(words), ids * ids), np.tile(np.repeat(np.arange(ids), ids), words), np.tile(np.arange(ids), words * ids)
    got = trie.score(av, au, aw, np.log10(prior))
    for a, b, c, s in zip(av, au, aw, got):
        p = max(two[a, c] - d, 0) / one[a] + d * kinds2[a] / one[a] / ids
        if ctx[a, b]:
            p = max(tri[a, b, c] - d, 0) / ctx[a, b] + d * kinds3[a, b] / ctx[a, b] * p
        assert abs(math.log10(p) - s) < 0.1  # three codes of a step of 12 / 255 at most
    trie.close()


@pytest.mark.parametrize("top", [0, 5, 1 << 14, 1 << 40])
def test_elias_fano(top, monkeypatch):
    import tempfile
    rng = np.random.default_rng(1)
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    for n in (0, 1, 2, 64, 65, 1000):
        x = np.sort(rng.integers(0, top + 1, n))
        with tempfile.TemporaryFile() as f:
            f.write(b"before")
            level = lm_score.EliasFano(x, f)
            assert (level.decode() == x).all()
            at = rng.integers(0, n, 300) if n else np.zeros(0, np.int64)
            assert (level.get(at) == x[at]).all()
        single = np.unique(x)
        with tempfile.TemporaryFile() as f:
            level = lm_score.EliasFano(single, f)
            asked = np.r_[single, single + 1, rng.integers(0, top + 2, 50), -1, top + 1]
            place = {int(y): i for i, y in enumerate(single)}
            assert level.find(asked).tolist() == [place.get(int(y), -1) for y in asked]


def test_model_beats_base_held_out(spark, sf):
    r = queries.op8_elias_fano_lm(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
