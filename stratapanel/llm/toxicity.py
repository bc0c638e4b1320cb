"""Toxicity by a weighted finite-state grammar of clauses.

Words are read as symbols: insult, threat, target, negation, report, other. Three transducers are composed into one machine:
negation turns insults in its scope into denied ones, reported speech (a verb of saying, or quotes) weakens what follows in its
clause, and the target transducer raises insults and threats that meet a target on either side. The machine's path weight times
the word's own weight, summed over a clause, is the clause's score; a document is known by its clauses' sum, its worst clause and
its sum per hundred words, and a logistic fit turns these three into a score.

Insults are a short fixed list and stems (words and word beginnings of 3 to 12 letters) learned from labels: the documents of each
kind that hold a stem are counted by Spark, and a stem stays if its log-likelihood ratio is beyond what the number of stems makes
likely by chance, also without the documents of any longer stem that continues it. A word takes the stem of the largest ratio. While fitting, a document's own label is taken out of the counts, so
stems that only it holds tell nothing.

Fit on at most ``fit_rows`` labelled documents, those of the smallest hashes of their ids, and at most ``most_stems`` stems;
everything else covers all rows and whole texts. Null and empty texts have no clause and the lowest score. Labels that occur several
times for an id count as 1 if any is 1; null labels are left out. Null or repeated ids keep their rows. Without labels of both
kinds the fixed list and fixed coefficients score. Columns other than ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import flushed, staged, task, texts

# Small word lists of the grammar in English, German, French and Spanish
INSULTS = """idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool fools jerk
 creep vermin filthy ugly dummkopf idiotisch abschaum wertlos widerlich dumm blöd versager imbécile crétin ordure minable stupide débile
 pourriture idiota imbécil estúpido estúpida basura escoria patético inútil asqueroso tonto""".split()
THREATS = """kill hurt destroy murder beat burn crush stab shoot punish töten umbringen vernichten zerstören schlagen tuer détruire frapper
 brûler matar destruir golpear quemar""".split()
TARGETS = """you your yours youre he she they them him her their people everyone du dich dir ihr euch sie dein deine tu toi te vous votre ils elles
 eux tú ti usted ustedes vosotros ellos ellas""".split()
NEGATIONS = "not no never none isnt arent dont wasnt nicht kein keine niemals nie ne pas jamais aucun nunca jamás ningún sin".split()
REPORTS = """said says say called calls claimed claims wrote alleged quoted told sagte sagt nannte behauptet schrieb dit disait appelle prétend
 écrit dijo dice llamó afirma escribió""".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP, LINE, DENIED, EXTRA = range(11)
SPECIAL = {**dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT), **dict.fromkeys(THREATS, THREAT),
           **dict.fromkeys('"“”„«»', QUOTE), **dict.fromkeys(".!?;…", STOP), "\n": LINE}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;…\n\"“”„«»]")
SHORT, LONG = 3, 12        # letters of a stem
HELD = 150_000             # stems that a task holds before it passes them on
SEED_DOCS = 4.0            # toxic documents that a word of the fixed list brings along
START = np.array([-3.5, 1.5, 0.5, 0.5])   # coefficients before any label: constant, log of the sum, worst clause, log of the density
COUNTS = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
MEASURES = pa.schema([("toxic", pa.int64()), ("total", pa.float64()), ("worst", pa.float64()), ("density", pa.float64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.int64()), ("worst", pa.float64())])


class Transducer:
    """A deterministic weighted transducer: arcs (state, symbol) -> (state, symbol out, weight); other symbols pass unchanged."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input, weights multiply. Only states that can be reached."""
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            s = todo.pop()
            for symbol in range(EXTRA + 1):
                a, middle, w = self.step(s[0], symbol)
                b, out, v = other.step(s[1], middle)
                arcs[s, symbol] = ((a, b), out, w * v)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(arcs, start)


def negation(scope: int = 3, weight: float = 0.2) -> Transducer:
    """State: words that the last negation still reaches."""
    arcs = {}
    for s in range(scope + 1):
        arcs[s, NEGATION] = (scope, NEGATION, 1.0)
        for stop in (STOP, LINE):
            arcs[s, stop] = (0, stop, 1.0)
        if s:
            for x in (OTHER, TARGET, REPORT):
                arcs[s, x] = (s - 1, x, 1.0)
            for x in (INSULT, THREAT):
                arcs[s, x] = (s - 1, DENIED, weight)
    return Transducer(arcs)


def reported(weight: float = 0.5) -> Transducer:
    """States: own words, after a verb of saying (to the clause's end), in quotes (to the line's end)."""
    arcs = {(0, REPORT): (1, REPORT, 1.0), (0, QUOTE): (2, QUOTE, 1.0), (1, QUOTE): (2, QUOTE, 1.0), (2, QUOTE): (0, QUOTE, 1.0), (1, STOP): (0, STOP, 1.0)}
    for s in range(3):
        arcs[s, LINE] = (0, LINE, 1.0)
        if s:
            arcs |= {(s, x): (s, x, weight) for x in (INSULT, THREAT, DENIED)}
    return Transducer(arcs)


def targeted(raised: float = 1.5, bare_threat: float = 0.3) -> Transducer:
    """States: nothing yet, a target, an insult without one, a threat without one. A late target gives an extra of its own."""
    arcs = {(0, TARGET): (1, TARGET, 1.0), (1, INSULT): (1, INSULT, raised), (1, THREAT): (1, THREAT, raised),
            (0, INSULT): (2, INSULT, 1.0), (2, THREAT): (2, THREAT, 1.0), (3, INSULT): (2, INSULT, 1.0),
            (0, THREAT): (3, THREAT, bare_threat), (3, THREAT): (3, THREAT, bare_threat),
            (2, TARGET): (1, EXTRA, raised - 1.0), (3, TARGET): (1, EXTRA, raised - bare_threat)}
    for s in range(4):
        for stop in (STOP, LINE):
            arcs[s, stop] = (0, stop, 1.0)
    return Transducer(arcs)


def grammar() -> tuple[list[list[tuple[int, int, float]]], int]:
    """The composed machine with numbered states, as rows of arcs by symbol."""
    m = negation().then(reported()).then(targeted())
    number = {m.start: 0}
    for s, _ in m.arcs:
        number.setdefault(s, len(number))
    table = [[(0, 0, 1.0)] * (EXTRA + 1) for _ in number]
    for (s, symbol), (to, out, w) in m.arcs.items():
        table[number[s]][symbol] = (number[to], out, w)
    return table, 0


MACHINE, BEGIN = grammar()


def clauses(symbols: list[tuple[int, int, float]]) -> list[float]:
    """Scores of the clauses with a match. ``symbols``: (place, symbol, weight) of all words but others, in order."""
    state, last, now, out = BEGIN, -1, None, []
    weight = 1.0
    for place, symbol, w in symbols:
        for _ in range(min(place - last - 1, len(MACHINE))):   # others between; beyond the number of states nothing moves
            after = MACHINE[state][OTHER][0]
            if after == state:
                break
            state = after
        last = place
        state, kind, path = MACHINE[state][symbol]
        if kind in (INSULT, THREAT, DENIED):
            now, weight = (now or 0.0) + w * path, w
        elif kind == EXTRA and now is not None:
            now += path * weight    # the match before meets its target
        elif kind in (STOP, LINE) and now is not None:
            out.append(now)
            now = None
    return out if now is None else [*out, now]


def stems(word: str) -> list[str]:
    """Beginnings and the whole word, which ends with a space."""
    return [word[:n] for n in range(SHORT, min(len(word), LONG) + 1)] + [word + " "]


def ratio(a: float, b: float, toxic: float, clean: float) -> float:
    """Signed log-likelihood ratio of a stem in a of the toxic and b of the clean documents."""
    n, e = a + b, toxic / (toxic + clean)
    g = 2 * sum(x * math.log(x / (n * s)) for x, s in ((a, e), (b, 1 - e)) if x)
    return g if a * clean > b * toxic else -g


def own_stems(found: dict[str, tuple[int, int]], toxic: int, clean: int, bound: float, least: float) -> dict[str, tuple[int, int]]:
    """Stems that tell something beside the stem that continues them: without its documents they are still beyond the bounds."""
    longer: dict[str, tuple[int, int]] = {}
    for s, v in found.items():
        for n in range(SHORT, len(s)):
            if v > longer.get(s[:n], (0, 0)):
                longer[s[:n]] = v
    out = {}
    for s, (a, b) in found.items():
        x, y = longer.get(s, (0, 0))
        x, y = a - x, max(0, b - y)
        if x > 0 and x * clean > y * toxic * least and ratio(x, y, toxic, clean) > bound:
            out[s] = (a, b)
    return out


class Lexicon(dict):
    """Words as (symbol, toxic documents, clean documents); learned as words are met."""

    def __init__(self, learned: dict[str, tuple[int, int]], toxic: int, clean: int):
        super().__init__({w: (s, 0.0, 0.0) for w, s in SPECIAL.items()})
        self.learned, self.toxic, self.clean = learned, toxic, clean
        self.least = min((ratio(*v, toxic, clean) for v in learned.values()), default=math.inf)
        for w in INSULTS:
            a, b = learned.get(w + " ", (0, 0))
            self[w] = (INSULT, a + SEED_DOCS, float(b))

    def __missing__(self, word: str):
        best, found = 0.0, None
        for s in stems(word):
            v = self.learned.get(s)
            if v:
                g = ratio(*v, self.toxic, self.clean)
                if g > best:
                    best, found = g, v
        out = (INSULT, *map(float, found)) if found else None
        if len(self) > 200_000:   # forget met words, not learned ones
            for w in [w for w in self if w not in SPECIAL and w not in INSULTS]:
                del self[w]
        self[word] = out
        return out

    def weight(self, symbol: int, a: float, b: float, own: int | None) -> float:
        """Log of how much likelier a toxic document holds the stem; ``own`` is the label of the document that is read."""
        if symbol == THREAT:
            return 1.0
        if symbol != INSULT:
            return 0.0
        t, c = self.toxic, self.clean
        if own is not None:
            a, b, t, c = a - own, max(0.0, b - (1 - own)), t - own, c - (1 - own)   # a fixed word may be no learned stem
        if a <= 0 or (own and not a + b < SEED_DOCS + 1 and ratio(a, b, t + 1, c + 1) < self.least * 0.8):
            return 0.0
        return max(0.0, math.log((a + 0.25) / (t + 1) * (c + 1) / (b + 0.25)))


def measure(text: bytes, lexicon: Lexicon, own: int | None = None) -> tuple[float, float, float, int]:
    """(sum, worst clause, sum per hundred words, clauses that match)."""
    words = TOKEN.findall(text.decode("utf-8", "replace").lower())
    marked = [(i, v) for i, v in enumerate(map(lexicon.__getitem__, words)) if v]
    if not any(v[0] in (INSULT, THREAT) for _, v in marked):
        return 0.0, 0.0, 0.0, 0
    found = clauses([(i, s, lexicon.weight(s, a, b, own)) for i, (s, a, b) in marked])
    total = sum(found)
    return total, max(found, default=0.0), 100 * total / len(words), sum(x > 0 for x in found)


def counted(batches):
    """Documents of each kind by stem, over (text, toxic) rows."""
    kept: dict[str, list[int]] = {}
    for y, t in texts(batches, "toxic"):
        words = set(TOKEN.findall(t.decode("utf-8", "replace").lower()))
        for s in {s for w in words if w not in SPECIAL for s in stems(w)}:
            c = kept.get(s)
            if c is None:
                c = kept[s] = [0, 0]
            c[1 - y] += 1
        if len(kept) >= HELD:
            yield from flushed(((s, *c) for s, c in kept.items()), COUNTS, 50_000)
            kept = {}
    yield from flushed(((s, *c) for s, c in kept.items()), COUNTS, 50_000)


def measured(batches, learned, toxic, clean):
    lexicon = Lexicon(learned, toxic, clean)
    yield from flushed(((y, *measure(t, lexicon, y)[:3]) for y, t in texts(batches, "toxic")), MEASURES)


def design(total, worst, density) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(worst), np.log1p(density)], 1)


def scored(batches, learned, toxic, clean, beta):
    lexicon = Lexicon(learned, toxic, clean)

    def out():
        for i, t in texts(batches, "doc_id"):
            total, worst, density, n = measure(t, lexicon)
            z = float((design(np.array([total]), np.array([worst]), np.array([density])) @ np.array(beta))[0])
            yield i, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n, worst

    yield from flushed(out(), SCORES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton steps, held near ``START`` by ``ridge``."""
    beta = START.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * (beta - START))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int, most_stems: int, ratio_least: float) -> dict:
    """What ``scored`` needs."""
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(fit_rows)
    # at most fit_rows pairs of numbers, so the texts stay where they are
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled")
    sizes = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, clean = sizes[0] or 0, sizes[1] or 0
    if not toxic or not clean:
        return {"learned": {}, "toxic": 0, "clean": 0, "beta": START.tolist()}
    counts = rows.mapInArrow(task("toxicity", "counted"), "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
    counts = staged(counts, "stems")
    bound = 2 * math.log(max(counts.count(), 2)) + 2.0
    a, b, e = F.col("a"), F.col("b"), toxic / (toxic + clean)
    n = a + b
    g = 2 * (a * F.log(a / (n * e)) + F.when(b > 0, b * F.log(b / (n * (1 - e)))).otherwise(0.0))
    strong = counts.withColumn("g", g).where((a * F.lit(clean) > b * F.lit(toxic) * ratio_least) & (F.col("g") > bound))
    learned = {r.stem: (r.a, r.b) for r in strong.orderBy(F.desc("g"), "stem").limit(most_stems).collect()}
    learned = own_stems(learned, toxic, clean, bound, ratio_least)
    model = {"learned": learned, "toxic": toxic, "clean": clean}
    m = rows.mapInArrow(task("toxicity", "measured", **model), "toxic long, total double, worst double, density double").toPandas()   # fit_rows at most
    return model | {"beta": logistic(design(*(m[c].to_numpy() for c in ("total", "worst", "density"))), m["toxic"].to_numpy(float)).tolist()}


def score(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, least: float = 0.3, fit_rows: int = 100_000,
          most_stems: int = 5_000, ratio_least: float = 10.0) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses, worst) of each row of ``docs``. Learns from rows of ``labels`` (doc_id, toxic)
    where ``train`` holds on doc_id; stems must be ``ratio_least`` times as frequent in toxic documents."""
    model = fit(docs, labels, train, fit_rows, most_stems, ratio_least)
    out = docs.select("doc_id", "text").mapInArrow(task("toxicity", "scored", **model), "doc_id long, score double, clauses long, worst double")
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).cast("int").alias("predicted"), "clauses", "worst")
