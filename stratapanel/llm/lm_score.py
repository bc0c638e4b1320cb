"""Language-model scores from Elias-Fano n-gram tries.

A trigram model is spread over buckets by the word before the predicted one: all n-grams u v w of a word v meet in the
bucket of v, are counted there over the training documents, become a trie, and every occurrence (of any document) is scored
against it. One exchange of packed occurrences carries both; what comes back are sums for each document of a chunk.

A trie has compact levels in one memory-mapped file: Elias-Fano sequences of the words v, of their successors w, of the
longer contexts (v, u) and, relative to the context, of the ranks of w among the successors of v; monotone pointers; and
smoothed probabilities quantised to a byte. A query finds w among v's successors, then that rank below (v, u), by successor
search in the decoded blocks of a level; what is missing backs off with its context's weight.

The ``vocabulary`` most frequent words (a fixed bound of what is broadcast) travel by number, all others by their hash, so
every word stays itself as u, v and w. What a bucket does not know is how often such a w occurs in all: a prediction is linear
in that, so its two terms go on to the bucket of w, where the vocabulary's counts close it.

A common word v (over 1 / ``HOT`` of all tokens, or over ``most`` occurrences) would be too much for a bucket: its occurrences
are spread by (v, u), where the trigrams below that context are whole. A prediction is linear in the shorter one, p(w | v), so
its two terms go on to the bucket of the pair (v, w), which counts the pair; how many different w follow v is counted over all
pairs before. The model is the same as for other words. A document's start is such a word without a u before it.

Null text is empty: one end token. Null and repeated ids keep their rows. Without training rows every count is 0.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged, task, texts, trim
from .ngram_join import from_six, mixed, record, runs, six

FLUSH, DOCS, HOT, ASKED, BLOCK, DISCOUNT, FLOOR = 1_000_000, 32_000, 256, 400_000, 8192, 0.75, -12.0
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
NONE = 255  # the code of a probability of 0
ID = np.uint64((1 << 21) - 1)
COUNTS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("ends", pa.int64())])
COUNTS_SQL = "bucket int, words binary, counts binary, n long, ends long"
EVENTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int32()), ("held_out", pa.bool_()), ("n", pa.int64()),
                    ("words", pa.binary()), ("counts", pa.binary()), ("body", pa.binary()), ("rare", pa.binary())])
EVENTS_SQL = "bucket int, chunk long, doc_id long, idx int, held_out boolean, n long, words binary, counts binary, body binary, rare binary"
PAIRS = pa.schema([("bucket", pa.int32()), ("listed", pa.binary()), ("rare", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                 ("base_score", pa.float64()), ("score", pa.float64())])


def hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)


# --- vocabulary ----------------------------------------------------------------------------------------------------
def words_of(batches, buckets: int):
    """Word counts of the training documents, a packed row for each flush and bucket."""
    kept, size, ends = [], 0, 0

    def flush():
        h = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
        u, c = np.unique(h, return_counts=True)
        b = buckets_of(u, buckets)  # grows with the hash
        edge = np.searchsorted(b, np.arange(buckets + 1))
        got = [k for k in range(buckets) if edge[k + 1] > edge[k]]
        if got:
            yield record(COUNTS, bucket=got, words=[u[edge[k]:edge[k + 1]].tobytes() for k in got], counts=[c[edge[k]:edge[k + 1]].astype("<u4").tobytes() for k in got],
                         n=[int(c[edge[k]:edge[k + 1]].sum()) for k in got], ends=[0] * len(got))

    for held_out, text in texts(batches, "held_out"):
        if held_out:
            continue
        h = hashes(text)
        kept.append(h)
        size += len(h)
        ends += 1
        if size >= FLUSH:
            yield from flush()
            kept, size = [], 0
    yield from flush()
    yield record(COUNTS, bucket=[0], n=[0], ends=[ends])


def words_added(batches):
    for bucket, rows in runs(batches, "bucket"):
        ends = sum(r["ends"] for r in rows)
        rows = [r for r in rows if r["words"]]
        h = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
        c = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]) if rows else np.zeros(0)
        u, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, c).astype("<u8") if len(u) else np.zeros(0, "<u8")
        yield record(COUNTS, bucket=[bucket], words=[u.tobytes()], counts=[total.tobytes()], n=[int(total.sum())], ends=[ends])


def tallied(batches):
    """How many words have each count; counts beyond 1000 are given by their powers of two."""
    schema = pa.schema([("c", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])
    for b in batches:
        for counts in b.column(b.schema.get_field_index("counts")):
            c = np.frombuffer(counts.as_py(), "<u8").astype(np.int64)
            g = np.where(c <= 1000, c, 1 << np.frexp(c.astype(np.float64))[1].astype(np.int64) - 1)
            u, at, k = np.unique(g, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(k), pa.array(np.bincount(at, c, len(u)).astype(np.int64))], schema=schema)


def frequent(batches, least: int):
    schema = pa.schema([("words", pa.binary()), ("counts", pa.binary())])
    for b in batches:
        for w, c in zip(b.column(b.schema.get_field_index("words")), b.column(b.schema.get_field_index("counts"))):
            h, n = np.frombuffer(w.as_py(), np.uint64), np.frombuffer(c.as_py(), "<u8")
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()]), pa.array([n[keep].astype("<u8").tobytes()])], schema=schema)


# --- occurrences ---------------------------------------------------------------------------------------------------
START_HASH = np.uint64(0x5BD1E9955BD1E995)


def occurrences(batches, buckets: int, head: bytes, hot: bytes):
    """Rows of documents, and for each chunk and bucket the packed occurrences (u, w, training, document) by word v; with them
    the hashes of those u, then of those w, that have no number."""
    from pyspark import TaskContext
    base, seq, size = TaskContext.get().partitionId() << 32, 0, 0
    known = np.frombuffer(head, np.uint64)
    spread = np.frombuffer(hot, np.uint64)
    pack = zstandard.ZstdCompressor(level=1)
    docs, kept = [], []

    def flush():
        yield record(EVENTS, bucket=[i % buckets for i in range(len(docs))], chunk=[base + seq] * len(docs), doc_id=[d[0] for d in docs],
                     idx=list(range(len(docs))), held_out=[d[1] for d in docs], n=[len(h) + 1 for h in kept])
        # each document: its start, then its words
        lengths = np.array([len(h) + 1 for h in kept])
        begin = np.cumsum(lengths) - lengths
        v = np.empty(int(lengths.sum()), np.uint64)
        word = np.ones(len(v), bool)
        word[begin] = False
        v[begin] = START_HASH
        v[word] = np.concatenate(kept)
        u, where = np.unique(v, return_inverse=True)
        at = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
        of = np.where(known[at] == u, at + FIRST, UNKNOWN) if len(known) else np.zeros(len(u), np.int64)
        of[u == START_HASH] = START
        ident = of[where].astype(np.uint64)
        before = np.r_[np.uint64(START), ident[:-1]]
        before[begin] = START
        after = np.r_[ident[1:], np.uint64(END)]
        after[begin[1:] - 1] = END
        u_hash, w_hash = np.r_[START_HASH, v[:-1]], np.r_[v[1:], START_HASH]  # read only where a word has no number
        doc = np.repeat(np.arange(len(kept), dtype=np.uint64), lengths)
        train = np.repeat(np.array([not d[1] for d in docs]), lengths).astype(np.uint64)
        event = before << np.uint64(37) | after << np.uint64(16) | train << np.uint64(15) | doc
        bucket = buckets_of(mixed(v), buckets)
        for far, other, other_hash in ((np.isin(v, spread), before, u_hash), (v == START_HASH, after, w_hash)):
            bucket[far] = buckets_of(mixed(v[far] + mixed(np.where(other[far] == UNKNOWN, other_hash[far], other[far] + np.uint64(1)))), buckets)
        order = np.lexsort((event, v, bucket))
        v, event, bucket = v[order], event[order], bucket[order]
        no_u, no_w = np.flatnonzero(before[order] == UNKNOWN), np.flatnonzero(after[order] == UNKNOWN)
        u_hash, w_hash = u_hash[order[no_u]], w_hash[order[no_w]]
        new = np.r_[True, (v[1:] != v[:-1]) | (bucket[1:] != bucket[:-1])]
        head_at = np.flatnonzero(new)
        n = np.diff(np.r_[head_at, len(v)]).astype("<u4")
        hb = bucket[head_at]
        edge = np.searchsorted(hb, np.arange(buckets + 1))
        got = [k for k in range(buckets) if edge[k + 1] > edge[k]]
        for i in range(0, len(got), 64):
            spans = [(k, edge[k], edge[k + 1], head_at[edge[k]], head_at[edge[k + 1]] if edge[k + 1] < len(head_at) else len(v)) for k in got[i:i + 64]]
            planes = [np.ascontiguousarray(event[x:y].astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for _, _, _, x, y in spans]
            rare = [b"".join(h[slice(*np.searchsorted(no, (x, y)))].tobytes() for no, h in ((no_u, u_hash), (no_w, w_hash))) for _, _, _, x, y in spans]
            yield record(EVENTS, bucket=[s[0] for s in spans], chunk=[base + seq] * len(spans), words=[v[head_at[a:b]].tobytes() for _, a, b, _, _ in spans],
                         counts=[n[a:b].tobytes() for _, a, b, _, _ in spans], body=[pack.compress(p) for p in planes], rare=rare)

    for doc_id, held_out, text in texts(batches, "doc_id", "held_out"):
        docs.append((doc_id, held_out))
        kept.append(hashes(text))
        size += len(kept[-1])
        if size >= FLUSH or len(docs) >= DOCS:
            yield from flush()
            seq, size, docs, kept = seq + 1, 0, [], []
    if docs:
        yield from flush()


# --- the trie ------------------------------------------------------------------------------------------------------
class EliasFano:
    """A non-decreasing sequence: low bytes plain, high parts in unary, in a file that is mapped into memory. Of every ``BLOCK``
    values the first and its bit are kept as samples; questions are sorted, and a block is decoded while it answers its own."""

    def __init__(self, values: np.ndarray, file):
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low = next(b for b in range(9) if top >> 8 * b <= 8 * n + 8)
        raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.low])
        high = (values.astype(np.uint64) >> np.uint64(8 * self.low)).astype(np.int64) if self.low < 8 else np.zeros(n, np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, bool)
        bits[high + np.arange(n)] = True
        self.first = values[::BLOCK].astype(np.int64)
        self.bit = np.r_[(high + np.arange(n))[::BLOCK], len(bits)]
        self.at, self.file, self.data = file.seek(0, os.SEEK_END), file, None
        file.write(raw.tobytes())
        file.write(np.packbits(bits).tobytes())

    def block(self, k: int) -> np.ndarray:
        """The values from k * BLOCK on."""
        if self.data is None:
            self.file.flush()
            self.data = np.asarray(np.memmap(self.file, np.uint8, "r", self.at, self.n * self.low + (int(self.bit[-1]) + 7) // 8))
        a, b = k * BLOCK, min(self.n, (k + 1) * BLOCK)
        x, y = int(self.bit[k]), int(self.bit[k + 1])
        bits = np.unpackbits(self.data[self.n * self.low + x // 8:self.n * self.low + (y + 7) // 8])[x % 8:x % 8 + y - x]
        high = np.flatnonzero(bits) + (x - np.arange(a, b))
        raw = np.zeros((b - a, 8), np.uint8)
        raw[:, :self.low] = self.data[a * self.low:b * self.low].reshape(b - a, self.low)
        return raw.view("<u8").ravel().astype(np.int64) + (high << 8 * self.low if self.low < 8 else 0)

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self.block(k) for k in range(len(self.first)))])

    def visits(self, asked: np.ndarray, marks: np.ndarray):
        """Blocks with the places in ``asked`` of the questions from their mark up to the next one."""
        order = np.argsort(asked)
        edges = np.r_[np.searchsorted(asked[order], marks), len(asked)]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield k, self.block(k), order[edges[k]:edges[k + 1]]

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Where each asked value stands, -1 where it doesn't: its successor's place, if equal."""
        out = np.full(len(asked), -1)
        for k, level, places in self.visits(asked, self.first):
            value = asked[places]
            at = np.searchsorted(level, value)
            at[at == len(level)] = 0
            out[places] = np.where(level[at] == value, at + k * BLOCK, -1)
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``."""
        out = np.empty(len(index), np.int64)
        for k, level, places in self.visits(index, np.arange(0, self.n, BLOCK)):
            out[places] = level[index[places] - k * BLOCK]
        return out


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logs / FLOOR, 0, 1) * 255).astype(np.uint8)


def opened(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (FLOOR / 255)


class Trie:
    """The n-grams of a bucket's words v (0 ... words - 1) from training occurrences (v, u, w); u and w number into ``prior``,
    which is 0 where only the bucket of w knows it. Of a word in ``open_words`` the bucket has whole contexts (v, u) only, so
    the shorter prediction is left out of its longer ones."""

    def __init__(self, words: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, prior: np.ndarray, open_words: np.ndarray | None = None):
        self.file = tempfile.TemporaryFile()
        self.span = span = np.int64(len(prior))
        pairs, pair_of, pair_n = np.unique(v * span + w, return_inverse=True, return_counts=True)
        pair_of = pair_of.astype(np.int32)
        longer, longer_of, longer_n = np.unique(v * span + u, return_inverse=True, return_counts=True)
        longer_of = longer_of.astype(np.int32)
        pv, pw = pairs // span, pairs % span
        total = np.bincount(v, minlength=words)
        kinds = np.bincount(pv, minlength=words)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p2 = (pair_n - DISCOUNT) / total[pv] + back[pv] * prior[pw] if len(pairs) else np.zeros(0)
        if open_words is not None:
            p2[open_words[pv]] = 0
        begin = np.r_[0, np.cumsum(kinds)]
        lv = longer // span
        offset = np.r_[0, np.cumsum(kinds[lv])]  # where the ranks below a longer context begin
        tri, tri_n = np.unique(offset[longer_of] + pair_of - begin[v], return_counts=True) if len(v) else (np.zeros(0, np.int64), np.zeros(0))
        del pair_of, longer_of
        ctx = np.searchsorted(offset, tri, "right") - 1
        third = np.bincount(ctx, minlength=len(longer))
        back3 = DISCOUNT * third / np.maximum(longer_n, 1)
        p3 = (tri_n - DISCOUNT) / longer_n[ctx] + back3[ctx] * p2[begin[lv[ctx]] + tri - offset[ctx]] if len(tri) else np.zeros(0)
        self.pairs, self.longer, self.tri = EliasFano(pairs, self.file), EliasFano(longer, self.file), EliasFano(tri, self.file)
        self.begin, self.offset = EliasFano(begin, self.file), EliasFano(offset, self.file)
        with np.errstate(divide="ignore"):
            self.codes = [quantised(np.log10(x)) for x in (p2, p3, back, back3)]

    def score(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
        """Logs of the predictions (v, u, w), a block of questions at a time."""
        p2, p3, back, back3 = self.codes
        out = np.empty(len(v), np.float32)
        for part, at, ctx, third in self.places(v, u, w):
            logs = opened(back[v[part]]) + log_prior[w[part]]
            logs[at >= 0] = opened(p2[at[at >= 0]])
            shorter = (ctx >= 0) & (third < 0)
            logs[shorter] += opened(back3[ctx[shorter]])
            logs[third >= 0] = opened(p3[third[third >= 0]])
            out[part] = logs
        return out

    def parts(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the terms a, b of the predictions a + b p(w | v) of open words; ``NONE`` where a is 0."""
        _, p3, _, back3 = self.codes
        a, b = np.full(len(v), NONE, np.uint8), np.zeros(len(v), np.uint8)
        for part, _, ctx, third in self.places(v, u, w):
            b[part][ctx >= 0] = back3[ctx[ctx >= 0]]
            a[part][third >= 0] = p3[third[third >= 0]]
        return a, b

    def places(self, v: np.ndarray, u: np.ndarray, w: np.ndarray):
        """Blocks of questions, and where their pairs, contexts and trigrams stand in the levels, or -1."""
        for i in range(0, len(v), ASKED):
            part = slice(i, min(i + ASKED, len(v)))
            at, ctx = self.pairs.find(v[part] * self.span + w[part]), self.longer.find(v[part] * self.span + u[part])
            inner = np.flatnonzero((at >= 0) & (ctx >= 0))
            third = np.full(len(at), -1)
            third[inner] = self.tri.find(self.offset.get(ctx[inner]) + at[inner] - self.begin.get(v[part][inner]))
            yield part, at, ctx, third

    def weights(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Logs of the weight of a word's own probability in the predictions after (v, u)."""
        _, _, back, back3 = self.codes
        ctx = self.longer.find(v * self.span + u)
        return opened(back[v]) + np.where(ctx >= 0, opened(back3[ctx]) if len(back3) else 0.0, 0.0)

    def close(self) -> None:
        self.file.close()


def deferred(h: np.ndarray, held: np.ndarray, weight: np.ndarray, chunk: np.ndarray, doc: np.ndarray, buckets: int):
    """Rows of predictions held + weight * p1(h) for the buckets of their words h."""
    bucket = buckets_of(h, buckets)
    order = np.lexsort((chunk, bucket))
    bucket = bucket[order]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(h)]
    for i in range(0, len(edges) - 1, 64):
        spans = [order[a:b] for a, b in zip(edges[i:i + 64], edges[i + 1:i + 65])]
        yield record(EVENTS, bucket=[bucket[a] for a in edges[i:i + 64][:len(spans)]], words=[h[s].tobytes() for s in spans],
                     counts=[chunk[s].astype("<i8").tobytes() + doc[s].astype("<u2").tobytes() for s in spans],
                     body=[held[s].astype("<f4").tobytes() + weight[s].astype("<f4").tobytes() for s in spans])


def handed_on(v: np.ndarray, w: np.ndarray, w_hash: np.ndarray, train: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: np.ndarray, doc: np.ndarray, buckets: int):
    """Rows of predictions a + b p(w | v) after common words v for the buckets of their pairs: those of w where it has no number
    (``w_hash`` is read there only). Each row has its chunks with their lengths and, byte by byte, pair, training, a, b, document."""
    pack = zstandard.ZstdCompressor(level=1)
    v, w = v.astype(np.uint64), w.astype(np.uint64)
    bucket = buckets_of(np.where(w == UNKNOWN, w_hash, mixed(v + mixed(w + np.uint64(1)))), buckets)
    key = train.astype(np.uint64) << np.uint64(42) | v << np.uint64(21) | w
    order = np.lexsort((key, chunk, bucket))
    bucket, key, chunk, w_hash = bucket[order], key[order].astype("<u8"), chunk[order], w_hash[order]
    rest = np.column_stack([a[order], b[order], doc[order].astype("<u2").view(np.uint8).reshape(-1, 2)])
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
    for i in range(0, len(edges) - 1, 64):
        spans = [slice(x, y) for x, y in zip(edges[i:i + 64], edges[i + 1:i + 65])]
        chunks = [np.unique(chunk[s], return_counts=True) for s in spans]
        yield record(EVENTS, bucket=[bucket[s.start] for s in spans], idx=[-2] * len(spans), n=[len(c) for c, _ in chunks],
                     counts=[c.astype("<i8").tobytes() + m.astype("<u4").tobytes() for c, m in chunks],
                     body=[pack.compress(np.column_stack([key[s].view(np.uint8).reshape(-1, 8)[:, :6], rest[s]]).T.tobytes()) for s in spans],
                     rare=[w_hash[s][key[s] & ID == UNKNOWN].tobytes() for s in spans])


def handed(body: bytes) -> tuple[np.ndarray, ...]:
    """(v, w, training, a, b, document) of such a row."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(10, -1)
    key = from_six(np.ascontiguousarray(planes[:6].T).tobytes())
    doc = np.ascontiguousarray(planes[8:].T).view("<u2").ravel()
    return (key >> np.uint64(21) & ID).astype(np.int64), (key & ID).astype(np.int64), key >> np.uint64(42) == 1, planes[6], planes[7], doc


def met(batches):
    """The different training pairs (v, w) of each row handed on: numbered ones as sorted steps, others as v and the hash of w."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for r in batch.to_pylist():
            v, w, train, *_ = handed(r["body"])
            listed = np.unique((v << 21 | w)[train & (w != UNKNOWN)]).astype("<u8")
            steps = np.diff(listed, prepend=np.uint64(0))
            rare = np.unique(np.column_stack([v[w == UNKNOWN].astype("<u8"), np.frombuffer(r["rare"], "<u8")])[train[w == UNKNOWN]], axis=0)
            yield record(PAIRS, bucket=[r["bucket"]], listed=[pack.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())], rare=[rare.tobytes()])


def kinds_met(batches):
    """How many different w each v has in a bucket of pairs."""
    unpack = zstandard.ZstdDecompressor()
    for _, rows in runs(batches, "bucket"):
        steps = [np.ascontiguousarray(np.frombuffer(unpack.decompress(r["listed"]), np.uint8).reshape(8, -1).T).view("<u8").ravel() for r in rows]
        listed = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps])) >> np.uint64(21)
        rare = np.unique(np.concatenate([np.frombuffer(r["rare"], "<u8").reshape(-1, 2) for r in rows]), axis=0)[:, 0]
        v, k = np.unique(np.r_[listed, rare].astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(k.astype(np.int64))], names=["v", "k"])


def paired(rows: list[dict], count, prior: np.ndarray, common: np.ndarray, totals: np.ndarray, kinds: np.ndarray, share: float):
    """Chunks, documents and logs of the predictions handed on to a bucket; ``count`` gives those of words without a number."""
    v, w, train, a, b, doc = map(np.concatenate, zip(*(handed(r["body"]) for r in rows)))
    unlisted, of = np.unique(np.frombuffer(b"".join(r["rare"] for r in rows), np.uint64), return_inverse=True)
    w[w == UNKNOWN] = len(prior) + of
    p1 = np.r_[prior, (count(unlisted) + 1) / share]
    pairs, at = np.unique(np.searchsorted(common, v) * len(p1) + w, return_inverse=True)
    n = np.bincount(at, train, len(pairs))
    pv, p = pairs // len(p1), p1[pairs % len(p1)]
    p2 = np.where(totals[pv] > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[pv] * p) / np.maximum(totals[pv], 1), p)
    logs = np.log10(np.where(a == NONE, 0.0, 10 ** opened(a)) + 10 ** opened(b) * p2[at])
    chunks = [np.repeat(np.frombuffer(r["counts"][:8 * r["n"]], "<i8"), np.frombuffer(r["counts"][8 * r["n"]:], "<u4")) for r in rows]
    return np.concatenate(chunks), doc, logs


def closed(batches, share: float, prior: bytes, common: bytes, totals: bytes, kinds: bytes):
    """Of each bucket: the vocabulary's counts (idx -1) close the predictions that were handed on, for a word w (idx null) or a
    pair (idx -2); sums go to the chunks."""
    prior, common, totals, kinds = np.frombuffer(prior, np.float64), *(np.frombuffer(x, np.int64) for x in (common, totals, kinds))
    for bucket, rows in runs(batches, "bucket"):
        names = [np.frombuffer(r["words"], np.uint64) for r in rows if r["idx"] == -1]
        counts = [np.frombuffer(r["counts"], "<u8") for r in rows if r["idx"] == -1]
        pairs = [r for r in rows if r["idx"] == -2]
        rows = [r for r in rows if r["idx"] is None]

        def count(h):  # a bucket's words stand in one row, sorted
            if not names or not len(names[0]):
                return np.zeros(len(h))
            at = np.minimum(np.searchsorted(names[0], h), len(names[0]) - 1)
            return np.where(names[0][at] == h, counts[0][at], 0).astype(np.float64)

        found = [paired(pairs, count, prior, common, totals, kinds, share)] if pairs else []
        if rows:
            n = [len(r["words"]) // 8 for r in rows]
            held = np.concatenate([np.frombuffer(r["body"][:4 * m], "<f4") for r, m in zip(rows, n)]).astype(np.float64)
            weight = np.concatenate([np.frombuffer(r["body"][4 * m:], "<f4") for r, m in zip(rows, n)])
            found.append((np.concatenate([np.frombuffer(r["counts"][:8 * m], "<i8") for r, m in zip(rows, n)]),
                          np.concatenate([np.frombuffer(r["counts"][8 * m:], "<u2") for r, m in zip(rows, n)]),
                          np.log10(held + weight * ((count(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])) + 1) / share))))
            del held, weight
        pairs.clear()
        rows.clear()
        if not found:
            continue
        chunk, doc, logs = map(np.concatenate, zip(*found))
        found.clear()
        order = np.lexsort((logs, doc, chunk))  # sums don't depend on the order of arrival
        chunk, doc, logs = chunk[order], doc[order], logs[order]
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for i in range(0, len(edges) - 1, 64):
            out = []
            for a, b in zip(edges[i:i + 64], edges[i + 1:i + 65]):
                ids, of = np.unique(doc[a:b], return_inverse=True)
                out.append((chunk[a], ids.astype("<u2").tobytes(), bytes(4 * len(ids)), bytes(8 * len(ids)) + np.bincount(of, logs[a:b]).astype("<f4").tobytes()))
            to, ids, got, sums = zip(*out)
            yield record(EVENTS, bucket=[bucket] * len(to), chunk=to, words=ids, counts=got, body=sums)
        del chunk, doc, logs, order
        trim()


def summed(batches, prior: bytes, hot: bytes, hot_ids: bytes, hot_counts: bytes, starts: int, buckets: int):
    """Of each bucket: counts, trie and scores; sums for each chunk's documents go back, predictions of a word without a number
    or after a common word on to their buckets. Rows of documents pass."""
    numbers = len(prior) // 8
    spread, spread_id, spread_n = np.frombuffer(hot, np.uint64), np.frombuffer(hot_ids, np.int64), np.frombuffer(hot_counts, np.int64)
    unpack = zstandard.ZstdDecompressor()
    for bucket, held in runs(batches, "bucket"):
        docs = [r for r in held if r["words"] is None]
        if docs:
            yield record(EVENTS, **{f.name: [r[f.name] for r in docs] for f in EVENTS})
        rows = [r for r in held if r["words"] is not None]
        held.clear()
        if not rows:
            continue
        word = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
        times = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
        event = np.concatenate([np.ascontiguousarray(np.frombuffer(unpack.decompress(r["body"]), np.uint8).reshape(8, -1).T).view("<u8").ravel() for r in rows])
        names, v = np.unique(word, return_inverse=True)
        v = np.repeat(v.astype(np.int32), times)
        u, w = (event >> np.uint64(37)).astype(np.int32), (event >> np.uint64(16) & ID).astype(np.int32)
        train, doc = (event >> np.uint64(15) & np.uint64(1)).astype(bool), (event & np.uint64(0x7FFF)).astype(np.uint16)
        n = [int(np.frombuffer(r["counts"], "<u4").sum()) for r in rows]
        chunks = [r["chunk"] for r in rows]
        # words without a number get one here
        cut = 8 * np.add.reduceat(u == UNKNOWN, np.r_[0, np.cumsum(n)[:-1]])
        no_u, no_w = np.flatnonzero(u == UNKNOWN), np.flatnonzero(w == UNKNOWN)
        rare = np.frombuffer(b"".join(r["rare"][:c] for r, c in zip(rows, cut)) + b"".join(r["rare"][c:] for r, c in zip(rows, cut)), np.uint64)
        unlisted, of = np.unique(rare, return_inverse=True)
        u[no_u], w[no_w] = numbers + of[:len(no_u)], numbers + of[len(no_u):]
        p1 = np.r_[np.frombuffer(prior, np.float64), np.zeros(len(unlisted))]
        with np.errstate(divide="ignore"):
            log1 = np.log10(p1)
        del rare, of, no_u
        rows.clear()
        del event, word, times
        # words that are spread over buckets have their counts from the vocabulary; the others are whole here
        count = np.bincount(v[train], minlength=len(names)).astype(np.int64)
        first, far = names == START_HASH, np.isin(names, spread)
        number = np.where(first, START, 0)
        if far.any():
            at = np.searchsorted(spread, names[far])
            count[far], number[far] = spread_n[at], spread_id[at]
        count[first] = starts
        base = np.where(first, 0.0, np.log10(count + 1.0))
        known = ((count > 0) & ~first).astype(np.float64)
        score = np.zeros(len(v), np.float32)
        fit = np.flatnonzero(~first[v] & train)
        trie = Trie(len(names), v[fit].astype(np.int64), u[fit], w[fit], p1, far)
        del fit
        far |= first
        ask = np.flatnonzero(~far[v])
        score[ask] = trie.score(v[ask].astype(np.int64), u[ask], w[ask], log1)
        del ask
        chunk_of, ends = np.array(chunks), np.cumsum(n)
        wide = np.flatnonzero(far[v])
        if len(wide):
            a, b = trie.parts(v[wide].astype(np.int64), u[wide], w[wide])  # a start has no context
            rare = w[wide] >= numbers
            w_hash = np.zeros(len(wide), np.uint64)
            w_hash[rare] = unlisted[w[wide[rare]] - numbers]
            yield from handed_on(number[v[wide]], np.where(rare, UNKNOWN, w[wide]), w_hash, train[wide], a, b,
                                 chunk_of[np.searchsorted(ends, wide, "right")], doc[wide], buckets)
            del a, b, rare, w_hash
        del wide
        no_w = no_w[~far[v[no_w]]]
        if len(no_w):
            weight = 10 ** trie.weights(v[no_w].astype(np.int64), u[no_w])
            yield from deferred(unlisted[w[no_w] - numbers], 10.0 ** score[no_w], weight, chunk_of[np.searchsorted(ends, no_w, "right")], doc[no_w], buckets)
            score[no_w] = 0
        trie.close()
        at, out = 0, []
        for chunk, m in zip(chunks, n):
            d, name = doc[at:at + m], v[at:at + m]
            ids, of = np.unique(d, return_inverse=True)
            # counted logs of whole numbers stay exact; the model's are quantised anyway
            out.append((chunk, ids.astype("<u2").tobytes(), np.bincount(of, known[name]).astype("<u4").tobytes(),
                        np.bincount(of, base[name]).tobytes() + np.bincount(of, score[at:at + m]).astype("<f4").tobytes()))
            at += m
        for i in range(0, len(out), 64):
            chunk, ids, got, sums = zip(*out[i:i + 64])
            yield record(EVENTS, bucket=[bucket] * len(chunk), chunk=chunk, words=ids, counts=got, body=sums)
        del v, u, w, train, doc, score, out
        trim()


def assembled(batches, tokens: int, kinds: int, ends: int):
    """The sums of each chunk's documents."""
    share = np.log10(float(tokens + kinds + 1))
    for _, rows in runs(batches, "chunk"):
        docs = sorted((r for r in rows if r["words"] is None), key=lambda r: r["idx"])
        sums, known = np.zeros((2, len(docs))), np.zeros(len(docs), np.int64)
        for r in sorted((r for r in rows if r["words"] is not None), key=lambda r: r["bucket"]):
            ids = np.frombuffer(r["words"], "<u2").astype(np.int64)
            known[ids] += np.frombuffer(r["counts"], "<u4")
            sums[1, ids] += np.frombuffer(r["body"][:8 * len(ids)], "<f8")
            sums[0, ids] += np.frombuffer(r["body"][8 * len(ids):], "<f4")
        n = np.array([r["n"] for r in docs])
        yield record(OUT, doc_id=[r["doc_id"] for r in docs], held_out=[r["held_out"] for r in docs], n_tokens=n, n_known=known + (ends > 0),
                     train_tokens=[tokens] * len(docs), base_score=sums[1] + np.log10(ends + 1.0) - n * share, score=sums[0])


def score(docs: DataFrame, held_out: Column, vocabulary: int = 1_500_000, most: int = 4_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``; learns from the rows
    that are not held out. Words of over ``most`` occurrences are spread over buckets; results don't depend on it."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = docs.select("doc_id", held_out.alias("held_out"), "text")
    counted = table.select("held_out", "text").mapInArrow(task("lm_score", "words_of", buckets=n), COUNTS_SQL)
    counted = staged(counted.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(task("lm_score", "words_added"), COUNTS_SQL), "words")
    totals = counted.agg(F.sum("n"), F.sum("ends")).first()
    ends = totals[1] or 0
    tokens = (totals[0] or 0) + ends
    tally = counted.where("words is not null").mapInArrow(task("lm_score", "tallied"), "c long, k long, n long").groupBy("c").agg(F.sum("k"), F.sum("n")).collect()
    tally = sorted(tuple(r) for r in tally)  # at most 1000 counts and the powers of two
    kinds = sum(k for _, k, _ in tally) + (ends > 0)
    least, kept = 1, sum(k for _, k, _ in tally)
    for c, k, _ in tally:
        if kept <= min(vocabulary, int(ID) - FIRST - 1):
            break
        kept, least = kept - k, c + 1
    few = counted.mapInArrow(task("lm_score", "frequent", least=least), "words binary, counts binary").collect()  # at most ``vocabulary``
    head = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in few]) if few else np.zeros(0, np.uint64)
    count = np.concatenate([np.frombuffer(r["counts"], "<u8") for r in few]).astype(np.int64) if few else np.zeros(0, np.int64)
    order = np.argsort(head)
    head, count = head[order], count[order]
    prior = np.empty(len(head) + FIRST)
    prior[[UNKNOWN, START]] = 0  # words without a number have their own
    prior[END] = (ends + 1) / (tokens + kinds + 1)
    prior[FIRST:] = (count + 1) / (tokens + kinds + 1)
    wide = count > max(min(tokens / HOT, most), 4)
    hot_ids = np.flatnonzero(wide) + FIRST
    hot = head[wide].tobytes()
    events = table.mapInArrow(task("lm_score", "occurrences", buckets=n, head=head.tobytes(), hot=hot), EVENTS_SQL)
    sums = staged(events.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        task("lm_score", "summed", prior=prior.tobytes(), hot=hot, hot_ids=hot_ids.tobytes(), hot_counts=count[wide].tobytes(), starts=ends, buckets=n),
        EVENTS_SQL), "sums")
    met_pairs = sums.where("idx = -2").select("bucket", "body", "rare").mapInArrow(task("lm_score", "met"), "bucket int, listed binary, rare binary")
    followers = met_pairs.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(task("lm_score", "kinds_met"), "v long, k long")
    followers = dict(followers.groupBy("v").agg(F.sum("k")).collect())  # a row for each common word
    common = np.r_[START, hot_ids]
    known = counted.where("words is not null").select(*[F.col(f.name) if f.name in ("bucket", "words", "counts") else
                                                        (F.lit(-1) if f.name == "idx" else F.lit(None)).cast(f.dataType).alias(f.name) for f in sums.schema])
    late = sums.where("chunk is null").union(known).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        task("lm_score", "closed", share=float(tokens + kinds + 1), prior=prior.tobytes(), common=common.tobytes(), totals=np.r_[ends, count[wide]].tobytes(),
             kinds=np.array([followers.get(int(v), 0) for v in common]).tobytes()), EVENTS_SQL)
    sums = sums.where("chunk is not null").union(late)
    return sums.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(
        task("lm_score", "assembled", tokens=tokens, kinds=kinds, ends=ends),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
