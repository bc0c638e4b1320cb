"""BPE encoding and decoding with tree concatenation.

Words are encoded through a cache of bounded size. A document with a long unsplit piece (a run of letters or signs
beyond ``leaf`` characters) is taken apart: its words become rows, and the piece's leaves become rows of their own, so
halves are encoded in parallel by different tasks; then each piece's leaves are joined pairwise, re-encoding growing
windows around each join until both sides agree (see ``bpe.Merges.join`` for why that is exact), and the document's rows
are put together. A null text is empty: no ids, the empty decoded text. Repeated rows each give their row; a null id is
kept. White space is dropped by these files, so a text of nothing else is like an empty one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .common import flushed, staged, task, texts

DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                    ("row", pa.string()), ("seg", pa.int64()), ("leaf", pa.int64()), ("last", pa.bool_()), ("body", pa.binary())])
LEAVES = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("seg", pa.int64()), ("leaf", pa.int64()), ("last", pa.bool_()), ("ids", pa.binary())])
OUT = pa.schema(list(DIGEST)[:4])


class Digests(dict):
    """Word -> its ids and token strings, each behind a space, as bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = bpe.word_encoder(path)
        self.strings = {i: s.encode() for i, s in self.encoder.bpe.strings.items()}

    def show(self, ids: bytes) -> tuple[int, bytes, bytes]:
        a = np.frombuffer(ids, self.encoder.dtype).tolist()
        return len(a), "".join(f" {i}" for i in a).encode(), b"".join(b" " + self.strings[i] for i in a)

    def __missing__(self, word: bytes) -> tuple[int, bytes, bytes]:
        if len(self) >= bpe.CACHE // 2:
            self.clear()
        out = self.show(self.encoder.__missing__(word))
        self.encoder.clear()
        if len(word) < 64:
            self[word] = out
        return out


@lru_cache(maxsize=2)
def digests(path: str) -> Digests:
    return Digests(path)


def digest(parts: list[tuple[int, bytes, bytes]]) -> tuple[int, str, str]:
    n, ids, out = zip(*parts) if parts else ((), (), ())
    return sum(n), hashlib.sha256(b"".join(ids)[1:]).hexdigest(), hashlib.sha256(b"".join(out)[1:]).hexdigest()


def decode(path: str, ids: list[int]) -> str:
    """The decoded text of ids, special tokens included: the file has no decoder, so its strings stand a space apart."""
    strings = bpe.merges(path).strings
    return " ".join(strings[i] for i in ids)


def encode(path: str, text: str) -> list[int]:
    e = bpe.word_encoder(path)
    return np.frombuffer(e.encode(text.encode()), e.dtype).tolist()


def segments(encoder: bpe.WordEncoder, text: bytes):
    """(kind, bytes) in order: special strings, plain runs of words, and long words alone."""
    special = encoder.bpe.split_special
    for i, s in enumerate(special.split(text) if special is not None and b"<|" in text else [text]):
        if i % 2:
            yield "special", s
            continue
        kept: list[bytes] = []
        for w in s.split():
            if len(w) > 4 * bpe.LEAF:
                if kept:
                    yield "plain", b" ".join(kept)
                kept = []
                yield "long", w
            else:
                kept.append(w)
        if kept:
            yield "plain", b" ".join(kept)


def digested(batches, path: str, leaf: int):
    from pyspark import TaskContext
    d = digests(path)
    e, get, part = d.encoder, d.__getitem__, TaskContext.get().partitionId()

    def rows():
        at = 0
        for doc_id, text in texts(batches, "doc_id"):
            found = list(segments(e, text))
            pieces = {k: e.cut(s) for k, (kind, s) in enumerate(found) if kind == "long"}
            if not any(len(p) > leaf for ps in pieces.values() for p in ps):
                parts = []
                for kind, s in found:
                    parts += [d.show(np.array([e.bpe.special[s.decode()]], e.dtype).tobytes())] if kind == "special" else map(get, s.split())
                yield (doc_id, *digest(parts), None, None, None, None, None)
                continue
            at += 1
            row, seg = f"{part} {at}", 0  # the table is staged, so a row's number in its task is its own
            for k, (kind, s) in enumerate(found):
                if kind != "long":
                    ids = np.array([e.bpe.special[s.decode()]], e.dtype).tobytes() if kind == "special" else e.encode_plain(s)
                    yield doc_id, None, None, None, row, seg, -1, True, ids
                    seg += 1
                    continue
                for p in pieces[k]:
                    for j in range(0, len(p), leaf):
                        yield doc_id, None, None, None, row, seg, j // leaf, j + leaf >= len(p), p[j:j + leaf].encode()
                    seg += 1

    yield from flushed(rows(), DIGEST, 500)


def leaves(batches, path: str):
    """Encodes each leaf; what is not a leaf passes."""
    e = bpe.word_encoder(path)

    def rows():
        for b in batches:
            for r in b.to_pylist():
                ids = r["body"] if r["leaf"] < 0 else np.array(e.bpe.tree(r["body"].decode(), r["last"]), e.dtype).tobytes()
                yield r["row"], r["doc_id"], r["seg"], r["leaf"], r["last"], ids

    yield from flushed(rows(), LEAVES, 500)


def joined(batches, path: str):
    """Rows of a document follow each other, by segment and leaf: joins the leaves of each piece in a tree, then digests."""
    d = digests(path)
    e = d.encoder

    def tree(parts: list[tuple[list[int], bool]]) -> list[int]:
        while len(parts) > 1:
            parts = [(e.bpe.join(a[0], b[0], b[1]), b[1]) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
        return parts[0][0]

    def rows():
        row, doc_id, seg, parts, shown = None, None, None, [], []

        def close():
            if parts:
                shown.append(d.show(np.array(tree(parts), e.dtype).tobytes()))
                parts.clear()

        for b in batches:
            for r in b.to_pylist():
                if r["row"] != row or r["seg"] != seg:
                    close()
                if r["row"] != row:
                    if row is not None:
                        yield (doc_id, *digest(shown))
                    row, doc_id, shown = r["row"], r["doc_id"], []
                seg = r["seg"]
                parts.append((np.frombuffer(r["ids"], e.dtype).tolist(), r["last"]))
        close()
        if row is not None:
            yield (doc_id, *digest(shown))

    yield from flushed(rows(), OUT)


def encode_decode(docs: DataFrame, path: str, leaf: int = 16_384) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``; pieces over ``leaf`` characters are
    encoded as leaves by tasks of their own."""
    first = staged(docs.select("doc_id", "text").mapInArrow(task("bpe_codec", "digested", path=path, leaf=leaf), """doc_id long,
        n_tokens long, ids_sha256 string, decoded_sha256 string, row string, seg long, leaf long, last boolean, body binary"""), "codec")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = (first.where("row is not null").select("row", "doc_id", "seg", "leaf", "last", "body").repartition(n, "row", "seg", "leaf")
               .mapInArrow(task("bpe_codec", "leaves", path=path), "row string, doc_id long, seg long, leaf long, last boolean, ids binary"))
    long = (encoded.repartition(n, "row").sortWithinPartitions("row", "seg", "leaf")
            .mapInArrow(task("bpe_codec", "joined", path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
    return first.where("row is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").union(long)
