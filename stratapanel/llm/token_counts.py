"""Token counts by whole-token shortcut.

Offline, every vocabulary string is run through the merges: those that come out as themselves alone are proven whole.
A piece of a text that is one of them counts one without any merge; only the other pieces are merged. Counting is one
map over the texts, without any exchange. A null text is empty: 0 bytes, 0 tokens. Ids may repeat or be null; each row
gives one row. Very long texts are cut into words as any other; nothing depends on the length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import flushed, task, texts

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

# Bytes that begin the UTF-8 forms of white space beyond ASCII.
WIDE_SPACE = re.compile(rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
RUN = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
UNEVEN = re.compile(rb"[ \n][ \n]|[\t\r\x0b\x0c]|[ \n]\Z")
ASCII_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def whole_tokens(model: bpe.Merges) -> frozenset[str]:
    """Vocabulary strings whose own encoding is that one token."""
    one = model.lib.model.tokenize
    return frozenset(s for s, i in model.vocab.items() if [t.id for t in one(s)] == [i])


class Counter(dict):
    """Word with the white space before it (bytes) -> number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe = bpe.merges(path)
        self.whole = whole_tokens(self.bpe)
        self.rest: dict[str, int] = {}

    def piece(self, p: bytes) -> int:
        s = bpe.byte_level(p)
        if s in self.whole:
            return 1
        n = self.rest.get(s)
        if n is None:
            if len(self.rest) >= bpe.CACHE:
                self.rest.clear()
            n = len(self.bpe.merge(s))
            if len(s) < 64:
                self.rest[s] = n
        return n

    def __missing__(self, run: bytes) -> int:
        if len(self) >= bpe.CACHE:
            self.clear()
        if run.isascii():
            n = sum(map(self.piece, ASCII_SPLIT.findall(run)))
        else:
            n = sum(self.piece(p.encode()) for p in bpe.BYTE_SPLIT.findall(run.decode()))
        if len(run) < 64:
            self[run] = n
        return n

    def plain(self, text: bytes) -> int:
        """White space never stands behind a piece's other characters, so a run of it and the word behind it are cut on
        their own, unless white space beyond ASCII may continue a run."""
        if WIDE_SPACE.search(text):
            return self.__missing__(text)
        return sum(map(self.__getitem__, RUN.findall(text)))

    def count(self, text: bytes) -> int:
        special = self.bpe.split_special
        if special is not None and b"<|" in text and special.search(text):
            return sum(1 if i % 2 else self.plain(s) for i, s in enumerate(special.split(text)))
        return self.plain(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def counted(batches, path: str, limit: int):
    count = counter(path).count
    yield from flushed(((i, len(t), n := count(t), n > limit) for i, t in texts(batches, "doc_id")), SCHEMA)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` for the byte-level file at ``path``."""
    return docs.select("doc_id", "text").mapInArrow(task("token_counts", "counted", path=path, limit=limit),
                                                    "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
