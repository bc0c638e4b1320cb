"""Byte-pair encoding from public tokenizer files: word caches, whole-token proof and tree concatenation.

The merges themselves are the ``tokenizers`` library's model; what is built here is how texts are cut so that most
words never reach it, and how a long unsplit piece is encoded in halves whose join is repaired exactly.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

CACHE = 300_000  # words of a generation kept by a worker; results do not depend on it
LEAF = 512       # characters of a leaf of the tree


class Merges:
    """The merge model of one tokenizer file on byte-level pieces."""

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.vocab = spec["model"]["vocab"]
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self._agree: dict[tuple[int, int], bool] = {}   # pairs of this file's token numbers
        self.width = 2 if max(self.strings) < 1 << 16 else 4

    def merge(self, piece: str) -> list[int]:
        """Ids of a byte-level piece, as the model merges it."""
        return self.tree(piece) if len(piece) > 2 * LEAF else [t.id for t in self.model.tokenize(piece)]

    # --- tree concatenation ------------------------------------------------------------------------------------
    def part(self, piece: str, last: bool) -> list[int]:
        """Ids of a part of a piece; only the piece's last part ends a word."""
        if last or not self.suffix:
            return [t.id for t in self.lib.model.tokenize(piece)] if piece else []
        return self.open_part(piece)

    def open_part(self, piece: str) -> list[int]:
        # The library ends every call with the word-end symbol. A first symbol that no merge takes (the word-end form of
        # the last character is another symbol) is not available, so open parts are merged here, by rank, leftmost first.
        ids = [self.vocab[c] for c in piece]
        ranks = self.ranks
        while len(ids) > 1:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
            if best is None:
                break
            rank, new = ranks[ids[best[1]], ids[best[1] + 1]]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) in ranks and ranks[ids[i], ids[i + 1]][0] == rank:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    @property
    def ranks(self) -> dict:
        if not hasattr(self, "_ranks"):
            merges = json.loads(self.lib.to_str())["model"]["merges"]
            pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
            self._ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        return self._ranks

    def chars(self, ids: list[int]) -> str:
        """The byte-level characters of ids, without word ends."""
        return "".join(self.strings[i].removesuffix(self.suffix) if self.suffix else self.strings[i] for i in ids)

    def agree(self, a: int, b: int) -> bool:
        """Whether two tokens stand next to each other in an encoding: their own characters merge back to just them.
        An encoding is exact if and only if all its neighbours agree."""
        key = (a, b)
        if key not in self._agree:
            if len(self._agree) > CACHE:
                self._agree.clear()
            text = self.chars([a, b])
            self._agree[key] = self.part(text, bool(self.suffix) and self.strings[b].endswith(self.suffix)) == [a, b]
        return self._agree[key]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Joins two exact encodings: re-encodes a window around the join, twice as wide each time, until it agrees with both sides."""
        if not left or not right:
            return left + right
        if self.agree(left[-1], right[0]):
            return left + right
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            whole = last and b == len(right)
            mid = self.part(self.chars(left[a:] + right[:b]), whole or not self.suffix)
            if (a == 0 or self.agree(left[a - 1], mid[0])) and (b == len(right) or self.agree(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            w *= 2

    def tree(self, piece: str, last: bool = True) -> list[int]:
        """Ids of a long piece: halves on their own, then their join."""
        if len(piece) <= LEAF:
            return self.part(piece, last)
        mid = len(piece) // 2
        return self.join(self.tree(piece[:mid], False), self.tree(piece[mid:], last), last)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


# The byte-to-character table of byte-level tokenizers (printable bytes stand for themselves, the rest follow from 256 on).
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
_REST = [b for b in range(256) if b not in PRINTABLE]
BYTE_CHARS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(_REST)}


def byte_level(piece: bytes) -> str:
    return piece.decode("latin-1").translate(BYTE_CHARS)


_BYTES = {chr(c): b for b, c in BYTE_CHARS.items()}


def raw_bytes(piece: str) -> bytes:
    """The bytes of a byte-level piece."""
    return bytes(map(_BYTES.__getitem__, piece))


# How the two public files cut a text into pieces.
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_SPLIT_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
# Latin letters and signs that composition leaves alone and whose lower case is one character each.
LATIN = re.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]+\Z")
BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Generations(dict):
    """Ids of byte strings: a full generation becomes the old one, and what is met again moves on from there, so frequent
    strings outlive any number of rare ones. Strings of 64 bytes and more are not kept."""

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, key: bytes) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.ids(key)
        if len(key) < 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Pieces(Generations):
    """Piece -> ids (little-endian)."""

    def __init__(self, bpe: Merges, code: str):
        super().__init__()
        self.bpe, self.code = bpe, code

    def ids(self, piece: bytes) -> bytes:
        return array(self.code, self.bpe.merge(byte_level(piece))).tobytes()


class WordEncoder(Generations):
    """White-space separated word (bytes) -> ids (little-endian), for files whose pieces never hold white space.

    Pieces are looked up by their bytes, so a new word made of known pieces needs no text of its own."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe = merges(path)
        self.dtype = np.dtype("<u2" if self.bpe.width == 2 else "<u4")
        self.code = "H" if self.bpe.width == 2 else "I"
        self.pieces = Pieces(self.bpe, self.code)

    def cut(self, word: bytes) -> list[str]:
        """Byte-level pieces of a word."""
        if word.isascii():
            if word.isalpha():
                return [word.lower().decode()]
            return [byte_level(p) for p in WORD_SPLIT_ASCII.findall(word.lower())]
        text = word.decode()
        if LATIN.match(text):
            text = text.lower()
            return [byte_level(p.encode()) for p in ([text] if text.isalpha() else WORD_SPLIT.findall(text))]
        lib = self.bpe.lib
        return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def ids(self, word: bytes) -> bytes:
        if word.isalpha():   # of bytes: ASCII letters only
            return self.pieces[word.lower()]
        if word.isascii():
            return b"".join(map(self.pieces.__getitem__, WORD_SPLIT_ASCII.findall(word.lower())))
        text = word.decode()
        if LATIN.match(text):
            text = text.lower()
            return b"".join([self.pieces[p.encode()] for p in ([text] if text.isalpha() else WORD_SPLIT.findall(text))])
        return b"".join([self.pieces[raw_bytes(p)] for p in self.cut(word)])

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text; the file's special strings count as their tokens."""
        special = self.bpe.split_special
        if special is not None and b"<|" in text and special.search(text):
            return b"".join(np.array([self.bpe.special[s.decode()]], self.dtype).tobytes() if i % 2 else self.encode_plain(s)
                            for i, s in enumerate(special.split(text)))
        return self.encode_plain(text)

    def encode_plain(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
