"""Language identification by compression.

Each language has a zstandard dictionary of raw content: texts of a bounded, documented sample of its labelled rows
(``dict_bytes`` per language, drawn by hash of the id; see ``sample`` for languages of only long or short texts). Texts are lower-cased and digits, signs and white space of ASCII
become single blanks, so capitals and tables say nothing. A whole text is cut into blocks and every block is compressed
with every dictionary; the language with the smallest total wins. The rejection flag marks narrow margins between the best two.

The model is at most ``dict_bytes`` per learned language, so it travels with the tasks. Prediction is one map, without an
exchange. Null, empty and letterless texts are ``und`` with score 0, and so is every text where no language was learned;
ties go to the language that sorts first. Null or repeated ids keep their rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import flushed, fold, task, texts

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
                    ("margin", pa.float64()), ("rejected", pa.bool_())])
DICT_BYTES, SALTS, BLOCK, SPREAD = 98_304, 32, 4096, 4
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_BLANK = bytes.maketrans(_NO_LETTERS, b" " * len(_NO_LETTERS))
LETTER = regex.compile(r"\p{L}")


def sample(docs: DataFrame, train: Column, dict_bytes: int) -> dict[str, bytes]:
    """Texts of each language in the order of their ids' hashes, as far as ``dict_bytes`` go. No document gives more than an
    eighth of them, so that none makes a language alone. Whole texts of 64 bytes up to that come first; what they leave open
    is filled with ``SPREAD`` blocks of each longer text, then with shorter texts. Chosen in salted parts, then overall."""
    most = dict_bytes // 8
    size = F.octet_length("text")
    labelled = docs.where(train & F.col("lang").isNotNull() & (size > 0)).select(
        "doc_id", "lang", "text", F.xxhash64("text").alias("__t"), size.alias("__size"))
    rows = labelled.drop("text").distinct()  # a repeated row counts once
    rows = (rows.withColumn("__tier", F.when(F.col("__size") > most, 1).when(F.col("__size") < 64, 2).otherwise(0))
            .withColumn("__n", F.least("__size", F.lit(most)))
            .withColumn("__h", F.xxhash64("doc_id", F.lit(7))).withColumn("__salt", F.pmod("__h", F.lit(SALTS))))
    for keys in (["lang", "__salt"], ["lang"]):
        w = Window.partitionBy(*keys).orderBy("__tier", "__h", "doc_id", "__size", "__t").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__sum", F.sum("__n").over(w)).where(F.col("__sum") <= dict_bytes)
    chosen = F.broadcast(rows.select(*[F.col(c).alias(f"{c}_") for c in ("doc_id", "lang", "__t", "__size")], "__h", "__tier"))  # at most dict_bytes rows a language
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    for c in ("lang", "__t", "__size"):
        same = same & (F.col(c) == F.col(f"{c}_"))
    block = most // SPREAD
    body = F.col("text").cast("binary")
    cut = [F.substring(body, (F.lit(1) + F.floor((F.col("__size") - block) * k / (SPREAD - 1))).cast("int"), F.lit(block)) for k in range(SPREAD)]
    body = F.when(F.col("__tier") == 1, F.concat(*cut)).otherwise(body)
    found = labelled.join(chosen, same).select("lang", "__tier", "__h", body.alias("body")).distinct().collect()
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], -r["__tier"], -r["__h"], r["body"])):
        blocks = [r["body"][k:k + block] for k in range(0, len(r["body"]), block)] if r["__tier"] == 1 else [r["body"]]
        out.setdefault(r["lang"], []).extend(normal(b.decode("utf-8", "ignore").encode()) for b in blocks)
    return {k: b"\n".join(v)[-dict_bytes:] for k, v in out.items()}


@lru_cache(maxsize=2)
def _compressors(key: str, model: tuple) -> list:
    out = []
    for lang, data in model:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # short matches count: words of three letters tell languages apart
        p = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY,
                                                write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=p)))
    return out


def normal(text: bytes) -> bytes:
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_BLANK).split())


def classify(text: bytes, model: list) -> tuple[str, float, float]:
    """(language, score, margin). The score is the best language's share when each counts 2 ** -(bytes per 100 of text)."""
    if not model or not LETTER.search(text.decode("utf-8", "replace")):
        return "und", 0.0, 0.0
    text = normal(text)
    sizes = [(sum(len(c.compress(text[i:i + BLOCK])) for i in range(0, len(text), BLOCK)), lang) for lang, c in model]
    best = min(sizes)
    others = [s for s, lang in sizes if lang != best[1]]
    if not others:
        return best[1], 1.0, 1.0
    share = 1.0 / sum(2.0 ** (-100.0 * min(10.0, (s - best[0]) / max(1, len(text)))) for s, _ in sizes)
    return best[1], share, (min(others) - best[0]) / min(others)


def predicted(batches, model: tuple, key: str, least_margin: float):
    made = _compressors(key, model)

    def rows():
        for doc_id, held_out, text in texts(batches, "doc_id", "held_out"):
            lang, score, margin = classify(text, made)
            yield doc_id, held_out, lang, score, margin, margin < least_margin

    yield from flushed(rows(), SCHEMA)


def identify(docs: DataFrame, train: Column, held_out: Column, dict_bytes: int = DICT_BYTES, least_margin: float = 0.01) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of each row of ``docs``; learns from rows where ``train`` holds."""
    model = tuple(sorted(sample(docs, train, dict_bytes).items()))
    key = hashlib.sha256(repr([(k, hashlib.sha256(v).hexdigest()) for k, v in model]).encode()).hexdigest()
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        task("language_id", "predicted", model=model, key=key, least_margin=least_margin),
        "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")
