"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes

#: Length of a vector, letters of a gram, and letters told apart (a power of two; 0 is what isn't a letter).
DIMS, GRAM, LETTERS = 512, 3, 64
#: Characters of text that are turned to counts at once.
_PIECE = 1 << 18
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter's number; by number: its random vector of -1 and 1, as bound at each place of a gram."""
    number = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalpha():
            low = ord(c.lower()[0])
            number[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (LETTERS - 27)
    base = np.random.default_rng(5).integers(0, 2, (LETTERS, DIMS)).astype(np.float32) * 2 - 1
    return number, np.stack([np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)])


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The vector of each gram: its letters' vectors, permuted by place, bound by multiplication."""
    placed = _letters()[1]
    v = placed[GRAM - 1][codes % LETTERS]
    for k in range(1, GRAM):
        v = v * placed[GRAM - 1 - k][(codes // LETTERS**k) % LETTERS]
    return v


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle (sum) of each text's gram vectors, and each text's number of letters. Grams of no letter don't count."""
    number, _ = _letters()
    out = np.zeros((len(texts), DIMS), np.float32)
    points = [np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]  # so that a single letter has a gram
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    cp = np.concatenate([*points, np.zeros(0, np.uint32)])
    x = number[np.minimum(cp, 0xFFFF)].astype(np.int64)
    wide = cp > 0xFFFF
    if wide.any():
        x[wide] = [27 + int(c) % (LETTERS - 27) if chr(c).isalpha() else 0 for c in cp[wide]]
    letters = np.bincount(doc[x > 0], minlength=len(texts))
    if len(x) < GRAM:
        return out, letters
    code = x[: len(x) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = code * LETTERS + x[k : len(x) - GRAM + 1 + k]
    ok = (doc[: len(code)] == doc[GRAM - 1 :]) & (code > 0)
    code, doc = code[ok], doc[: len(ok)][ok]
    used = np.flatnonzero(np.bincount(code, minlength=1))
    place = np.zeros(LETTERS**GRAM, np.int32)
    place[used] = np.arange(len(used))
    at = 0
    step = max(1, (1 << 21) // max(1, len(used)))  # rows of a count matrix of 2 ** 21 cells
    vectors = gram_vectors(used)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    while at < len(texts):
        to = min(len(texts), at + step)
        a, b = edges[at], edges[to]
        counts = np.bincount((doc[a:b] - at) * len(used) + place[code[a:b]], minlength=(to - at) * len(used)).reshape(to - at, len(used))
        out[at:to] = counts.astype(np.float32) @ vectors
        at = to
    return out, letters


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    _, offs = text_bytes(batch.column(column))
    for i, j in slices(offs, _PIECE):
        yield i, j, [t or "" for t in batch.column(column)[i:j].to_pylist()]


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, total): each task's sum by language, one row a language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for i, j, texts in _batches(batch, 1):
            vectors, _ = document_vectors(texts)
            norms = np.linalg.norm(vectors, axis=1)
            for lang, v, n in zip(batch.column(0)[i:j].to_pylist(), vectors, norms, strict=True):
                if n > 0:
                    sums[lang] = sums.get(lang, 0) + np.rint(v / n * 1e6).astype(np.int64)  # whole numbers: the order of tasks doesn't matter
    yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])


def prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, prototype) for each non-null language: the sum of its documents' vectors of length 1. Each task sends one row a language."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(_bundle, "lang string, bundle array<bigint>")
    return parts.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("prototype"))


def _predict(langs: list[str], protos: np.ndarray, text: int, keep: list[int]):
    """The columns ``keep`` of each row, then its language and score; ``text``: the number of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.schema.names[k] for k in keep] + ["lang_pred", "score"]
            for i, j, texts in _batches(batch, text):
                vectors, letters = document_vectors(texts)
                norms = np.linalg.norm(vectors, axis=1)
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if langs:
                    cos = vectors @ protos.T / np.maximum(norms, 1e-9)[:, None]
                    best = cos.argmax(1)
                    for k in np.flatnonzero(letters > 0):
                        pred[k], score[k] = langs[best[k]], float(np.clip(cos[k, best[k]], 0, 1))
                yield pa.record_batch([*(batch.column(k)[i:j] for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    return run


def predict(df: DataFrame, protos: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score: the language whose prototype has the highest cosine, ties to the lesser name, and that cosine (0 if negative).

    The model is one vector of ``DIMS`` numbers a language, whatever the corpus; the driver holds it. Null text or
    one without letters, or no languages learned: ``und`` and 0.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(*_model(protos), 1, [0]), "doc_id long, lang_pred string, score double")


def add_language(df: DataFrame, protos: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` with lang_pred and score as in ``predict``; columns of these names give way. No shuffle."""
    rows = df.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(*_model(protos), rows.columns.index(text), list(range(len(rows.columns)))), schema)


def _model(protos: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, of length 1."""
    model = sorted((r["lang"], r["prototype"]) for r in protos.collect())
    m = np.array([p for _, p in model], np.float64).reshape(len(model), DIMS)
    return [name for name, _ in model], (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that nothing is learned from. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Prototypes are learned from the documents that aren't held out and have a language."""
    protos = prototypes(df.filter(~held_out()))
    return predict(df, protos).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
