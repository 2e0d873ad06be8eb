"""Language identification with hyperdimensional letter profiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import table

DIMENSIONS = 1024
KNOWN_ROWS, SLOTS = 1 << 14, 1 << 20
_CODE = np.uint64((1 << 21) - 1)  # a code point takes 21 bits
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int32)


@lru_cache(maxsize=1 << 16)
def _letter_vector(code: int) -> np.ndarray:
    """The random vector of a letter of any script (0: what is no letter), the same in every task."""
    return np.random.default_rng([7, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Binds the letters of each trigram, each rotated by its place, by multiplication."""
    parts = [(grams >> np.uint64(21 * k) & _CODE).astype(np.int64) for k in (2, 1, 0)]
    codes, at = np.unique(np.concatenate(parts), return_inverse=True)
    letters = np.array([_letter_vector(c) for c in codes.tolist()]).reshape(len(codes), DIMENSIONS)
    a, b, c = at.reshape(3, len(grams))
    return (np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]).astype(np.float32)


class _Vectors:
    """Vectors of the trigrams met so far, KNOWN_ROWS at most, one a slot; others are bound anew each time."""

    def __init__(self):
        self.key, self.row = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.known = np.empty((KNOWN_ROWS, DIMENSIONS), np.float32)
        self.size = 0

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slot = (grams * _SPREAD >> np.uint64(44)).astype(np.int64)
        known = self.key[slot] == grams
        if not known.all() and self.size < KNOWN_ROWS:
            free = np.flatnonzero(self.key[slot] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]][: KNOWN_ROWS - self.size]
            self.known[self.size : self.size + len(free)] = _gram_vectors(grams[free])
            self.key[slot[free]], self.row[slot[free]] = grams[free], np.arange(self.size, self.size + len(free))
            self.size += len(free)
            known = self.key[slot] == grams
        if known.all():
            return counts.astype(np.float32) @ self.known[self.row[slot]]
        out = counts[known].astype(np.float32) @ self.known[self.row[slot[known]]]
        rest = np.flatnonzero(~known)
        for k in range(0, len(rest), 4096):
            out = out + counts[rest[k : k + 4096]].astype(np.float32) @ _gram_vectors(grams[rest[k : k + 4096]])
        return out


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams around each letter of the text, with how often each occurs. What is no letter counts as a blank."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    kind = _letters()[codes]
    # letters below 1,024 are packed into 32 bits, which sort faster; the key of a trigram is the same either way
    bits, kind = (10, kind) if kind.max() < 1024 else (21, kind.astype(np.int64))
    mid = kind[1:-1]
    grams, counts = np.unique(((kind[:-2] << bits | mid) << bits | kind[2:])[mid > 0], return_counts=True)
    if bits == 10:
        grams = grams.astype(np.int64)
        grams = (grams >> 20) << 42 | (grams >> 10 & 1023) << 21 | grams & 1023
    return grams.view(np.uint64), counts


def _bundles(batches):
    """For Arrow batches of (text, lang): the sum of the text vectors of each language in the partition."""
    vectors, total = _Vectors(), {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            grams, counts = _grams(text.as_py())
            if len(grams):
                total[lang] = total.get(lang, 0) + vectors.bundle(grams, counts).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": list(total), "vector": [v.tolist() for v in total.values()]})


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The bundled vector of each language. Rows whose language is null do not count."""
    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(_bundles, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect():  # DIMENSIONS numbers a language
        out[r.lang] = np.array([x.x for x in r.v])
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language whose prototype has the largest cosine with the text's vector, and that cosine (0 if negative).

    `und` and 0 if the text is null or has no letter, or if there is no prototype. Equal cosines go to the first
    language in order of name. One row for each row; other columns are ignored.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), DIMENSIONS)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float64)

    def run(batches):
        vectors = _Vectors()
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1):
                grams, counts = _grams(text.as_py())
                if not len(grams) or not names:
                    lang.append("und")
                    score.append(0.0)
                    continue
                v = vectors.bundle(grams, counts).astype(np.float64)
                cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
                k = int(np.argmax(cos))
                lang.append(names[k])
                score.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learnt from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.where(~held_out()))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
