"""Toxicity by class-conditional Kneser-Ney models of words.

The probability of a word in a class comes from its continuation count there: after how many different words it
stands. Copies of a passage bring no new ones. A discount is taken off each count; the mass that it frees in a class is
dealt out by counts that both classes share, and the mass that it frees there evenly over all words and one unknown
word, so each class's probabilities sum to one. A word whose counts do not exceed the discount has just its share of
the freed mass in both classes, whatever it is, so the models hold no entry for it and yet lose nothing.

A text's log-likelihoods under the two models are compared per word: over all of it, and over its most toxic stretch of
each length in WINDOWS, so that a few words in a long text still count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import staged, table
from presswork.llm.textkit import LOWER, Prefix, pieces, words

DISCOUNT = 2.5
WINDOWS = (2, 8)
LABELLED = 500_000
CALIBRATE = 10  # one labelled text in so many sets the weights instead of being counted
CALIBRATION = 20_000
FOLDS, HELD_OUT = 5, 0
_FEATURES = ("mean", *(f"most_{n}" for n in WINDOWS))
_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_WORD_BITS = 40
_WORD = (1 << _WORD_BITS) - 1


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of some texts: a 40-bit hash, 23 bits of the hash of the word before (0 at the start), the row."""
    data = LOWER[data]
    start, end, row = words(data, at, _BREAK)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), row
    word = (Prefix(data).hash(start, end) >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
    before = np.r_[0, (word[:-1] >> (_WORD_BITS - 23)) | 1]
    before[np.r_[True, row[1:] != row[:-1]]] = 0
    return word, before, row


def _among(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are there, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _pairs(labelled):
    """(id, text) of labelled texts -> (pair, classes): each word after the word before it, and the classes (1: not
    toxic, 2: toxic) in which it stands there."""

    def run(batches):
        ids, toxic = labelled.value
        for batch in batches:
            ok, at_id = _among(np.asarray(batch.column(0), np.int64), ids)
            kind = toxic[at_id[ok]]
            for i, _, data, at in pieces(batch.column(1).filter(pa.array(ok)), limit=1 << 22):
                word, before, row = _tokens(data, at)
                pair, where = np.unique(before << _WORD_BITS | word, return_inverse=True)
                is_toxic = kind[i + row] > 0
                plain, bad = (np.bincount(where[x], minlength=len(pair)) > 0 for x in (~is_toxic, is_toxic))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(plain + 2 * bad.astype(np.int32))], names=["pair", "classes"])

    return run


def kneser_ney(pairs: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, float]:
    """(word, p0, p1) for each word whose probabilities differ by more than the classes' freed mass; and the log
    ratio, toxic to ordinary, of every other word, known or not.

    pairs: word, context and classes (1, 2, or 3 for both), each pair once.
    """
    counted = staged(
        pairs.groupBy("word").agg(
            F.count("*").alias("n"), F.count_if(F.col("classes").bitwiseAND(1) > 0).alias("n0"), F.count_if(F.col("classes").bitwiseAND(2) > 0).alias("n1")
        )
    )
    freed = lambda c: F.coalesce(F.sum(F.least(F.col(c).cast("double"), F.lit(discount))), F.lit(0.0))
    total = counted.agg(F.count("*").alias("types"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"of_{c}") for c in ("n", "n0", "n1")), *(freed(c).alias(f"freed_{c}") for c in ("n", "n0", "n1"))).first()

    def probability(c: str, lower: Column) -> Column:
        whole = total[f"of_{c}"]
        if not whole:
            return lower
        return F.greatest(F.col(c) - discount, F.lit(0.0)) / whole + total[f"freed_{c}"] / whole * lower

    shared = probability("n", F.lit(1.0 / (total.types + 1)))
    entries = counted.where((F.col("n0") > discount) | (F.col("n1") > discount)).select("word", probability("n0", shared).alias("p0"), probability("n1", shared).alias("p1"))
    left = [total[f"freed_{c}"] / total[f"of_{c}"] if total[f"of_{c}"] else 1.0 for c in ("n0", "n1")]
    return entries, math.log(left[1] / left[0])


class Model:
    """Log-likelihood ratios of words, toxic less ordinary."""

    def __init__(self, word: np.ndarray, ratio: np.ndarray, other: float):
        order = np.argsort(word)
        self.word, self.ratio, self.other = word[order], ratio[order].astype(np.float32), other

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text: the ratio per word over all of it, and over its most toxic stretch of each length. 0 without words."""
        word, _, row = _tokens(data, at)
        n = len(at) - 1
        out = np.zeros((n, 1 + len(WINDOWS)))
        if len(word):
            known, where = _among(word, self.word)
            ratio = np.full(len(word), self.other)
            ratio[known] = self.ratio[where[known]]
            count = np.bincount(row, minlength=n)
            sums = np.r_[0.0, np.cumsum(ratio)]
            full, starts = np.flatnonzero(count), np.cumsum(count) - count
            out[full, 0] = np.add.reduceat(ratio, starts[full]) / count[full]
            for k, width in enumerate(WINDOWS):
                begin = np.maximum(np.arange(len(word)) + 1 - width, starts[row])
                out[full, 1 + k] = np.maximum.reduceat((sums[1:] - sums[begin]) / width, starts[full])
        return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = LABELLED):
    """Learns a scorer from labelled rows: labels has (id, toxic 0 or 1); of several labels of an id the worst counts.

    Of equal texts with equal labels one counts. Uses at most about `most_labelled` labelled ids, taken by hash where
    there are more, whose texts are counted whole: this bounds the models too, so that they can be broadcast. One in
    CALIBRATE of them (at most about CALIBRATION) is not counted but sets the weights and the bias that turn
    log-likelihood ratios into a probability. Without labels every score is 0.5.
    """
    spark = docs.sparkSession
    known = labels.where("id is not null and toxic is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most_labelled:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / n))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    once = rows.select("id", F.xxhash64("text").alias("same")).join(known, "id").groupBy("same", "toxic").agg(F.min("id").alias("id"))
    aside = lambda c: F.crc32(F.concat(F.lit("calibrate/"), F.col(c).cast("string"))) % CALIBRATE == 0
    got = once.select("id", "toxic", aside("id").alias("aside")).distinct().orderBy("id").toArrow()
    ids, toxic, left_out = (np.asarray(got[c].combine_chunks()) for c in ("id", "toxic", "aside"))
    labelled = spark.sparkContext.broadcast((ids[~left_out], toxic[~left_out]))
    pairs = rows.where(~aside("id")).mapInArrow(_pairs(labelled), "pair long, classes int").groupBy("pair").agg(F.bit_or("classes").alias("classes"))
    entries, other = kneser_ney(pairs.select((F.col("pair").bitwiseAND(F.lit(_WORD))).alias("word"), "classes"))
    entries = entries.select("word", F.log(F.col("p1") / F.col("p0")).cast("float").alias("ratio")).toArrow()
    shared = spark.sparkContext.broadcast(Model(*(np.asarray(entries[c].combine_chunks()) for c in ("word", "ratio")), other))

    chosen = np.flatnonzero(left_out)
    chosen = chosen[:: max(1, -(-len(chosen) // CALIBRATION))]
    sample = spark.sparkContext.broadcast((ids[chosen], toxic[chosen]))

    def measure(batches):
        keys, kinds = sample.value
        for batch in batches:
            ok, at_id = _among(np.asarray(batch.column(0), np.int64), keys)
            kind = kinds[at_id[ok]].astype(np.int32)
            for i, j, data, at in pieces(batch.column(1).filter(pa.array(ok))):
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in shared.value.features(data, at).T), pa.array(kind[i:j])], names=[*_FEATURES, "toxic"])

    seen = rows.where(aside("id")).mapInArrow(measure, ", ".join(f"{x} double" for x in _FEATURES) + ", toxic int").toArrow()
    weights = _logistic(np.c_[*(np.asarray(seen[x]) for x in _FEATURES), np.ones(len(seen))], np.asarray(seen["toxic"], np.float64))
    return shared, weights


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a lightly regularised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(axis=0, initial=0.0), 1e-9)
    x = x / scale
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def score(docs: DataFrame, learnt, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1: the probability that the text is toxic), mean, most_2, most_8 (the ratios it comes from).

    One row for each row; a null or empty text has ratios of 0 and the score that these have. Other columns are
    ignored.
    """
    shared, weights = learnt

    def run(batches):
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                ratios = shared.value.features(data, at)
                z = np.clip(ratios @ weights[:-1] + weights[-1], -35, 35)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-z))), *(pa.array(x) for x in ratios.T)], names=["id", "score", *_FEATURES])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, " + ", ".join(f"{x} double" for x in _FEATURES))
    return out.withColumnRenamed("id", id_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document, learnt from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "toxic")
    scored = score(docs, learn(docs.where(~held_out("doc_id")), labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
