"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its lower-cased words in ``BUCKETS`` hashed buckets (1 + log of
the count, scaled to length 1), one indicator per structure statistic for the range that its
value falls in, and indicators for the recorded length.  The score is the logistic function
of  w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j,  where the pairs cost no more than
the features: they are half of  sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import BLANK, LOWER, ByteHash, runs, words

#: Hashed buckets of words.
BUCKETS = 1 << 13
#: Rank of the interactions.
FACTORS = 4
#: Labelled rows to fit on, picked by a hash of the text beyond that: the bound of what is fitted, not of what is scored.
SAMPLE = 20_000
ITERATIONS, STEP, PENALTY, SEED = 60, 0.02, 1e-2, 11
#: Tasks that fit the sample.
_FIT_PARTS = 16
#: A score from here on predicts label 1.
THRESHOLD = 0.3

_BINS = 12
_STATISTICS = ("upper", "symbols", "marks", "digits", "non_ascii", "lines", "word_length", "distinct", "commonest", "repeated_bytes")
_METADATA = 34  # recorded length by powers of two, null, and disagreeing with the text
SIZE = BUCKETS + _BINS * len(_STATISTICS) + _METADATA

_UPPER, _LETTER, _DIGIT = np.zeros((3, 256), bool)
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL, _MARK = np.zeros((2, 256), bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]@^~_=+\\/"]] = True
_MARK[[ord(c) for c in "!?.,;:\"'()-"]] = True


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Range of a share from 0 to 1, finer near 0: the first for none at all."""
    share = part / np.maximum(whole, 1)
    return np.where(part > 0, np.minimum(1 + np.floor(np.sqrt(share) * (_BINS - 1)), _BINS - 1), 0).astype(np.int64)


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(2 * np.log2(1 + x)), 0, _BINS - 1).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray, hasher: ByteHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a run of whole texts, by text and feature; ``n_chars`` is -1 for null."""
    n = len(off) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[off])

    starts, ends, first = words(data, off, ~BLANK)
    of, n_words, size = np.repeat(np.arange(n), np.diff(first)), np.diff(first), np.diff(off)
    hashes = hasher.ranges(LOWER[data], starts, ends)
    code, count = np.unique(of * BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, return_counts=True)
    text, weight = code // BUCKETS, 1 + np.log(count)
    length = np.sqrt(np.bincount(text, weight**2, n))
    kinds = np.bincount(text, minlength=n)
    commonest = np.zeros(n, np.int64)
    np.maximum.at(commonest, text, count)
    twin = np.zeros(len(data), bool)  # equal to the byte two before
    twin[2:] = data[2:] == data[:-2]
    letters = per_text(_LETTER[data])
    bins = (
        _share_bin(per_text(_UPPER[data]), letters), _share_bin(per_text(_SYMBOL[data]), size), _share_bin(per_text(_MARK[data]), size), _share_bin(per_text(_DIGIT[data]), size),
        _share_bin(per_text(data >= 0x80), size), _share_bin(per_text(data == 0x0A), n_words), _log_bin(per_text(~BLANK[data]) / np.maximum(n_words, 1)),
        _share_bin(kinds, n_words), _share_bin(commonest, n_words), _share_bin(per_text(twin), size),
    )
    at = BUCKETS + _BINS * np.arange(len(bins))
    recorded = np.where(n_chars < 0, 32, np.minimum(np.log2(np.maximum(n_chars, 0) + 1), 31).astype(np.int64))
    own = per_text(data & 0xC0 != 0x80)
    wrong = np.flatnonzero((n_chars >= 0) & (n_chars != own))
    rows, base = np.arange(n), BUCKETS + _BINS * len(bins)
    texts = np.concatenate([text, *(rows for _ in bins), rows, wrong])
    places = np.concatenate([code % BUCKETS, *(a + b for a, b in zip(at, bins, strict=True)), base + recorded, np.full(len(wrong), base + 33)])
    values = np.concatenate([weight / np.maximum(length[text], 1e-12), np.ones(n * (len(bins) + 1) + len(wrong))])
    order = np.argsort(texts * SIZE + places)
    return texts[order], places[order], values[order]


@dataclass(frozen=True)
class Machine:
    """Intercept, weights and factors (a row per feature)."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, text: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Margin of each of ``n`` texts, in time linear in the features."""
        linear = np.bincount(text, self.linear[place] * value, n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            each = self.factors[place, f] * value
            pairs += np.bincount(text, each, n) ** 2 - np.bincount(text, each**2, n)
        return self.intercept + linear + pairs / 2


def _inputs(docs: DataFrame, id_col: str, text_col: str, length_col: str, *more: Column) -> DataFrame:
    recorded = F.coalesce(F.col(length_col).cast("long"), F.lit(-1).cast("long")) if length_col in docs.columns else F.lit(-1).cast("long")
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), recorded.alias("n"), *more)


def trained(labelled: DataFrame, *, label_col: str = "label", text_col: str = "text", length_col: str = "n_chars", sample: int = SAMPLE, iterations: int = ITERATIONS) -> Machine:
    """Fit on ``labelled`` texts with a label of 0 or 1 (others are left out), on ``sample`` rows at most.

    Null text counts as empty, repeated rows each.  With one class or none, the machine gives
    the same score to all: the share of label 1, a half without labels.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1))
    rows = _inputs(rows, label_col, text_col, length_col)
    total, good = rows.agg(F.count("*"), F.sum("k")).first()
    if not total or good in (0, total):
        share = min(max(good / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    if total > sample:
        rows = rows.orderBy(F.xxhash64("t", "n", "k"), "t", "n", "k").limit(sample)
    rows = rows.repartition(_FIT_PARTS, F.xxhash64("t", "n", "k"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(5)
        for b in batches:
            label, recorded = b.column(0).to_numpy(), b.column(2).to_numpy()
            for i, j, data, off in runs(b.column(1)):
                text, place, value = features(data, off, recorded[i:j], hasher)
                cut = pa.array(np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(label[i:j].astype(float)), pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value))], ["label", "places", "values"])

    vector = F.udf(lambda p, v: Vectors.sparse(SIZE, p, v), VectorUDT())  # rows of the bounded sample only
    train = rows.mapInArrow(vectors, "label double, places array<int>, values array<double>").select("label", vector("places", "values").alias("features")).persist()
    try:
        fitted = FMClassifier(factorSize=FACTORS, maxIter=iterations, stepSize=STEP, regParam=PENALTY, seed=SEED, solver="adamW").fit(train)
        return Machine(float(fitted.intercept), fitted.linear.toArray(), fitted.factors.toArray())
    finally:
        train.unpersist()


def scored(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: label 1 likelier) of every row, whole texts, no shuffle.

    Null and empty texts have a score too, from structure and metadata.  A null or missing
    length is a feature of its own.  Repeated rows are scored each; other columns are not
    read; no rows give none.  Scores are rounded to nine places.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(5)
        for b in batches:
            out, recorded = np.zeros(b.num_rows), b.column(2).to_numpy()
            for i, j, data, off in runs(b.column(1)):
                out[i:j] = machine.margins(*features(data, off, recorded[i:j], hasher), j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(out, -500, 500))), 9))], ["k", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _inputs(docs, id_col, text_col, length_col).mapInArrow(score, f"k {kind}, score double").toDF(id_col, "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is left out of training: CRC-32 of its id as text modulo 5 is 0; not for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted``, by a machine fitted on the other labels.

    An id with several labels counts with each.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("labelled_id"), F.col("quality").cast("int").alias("label"))
    columns = [c for c in ("text", "n_chars") if c in docs.columns]
    train = docs.select(F.col(id_col).alias("own_id"), *columns).join(known, F.col("own_id") == F.col("labelled_id")).select("label", *columns)
    found = scored(docs, trained(train, sample=sample), id_col=id_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
