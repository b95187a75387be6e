"""Language identification by nearest centroid.

A text, with a blank before and after it, is a vector of hashed byte n-grams, weighted by
TF-IDF and scaled to length 1.  Each
language has several centroids, clustered by spherical k-means, and a text gets the language
of the centroid nearest by cosine.  A text farther from it than any of the texts of that
centroid, but for a small share, is marked as rejected.

Document frequencies are counted over all training texts.  Only the clustering sees a
sample: about ``SAMPLE`` labelled texts per language, picked by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import runs

DIMENSIONS = 4096
NGRAMS = (2, 3)
#: Labelled texts per language that the clustering sees.
SAMPLE = 2000
CENTROIDS = 4
ITERATIONS = 12
#: Share of a centroid's own sample that lies beyond its rejection distance.
REJECTED_SHARE = 0.002
UNDETERMINED = "und"
#: Texts made into vectors together, and languages a model may have: both bound memory.
ROWS, MOST_LANGUAGES = 256, 500

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def cleaned(data: np.ndarray) -> np.ndarray:
    """ASCII letters and Latin-1 capitals in lower case, every other ASCII byte a space."""
    out = _CLEAN[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) > 1 else []
    out[capital] += 0x20
    return out


def vectors(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, n-gram counts as rows of ``DIMENSIONS``) of runs of texts."""
    for i, j, data, off in runs(texts, rows=ROWS):
        size = np.diff(off)
        low = np.full(len(data) + 2 * (j - i), 0x20, np.uint8)
        low[np.arange(len(data)) + 2 * np.repeat(np.arange(j - i), size) + 1] = cleaned(data)
        total = np.zeros((j - i) * DIMENSIONS, np.int64)
        of = np.repeat(np.arange(j - i), size + 2)
        for n in NGRAMS:
            size = len(low) - n + 1
            if size <= 0:
                continue
            x = np.zeros(size, np.uint64)
            blank = np.ones(size, bool)
            for k in range(n):
                x = (x << np.uint64(8)) | low[k : k + size]
                blank &= low[k : k + size] == 0x20
            keep = (of[:size] == of[n - 1 :]) & ~blank
            slot = ((x + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            total += np.bincount(of[:size][keep] * DIMENSIONS + slot[keep].astype(np.int64), minlength=len(total))
        yield i, j, total.reshape(j - i, DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 (or 0 where a text has no n-gram)."""
    x = np.log1p(counts) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id, as text, has CRC-32 remainder 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def inverse_frequency(texts: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each dimension over all of ``texts`` (one column, t)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for i, j, x in vectors(b.column(0)):
                df[:-1] += (x > 0).sum(axis=0)
                df[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(df)], ["d", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for r in texts.mapInArrow(count, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect():
        df[r["d"]] = r["n"]
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def clustered(x: np.ndarray, k: int, rounds: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of the rows of ``x``, in an order of their own: centroids and their rejection cosines."""
    raw = [r.tobytes() for r in np.ascontiguousarray(x)]
    x = x[sorted(range(len(raw)), key=raw.__getitem__)]  # float sums then do not hang on the order of arrival
    centre = [x.mean(axis=0)]
    near = x @ centre[0]
    chosen = [int(np.argmax(near))]
    for _ in range(1, min(k, len(x))):  # next the text least like those chosen
        best = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(best)))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == g].sum(axis=0) if (own == g).any() else c[g] for g in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    cosine = x @ c.T
    own = cosine.argmax(axis=1)
    least = [np.quantile(cosine[own == g, g], REJECTED_SHARE) if (own == g).any() else 0.0 for g in range(len(c))]
    return c, np.array(least)


class Model:
    """Inverse frequencies, centroids with their languages, and rejection cosines."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.centroids, self.least = idf, languages, centroids, least

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        label, score, far = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return label, score, far
        for i, j, x in vectors(texts):
            cosine = weighted(x, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            score[i:j] = np.clip(cosine[np.arange(j - i), best], 0, 1)
            far[i:j] = score[i:j] < self.least[best]
            for k in range(i, j):
                if has_letter(texts[k].as_py()):
                    label[k] = self.languages[best[k - i]]
        none = np.array([v == UNDETERMINED for v in label])
        score[none], far[none] = 0, True
        return label, score, far


def trained(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from the rows of ``docs`` that are not held out and have a language.

    What comes to the driver is ``centroids`` vectors for each of at most ``MOST_LANGUAGES``
    languages; a column with more values is an error.  Null texts teach nothing, texts without
    n-grams no centroid.  Repeated rows count as often as they occur; rows with a null id
    are trained on.  Rows of one language, whatever their order, give the same centroids.
    Without labelled rows the model has no language and predicts ``und``.
    """
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    idf = inverse_frequency(known.select("t"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    pick = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in vectors(b.column(0)):
                some = np.flatnonzero(x.any(axis=1))
                v = weighted(x[some], idf).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(i + some)), pa.array([r.tobytes() for r in v], pa.binary())], ["lang", "vector"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["vector"]), np.float32).reshape(len(group), DIMENSIONS).astype(np.float64)
        c, least = clustered(x, centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [r.tobytes() for r in c], "least": least})

    embedded = known.join(F.broadcast(sizes), "lang").where(pick).select("t", "lang").mapInArrow(embed, "lang string, vector binary")
    found = embedded.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, least double").toPandas()
    found = found.sort_values(["lang", "centroid"], ignore_index=True)
    c = np.frombuffer(b"".join(found["centroid"]), np.float64).reshape(len(found), DIMENSIONS)
    return Model(idf, found["lang"].tolist(), c, found["least"].to_numpy())


def identified(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``language``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected``.

    The language is that of the nearest centroid even where it is rejected for its distance;
    null and letterless texts, and no others, are ``und`` with score 0 and rejected.  Ties go to the language
    that sorts first.  Repeated rows give repeated rows; empty tables an empty result.  Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.languages, model.centroids, model.least))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*shared.value)
        for b in batches:
            label, score, far = here.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score), pa.array(far)], ["k", "language", "score", "rejected"])

    narrow = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(predict, f"k {kind}, language string, score double, rejected boolean").withColumnRenamed("k", id_col)
