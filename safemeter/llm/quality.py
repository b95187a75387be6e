"""Quality rules: a trusted-target against raw-corpus log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: one over the trusted documents, one
over all documents.  A document's score is the mean over its n-grams of
log(p_target / p_raw); it passes when the score reaches ``threshold``.  Ratios are kept as
integers (``SCALE`` per nat), so sums are exact in any order and the verdict is the same on
every run.  Simple counts per document (words, symbols, repeated lines and words) are taken
in the same pass and fail a document on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BLANK, ByteHash, mix, runs, windows, words
from ._common import fresh_name, small_enough

NGRAM = 4
BUCKETS = 1 << 16
SCALE = 1 << 20
#: Pseudo-count of each bucket in both multinomials.
SMOOTHING = 1.0
#: Between the classes: fitted on half of the labels, documents of the other half that pass the base rules score above -0.16
#: where labelled good, and below -0.5 where labelled bad.
THRESHOLD = -0.3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, llr_sum long"


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of ``data[i : i + n]`` for each i with n bytes left."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    size = len(data) - n + 1
    x = np.zeros(size, np.uint64)
    for k in range(n):
        x = (x << np.uint64(8)) | data[k : k + size] if n <= 8 else x * np.uint64(0x100000001B3) + data[k : k + size]
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def _whole(off: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first ``size`` positions start an n-byte range inside one text."""
    step = np.zeros(size + 1, np.int32)
    keep = np.maximum(off[1:] - n + 1, off[:-1])
    np.add.at(step, np.minimum(off[:-1], size), 1)
    np.add.at(step, np.minimum(keep, size), -1)
    return np.cumsum(step[:-1]) > 0


def gram_counts(docs: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """``bucket``, ``raw`` and ``target`` counts over all texts and over those of the trusted ids.

    ``trusted_ids``: one column of distinct ids.  Buckets that no text has are absent.
    """
    flag = fresh_name(docs.columns, "trusted")
    ids = trusted_ids.toDF(flag)
    side = F.broadcast(ids) if small_enough(ids) else ids.hint("shuffle_hash")
    marked = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    marked = marked.join(side, marked["k"] == F.col(flag), "left").select("t", F.col(flag).isNotNull().alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            trusted = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, off in runs(b.column(0)):
                at = buckets(data, n)
                ok = _whole(off, len(at), n)
                total[0] += np.bincount(at[ok], minlength=BUCKETS)
                ok &= np.repeat(trusted[i:j], np.diff(off))[: len(at)]
                total[1] += np.bincount(at[ok], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    parts = marked.mapInArrow(count, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """Integer log-likelihood ratios of all ``BUCKETS`` buckets (a fixed number of rows, whatever the corpus)."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS, np.int64)
    share = [np.log((x + smoothing) / (x.sum() + smoothing * BUCKETS)) for x in (target, raw)]
    return np.rint((share[0] - share[1]) * SCALE).astype(np.int64)


def repeated_lines(data: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the lines with a word that equal an earlier line of it, byte by byte."""
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.unique(np.concatenate([off[:-1], breaks + 1]))
    doc = np.searchsorted(off[1:], begins, side="right")
    keep = doc < len(off) - 1
    # the line after a break at the very end of a text is empty and holds no word; the next text starts there too
    begins, doc = begins[keep], doc[keep]
    stops = np.searchsorted(breaks, begins)
    ends = np.minimum(np.append(breaks, len(data))[stops], off[doc + 1])
    worded = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    raw, found, seen, last = data.tobytes(), np.zeros(len(off) - 1, np.int64), set(), -1
    for d, a, b in zip(doc[worded].tolist(), begins[worded].tolist(), ends[worded].tolist(), strict=True):
        if d != last:
            seen, last = set(), d
        n = len(seen)
        seen.add(raw[a:b])
        found[d] += len(seen) == n
    return found


def measure(texts: pa.Array, llr: np.ndarray, n: int = NGRAM, hasher: ByteHash | None = None) -> dict[str, np.ndarray]:
    """The counts of ``_RESULT`` for each text."""
    hasher = hasher or ByteHash(3)
    out = {k.split()[0]: np.zeros(len(texts), np.int64) for k in _RESULT.split(", ")}
    for i, j, data, off in runs(texts):
        rows = slice(i, j)

        def per_text(mask: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            total = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return np.diff(total[np.minimum(off, len(mask))])

        starts, ends, first = words(data, off, ~BLANK)
        out["n_words"][rows] = np.diff(first)
        out["word_chars"][rows] = per_text(~BLANK[data] & (data & 0xC0 != 0x80))
        out["n_symbols"][rows] = per_text(SYMBOL[data])
        out["n_dup_lines"][rows] = repeated_lines(data, off, starts)
        # word windows
        if len(starts) >= WINDOW:
            of = np.repeat(np.arange(j - i), np.diff(first))
            key = windows(hasher.ranges(data, starts, ends), WINDOW, 1)[: len(starts) - WINDOW + 1]
            inside = of[: len(key)] == of[WINDOW - 1 :]
            key = mix(key ^ mix(of[: len(key)].astype(np.uint64) + np.uint64(1)))
            at = np.flatnonzero(inside)
            order = at[np.argsort(key[at])]
            twin = key[order][1:] == key[order][:-1]
            again = np.zeros(len(starts), bool)
            again[order[1:][twin]] = True
            again[order[:-1][twin]] = True
            covered = again.copy()
            for k in range(1, WINDOW):
                covered[k:] |= again[:-k]
            out["n_repeat_words"][rows] = np.bincount(of[covered], minlength=j - i)
        # n-grams
        at = buckets(data, n)
        ok = _whole(off, len(at), n)
        out["n_grams"][rows] = per_text(ok)
        out["llr_sum"][rows] = per_text(np.where(ok, llr[at], 0))
    return out


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Ids that every label row calls good (``quality`` 1) and none calls toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good")).where("good = 1").select(id_col)


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT, corpus: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, llr (mean log-likelihood ratio; null without n-grams), base_failed, kept.

    Only ``id_col`` and those columns come back; other columns of ``docs`` are not read.
    ``corpus``: the raw corpus that is counted (``docs`` by default).  Null text counts as
    empty and fails the base rules.  Repeated rows are judged each.  Without trusted texts
    all ratios are 0.  Empty tables give an empty result.
    """
    llr = ratios(gram_counts(docs if corpus is None else corpus, trusted_ids(labels, id_col=id_col), id_col=id_col, text_col=text_col, n=n))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(3)
        for b in batches:
            found = measure(b.column(1), llr, n, hasher)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.values())], ["k", *found])

    got = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(score, f"k {kind}, {_RESULT}")
    llr_mean = F.when(F.col("n_grams") > 0, F.col("llr_sum") / F.col("n_grams") / F.lit(float(SCALE)))
    enough = F.col("llr_sum") >= F.lit(round(threshold * SCALE)) * F.col("n_grams")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    got = got.withColumns({"llr": llr_mean, "base_failed": failed, "kept": ~failed & enough})
    return got.select(F.col("k").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judged` keeps; no shuffle of the texts.

    Null text counts as empty.  Rows are judged one by one, whatever their id: repeated rows
    stay or go together.  Ties of score and threshold stay.  Empty tables give an empty result.
    """
    llr = ratios(gram_counts(docs, trusted_ids(labels, id_col=id_col), id_col=id_col, text_col=text_col, n=n))
    place = docs.columns.index(text_col)
    bar = round(threshold * SCALE)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(3)
        for b in batches:
            m = measure(b.column(place), llr, n, hasher)
            keep = (m["n_words"] >= min_words) & (100 * m["n_repeat_words"] <= max_repeated_percent * m["n_words"]) & (m["llr_sum"] >= bar * m["n_grams"])
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(good, docs.schema)


JUDGED_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
base as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines from w),
places as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3),
threes as (select doc_id, i, count(*) over (partition by doc_id, w[i:i + 2]) as often from places),
covered as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 3)) as p from threes where often > 1) group by doc_id),
b as (select doc_id, hex(encode(t)) as h from d),
starts as (select doc_id, h, unnest(range(0, length(h) // 2 - {NGRAM - 1})) as i from b where length(h) >= {2 * NGRAM}),
grams as (select doc_id, substr(h, 2 * i + 1, {2 * NGRAM}) as g, count(*) as n from starts group by 1, 2),
placed as (
  select doc_id, cast((cast(cast('0x' || g as ubigint) as hugeint) * 11400714819323198485 % 18446744073709551616) // 281474976710656 % {BUCKETS} as int) as bucket, sum(n) as n from grams group by 1, 2),
good as (select doc_id from labels where doc_id is not null group by doc_id having bool_and(coalesce(quality = 1 and coalesce(toxic, 0) = 0, false))),
counts as (select bucket, sum(n) as raw, coalesce(sum(n) filter (doc_id in (select doc_id from good)), 0) as target from placed group by bucket),
sums as (select sum(raw) as raws, sum(target) as targets from counts),
ratio as (
  select bucket, case when targets = 0 then 0 else cast(round((ln((target + {SMOOTHING}::double) / (targets + {SMOOTHING * BUCKETS}::double)) - ln((raw + {SMOOTHING}::double) / (raws + {SMOOTHING * BUCKETS}::double))) * {SCALE}) as bigint) end as r
  from counts cross join sums),
score as (select doc_id, cast(sum(n) as bigint) as n_grams, cast(sum(n * r) as bigint) as llr_sum from placed join ratio using (bucket) group by doc_id),
judged as (
  select *, coalesce(c.n_repeat_words, 0) as repeated from base left join covered c using (doc_id) left join score using (doc_id)),
failed as (select *, n_words < {MIN_WORDS} or 100 * repeated > {MAX_REPEATED_PERCENT} * n_words as base_failed from judged)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(repeated as bigint) as n_repeat_words, base_failed,
  not base_failed and coalesce(llr_sum, 0) >= {round(THRESHOLD * SCALE)} * coalesce(n_grams, 0) as kept, llr_sum::double / n_grams / {float(SCALE)}::double as llr
from failed
"""
