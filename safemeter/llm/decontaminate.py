"""Benchmark decontamination by winnowing.

Every text is reduced to fingerprints: in each sliding window of consecutive k-gram hashes
the smallest one is kept.  A window of ``span`` words holds ``span - k + 1`` k-grams, which
is the size of the sliding window, so any span of that many shared words has a fingerprint
in common.  Benchmark items shorter than ``span`` words are one window; there k is their
own length and the sliding window is 1.  Training fingerprints join the benchmark's, and
each hit is extended to the windows around it, which join the benchmark's windows by the
SHA-256 of their words; the shorter hashes before only find candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, WORDY, ByteHash, runs, signed, windows, words
from ._common import bit_filter, by_id, in_filter, written

SPAN = 13
GRAM = 5
#: Bits of the filter that spares most fingerprints the join: 16 for each of the benchmark's, within these bounds.
FILTER_BITS, MOST_FILTER_BITS = 1 << 24, 1 << 27
#: Benchmark windows (some 50 bytes each) are broadcast up to this many, item ids up to so many
#: bytes in all; beyond it the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _grams(texts: pa.Array, span: int, gram: int, lengths: list[int], hasher: ByteHash):
    """For each run of texts: (first and end row, word counts, each text's first word, text of each word,
    [(length, window starts, gram places, gram hashes)], digests of windows).

    For each window start the place and value of the fingerprint that stands for it.  Places
    count from the run's first word.
    """
    for i, j, data, off in runs(texts):
        low = LOWER[data]
        starts, ends, first = words(low, off, WORDY)
        counts = np.diff(first)
        word = hasher.ranges(low, starts, ends)

        def digests(first_word: np.ndarray, length: int, low: np.ndarray = low, starts: np.ndarray = starts, ends: np.ndarray = ends) -> list[bytes]:
            """SHA-256 of windows: their lower-case words joined by spaces."""
            raw = low.tobytes()
            return [hashlib.sha256(b" ".join(raw[starts[w] : ends[w]] for w in range(f, f + length))).digest() for f in first_word.tolist()]

        of = np.repeat(np.arange(j - i), counts)
        stop = np.repeat(first[1:], counts)
        found = []
        for length in lengths:
            k = gram if length == span else length
            at = np.flatnonzero(np.arange(len(word)) + length <= stop)
            if not len(at):
                continue
            g = windows(word, k, 100 + length)
            place, least = at.copy(), g[at]
            for step in range(1, length - k + 1):
                lower = g[at + step] <= least
                place[lower], least[lower] = at[lower] + step, g[at + step][lower]
            found.append((length, at, place, least))
        yield i, j, counts, first, of, found, digests


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``item`` (string), ``length``, ``fingerprint``, ``window``: every window of every item with its fingerprint."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(5)
        for b in batches:
            for i, _, counts, _, of, found, digests in _grams(b.column(1), span, gram, list(range(1, span + 1)), hasher):
                for length, at, _, fp in found:
                    own = (np.minimum(counts, span) == length)[of[at]]
                    items = b.column(0).take(pa.array(i + of[at][own]))
                    window = pa.array(digests(at[own], length), pa.binary())
                    yield pa.RecordBatch.from_arrays([items, pa.array(np.full(own.sum(), length, np.int32)), pa.array(signed(fp[own])), window], ["item", "length", "fingerprint", "window"])

    narrow = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(windows_of, "item string, length int, fingerprint long, window binary").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, found): one row of ``row``, id and ``n_words`` per document, and per occurrence
    of a benchmark window in it ``row``, ``start`` (word index), ``length`` and ``window``,
    with the benchmark's windows as a third result."""
    bench = written(benchmark_windows(benchmark, id_col=item_id_col, text_col=item_text_col, span=span, gram=gram), "benchmark")
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())
    size = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (16 * bench.count()).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(bench, "fingerprint", size))
    kind = docs.schema[id_col].dataType.simpleString()
    hit = "struct<start:int,length:int,fingerprint:long,window:binary>"

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash(5)
        for b in batches:
            n_words, parts, window = np.zeros(b.num_rows, np.int64), [], []
            for i, j, counts, first, of, found, digests in _grams(b.column(1), span, gram, lengths, hasher):
                n_words[i:j] = counts
                for length, at, _, fp in found:
                    some = in_filter(bits.value, fp)
                    at = at[some]
                    parts.append((i + of[at], at - first[of[at]], np.full(len(at), length), signed(fp[some])))
                    window += digests(at, length)
            none = np.zeros(0, np.int64)
            rows, *columns = (np.concatenate([none, *(x[k] for x in parts)]) for k in range(4))
            order = np.argsort(rows, kind="stable")
            offsets = np.searchsorted(rows[order], np.arange(b.num_rows + 1)).astype(np.int32)
            columns = [pa.array(c[order].astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64), strict=True)]
            struct = pa.StructArray.from_arrays([*columns, pa.array(window, pa.binary()).take(pa.array(order))], ["start", "length", "fingerprint", "window"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.ListArray.from_arrays(pa.array(offsets), struct)], ["id", "n_words", "hits"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    marked = narrow.mapInArrow(fingerprints, f"id {kind}, n_words long, hits array<{hit}>")
    marked = written(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    small = bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda x: x)
    some = marked.select("row", F.inline("hits"))
    some = some.join(side(bench.select("length", "fingerprint").distinct()), ["length", "fingerprint"], "left_semi")
    found = some.join(side(bench.select("length", "window").distinct()), ["length", "window"], "left_semi").select("row", "start", "length", "window")
    return marked.select("row", F.col("id").alias(id_col), "n_words"), written(found, "found"), bench


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, hit_share: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside any occurrence of a
    benchmark window), items (sorted array of item ids with occurring windows), spans
    (array of start and end word indices, end exclusive, of the maximal hit runs) and
    ``contaminated``: n_hit > 0 and hit_share * n_hit >= n_words.

    Null or blank texts have no words and are never hit.  Null item ids count for n_hit but
    not among the items.  Repeated rows are judged each.  Without benchmark items nothing
    is hit.  Other columns of either table are not read.
    """
    rows, found, bench = hits(docs, benchmark, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, span=span, gram=gram)
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, 0)
    runs_ = found.select("row", "start", "length").distinct().withColumn("reached", F.max(end).over(before))
    runs_ = runs_.withColumn("n", F.sum(F.when(F.col("reached").isNull() | (F.col("start") > F.col("reached")), 1).otherwise(0)).over(upto))
    runs_ = runs_.groupBy("row", "n").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    spans = runs_.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    size = bench.agg(F.count("*"), F.sum(F.octet_length("item"))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES
    named = bench.where("item is not null").select("length", "window", "item").distinct()
    occurring = found.select("row", "length", "window").distinct()
    items = occurring.join(F.broadcast(named) if small else named, ["length", "window"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(spans.join(items, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        ((n_hit > 0) & (hit_share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` without the contaminated documents.

    An id that several rows share goes if any of them is contaminated; rows with a null id stay.
    """
    bad = contamination(docs, benchmark, id_col=id_col, **params).where("contaminated").where(F.col(id_col).isNotNull()).select(id_col).distinct()
    return by_id(docs, written(bad, "contaminated"), id_col, "left_anti")


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTAMINATION_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
places as (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0),
bench as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as span from places),
lengths as (select distinct n from bench),
starts as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join lengths where len(w) >= n),
spans as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as span from starts),
found as (select s.doc_id, s.n, s.i, b.item_id from spans s join bench b on s.n = b.n and s.span = b.span),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from found)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""
