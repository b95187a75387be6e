"""Packing into padded batches with optimal length buckets.

The global histogram of lengths goes to the driver (at most ``max_length`` + 1 numbers);
dynamic programming over it picks the bucket boundaries with the least padding.  In each
bucket the sequences are numbered without gaps, in parallel, and cut into batches that
hold ``token_budget`` tokens, padding included.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

MAX_LENGTH = 2048
BUCKETS = 8
TOKEN_BUDGET = 16384
#: Sequences numbered together in one window.
SLICE_ROWS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> tuple[list[int], int]:
    """At most ``k`` upper bounds among ascending ``lengths`` that minimise the padding; that padding.

    Ties take the smaller cut.  No lengths: no bounds.
    """
    n = len(lengths)
    if n == 0:
        return [], 0
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    below = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    # cost[i, j]: lengths i..j padded to lengths[j]
    best = lengths * below[1:] - tokens[1:]
    cuts = []
    for _ in range(1, min(k, n)):
        new, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (below[j + 1] - below[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            at = int(np.argmin(cost))
            if cost[at] < new[j]:
                new[j], cut[j] = cost[at], at
        best = new
        cuts.append(cut)
    bounds, j = [int(lengths[-1])], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            bounds.append(int(lengths[j]))
    return bounds[::-1], int(best[-1])


def numbered(rows: DataFrame, by: str, row: str = "row") -> DataFrame:
    """``rows`` with ``position``: 0, 1, 2 ... within each value of ``by``, in an order given by a hash of the unique ``row``.

    ``rows`` must be a written table.  Rows are dealt into slices of about ``SLICE_ROWS``
    that are numbered side by side, so one value may hold all rows.
    """
    slices = max(1, math.ceil(rows.count() / SLICE_ROWS))
    dealt = rows.withColumn("hash", F.xxhash64(row)).withColumn("slice", F.pmod("hash", F.lit(slices)).cast("int"))
    before = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(by, "slice").agg(F.count("*").alias("size")).select(by, "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(by, "slice").orderBy("hash", row)) - 1
    return dealt.withColumn("place", place).join(sizes, [by, "slice"]).withColumn("position", F.col("place") + F.col("offset")).drop("hash", "slice", "place", "offset")


def packed(lengths: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per sequence: id, ``segment`` (0 unless the document is longer than
    ``max_length`` and so is cut), ``start``, ``length``, ``bucket``, ``padded_length``,
    ``batch`` (dense over all buckets) and ``slot`` in the batch.

    Which sequences of a bucket share a batch follows the order in which the input was read:
    another split of the same rows gives other batches of the same sizes.  A batch has at most ``token_budget // padded_length`` sequences, one at least.  Null or
    zero length gives one empty sequence, in the first bucket.  Ties and repeated rows are
    packed each.  An empty table gives an empty result.  Other columns are not read.
    """
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    whole = lengths.select(F.col(id_col), n.alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / max_length), F.lit(1))
    cut = whole.select(id_col, "n", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("segment"))
    cut = cut.select(id_col, F.col("segment").cast("int"), (F.col("segment") * max_length).alias("start"), F.least(F.col("n") - F.col("segment") * max_length, F.lit(max_length)).cast("int").alias("length"))
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "sequences")
    histogram = sorted((r["length"], r["count"]) for r in cut.groupBy("length").count().collect())
    bounds, _ = optimal_boundaries(np.array([x for x, _ in histogram]), np.array([c for _, c in histogram]), buckets)
    bounds = bounds or [max_length]
    bucket = sum((F.when(F.col("length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    padded = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1)
    capacity = [max(1, token_budget // max(1, b)) for b in bounds]
    sizes, first, total = dict.fromkeys(range(len(bounds)), 0), [], 0
    for x, c in histogram:
        sizes[sum(x > b for b in bounds[:-1])] += c
    for k, room in enumerate(capacity):
        first.append(total)
        total += -(-sizes[k] // room)
    room = F.element_at(F.array(*map(F.lit, capacity)), F.col("bucket") + 1)
    start_batch = F.element_at(F.array(*(F.lit(x).cast("long") for x in first)), F.col("bucket") + 1)
    placed = numbered(cut.withColumn("bucket", bucket.cast("int")), "bucket")
    return placed.select(
        id_col, "segment", "start", "length", "bucket", padded.alias("padded_length"),
        (start_batch + F.floor(F.col("position") / room)).alias("batch"), (F.col("position") % room).cast("int").alias("slot"),
    )
