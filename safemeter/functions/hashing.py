"""Hashes of configurations and data sets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .numbering import numbered

# The fields that make up a configuration and a canonical record.
CONFIGURATION_FIELDS = ("dataset_hash", "detector_version", "git_sha", "high_threshold", "judge_model", "low_threshold", "policy_version", "seed")
RECORD_FIELDS = ("family", "is_synthetic", "label", "objective", "source", "text")
CHUNK_ROWS = 1024


def _canonical(frame: pd.DataFrame, fields: tuple[str, ...]) -> list[bytes]:
    """Key-sorted compact JSON of each row; characters beyond ASCII are escaped."""
    rows = frame[list(fields)].astype(object).where(frame[list(fields)].notna(), None)
    return [json.dumps(r, sort_keys=True, separators=(",", ":")).encode() for r in rows.to_dict("records")]


def configuration_hash(runs: DataFrame) -> DataFrame:
    """``runs`` with ``configuration_hash`` computed from its eight configuration fields."""

    @F.pandas_udf("string")
    def digest(fields: pd.DataFrame) -> pd.Series:
        return pd.Series(["sha256:" + hashlib.sha256(line).hexdigest() for line in _canonical(fields, CONFIGURATION_FIELDS)])

    return runs.withColumn("configuration_hash", digest(F.struct(*CONFIGURATION_FIELDS)))


def record_digest(*, fields: tuple[str, ...] = RECORD_FIELDS) -> Column:
    """SHA-256 (binary) of each row's canonical JSON line."""

    @F.pandas_udf("binary")
    def digest(record: pd.DataFrame) -> pd.Series:
        return pd.Series([hashlib.sha256(line + b"\n").digest() for line in _canonical(record, fields)])

    return digest(F.struct(*fields))


def dataset_hash_exact(prompts: DataFrame, order: list[str]) -> str:
    """One digest over the canonical lines in ``order``, which must be unique; only the digest reaches the driver.

    The digest of all lines is sequential by nature: lines are made and sorted in parallel, then one
    task reads the sorted partitions one after another, holding a batch of lines at a time, and
    fails if a line is out of its place.
    """

    @F.pandas_udf("binary")
    def line(record: pd.DataFrame) -> pd.Series:
        return pd.Series(_canonical(record, RECORD_FIELDS))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for b in batches:
            for i, x in zip(b.column(0), b.column(1), strict=True):
                if i.as_py() != n:
                    raise ValueError(f"line {i} came in place of {n}")
                digest.update(x.as_buffer())
                digest.update(b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n], "digest": [digest.hexdigest()]})

    lines = numbered(prompts.select(*order, line(F.struct(*RECORD_FIELDS)).alias("line")), order, "i").select("i", "line")
    (found,) = lines.orderBy("i").coalesce(1).mapInArrow(digested, "n long, digest string").collect() or [{"digest": hashlib.sha256().hexdigest()}]
    return f"sha256:{found['digest']}"


def dataset_hash_tree(prompts: DataFrame, order: list[str]) -> DataFrame:
    """One row, ``dataset_hash``: digests of rows, then of runs of ``CHUNK_ROWS`` ordered rows, level by level.

    Never compare it with :func:`dataset_hash_exact`; the prefix names the scheme.  The
    result does not depend on the partitioning.  ``order`` must be unique.  An empty set has
    the digest of no bytes.
    """
    level = numbered(prompts.select(*order, record_digest().alias("digest")), order, "i").select("i", "digest")
    while True:  # one level is 1,024 times smaller than the one before
        chunks = level.groupBy(F.floor(F.col("i") / CHUNK_ROWS).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", F.hex("digest").alias("h")))).alias("rows"))
        level = chunks.select("i", F.unhex(F.sha2(F.array_join(F.transform("rows", lambda x: x["h"]), ""), 256)).alias("digest"))
        level = written(level, "digests")
        if level.count() < 2:
            break
    top = level.agg(F.max("digest").alias("digest"))
    return top.select(F.concat(F.lit("sha256-tree:"), F.coalesce(F.lower(F.hex("digest")), F.sha2(F.lit(""), 256))).alias("dataset_hash"))
