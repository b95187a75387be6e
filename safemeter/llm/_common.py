"""Shared pieces of the operators: what a run writes, broadcasts of proven size, hot keys."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_folder


class Scratch:
    """A folder of its own in the shared folder, for what one run of an operator writes.

    Reading back what was written cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and what follows sees one fixed set of rows.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, by: str, n: int) -> DataFrame:
        """``df`` written in ``n`` buckets of column ``by``, so that grouping by it later moves no row."""
        label = f"{name}_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(n, by).saveAsTable(label)
        out = self.spark.table(label)
        self.spark.sql(f"DROP TABLE {label}")  # the entry only: the files are the folder's
        return out

    def drop(self, name: str = "") -> None:
        """Delete what was written under ``name``, or all of it."""
        remove(self.spark, f"{self.root}/{name}")


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which a heap with room puts off
    for long.  The first collection frees what Python held, the second the plans behind it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written in a folder of its own in the shared folder, and read back."""
    return Scratch(df.sparkSession, label).written(df, "rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name (case aside)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that may be broadcast, and their bytes written out; more of either are joined by a shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small_enough(df: DataFrame, rows: int = BROADCAST_IDS) -> bool:
    """Whether ``df`` has no more than ``rows`` rows and ``BROADCAST_BYTES``, whatever its columns hold."""
    first = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long").alias("size"))
    n, size = first.agg(F.count("*"), F.sum("size")).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def by_id(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """``docs`` joined with one column of ids, ``left_anti`` or ``left_semi``; a null id matches none."""
    flag = fresh_name(docs.columns, "listed_id")
    ids = ids.toDF(flag)
    return docs.join(F.broadcast(ids) if small_enough(ids) else ids, docs[id_col] == F.col(flag), how)


#: A key that more than one row in so many has is hot: there are fewer such keys than this.
HOT_SHARE = 1000


def skew_join(rows: DataFrame, values: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per ``key``, not null), by an inner join.

    ``counts``: a written table with a row per ``key`` of ``rows`` and the number ``n`` of its
    rows.  Hot keys are fewer than ``HOT_SHARE``, so their values are broadcast; the others are
    joined by a shuffle, in which no key stands out.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_SHARE > total).where("n > 1").select(key)
    few = F.broadcast(values.join(F.broadcast(hot), key, "left_semi"))
    others = rows.join(F.broadcast(hot), key, "left_anti").join(values.hint("shuffle_merge"), key)
    return rows.join(few, key).unionByName(others)


#: Bits of a row of ``bit_filter``: what Spark's bitmap aggregate holds.
_BITMAP = 1 << 15


def bit_filter(values: DataFrame, column: str, size: int) -> np.ndarray:
    """Bytes with the bit ``value mod size`` set for each value of a long column.

    ``size`` (a power of 2) bounds what the driver gets, whatever the number of values; a bit
    that is set may be another value's, so an exact join has to follow.
    """
    place = F.col(column).bitwiseAND(F.lit(size - 1))
    rows = values.select(F.shiftright(place, 15).alias("row"), place.bitwiseAND(F.lit(_BITMAP - 1)).alias("bit"))
    bits = np.zeros((size // _BITMAP, _BITMAP // 8), np.uint8)
    rows = rows.repartition("row")  # a value is smaller than a part of the bitmap
    for r in rows.groupBy("row").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        bits[r["row"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.reshape(-1)


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values have their bit set."""
    p = (values.astype(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


#: ``monotonically_increasing_id`` holds the partition above these bits and the row in it below.
_ROW_BITS = 33


def ranked(df: DataFrame, order: list[str], scratch: Scratch, label: str, name: str = "i") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... by the columns ``order``, nulls first; rows that tie come in any order.

    A range sort deals the rows out and is written once with each row's place; the sizes of
    the partitions before are added on reading.  Ties are dealt out too, by a seeded number.
    """
    tie = fresh_name(df.columns, "tie")
    keys = [*order, tie]
    dealt = df.withColumn(tie, F.rand(7)).repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = scratch.written(dealt.drop(tie).withColumn("_place", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_place", _ROW_BITS))
    sizes = dict(map(tuple, dealt.groupBy("_part").count().collect()))  # a row per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offsets = df.sparkSession.createDataFrame(sorted(before.items()), "_part long, _before long")
    return dealt.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias(name))


def whole_groups(batches: Iterator[pa.RecordBatch], by: int, rows: int) -> Iterator[pa.Table]:
    """About ``rows`` rows at a time, in tasks, that end where the first ``by`` columns (not null) change; equal ones must follow one another."""
    kept, n = [], 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        same = np.ones(n, bool)
        for c in range(by):
            same &= pc.equal(t.column(c), t.column(c)[-1]).to_numpy()
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        kept, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    step = "lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end"
    each = f"lambda a, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::bigint[], {step}, xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), {each}, 4294967295::bigint), 4294967295::bigint)"
