"""Replay of a corpus as a stream of blind events.

The events go to ordered files and the truth to a place of its own; the stream reads the
event files with the blind schema, so no truth column can reach a detector.  Detection is
stateless.  The sink keeps each key and its digest as the stream's state: a row that comes again
adds nothing, a changed payload raises, and what has landed is not read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType, VariantType

from ..operators.staging import blind_events, truth_of, with_clock
from ..schemas import BLIND_EVENT
from ..sources.shared import exists

#: Rows of a file of events.
ROWS_PER_FILE = 50_000
#: Keys outgrow an executor's heap, so they are kept in RocksDB.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DIGEST, KIND = "_digest", "_kind"


def publish(corpus: DataFrame, order: list[str], events_path: str, truth_path: str, *, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write the events as files of about ``rows_per_file`` in order of time, and their truth apart; the number of files."""
    replayed = with_clock(corpus, order)
    truth_of(replayed).write.mode("overwrite").parquet(truth_path)
    files = max(1, -(-replayed.count() // rows_per_file))
    blind_events(replayed).repartitionByRange(files, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(events_path)
    return files


def subscribe(spark: SparkSession, events_path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """The stream of blind events."""
    return spark.readStream.schema(BLIND_EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(events_path)


def payload_digest(schema: StructType, keys: list[str]) -> Column:
    """SHA-256 of a row's columns other than ``keys``, null apart from every value."""

    def text(name: str, of: DataType) -> Column:
        nested = isinstance(of, (ArrayType, MapType, StructType, VariantType))
        return F.to_json(name, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}) if nested else F.base64(name) if of.typeName() == "binary" else F.col(name).cast("string")

    texts = [text(f.name, f.dataType).alias(f.name) for f in schema.fields if f.name not in keys]
    return F.sha2(F.to_json(F.struct(*texts), {"ignoreNullFields": "false"}), 256) if texts else F.lit("")


def land(stream: DataFrame, path: str, checkpoint: str, *, keys: list[str], also: tuple[Callable[[DataFrame, int], None], ...] = ()) -> StreamingQuery:
    """Write a stream to ``path`` by key, all that is there now; ``also`` gets the new rows of every batch.

    A key's first row lands, the same row again (null equal to null) is a no-op, and another
    payload raises.  The state, in RocksDB under ``checkpoint``, holds the keys and, apart,
    each key with its payload's digest; a batch that brings more new pairs of them than new
    keys brings another payload.  So a batch costs what it brings, however much has landed,
    though the stream is computed twice.  A query with a new checkpoint takes the digests of
    what lies in ``path`` into its first batch, in one read; one that goes on from its
    checkpoint reads nothing.  Two queries that run at once into one path do not see each
    other's keys.  The new rows of a batch overwrite the folder of that batch, so a batch
    that is retried after a crash leaves one copy.
    """
    session, schema = stream.sparkSession, stream.schema
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    digest, known = payload_digest(schema, keys), f"{checkpoint}/known"
    if not exists(session, f"{checkpoint}/offsets"):
        there = session.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(path).where(F.col("batch").substr(1, len(query)) != query) if exists(session, path) else session.createDataFrame([], schema)
        there.select(*keys, digest.alias(DIGEST)).write.mode("overwrite").parquet(known)
    rows, old = stream.withColumn(DIGEST, digest), session.readStream.schema(StructType([*(schema[k] for k in keys), StructField(DIGEST, StringType())])).parquet(known)
    first = rows.withColumn(KIND, F.lit("first")).unionByName(old.withColumn(KIND, F.lit("known")), allowMissingColumns=True).dropDuplicates(keys)
    pairs = rows.select(*keys, DIGEST).unionByName(old).dropDuplicates([*keys, DIGEST]).withColumn(KIND, F.lit("pair"))
    parts = first.unionByName(pairs, allowMissingColumns=True).unionByName(old.withColumn(KIND, F.lit("old")), allowMissingColumns=True)

    def sink(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            of = lambda *kinds: batch.where(F.col(KIND).isin(*kinds))
            count = {r[KIND]: r["count"] for r in batch.groupBy(KIND).count().collect()}
            if count.get("pair", 0) > count.get("first", 0) + count.get("known", 0):
                other = of("pair").select(*keys).exceptAll(of("first", "known").select(*keys)).first()
                raise ValueError(f"another payload was landed under {list(other)}")
            new = of("first").select(*schema.names)
            if count.get("old"):  # any of a key's rows may have come first
                own = of("old").select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)))
                new = new.join(own, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]), "left_anti")
            if not new.isEmpty():
                new.write.mode("overwrite").parquet(f"{path}/batch={query}-{n}")
            for subscriber in also:
                subscriber(new, n)
        finally:
            batch.unpersist()

    before = session.conf.get(STATE_STORE)
    session.conf.set(STATE_STORE, ROCKS_DB)  # the query keeps the settings of its start
    try:
        return parts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        session.conf.set(STATE_STORE, before)


def landed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What lies in ``path``; no rows where no batch has landed yet."""
    return spark.read.schema(schema).parquet(path).select(*schema.names) if exists(spark, path) else spark.createDataFrame([], schema)
