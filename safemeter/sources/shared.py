"""The folder that driver and executors share, for what one job writes and the next reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in one local process as in tests, a temporary folder of that process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="safemeter-"))
    return "file://" + _OWN_FOLDER[0]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """``df`` written in a new shared folder and read back: what follows sees one fixed set of rows."""
    path = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A split with more than so many times its even share of the rows keeps the other cores waiting.
UNEVEN = 2


def evened(df: DataFrame, *by: str, probe: DataFrame | None = None) -> DataFrame:
    """``df``, dealt out over all cores (by the columns ``by``, if any) where its splits are too few or uneven for them.

    So it is with files of one row group, which are read in one task.  Tables of many
    splits stay as they are and nothing is moved.  ``probe``: the same splits with columns
    that are cheap to read; only its rows are counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if probe is None else probe).groupBy(F.spark_partition_id().alias("split")).count()
    most, total = splits.agg(F.max("count"), F.sum("count")).first()
    if total is None or most * cores <= UNEVEN * total:
        return df
    return df.repartition(cores, *by)


#: Rows of each table that one task of a join or an aggregate by key is meant for, however large the table is.
ROWS_PER_TASK = 250_000


def tasks_for(df: DataFrame) -> int:
    """Into how many partitions a join or an aggregate by key deals tables of about as many rows as ``df``.

    Spark's own partitions are as many as a setting says, or are joined by their compressed
    bytes; keys compress so well that a task then sorts ten times of what it read.  ``df`` is
    counted, without reading its columns.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def files_of(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = files_of(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    store, at = files_of(spark, path)
    store.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    store, at = files_of(spark, path)
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    store, at = files_of(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its content at once; False if it is there already, which leaves it as it is.

    The content is written aside first, so nobody sees half of it.  The name is then taken by
    a rename that never overwrites, atomic where the file system's renames are; on a local
    file system, where they are not, by a hard link, which is.
    """
    folder, _, name = path.rpartition("/")
    store, aside = files_of(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = store.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    try:
        if store.getUri().getScheme() == "file":
            of = lambda p: jvm.java.io.File(hadoop.Path(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(of(path), of(aside.toString()))
        else:
            never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, hadoop.Path(path), never)
    except Exception:
        if not exists(spark, path):
            raise
        return False
    finally:
        store.delete(aside, False)
    return True
