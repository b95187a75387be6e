"""Tables kept in the same buckets by event, so that the joins of events move no rows.

Events, truth and detections meet on (run, event), and the facts of a candidate meet those of
its baseline on (another run, event).  What all of these joins share is the event.  Tables are
therefore bucketed by the event alone: each is moved once when it is kept, and the three-way
join, the facts that it gives and the paired join stay inside their buckets.  An event occurs
once a run, so no bucket is larger than its share, whatever part of the rows one run holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators import compare, facts, metrics
from ..operators.staging import stg_detections, stg_events, stg_ground_truth
from ..schemas import RunTables
from ..sources.shared import new_folder, remove, written
from .measure import Models

BY = "event_id"
#: Rows of a table that a bucket is meant for, over all runs; a sort within a task holds them or spills.
ROWS_PER_BUCKET = 2_000_000
#: Off: tables bucketed by one of the columns of a join are in place for it.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class Copartition:
    """Bucketed tables of one session, in the shared folder, until :meth:`close`."""

    def __init__(self, spark: SparkSession, rows: int, *, rows_per_bucket: int = ROWS_PER_BUCKET):
        """``rows``: of the largest table; all tables get the buckets that these take, as many as Spark allows."""
        self.spark = spark
        self.buckets = min(max(1, -(-rows // rows_per_bucket)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        self._tables: dict[str, str] = {}

    @contextmanager
    def in_place(self) -> Iterator[None]:
        """Actions inside plan joins on (run, event) without moving bucketed tables."""
        before = self.spark.conf.get(ALL_KEYS)
        self.spark.conf.set(ALL_KEYS, "false")
        try:
            yield
        finally:
            self.spark.conf.set(ALL_KEYS, before)

    def _write(self, df: DataFrame) -> DataFrame:
        name, path = f"copartition_{uuid.uuid4().hex}", new_folder(self.spark, "copartition")
        self._tables[name] = path
        df.write.format("parquet").option("path", path).bucketBy(self.buckets, BY).sortBy(BY).saveAsTable(name)
        return self.spark.table(name)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` moved into its buckets, one file each, and read back."""
        return self._write(df.repartition(self.buckets, BY))

    def derived(self, df: DataFrame) -> DataFrame:
        """What a join of kept tables gives, written where its rows are, as a kept table itself."""
        with self.in_place():
            return self._write(df)

    def close(self) -> None:
        """Forget the tables and delete their files; nothing read from them can be used afterwards."""
        for name, path in self._tables.items():
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, path)
        self._tables = {}

    def __enter__(self) -> Copartition:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def staged(place: Copartition, t: RunTables) -> RunTables:
    """A store's tables, staged and in buckets.  Prompts and rationales are left behind: no metric reads them."""
    return RunTables(t.runs, place.keep(stg_events(t.events).drop("prompt_text")), place.keep(stg_ground_truth(t.ground_truth)), place.keep(stg_detections(t.detections).drop("judge_rationale")))


def classified(t: RunTables) -> DataFrame:
    """The facts of :func:`staged` tables, as a plan; run :meth:`Copartition.in_place` it has no shuffle."""
    return facts.with_outcomes(facts.joined(t.events, t.ground_truth, t.detections))


def paired(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The cases of kept facts, as a plan; run in place it does not move facts.

    The pairs of runs are written first: Spark then knows their size and broadcasts them if
    they are small.  From the product of two tables of runs it would not, and the facts would
    be shuffled by run.
    """
    return compare.case_comparisons(runs, rows, pairs=written(compare.lineage(runs), "pairs"))


def measured(place: Copartition, t: RunTables) -> Models:
    """The models of a store as ``measure.measured`` gives them, facts and cases kept in their buckets."""
    rows = place.derived(classified(staged(place, t)))
    burden, cases = metrics.false_positive_burden(rows), place.derived(paired(t.runs, rows))
    return Models(rows, burden, metrics.performance_by_family(rows, burden), metrics.tier_contribution(rows), cases, compare.run_comparisons(t.runs, cases, burden))
