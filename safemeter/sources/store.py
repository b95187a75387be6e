"""The run store: immutable Parquet segments by run, and snapshots that name them.

An append or a replacement writes its rows into a segment, folders of its own that nothing
refers to yet, and then publishes a snapshot: one small file with the next number that names
all segments of the store.  A number can be taken once; who finds it taken starts again from
the newer snapshot, checks included.  So writers may run side by side, a job that dies leaves
no trace that a reader sees, and a replacement appears whole.  Readers resolve one snapshot
and read its files; nothing that a snapshot names is ever moved or deleted by a reader or a
writer, only by :meth:`RunStore.vacuum`.

Tables that lie loose in the store's root, as older jobs left them, count as a segment until
a replacement.  A run is visible once its row in ``runs`` is: events of a run that died half
way stay out of sight, and appending the run again adds what is missing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import broken_rules, duplicate_keys, table_rules
from ..operators.facts import incomplete
from ..operators.metrics import table_counts
from ..schemas import KEYS, TABLES, RunTables, columns_of
from .shared import exists, names_in, put_if_absent, read_text, remove, tasks_for

CHILDREN = ("events", "ground_truth", "detections")
#: Folders of the snapshots and of the segments.
LOG, SEGMENTS = "_snapshots", "_segments"
#: How often a writer starts again because others were faster.
ATTEMPTS = 20


@dataclass(frozen=True)
class Snapshot:
    """``number`` (0: nothing was published yet), names of the segments, and whether loose tables count."""

    number: int = 0
    segments: tuple[str, ...] = ()
    loose: bool = True

    def text(self) -> str:
        return json.dumps({"number": self.number, "segments": self.segments, "loose": self.loose})


class StoreError(ValueError):
    """What was given contradicts the store or its contracts."""


class RunStore:
    """A store as it is at each call; with ``at``, as it was at that snapshot."""

    def __init__(self, spark: SparkSession, root: str, at: Snapshot | None = None):
        self.spark, self.root, self._at = spark, root.rstrip("/"), at

    # ---- snapshots
    def snapshot(self) -> Snapshot:
        """The newest snapshot, or the one this store is fixed at."""
        if self._at is not None:
            return self._at
        numbers = [x for x in names_in(self.spark, f"{self.root}/{LOG}") if not x.startswith(".")]
        if not numbers:
            return Snapshot()
        found = json.loads(read_text(self.spark, f"{self.root}/{LOG}/{max(numbers)}"))
        return Snapshot(found["number"], tuple(found["segments"]), found["loose"])

    def pinned(self) -> RunStore:
        """This store at its newest snapshot: all reads see the same runs."""
        return RunStore(self.spark, self.root, self.snapshot())

    def _publish(self, new: Snapshot) -> bool:
        return put_if_absent(self.spark, f"{self.root}/{LOG}/{new.number:020d}", new.text())

    def _discard(self, segment: str) -> None:
        for n in TABLES:
            remove(self.spark, self._folder(n, segment))

    def vacuum(self) -> list[str]:
        """Delete what the newest snapshot does not name, and the older snapshots; the names of the segments deleted.

        For times without writers, and without readers of older snapshots.
        """
        now = self.snapshot()
        there = {x.removeprefix("segment=") for n in TABLES for x in names_in(self.spark, f"{self.root}/{SEGMENTS}/{n}")}
        spent = sorted(there - set(now.segments))
        for x in spent:
            self._discard(x)
        for x in names_in(self.spark, f"{self.root}/{LOG}"):
            if x.startswith(".") or int(x) < now.number:
                remove(self.spark, f"{self.root}/{LOG}/{x}")
        if not now.loose:
            for n in TABLES:
                remove(self.spark, f"{self.root}/{n}")
        return spent

    # ---- reading
    def _folder(self, name: str, segment: str) -> str:
        return f"{self.root}/{SEGMENTS}/{name}/segment={segment}"

    def _parts(self, name: str) -> list[DataFrame]:
        """The loose table and the segments of a table, as far as there are any, at one snapshot."""
        at, read = self.snapshot(), self.spark.read.schema(TABLES[name])
        loose = [read.parquet(f"{self.root}/{name}")] if at.loose and exists(self.spark, f"{self.root}/{name}") else []
        folders = [p for x in at.segments if exists(self.spark, p := self._folder(name, x))]
        return loose + ([read.option("basePath", f"{self.root}/{SEGMENTS}/{name}").parquet(*folders)] if folders else [])

    def _raw(self, name: str) -> DataFrame:
        parts = [df.select(*columns_of(TABLES[name])) for df in self._parts(name)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def lacking(self) -> dict[str, list[str]]:
        """Columns of the contract that a loose table was written without, by table; segments are written by this class."""
        if not self.snapshot().loose:
            return {}
        have = {n: set(self.spark.read.parquet(f"{self.root}/{n}").columns) for n in TABLES if exists(self.spark, f"{self.root}/{n}")}
        return {n: missing for n, columns in have.items() if (missing := sorted(set(columns_of(TABLES[n])) - columns))}

    def guard(self) -> None:
        """Refuse a store whose events were written without ``run_id`` or with other columns."""
        for name, missing in self.lacking().items():
            raise StoreError(f"{name} lacks {missing}: written under an older contract")

    def runs(self) -> DataFrame:
        return self._raw("runs")

    def table(self, name: str) -> DataFrame:
        """Rows of finished runs only."""
        if name == "runs":
            return self.runs()
        at = self.pinned()
        # never moved by run: a run can hold any part of the rows
        return at._raw(name).join(F.broadcast(at.runs().select("run_id")), "run_id", "left_semi").select(*columns_of(TABLES[name]))

    def tables(self) -> RunTables:
        at = self.pinned()
        return RunTables(*(at.table(n) for n in TABLES))

    def run(self, run_id: str) -> dict:
        found = self.runs().where(F.col("run_id") == run_id).limit(2).collect()
        if not found:
            raise StoreError(f"unknown run {run_id}")
        return found[0].asDict()

    def joined(self, run_id: str | None = None, *, strict: bool = True) -> DataFrame:
        """Joined results of one run or all, by run and event; ``strict`` raises on events without truth or detection."""
        at = self.pinned()
        parts = [at.table(n) if run_id is None else at.table(n).where(F.col("run_id") == run_id) for n in CHILDREN]
        n, key = tasks_for(parts[0]), KEYS["events"]
        if strict:
            missing = incomplete(*parts, partitions=n).orderBy("run_id", "event_id").limit(5).collect()
            if missing:
                raise StoreError(f"events without truth or detection, first: {[(r[0], r[1]) for r in missing]}")
        events, truth, detections = (df.repartition(n, *key) for df in parts)
        # each partition's share is bounded, so it is hashed; a sort would take all columns along, and the range's sample joins again
        return events.join(truth.hint("shuffle_hash"), key).join(detections.hint("shuffle_hash"), key).repartitionByRange(n, *key).sortWithinPartitions(*key)

    def counts(self, run_id: str | None = None) -> DataFrame:
        """Rows of the four tables and of their join."""
        at = self.pinned()
        names = {n: at.table(n) for n in TABLES} | {"joined_results": at.joined(strict=False)}
        if run_id is not None:
            names = {n: df.where(F.col("run_id") == run_id) for n, df in names.items()}
        return table_counts(names)

    # ---- appending
    def append(self, new: RunTables, *, replace: bool = False) -> dict[str, int]:
        """Land runs with their events, truth and detections; how many rows of each table were new.

        Everything is checked before anything is written.  Rows that are there already with
        the same payload (null equal to null) are no-ops; another payload under the same key
        raises.  ``replace`` puts these runs in the place of all others.  Either way the new
        rows appear at once, or not at all; readers go on with the snapshot they have.
        """
        parts = tasks_for(new.events)

        def own(n: str) -> DataFrame:
            rows = getattr(new, n).select(*columns_of(TABLES[n])).to(self.spark.createDataFrame([], TABLES[n]).schema)
            # dealt out by key once: repeats, orphans, what is there already and what is new are found where the rows are
            return (rows if n == "runs" else rows.repartition(parts, *KEYS[n])).persist()

        given = {n: own(n) for n in TABLES}
        again = [duplicate_keys(df, KEYS[n]).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in given.items()]
        repeated = {name for name, n in reduce(DataFrame.unionByName, again).collect() if n}  # the others need not be told apart by all columns
        batch = given | {n: given[n].distinct().persist() for n in repeated}
        try:
            for _ in range(ATTEMPTS):
                counts = self.pinned()._append_once(batch, repeated, replace, parts)
                if counts is not None:
                    return counts
            raise StoreError(f"other writers were faster {ATTEMPTS} times")
        finally:
            for df in (*batch.values(), *given.values()):
                df.unpersist()

    def _append_once(self, batch: dict[str, DataFrame], repeated: set[str], replace: bool, parts: int) -> dict[str, int] | None:
        """One attempt from this snapshot; None if another writer has published the next one."""
        at = self.snapshot()
        if not replace:
            self.guard()
        known = {n: self.spark.createDataFrame([], TABLES[n]) if replace else self._raw(n) for n in TABLES}
        self._check(batch, repeated, known["runs"])
        run_ids = [r[0] for r in batch["runs"].select("run_id").collect()]  # as many as runs are landed at once
        fresh, counts = {}, {}
        for n, df in batch.items():
            there = known[n].where(F.col("run_id").isin(*run_ids))  # one partition per run
            fresh[n], counts[n] = self._news(n, df, there, parts)
        if not any(counts.values()) and not replace:
            return counts
        segment = uuid.uuid4().hex
        for n in (*CHILDREN, "runs"):
            if counts[n]:
                rows = fresh[n].write if n == "runs" else fresh[n].write.partitionBy("run_id")
                rows.parquet(self._folder(n, segment))
        kept = () if replace else at.segments
        if self._publish(Snapshot(at.number + 1, (*kept, segment), at.loose and not replace)):
            return counts
        self._discard(segment)  # nothing refers to it
        return None

    def _news(self, name: str, new: DataFrame, there: DataFrame, parts: int) -> tuple[DataFrame, int]:
        """Rows of ``new`` that ``there`` lacks, and how many; another payload under a key of theirs raises."""
        if there.isEmpty():  # as when runs land for the first time: nothing to compare with
            return new, new.count()
        keys = KEYS[name]
        if name != "runs" and (needed := max(parts, tasks_for(there))) > parts:  # a small batch of large runs
            new, parts = new.repartition(needed, *keys), needed
        there = there if name == "runs" else there.repartition(parts, *keys)
        self._conflicts(name, new, there)
        fresh = new.join(there.select(*keys).hint("shuffle_hash"), keys, "left_anti").select(*columns_of(TABLES[name]))
        return fresh, fresh.count()

    def _check(self, batch: dict[str, DataFrame], repeated: set[str], known_runs: DataFrame) -> None:
        runs, events, truth, detections = (batch[n] for n in TABLES)
        keys = events.select(*KEYS["events"]).hint("shuffle_hash")
        all_runs = F.broadcast(known_runs.select("run_id").unionByName(runs.select("run_id")).distinct())
        lineage = runs.where(F.col("baseline_run_id").isNotNull()).select(F.col("run_id").alias("own"), F.col("baseline_run_id").alias("run_id"))
        failures = {
            **{f"rules of {n}": broken_rules(df, table_rules(n)) for n, df in batch.items()},
            "baseline does not exist": lineage.join(all_runs, "run_id", "left_anti"),
            "events of unknown runs": events.join(all_runs, "run_id", "left_anti"),  # never moved by run
            "truth without event": truth.join(keys, KEYS["events"], "left_anti"),
            "detections without event": detections.join(keys, KEYS["events"], "left_anti"),
            **{f"conflicting rows in {n}": duplicate_keys(batch[n], KEYS[n]) for n in TABLES if n in repeated},
        }
        named = [bad.select(F.lit(i).alias("i"), F.lit(what).alias("what"), F.to_json(F.struct("*")).alias("row")) for i, (what, bad) in enumerate(failures.items())]
        first = reduce(DataFrame.unionByName, named).agg(F.min(F.struct("i", "what", "row")).alias("first")).first()["first"]  # one job for all rules
        if first:
            raise StoreError(f"{first['what']}: {first['row']}")

    def conflicts(self, name: str, new: DataFrame) -> DataFrame:
        """Keys of ``new`` rows under which the table holds another payload (null equal to null)."""
        there, keys = self._raw(name), KEYS[name]
        n = max(tasks_for(new), tasks_for(there))
        return self._differing(name, new.repartition(n, *keys), there.repartition(n, *keys))

    def _differing(self, name: str, new: DataFrame, there: DataFrame) -> DataFrame:
        payload = [c for c in columns_of(TABLES[name]) if c not in KEYS[name]]
        old = there.select(*KEYS[name], *(F.col(c).alias(f"old_{c}") for c in payload))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in payload])
        return new.join(old.hint("shuffle_hash"), KEYS[name]).where(~same).select(*KEYS[name])

    def _conflicts(self, name: str, new: DataFrame, there: DataFrame) -> None:
        first = self._differing(name, new, there).agg(F.min(F.struct(*KEYS[name])).alias("key")).first()["key"]
        if first:
            raise StoreError(f"{name} holds another payload under {[first[k] for k in KEYS[name]]}")
