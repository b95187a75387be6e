"""The run store: replays are no-ops, conflicts and orphans raise, half-written runs stay out of sight."""

import pytest
from pyspark.sql import functions as F

from safemeter.plans import driver_tables
from safemeter.schemas import RunTables
from safemeter.sources.corpus import read_corpus, write_corpus
from safemeter.sources.shared import names_in, put_if_absent, read_text
from safemeter.sources.store import RunStore, StoreError


@pytest.fixture(scope="module")
def small(spark):
    t = driver_tables.measurement(spark, "/root/testdata/sf0.001")
    keep = F.col("event_id") < "evt-000020"
    return RunTables(t.runs, t.events.where(keep), t.ground_truth.where(keep), t.detections.where(keep))


def only(t, *ids):
    return RunTables(*(df.where(F.col("run_id").isin(*ids)) for df in (t.runs, t.events, t.ground_truth, t.detections)))


def test_append_replay_conflict_and_lineage(spark, small, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError, match="baseline"):
        store.append(only(small, "r2"))
    assert store.append(only(small, "r1")) == {"runs": 1, "events": 20, "ground_truth": 20, "detections": 20}
    assert set(store.append(only(small, "r1")).values()) == {0}
    assert store.append(only(small, "r2"))["events"] == 20
    r1 = only(small, "r1")
    changed = RunTables(r1.runs, r1.events, r1.ground_truth, r1.detections.withColumn("latency_ms", F.lit(9.5)))
    with pytest.raises(StoreError, match="another payload"):
        store.append(changed)
    assert store.joined("r1").count() == 20 and store.joined().count() == 40
    assert store.run("r1")["run_id"] == "r1"
    with pytest.raises(StoreError, match="unknown"):
        store.run("zz")
    assert {r["relation"]: r["n"] for r in store.counts("r2").collect()}["joined_results"] == 20


def test_faulty_batches_write_nothing(spark, small, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    r1 = only(small, "r1")
    orphan = r1.ground_truth.withColumn("event_id", F.lit("evt-999999")).limit(1)
    bad = [
        RunTables(r1.runs, r1.events, r1.ground_truth.unionByName(orphan), r1.detections),
        RunTables(r1.runs, r1.events, r1.ground_truth, r1.detections.withColumn("tier1_score", F.lit(2.0))),
        RunTables(r1.runs.withColumn("git_sha", F.lit(" ")), r1.events, r1.ground_truth, r1.detections),
        RunTables(r1.runs, r1.events.withColumn("text", F.lit(None).cast("string")), r1.ground_truth, r1.detections),
        RunTables(r1.runs, r1.events.unionByName(r1.events.withColumn("text", F.lit("x"))), r1.ground_truth, r1.detections),
    ]
    for tables in bad:
        with pytest.raises(StoreError):
            store.append(tables)
    assert store.runs().count() == 0 and store.table("events").count() == 0


def test_half_written_run_is_invisible_and_completes(spark, small, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    r1 = only(small, "r1")
    r1.events.limit(5).write.partitionBy("run_id").parquet(f"{store.root}/events")
    assert store.table("events").count() == 0
    assert store.append(r1)["events"] == 15
    assert store.joined("r1").count() == 20


def test_strict_read_names_missing_events(spark, small, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    r1 = only(small, "r1")
    store.append(RunTables(r1.runs, r1.events, r1.ground_truth, r1.detections.where("event_id <> 'evt-000003'")))
    with pytest.raises(StoreError, match="evt-000003"):
        store.joined("r1")
    assert store.joined("r1", strict=False).count() == 19


def test_legacy_store_is_refused(spark, small, tmp_path):
    small.events.drop("run_id").write.parquet(str(tmp_path / "old/events"))
    with pytest.raises(StoreError, match="run_id"):
        RunStore(spark, str(tmp_path / "old")).guard()


def test_corpus_file_round_trip(spark, tmp_path):
    corpus = driver_tables.prompts(spark, "/root/testdata/sf0.001")
    n = write_corpus(corpus, str(tmp_path / "c"))
    back = read_corpus(spark, str(tmp_path / "c"))
    assert n == corpus.count() == back.count()
    spark.createDataFrame([("t", "benign", "attack", True, "s", "o")], "text string, family string, label string, is_synthetic boolean, source string, objective string").write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "bad"))


def crash(*_):
    raise RuntimeError("died")


def test_replacement_is_whole_or_not_at_all(spark, small, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "s"))
    store.append(only(small, "r1", "r2"))
    with monkeypatch.context() as m:
        m.setattr(RunStore, "_publish", crash)  # dies after all is written aside
        with pytest.raises(RuntimeError):
            store.append(only(small, "r1"), replace=True)
    reader, before = RunStore(spark, store.root).pinned(), store.joined()
    assert store.runs().count() == 2 and before.count() == 40
    assert store.append(only(small, "r1"), replace=True)["runs"] == 1
    assert [r[0] for r in store.runs().select("run_id").collect()] == ["r1"] and store.joined().count() == 20
    assert reader.joined().count() == 40 and before.count() == 40  # who read before goes on reading
    assert store.append(only(small, "r2"))["events"] == 20 and store.joined().count() == 40
    assert len(store.vacuum()) == 2 and RunStore(spark, store.root).joined().count() == 40  # the dead job's and the replaced segment
    assert store.append(only(small, "r1"), replace=True)["runs"] == 1 and store.joined().count() == 20


def test_two_readers_and_a_dead_writer_lose_nothing(spark, small, tmp_path, monkeypatch):
    """A writer dies at each of its steps; two readers look in between; the second attempt is whole."""
    steps = {"write": ("pyspark.sql.readwriter.DataFrameWriter.parquet", 2), "publish": ("safemeter.sources.store.put_if_absent", 0)}
    for name, (target, after) in steps.items():
        store, calls = RunStore(spark, str(tmp_path / name)), []
        store.append(only(small, "r1"))
        module, _, attribute = target.rpartition(".")
        with monkeypatch.context() as m:
            import pyspark.sql.readwriter

            owner = pyspark.sql.readwriter.DataFrameWriter if name == "write" else __import__(module, fromlist=["x"])
            real = getattr(owner, attribute)

            def dying(*a, _real=real, _after=after, _calls=calls, **b):
                _calls.append(1)
                return crash() if len(_calls) > _after else _real(*a, **b)

            m.setattr(owner, attribute, dying)
            with pytest.raises(RuntimeError):
                store.append(only(small, "r1", "r2"), replace=True)
        one, two = RunStore(spark, store.root), RunStore(spark, store.root)
        assert one.joined().count() == two.joined().count() == 20 and one.counts().count() == two.counts().count()
        assert one.append(only(small, "r2"))["events"] == 20 and two.joined().count() == 40


def test_two_writers_side_by_side(spark, small, tmp_path, monkeypatch):
    """Another writer publishes while this one is about to: it starts again and both are there."""
    store, other, real = RunStore(spark, str(tmp_path / "s")), RunStore(spark, str(tmp_path / "s")), RunStore._publish
    store.append(only(small, "r1"))
    turns = []

    def publish(self, new):
        if not turns:
            turns.append(1)
            other.append(only(small, "r3"))
        return real(self, new)

    monkeypatch.setattr(RunStore, "_publish", publish)
    assert store.append(only(small, "r2"))["events"] == 20
    assert sorted(r[0] for r in store.runs().select("run_id").collect()) == ["r1", "r2", "r3"] and store.joined().count() == 60
    turns.clear()
    changed = only(small, "r2")
    changed = RunTables(changed.runs, changed.events, changed.ground_truth, changed.detections.withColumn("latency_ms", F.lit(7.5)))
    monkeypatch.setattr(RunStore, "_publish", real)
    with pytest.raises(StoreError, match="another payload"):
        other.append(changed)


def test_a_number_is_taken_once(spark, tmp_path):
    path = f"{tmp_path}/log/1"
    assert put_if_absent(spark, path, "one") and not put_if_absent(spark, path, "two")
    assert read_text(spark, path) == "one" and names_in(spark, f"{tmp_path}/log") == ["1"] and names_in(spark, f"{tmp_path}/none") == []


def test_repeated_rows_of_a_batch_land_once(spark, small, tmp_path):
    """Only tables that repeat a key are told apart by all columns; a small batch of a landed run is dealt out by what is there."""
    store, r1 = RunStore(spark, str(tmp_path / "s")), only(small, "r1")
    twice = RunTables(r1.runs.unionByName(r1.runs), r1.events.unionByName(r1.events), r1.ground_truth, r1.detections)
    assert store.append(twice) == {"runs": 1, "events": 20, "ground_truth": 20, "detections": 20}
    one = F.col("event_id") == "evt-000007"
    assert set(store.append(RunTables(r1.runs, r1.events.where(one), r1.ground_truth.where(one), r1.detections.where(one))).values()) == {0}
    assert store.joined("r1").count() == 20


def test_partitions_of_the_store_follow_its_rows(spark, small, tmp_path, monkeypatch):
    """Rows of a partition are bounded, whatever Spark's own setting or its compressed sizes say."""
    monkeypatch.setattr("safemeter.sources.shared.ROWS_PER_TASK", 2)
    store = RunStore(spark, str(tmp_path / "s"))
    assert store.append(small)["events"] == 60
    joined = store.joined()
    keys = [(r["run_id"], r["event_id"]) for r in joined.select("run_id", "event_id").collect()]
    assert len(keys) == 60 and keys == sorted(keys)
    assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 20
