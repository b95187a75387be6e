"""Bucketed tables give the models of the plain ones, and their joins move no rows."""

import pytest

from safemeter.plans import copartition, driver_tables, measure
from safemeter.schemas import RunTables
from safemeter.sources.shared import exists

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Joins of events shuffle here unless they are in place; only the few pairs of runs are small enough."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 8000)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_models_equal_the_plain_ones(spark):
    t = driver_tables.measurement(spark, SF)
    want = measure.measured(t, keep=False)
    with copartition.Copartition(spark, t.events.count(), rows_per_bucket=500) as place:
        assert place.buckets == 6
        got = copartition.measured(place, t)
        for n in ("facts", "cases", "comparisons", "tiers"):
            a, b = getattr(got, n), getattr(want, n)
            a = a.select(*(c for c in b.columns if c in a.columns))
            b = b.select(*a.columns)
            assert set(getattr(want, n).columns) - set(a.columns) <= {"prompt_text", "judge_rationale"}
            assert a.count() == b.count() and a.exceptAll(b).isEmpty()
        names, paths = list(place._tables), list(place._tables.values())
    assert not any(spark.catalog.tableExists(n) for n in names) and not any(exists(spark, p) for p in paths)


def test_joins_of_kept_tables_have_no_shuffle(spark, no_broadcast):
    t = driver_tables.measurement(spark, SF)
    with copartition.Copartition(spark, t.events.count(), rows_per_bucket=500) as place:
        kept = copartition.staged(place, t)
        rows = place.derived(copartition.classified(kept))
        with place.in_place():
            three = _plan(copartition.classified(kept))
            both = _plan(copartition.paired(t.runs, rows))
        assert three.count("SortMergeJoin") == 2 and "Exchange hashpartitioning" not in three
        assert both.count("SortMergeJoin") == both.count("BroadcastHashJoin") == 1 and "Exchange hashpartitioning" not in both
        assert "Exchange hashpartitioning" in _plan(copartition.classified(kept))  # the setting is off again
        assert len(set(rows.inputFiles())) == place.buckets  # one file a bucket, written where the rows were


def test_empty_tables_and_as_many_buckets_as_allowed(spark):
    t = driver_tables.measurement(spark, SF)
    none = RunTables(*(getattr(t, n).limit(0) for n in ("runs", "events", "ground_truth", "detections")))
    with copartition.Copartition(spark, 0) as place:
        m = copartition.measured(place, none)
        assert place.buckets == 1 and m.facts.count() == m.cases.count() == m.comparisons.count() == 0
    assert copartition.Copartition(spark, 10**15).buckets == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
