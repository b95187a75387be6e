"""All checks in one pass equal the checks one by one, on clean and on faulty tables, and read each table once."""

import re
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safemeter.operators import checks, facts
from safemeter.plans import driver_tables, measure
from safemeter.schemas import RunTables

NAMES = ("runs", "events", "ground_truth", "detections")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two hundred events a run, as Parquet tables."""
    t = driver_tables.measurement(spark, "/root/testdata/sf0.001")
    root = str(tmp_path_factory.mktemp("stored"))
    for n in NAMES:
        df = getattr(t, n)
        (df if n == "runs" else df.where(F.substring("event_id", 5, 20).cast("long") < 200)).write.parquet(f"{root}/{n}")
    return RunTables(*(spark.read.parquet(f"{root}/{n}") for n in NAMES)), root


def _with(df: DataFrame, where: str, **changes: str) -> DataFrame:
    """Rows that match, with columns changed, beside the others."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return df.withColumns({c: F.when(hit, F.expr(v)).otherwise(F.col(c)) for c, v in changes.items()})


def _twice(df: DataFrame, where: str) -> DataFrame:
    return df.unionByName(df.where(where))


def _faulty(t: RunTables) -> RunTables:
    n = "cast(substring(event_id, 5, 20) as long)"
    runs = _twice(_with(_with(t.runs, "run_id = 'r2'", status="'odd'", git_sha="null"), "run_id = 'r3'", completed_at="timestamp'2020-01-01'"), "run_id = 'r2'").where("run_id <> 'r1'")
    events = _twice(_with(t.events.where(f"{n} % 17 <> 3"), f"{n} % 11 = 0", text="null"), f"{n} % 13 = 0")
    events = reduce(DataFrame.unionByName, [events, _with(t.events.where(f"{n} = 5"), "true", event_id="null"), _with(t.events.where(f"{n} in (6, 7)"), "true", run_id="null")])
    truth = _twice(_with(_with(t.ground_truth.where(f"{n} % 19 <> 4"), f"{n} % 7 = 0", label="'benign'"), f"{n} % 23 = 0", family="'new'"), f"{n} % 29 = 0")
    truth = truth.unionByName(_with(t.ground_truth.where(f"{n} = 8"), "true", event_id="null"))
    found = _with(_with(t.detections, f"{n} % 9 = 0", tier1_score="2.0", latency_ms="null"), f"{n} % 10 = 1", decided_by="'oracle'")
    return RunTables(runs, events, truth, _with(_twice(found, f"{n} % 31 = 2"), f"{n} = 12", run_id="null"))


def _compared(t: RunTables, m: measure.Models) -> tuple[dict, dict]:
    args = (t, m.facts, m.burden, m.family, m.tiers, m.cases, m.comparisons)
    one, all_at_once = checks.violations(checks.all_checks(*args)), checks.all_violations(*args)
    assert one.columns == all_at_once.columns and one.dtypes == all_at_once.dtypes
    return ({r["check"]: r["violations"] for r in df.collect()} for df in (one, all_at_once))


def test_one_pass_counts_what_the_single_checks_find(stored):
    t = _faulty(stored[0])
    m = measure.measured(t)
    off = measure.Models(
        _with(m.facts, "event_id like '%3'", is_true_positive="true", is_false_negative="true"), _twice(_with(m.burden, "run_id = 'r3'", false_positive_rate="1.5"), "run_id = 'r2'"),
        _twice(_with(_with(m.family, "evaluation_family like 'm%'", caught_attacks="caught_attacks + 1"), "run_id = 'r2'", catch_rate="-1.0"), "run_id = 'r3'"),
        _twice(m.tiers, "run_id = 'r2' and decided_by = 'judge'"), _twice(m.cases, "is_fixed"), _twice(_with(m.comparisons, "true", candidate_catch_rate="2.0"), "true"),
    )
    one, all_at_once = _compared(t, off)
    assert one == all_at_once
    assert {c for c, n in one.items() if n == 0} <= {"c15_case_grain", "c15_comparison_grain", "c13_comparison_rates", "c16_compatible"}  # r1 is gone, so no pairs
    paired = RunTables(stored[0].runs, t.events, t.ground_truth, t.detections)
    one, all_at_once = _compared(paired, measure.Models(off.facts, off.burden, off.family, off.tiers, *(getattr(measure.measured(paired), x) for x in ("cases", "comparisons"))))
    assert one == all_at_once


def test_clean_and_empty_tables_have_no_violations(stored):
    t = stored[0]
    for tables in (t, RunTables(*(getattr(t, n).limit(0) for n in NAMES))):
        one, all_at_once = _compared(tables, measure.measured(tables))
        assert one == all_at_once and len(one) == 28 and not any(one.values())


def test_each_stored_table_is_read_once(spark, stored, tmp_path):
    t, root = stored
    m = measure.measured(t, keep=lambda df: df.write.parquet(f"{tmp_path}/facts") or spark.read.parquet(f"{tmp_path}/facts"))
    scans = lambda df, n: len(re.findall(rf"FileScan parquet[^\n]*{root}/{n}\b", df._jdf.queryExecution().executedPlan().toString()))
    alone, whole = checks.stored_violations(t, m.facts, m.tiers), measure.checked(t, m)
    assert [scans(alone, n) for n in NAMES] == [1, 1, 1, 1] and [scans(whole, n) for n in NAMES[1:]] == [1, 1, 1]
    assert "Join" not in checks.stored_violations(t, t.events.limit(0).select("*", *(F.lit(False).alias(f"is_{x}") for x in ("true_positive", "false_positive", "true_negative", "false_negative"))), m.tiers)._jdf.queryExecution().optimizedPlan().toString()


def test_incomplete_events_are_found_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr("safemeter.sources.shared.ROWS_PER_TASK", 100)
    t = driver_tables.measurement(spark, "/root/testdata/sf0.001")
    n = t.events.count()
    one, two = F.col("event_id") == "evt-000003", F.col("event_id") == "evt-000004"
    events = t.events.unionByName(t.events.where(one)).unionByName(t.events.where(one).withColumn("event_id", F.lit(None).cast("string")))
    found = facts.incomplete(events, t.ground_truth.where(~one), t.detections.where(~(one | two)))
    assert found.rdd.getNumPartitions() >= n // 100
    runs = ("r1", "r2", "r3")
    want = [(r, e) for r in runs for e in ("evt-000003", "evt-000004", None)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
