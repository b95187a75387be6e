"""Gate decisions on hand-made comparison rows, and its refusals."""

import pytest

from safemeter.operators import gate

COLUMNS = "candidate_run_id string, baseline_run_id string, evaluation_family string, catch_rate_delta double, false_positive_rate_delta double"


BENIGN, DROP, RISE = "benign", "family_catch_rate_drop", "false_positive_rate_increase"
#: What each candidate did by family (deltas of catch rate and of false positives), and what the gate says.
CASES = {
    "gains everywhere": ([("f1", 0.2, -0.003), ("f2", 0.04, -0.003)], "pass", []),
    "a drop just under the warning": ([("f1", -0.0099, 0.0), ("f2", 0.3, 0.0)], "pass", []),
    "a drop just over it": ([("f1", -0.0101, 0.0), ("f2", 0.3, 0.0)], "warn", [(DROP, "f1", "warn")]),
    "a drop at the failure": ([("f1", -0.05, 0.0)], "warn", [(DROP, "f1", "warn")]),
    "one family fails, another warns": ([("f1", -0.4, 0.0), ("f2", -0.03, 0.0), ("f3", 0.1, 0.0)], "fail", [(DROP, "f1", "fail"), (DROP, "f2", "warn")]),
    "more false alarms alone": ([("f1", 0.5, 0.0040), ("f2", 0.5, 0.0040)], "warn", [(RISE, BENIGN, "warn")]),
    "false alarms at the failure": ([("f1", 0.0, 0.01)], "warn", [(RISE, BENIGN, "warn")]),
    "false alarms beyond it": ([("f1", 0.0, 0.25), ("f2", -0.2, 0.25)], "fail", [(RISE, BENIGN, "fail"), (DROP, "f2", "fail")]),
    "fewer of both": ([("f1", -0.02, -0.5)], "warn", [(DROP, "f1", "warn")]),
}


def test_gate_table(spark):
    """All candidates judged at once; each has the status and findings of its own rows."""
    rows = [(name, "base", *r) for name, (deltas, _, _) in CASES.items() for r in deltas]
    df = spark.createDataFrame(rows, COLUMNS)
    found = gate.findings(df, gate.RegressionPolicy())
    status = {r["candidate_run_id"]: r["status"] for r in gate.gate_status(df, found).collect()}
    listed = {name: [] for name in CASES}
    for f in found.collect():
        listed[f["candidate_run_id"]].append((f["metric"], f["evaluation_family"], f["status"]))
    assert status == {name: want for name, (_, want, _) in CASES.items()}
    assert {k: sorted(v) for k, v in listed.items()} == {name: want for name, (_, _, want) in CASES.items()}


def test_a_candidate_without_comparison_is_an_error(spark):
    from safemeter.plans import driver_tables, measure

    t = driver_tables.measurement(spark, "/root/testdata/sf0.001")
    m = measure.measured(t)
    with pytest.raises(ValueError):
        gate.evaluate_one("r2", t.runs, m.facts, m.cases.limit(0), m.comparisons.limit(0))


def test_bad_policy():
    with pytest.raises(ValueError):
        gate.RegressionPolicy(warn_family_catch_rate_drop=0.2, fail_family_catch_rate_drop=0.1)


def test_disagreeing_and_null_deltas_are_rejected(spark):
    df = spark.createDataFrame([("c", "b", "x", 0.0, 0.0), ("c", "b", "y", 0.0, 0.1), ("d", "b", "x", 0.0, None)], COLUMNS)
    assert sorted(r[0] for r in gate.rejected(df).collect()) == ["c", "d"]


def test_unknown_and_baseless_runs_raise(spark):
    from safemeter.plans import driver_tables, measure

    t = driver_tables.measurement(spark, "/root/testdata/sf0.001")
    m = measure.measured(t)
    with pytest.raises(ValueError, match="unknown"):
        gate.evaluate_one("nope", t.runs, m.facts, m.cases, m.comparisons)
    with pytest.raises(ValueError, match="no baseline"):
        gate.evaluate_one("r1", t.runs, m.facts, m.cases, m.comparisons)
    assert gate.evaluate_one("r3", t.runs, m.facts, m.cases, m.comparisons)["status"] in ("pass", "warn", "fail")
    clean = measure.checked(t, m).where("violations > 0").collect()
    assert clean == []
