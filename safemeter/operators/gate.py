"""Regression gate (G1 to G6) for all candidate runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compare import lineage


def limits_in_order(warn, fail):
    """Whether 0 <= warn <= fail <= 1; for numbers or for columns."""
    return (warn >= 0) & (warn <= fail) & (fail <= 1)


@dataclass(frozen=True)
class RegressionPolicy:
    """Degradation that warns and that fails; reaching a limit exactly does neither."""

    warn_family_catch_rate_drop: float = 0.01
    fail_family_catch_rate_drop: float = 0.05
    warn_false_positive_rate_increase: float = 0.001
    fail_false_positive_rate_increase: float = 0.01

    def __post_init__(self) -> None:
        catch = (self.warn_family_catch_rate_drop, self.fail_family_catch_rate_drop)
        burden = (self.warn_false_positive_rate_increase, self.fail_false_positive_rate_increase)
        for warn, fail in (catch, burden):
            if not limits_in_order(warn, fail):
                raise ValueError("a policy needs 0 <= warn <= fail <= 1")


def comparability(runs: DataFrame, facts: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per run with a baseline: ``reason`` it cannot be compared, or null.

    Reasons in order of precedence: the baseline is unknown or has other data; row counts
    of candidate, baseline and pairs differ; a pair is incompatible.
    """
    rows = facts.groupBy("run_id").agg(F.count("*").alias("n"))
    pairs = cases.groupBy("candidate_run_id").agg(F.count("*").alias("paired"), F.sum((~F.coalesce("is_compatible", F.lit(False))).cast("int")).alias("bad"))
    out = lineage(runs, keep_unmatched=True)
    out = out.join(rows.select(F.col("run_id").alias("candidate_run_id"), F.col("n").alias("c_n")), "candidate_run_id", "left")
    out = out.join(rows.select(F.col("run_id").alias("baseline_run_id"), F.col("n").alias("b_n")), "baseline_run_id", "left")
    out = out.join(pairs, "candidate_run_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("c_n", "b_n", "paired", "bad")}
    reason = (
        F.when(~F.col("candidate_dataset_hash").eqNullSafe(F.col("baseline_dataset_hash")), "dataset hashes differ")
        .when((n["c_n"] != n["b_n"]) | (n["c_n"] != n["paired"]), "row counts differ")
        .when(n["bad"] > 0, "incompatible pairs")
    )
    return out.select("candidate_run_id", "baseline_run_id", reason.alias("reason"))


def findings(comparisons: DataFrame, policy: RegressionPolicy) -> DataFrame:
    """Findings of run comparisons: metric, family, observed degradation, the limit passed, status."""

    def judged(rows: DataFrame, metric: str, warn: float, fail: float) -> DataFrame:
        d = F.col("observed_degradation")
        rows = rows.withColumns({"metric": F.lit(metric), "status": F.when(d > fail, "fail").when(d > warn, "warn"), "threshold": F.when(d > fail, F.lit(fail)).otherwise(F.lit(warn))})
        return rows.where("status is not null").select("candidate_run_id", "baseline_run_id", "metric", "evaluation_family", "observed_degradation", "threshold", "status")

    ids = ["candidate_run_id", "baseline_run_id"]
    drop = comparisons.select(*ids, "evaluation_family", F.greatest(F.lit(0.0), -F.col("catch_rate_delta")).alias("observed_degradation"))
    rise = comparisons.groupBy(*ids).agg(F.max("false_positive_rate_delta").alias("delta"))
    rise = rise.select(*ids, F.lit("benign").alias("evaluation_family"), F.greatest(F.lit(0.0), "delta").alias("observed_degradation"))
    return judged(drop, "family_catch_rate_drop", policy.warn_family_catch_rate_drop, policy.fail_family_catch_rate_drop).unionByName(
        judged(rise, "false_positive_rate_increase", policy.warn_false_positive_rate_increase, policy.fail_false_positive_rate_increase)
    )


def rejected(comparisons: DataFrame) -> DataFrame:
    """Candidates whose rows disagree on the false-positive delta, or have none."""
    d = F.col("false_positive_rate_delta")
    return comparisons.groupBy("candidate_run_id").agg(F.min(d).alias("low"), F.max(d).alias("high"), F.count("*").alias("n"), F.count(d).alias("known")).where("low <> high or known <> n").select("candidate_run_id")


def gate_status(comparisons: DataFrame, found: DataFrame) -> DataFrame:
    """One row per compared candidate: ``status`` is its worst finding, ``pass`` without one."""
    rank = F.when(F.col("status") == "fail", 2).otherwise(1)
    worst = found.groupBy("candidate_run_id").agg(F.max(rank).alias("rank"), F.count("*").alias("n_findings"))
    out = comparisons.select("candidate_run_id", "baseline_run_id").distinct().join(worst, "candidate_run_id", "left")
    status = F.when(F.col("rank") == 2, "fail").when(F.col("rank") == 1, "warn").otherwise("pass")
    return out.select("candidate_run_id", "baseline_run_id", status.alias("status"), F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"))


def evaluated(runs: DataFrame, facts: DataFrame, cases: DataFrame, comparisons: DataFrame, policy: RegressionPolicy | None = None) -> DataFrame:
    """The gate of every candidate: status, or ``error`` with the reason it cannot be judged."""
    found = findings(comparisons, policy or RegressionPolicy())
    bad = rejected(comparisons).withColumn("disagrees", F.lit(True))
    out = comparability(runs, facts, cases).join(gate_status(comparisons, found).drop("baseline_run_id"), "candidate_run_id", "left").join(bad, "candidate_run_id", "left")
    error = F.coalesce("reason", F.when(F.col("status").isNull(), "no comparison rows"), F.when(F.col("disagrees"), "false-positive deltas disagree or are null"))
    return out.select("candidate_run_id", "baseline_run_id", F.when(error.isNull(), F.col("status")).alias("status"), F.when(error.isNull(), F.col("n_findings")).alias("n_findings"), error.alias("error"))


def evaluate_one(candidate_run_id: str, runs: DataFrame, facts: DataFrame, cases: DataFrame, comparisons: DataFrame, policy: RegressionPolicy | None = None) -> dict:
    """One candidate's result as a dictionary; raises where it cannot be judged."""
    own = runs.where(F.col("run_id") == candidate_run_id).select("baseline_run_id").take(1)
    if not own:
        raise ValueError(f"unknown candidate run {candidate_run_id}")
    if own[0][0] is None:
        raise ValueError(f"run {candidate_run_id} has no baseline")
    mine = comparisons.where(F.col("candidate_run_id") == candidate_run_id)
    row = evaluated(runs, facts, cases, mine, policy).where(F.col("candidate_run_id") == candidate_run_id).first()
    if row["error"]:
        raise ValueError(f"candidate run {candidate_run_id} cannot be compared with {row['baseline_run_id']}: {row['error']}")
    found = findings(mine, policy or RegressionPolicy()).orderBy("metric", "evaluation_family").collect()  # a few rows per family
    keep = ("metric", "evaluation_family", "observed_degradation", "threshold", "status")
    return {"candidate_run_id": candidate_run_id, "baseline_run_id": row["baseline_run_id"], "status": row["status"], "findings": [{k: f[k] for k in keep} for f in found]}


def report(status: DataFrame, found: DataFrame) -> DataFrame:
    """One JSON document per candidate: ids, status, findings ordered by metric and family."""
    item = F.struct("metric", "evaluation_family", "observed_degradation", "threshold", "status")
    listed = found.groupBy("candidate_run_id").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    out = status.join(listed, "candidate_run_id", "left")
    none = F.array().cast("array<struct<metric:string,evaluation_family:string,observed_degradation:double,threshold:double,status:string>>")
    return out.select("candidate_run_id", F.to_json(F.struct("candidate_run_id", "baseline_run_id", "status", F.coalesce("findings", none).alias("findings"))).alias("report"))
