"""Paired comparison of candidate runs with their baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ratio

_SIDE = ("prompt_hash", "evaluation_family", "ground_truth_label", "final_flag", "decided_by", "latency_ms", "judge_cost_usd", "is_actual_attack")


def lineage(runs: DataFrame, *, keep_unmatched: bool = False) -> DataFrame:
    """Candidate runs with their baseline: ids and both data-set hashes.

    ``keep_unmatched``: also candidates whose baseline is not there; its hash is null.
    """
    c = runs.where(F.col("baseline_run_id").isNotNull()).select(F.col("run_id").alias("candidate_run_id"), "baseline_run_id", F.col("dataset_hash").alias("candidate_dataset_hash"))
    b = runs.select(F.col("run_id").alias("baseline_run_id"), F.col("dataset_hash").alias("baseline_dataset_hash"))
    return c.join(b, "baseline_run_id", "left" if keep_unmatched else "inner").select("candidate_run_id", "baseline_run_id", "candidate_dataset_hash", "baseline_dataset_hash")


def _candidate_side(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    side = facts.select(F.col("run_id").alias("candidate_run_id"), "event_id", *(F.col(c).alias(f"candidate_{c}") for c in _SIDE))
    return side.join(F.broadcast(pairs.select("candidate_run_id", "baseline_run_id")), "candidate_run_id")


def _baseline_side(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("run_id").alias("baseline_run_id"), "event_id", *(F.col(c).alias(f"baseline_{c}") for c in _SIDE))


def case_comparisons(runs: DataFrame, facts: DataFrame, *, pairs: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """One row per candidate run and event that both runs have.

    The pairs of runs are few, so they are broadcast; the large join is on (baseline run,
    event), never on a run alone.  ``pairs``: the lineage of ``runs``, where it was written and
    its size is known.  ``partitions``: as many as the facts call for, so that a task hashes a
    bounded part of the baselines' facts; without, facts are joined as they lie.
    """
    pairs, key = lineage(runs) if pairs is None else pairs, ["baseline_run_id", "event_id"]
    candidates, baselines = _candidate_side(pairs, facts), _baseline_side(facts)
    if partitions is not None:
        baselines = baselines.join(F.broadcast(pairs.select("baseline_run_id").distinct()), "baseline_run_id", "left_semi")
        candidates, baselines = candidates.repartition(partitions, *key), baselines.repartition(partitions, *key).hint("shuffle_hash")
    both = candidates.join(baselines, key)
    correct = {s: F.col(f"{s}_final_flag") == F.col(f"{s}_is_actual_attack") for s in ("baseline", "candidate")}
    same = [F.col(f"baseline_{c}") == F.col(f"candidate_{c}") for c in ("prompt_hash", "evaluation_family", "ground_truth_label")]
    both = both.withColumns({"baseline_correct": correct["baseline"], "candidate_correct": correct["candidate"], "is_compatible": same[0] & same[1] & same[2]})
    both = both.withColumnsRenamed({"candidate_evaluation_family": "evaluation_family", "candidate_ground_truth_label": "ground_truth_label"})
    return both.select(
        "candidate_run_id", "baseline_run_id", "event_id", "baseline_prompt_hash", "candidate_prompt_hash", "baseline_evaluation_family",
        "evaluation_family", "baseline_ground_truth_label", "ground_truth_label", "baseline_final_flag", "candidate_final_flag",
        "baseline_decided_by", "candidate_decided_by", "baseline_latency_ms", "candidate_latency_ms", "baseline_judge_cost_usd",
        "candidate_judge_cost_usd", "baseline_correct", "candidate_correct", "is_compatible",
        (~F.col("baseline_correct") & F.col("candidate_correct")).alias("is_fixed"),
        (F.col("baseline_correct") & ~F.col("candidate_correct")).alias("is_regressed"),
        ((F.col("ground_truth_label") == "benign") & ~F.col("baseline_final_flag") & F.col("candidate_final_flag")).alias("is_new_false_positive"),
        (F.col("candidate_latency_ms") - F.col("baseline_latency_ms")).alias("latency_delta_ms"),
        (F.col("candidate_judge_cost_usd") - F.col("baseline_judge_cost_usd")).alias("judge_cost_delta_usd"),
    )


def burden_deltas(runs: DataFrame, burden: DataFrame) -> DataFrame:
    """False-positive rates of the whole candidate and baseline runs, and their difference."""
    rate = "false_positive_rate"
    pairs = lineage(runs).select("candidate_run_id", "baseline_run_id")
    c = burden.select(F.col("run_id").alias("candidate_run_id"), F.col(rate).alias(f"candidate_{rate}"))
    b = burden.select(F.col("run_id").alias("baseline_run_id"), F.col(rate).alias(f"baseline_{rate}"))
    out = pairs.join(c, "candidate_run_id").join(b, "baseline_run_id")
    return out.withColumn(f"{rate}_delta", F.col(f"candidate_{rate}") - F.col(f"baseline_{rate}"))


def run_comparisons(runs: DataFrame, cases: DataFrame, burden: DataFrame) -> DataFrame:
    """Per candidate and attack family: caught on both sides, transitions, catch-rate delta, with the burden delta beside it."""
    count = lambda c: F.sum(F.col(c).cast("int")).cast("long")
    keys = ["candidate_run_id", "baseline_run_id", "evaluation_family"]
    family = cases.where(F.col("ground_truth_label") == "attack").groupBy(*keys).agg(
        F.count("*").alias("attack_examples"),
        count("baseline_final_flag").alias("baseline_caught_attacks"),
        count("candidate_final_flag").alias("candidate_caught_attacks"),
        count("is_fixed").alias("fixed_attacks"),
        count("is_regressed").alias("regressed_attacks"),
    )
    change = F.col("candidate_caught_attacks") - F.col("baseline_caught_attacks")
    family = family.withColumns({
        "baseline_catch_rate": ratio("baseline_caught_attacks", "attack_examples"),
        "candidate_catch_rate": ratio("candidate_caught_attacks", "attack_examples"),
        "catch_rate_delta": change.cast("double") / F.col("attack_examples"),
    })
    return family.join(burden_deltas(runs, burden), keys[:2])


def incompatible_cases(runs: DataFrame, facts: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Cases that only one run of a pair has or whose hash, label or family changed, and, with a null event, pairs whose data sets differ.

    One full outer join does both directions.  ``partitions`` as in :func:`case_comparisons`.
    """
    pairs, key = lineage(runs), ["candidate_run_id", "baseline_run_id", "event_id"]
    named = F.broadcast(pairs.select("candidate_run_id", "baseline_run_id"))
    only = ("prompt_hash", "evaluation_family", "ground_truth_label")
    c = facts.select(F.col("run_id").alias("candidate_run_id"), "event_id", *(F.col(x).alias(f"c_{x}") for x in only)).join(named, "candidate_run_id").withColumn("in_c", F.lit(True))
    b = facts.select(F.col("run_id").alias("baseline_run_id"), "event_id", *(F.col(x).alias(f"b_{x}") for x in only)).join(named, "baseline_run_id").withColumn("in_b", F.lit(True))
    if partitions is not None:
        c, b = c.repartition(partitions, *key), b.repartition(partitions, *key).hint("shuffle_hash")
    changed = F.lit(False)
    for x in only:
        changed |= F.coalesce(F.col(f"c_{x}") != F.col(f"b_{x}"), F.lit(False))
    cases = c.join(b, key, "full_outer").where(F.col("in_c").isNull() | F.col("in_b").isNull() | changed)
    hashes = pairs.where(F.col("candidate_dataset_hash") != F.col("baseline_dataset_hash")).select("candidate_run_id", "baseline_run_id", F.lit(None).cast("string").alias("event_id"))
    return cases.select("candidate_run_id", "baseline_run_id", "event_id").unionByName(hashes)
