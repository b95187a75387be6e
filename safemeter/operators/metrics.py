"""Run metrics (A1 to A5, J5): catch rate is never given without the false-positive burden beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ratio(part: str, whole: str) -> Column:
    """Double quotient, null where the denominator is 0."""
    return F.when(F.col(whole) != 0, F.col(part).cast("double") / F.col(whole))


def family_summary(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("family").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame], *, per_run: bool = False) -> DataFrame:
    """``relation``, ``n`` of each table, by ``run_id`` if ``per_run``."""
    out = None
    for name, df in tables.items():
        grouped = df.groupBy("run_id") if per_run else df.groupBy()
        one = grouped.agg(F.count("*").alias("n")).withColumn("relation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def false_positive_burden(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("run_id").agg(
        _count(F.col("ground_truth_label") == "benign").alias("benign_examples"),
        _count(F.col("is_false_positive")).alias("false_positives"),
        _count(F.col("is_true_negative")).alias("true_negatives"),
        _count(F.col("is_true_positive")).alias("true_positive_blocks"),
        _count(F.col("final_flag")).alias("total_blocks"),
    )
    return counts.withColumns({
        "false_positive_rate": ratio("false_positives", "benign_examples"),
        "evaluation_mix_false_alarm_share_of_blocks": ratio("false_positives", "total_blocks"),
    })


_BURDEN = ("benign_examples", "false_positives", "false_positive_rate", "evaluation_mix_false_alarm_share_of_blocks")


def performance_by_family(facts: DataFrame, burden: DataFrame | None = None) -> DataFrame:
    """Catch rate per run and attack family, with the run's burden beside it.

    Without ``burden`` both come from one pass: the facts are summed per run, family and
    label, and the few sums of a run are added up over it.  A given ``burden`` has one row per
    run, so the optimiser broadcasts it by its size.
    """
    flags = {"caught_attacks": "is_true_positive", "missed_attacks": "is_false_negative", "fp": "is_false_positive", "blocks": "final_flag"}
    sums = facts.groupBy("run_id", "evaluation_family", "ground_truth_label").agg(F.count("*").alias("attack_examples"), *(_count(F.col(c)).alias(n) for n, c in flags.items()))
    if burden is None:
        run = Window.partitionBy("run_id")
        sums = sums.withColumns({
            "benign_examples": F.sum(F.when(F.col("ground_truth_label") == "benign", F.col("attack_examples")).otherwise(0)).over(run),
            "false_positives": F.sum("fp").over(run), "total_blocks": F.sum("blocks").over(run),
        })
        sums = sums.withColumns({"false_positive_rate": ratio("false_positives", "benign_examples"), "evaluation_mix_false_alarm_share_of_blocks": ratio("false_positives", "total_blocks")})
    family = sums.where(F.col("ground_truth_label") == "attack").withColumn("catch_rate", ratio("caught_attacks", "attack_examples"))
    own = ["run_id", "evaluation_family", "attack_examples", "caught_attacks", "missed_attacks", "catch_rate"]
    if burden is None:
        return family.select(*own, *_BURDEN)
    return family.select(*own).join(burden.select("run_id", *_BURDEN), "run_id")


def tier_contribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy("run_id", "decided_by").agg(
        F.count("*").alias("decisions"),
        _count(F.col("is_actual_attack")).alias("attack_examples_decided"),
        _count(F.col("is_true_positive")).alias("caught_attacks"),
        _count(F.col("is_false_positive")).alias("false_positives"),
        F.avg("latency_ms").alias("average_end_to_end_latency_ms"),
        F.sum("judge_cost_usd").alias("total_judge_cost_usd"),
        F.avg("judge_cost_usd").alias("average_judge_cost_usd"),
    )
