"""Two-tier routing (P5 to P7): bands, the fast flag, and the final decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.5, 0.85


def band(score: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Below ``low`` clear_benign, above ``high`` clear_attack, both limits themselves ambiguous."""
    return F.when(score < low, "clear_benign").when(score > high, "clear_attack").otherwise("ambiguous")


def tier1_flag(score: Column, high: float = HIGH) -> Column:
    return score > high


def decided(scored: DataFrame, judge: Callable[[DataFrame], DataFrame], *, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``scored`` (with ``tier1_score``) with all decision columns.

    Only ambiguous rows go to ``judge``, which adds a struct column ``verdict`` (is_attack,
    rationale, latency_ms, cost_usd, model); rows and not a condition are split, so a judge
    that costs money never sees a clear case.  ``latency_ms`` of the input, where there is
    one, counts in full; a judge's latency comes on top.
    """
    score = F.col("tier1_score")
    rows = scored.withColumns({"tier1_band": band(score, low, high), "tier1_flag": tier1_flag(score, high)})
    own = F.col("latency_ms") if "latency_ms" in scored.columns else F.lit(0.0)
    none = F.lit(None)
    fast = rows.where(F.col("tier1_band") != "ambiguous").withColumns({
        "escalated_to_judge": F.lit(False), "judge_verdict": none.cast("boolean"), "final_flag": F.col("tier1_band") == "clear_attack",
        "decided_by": F.lit("fast"), "latency_ms": own, "judge_cost_usd": F.lit(0.0), "judge_rationale": none.cast("string"), "judge_model": none.cast("string"),
    })
    judged = judge(rows.where(F.col("tier1_band") == "ambiguous")).withColumns({
        "escalated_to_judge": F.lit(True), "judge_verdict": F.col("verdict.is_attack"), "final_flag": F.col("verdict.is_attack"),
        "decided_by": F.lit("judge"), "latency_ms": own + F.col("verdict.latency_ms"), "judge_cost_usd": F.col("verdict.cost_usd"),
        "judge_rationale": F.col("verdict.rationale"), "judge_model": F.col("verdict.model"),
    }).drop("verdict")
    return fast.unionByName(judged)
