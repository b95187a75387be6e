"""Table contracts and enumerations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The enumerations of the stored tables.
FAMILIES = (
    "role-play / persona", "prefix-injection", "encoding / obfuscation", "many-shot",
    "gradual escalation", "novel (synthetic)", "benign",
)
BENIGN, ATTACK = "benign", "attack"
LABELS = (ATTACK, BENIGN)
BANDS = ("clear_benign", "ambiguous", "clear_attack")
DECIDERS = ("fast", "judge")
RUN_STATUSES = ("completed", "failed")
GATE_STATUSES = ("pass", "warn", "fail")

CORPUS = "text string, family string, label string, is_synthetic boolean, source string, objective string, prompt_hash string"
RUNS = (
    "run_id string, status string, started_at timestamp, completed_at timestamp, dataset_name string, dataset_version string, "
    "dataset_hash string, detector_version string, judge_model string, policy_version string, configuration_hash string, seed bigint, "
    "low_threshold double, high_threshold double, git_sha string, baseline_run_id string"
)
EVENTS = "run_id string, event_id string, ts timestamp_ntz, prompt_hash string, text string"
GROUND_TRUTH = "run_id string, event_id string, family string, label string, is_synthetic boolean, source string, objective string"
DETECTIONS = (
    "run_id string, event_id string, tier1_score double, tier1_band string, tier1_flag boolean, escalated_to_judge boolean, "
    "judge_verdict boolean, final_flag boolean, decided_by string, latency_ms double, judge_cost_usd double, judge_rationale string, judge_model string"
)
TABLES = {"runs": RUNS, "events": EVENTS, "ground_truth": GROUND_TRUTH, "detections": DETECTIONS}
KEYS = {"runs": ["run_id"], "events": ["run_id", "event_id"], "ground_truth": ["run_id", "event_id"], "detections": ["run_id", "event_id"]}
#: What a detector may see of an event.
BLIND_EVENT = "event_id string, ts timestamp_ntz, prompt_hash string, text string"
JUDGE_RESULT = "is_attack boolean, rationale string, latency_ms double, cost_usd double, model string"


@dataclass(frozen=True)
class RunTables:
    """The four stored tables."""

    runs: DataFrame
    events: DataFrame
    ground_truth: DataFrame
    detections: DataFrame


def columns_of(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
