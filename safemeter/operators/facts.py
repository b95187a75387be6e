"""Classification facts: the three-way join (J1), completeness (J2) and outcome flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import tasks_for
from .staging import stg_detections, stg_events, stg_ground_truth

KEY = ["run_id", "event_id"]


def joined(events: DataFrame, truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Inner join of staged events, truth and detections on run and event, so no pair crosses runs."""
    return events.join(truth, KEY).join(detections, KEY)


def with_outcomes(rows: DataFrame) -> DataFrame:
    attack, flag = F.col("ground_truth_label") == "attack", F.col("final_flag")
    return rows.withColumns({
        "is_actual_attack": attack,
        "is_true_positive": attack & flag,
        "is_false_positive": ~attack & flag,
        "is_true_negative": ~attack & ~flag,
        "is_false_negative": attack & ~flag,
    })


def fct_classifications(events: DataFrame, truth: DataFrame, detections: DataFrame, *, with_text: bool = True, partitions: int | None = None) -> DataFrame:
    """Facts of raw tables.  ``with_text=False`` drops the prompt and rationale before the shuffle; no metric reads them.

    Tables are dealt out into ``partitions`` or as many as the largest of them calls for, so that
    a task hashes a bounded part of them.
    """
    n = max(tasks_for(df) for df in (events, truth, detections)) if partitions is None else partitions
    e, d = stg_events(events), stg_detections(detections)
    if not with_text:
        e, d = e.drop("prompt_text"), d.drop("judge_rationale")
    e, g, d = (df.repartition(n, *KEY) for df in (e, stg_ground_truth(truth), d))
    return with_outcomes(joined(e, g.hint("shuffle_hash"), d.hint("shuffle_hash")))


def incomplete(events: DataFrame, truth: DataFrame, detections: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Keys of events that lack truth or a detection.

    Keys only are moved, into ``partitions`` or as many as the largest table calls for, so that
    a task holds a bounded part of them whatever the size of the tables.  Who lacks both is
    found by the first of the two joins alone, so nothing is moved again to tell keys apart.
    """
    n = max(tasks_for(df) for df in (events, truth, detections)) if partitions is None else partitions
    keys, judged, found = (df.select(*KEY).repartition(n, *KEY) for df in (events, truth, detections))
    judged, found = judged.hint("shuffle_hash"), found.hint("shuffle_hash")
    without_truth = keys.join(judged, KEY, "left_anti").distinct()
    return without_truth.union(keys.join(judged, KEY, "left_semi").join(found, KEY, "left_anti").distinct())
