"""One-to-one staging projections (P9), event and truth splits (P2, P3) and the replay clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered

START = "2026-01-01 00:00:00"
INTERVAL_MS = 100


def stg_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumnRenamed("status", "run_status")


def stg_events(events: DataFrame) -> DataFrame:
    return events.select("run_id", "event_id", F.col("ts").alias("event_ts"), "prompt_hash", F.col("text").alias("prompt_text"))


def stg_ground_truth(truth: DataFrame) -> DataFrame:
    return truth.select("run_id", "event_id", F.col("family").alias("evaluation_family"), F.col("label").alias("ground_truth_label"), "is_synthetic", "source", "objective")


def stg_detections(detections: DataFrame) -> DataFrame:
    return detections


def with_clock(corpus: DataFrame, order: list[str], *, start: str = START, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """``corpus`` with ``event_id`` and ``ts`` from its dense position in ``order``."""
    out = numbered(corpus, order, "_i")
    ts = F.timestamp_add("MILLISECOND", F.col("_i") * interval_ms, F.lit(start).cast("timestamp_ntz"))
    return out.withColumns({"event_id": F.format_string("evt-%06d", "_i"), "ts": ts}).drop("_i")


def blind_events(replayed: DataFrame) -> DataFrame:
    """What a detector may see; truth columns never pass."""
    return replayed.select("event_id", "ts", "prompt_hash", "text")


def truth_of(replayed: DataFrame) -> DataFrame:
    return replayed.select("event_id", "family", "label", "is_synthetic", "source", "objective")
