"""Score, land, measure, compare: the library's three workloads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import configuration_hash
from ..operators import checks, compare, facts, fast_tier, gate, metrics, routing, term_regression
from ..operators.judge import stub
from ..operators.staging import blind_events, truth_of, with_clock
from ..schemas import DETECTIONS, RunTables, columns_of
from ..sources.shared import tasks_for
from ..sources.store import RunStore


@dataclass(frozen=True)
class Models:
    """Modelled tables of a store; ``facts`` is kept in memory because every metric reads it."""

    facts: DataFrame
    burden: DataFrame
    family: DataFrame
    tiers: DataFrame
    cases: DataFrame
    comparisons: DataFrame
    #: Into how many partitions the joins and aggregates by key deal the facts; None leaves it to Spark.
    partitions: int | None = None


def detections_of(events: DataFrame, tier: fast_tier.FastTier | term_regression.TermModel, *, judge: Callable[[DataFrame], DataFrame] = stub, low: float = routing.LOW, high: float = routing.HIGH) -> DataFrame:
    """Two-tier detection of blind events, batch or, with a tier that scores row by row, stream."""
    scored = tier.score(events.withColumn("latency_ms", F.lit(0.0)))
    out = routing.decided(scored, judge, low=low, high=high)
    return out.select(*(c for c in columns_of(DETECTIONS) if c in out.columns))


def scored_run(corpus: DataFrame, order: list[str], tier: fast_tier.FastTier | term_regression.TermModel, manifest: DataFrame, *, judge: Callable[[DataFrame], DataFrame] = stub) -> RunTables:
    """The four tables of one run: the corpus replayed blind, scored and judged.

    ``manifest``: one row of the runs table; its thresholds apply, its configuration hash is computed.
    """
    run = manifest.select("run_id", "low_threshold", "high_threshold").first()
    replayed = with_clock(corpus, order)
    own = F.lit(run["run_id"])
    events = blind_events(replayed)
    found = detections_of(events, tier, judge=judge, low=run["low_threshold"], high=run["high_threshold"])
    return RunTables(configuration_hash(manifest), events.withColumn("run_id", own), truth_of(replayed).withColumn("run_id", own), found.withColumn("run_id", own))


def land(store: RunStore, tables: RunTables) -> dict[str, int]:
    """Append a run and make sure that its events are complete."""
    counts = store.append(tables)
    parts = tasks_for(tables.events)  # the store has refused truth and detections without an event
    if missing := facts.incomplete(tables.events, tables.ground_truth, tables.detections, partitions=parts).take(1):
        raise ValueError(f"incomplete event: {missing[0]}")
    return counts


def measured(t: RunTables, *, keep: bool | Callable[[DataFrame], DataFrame] = True) -> Models:
    """``keep``: whether the facts are kept in memory, or what keeps them, such as writing them."""
    n = max(tasks_for(df) for df in (t.events, t.ground_truth, t.detections))
    rows = facts.fct_classifications(t.events, t.ground_truth, t.detections, with_text=False, partitions=n)
    rows = keep(rows) if callable(keep) else rows.persist() if keep else rows
    burden = metrics.false_positive_burden(rows)
    cases = compare.case_comparisons(t.runs, rows, partitions=n)
    return Models(rows, burden, metrics.performance_by_family(rows, burden), metrics.tier_contribution(rows), cases, compare.run_comparisons(t.runs, cases, burden), n)


def checked(t: RunTables, m: Models) -> DataFrame:
    """Violations per check over tables and models."""
    return checks.all_violations(t, m.facts, m.burden, m.family, m.tiers, m.cases, m.comparisons, partitions=m.partitions)


def gated(t: RunTables, m: Models, policy: gate.RegressionPolicy | None = None) -> DataFrame:
    return gate.evaluated(t.runs, m.facts, m.cases, m.comparisons, policy)
