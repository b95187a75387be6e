"""Data-quality checks (C1 to C16): each returns the violating rows, none if all is well.

A null passes a range or value check; only a not-null check catches it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BANDS, DECIDERS, FAMILIES, KEYS, LABELS, RUN_STATUSES, TABLES, RunTables, columns_of
from .compare import incompatible_cases
from .facts import incomplete

#: Columns that may be null.
NULLABLE = {"runs": {"baseline_run_id"}, "detections": {"judge_verdict", "judge_rationale", "judge_model"}}
ACCEPTED = {
    "runs": {"status": RUN_STATUSES},
    "ground_truth": {"label": LABELS, "family": FAMILIES},
    "detections": {"tier1_band": BANDS, "decided_by": DECIDERS},
}


def label_family_mismatch(truth: DataFrame) -> DataFrame:
    """The benign family and the benign label must go together."""
    return truth.where((F.col("family") == "benign") != (F.col("label") == "benign"))


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null among ``columns``, and the names of those, found in one pass."""
    named = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in columns)))
    return df.withColumn("null_columns", named).where(F.size("null_columns") > 0)


def required_nulls(name: str, df: DataFrame) -> DataFrame:
    return nulls(df, [c for c in columns_of(TABLES[name]) if c not in NULLABLE.get(name, ())])


def duplicate_keys(df: DataFrame, keys: list[str], *, partitions: int | None = None) -> DataFrame:
    """Keys of several rows.  ``partitions``: the keys are dealt out into so many, each with a bounded part of them."""
    if partitions is not None:
        df = df.select(*keys).repartition(partitions, *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unaccepted(df: DataFrame, accepted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows with a value outside its accepted set, and the names of those columns."""
    named = F.array_compact(F.array(*(F.when(~F.col(c).isin(*v), c) for c, v in accepted.items())))
    return df.withColumn("bad_columns", named).where(F.size("bad_columns") > 0)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def run_rules() -> dict[str, Column]:
    low, high = F.col("low_threshold"), F.col("high_threshold")
    return {
        "threshold_order": (low >= 0) & (low <= high) & (high <= 1),
        "time_order": F.col("completed_at") >= F.col("started_at"),
        "self_baseline": F.col("baseline_run_id") != F.col("run_id"),
    }


def manifest_rules() -> dict[str, Column]:
    """Rules of a manifest (P12): those of the table, and no blank identity or version."""
    names = ("run_id", "dataset_name", "dataset_version", "dataset_hash", "detector_version", "judge_model", "policy_version", "git_sha")
    filled = {f"blank_{c}": F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) > 0 for c in names}
    return filled | run_rules()


def detection_rules() -> dict[str, Column]:
    escalated, verdict = F.col("escalated_to_judge"), F.col("judge_verdict").isNotNull()
    return {
        "score_range": F.col("tier1_score").between(0, 1),
        "latency_not_negative": F.col("latency_ms") >= 0,
        "cost_not_negative": F.col("judge_cost_usd") >= 0,
        "routing_consistent": (escalated == (F.col("decided_by") == "judge")) & (escalated == verdict),
    }


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, and the names of the broken ones; a rule that is null passes."""
    named = F.array_compact(F.array(*(F.when(~rule, name) for name, rule in rules.items())))
    return df.withColumn("broken", named).where(F.size("broken") > 0)


def table_rules(name: str) -> dict[str, Column]:
    """All rules that a row of a stored table can break by itself, for one pass over it."""
    rules = {f"{c} is null": F.col(c).isNotNull() for c in columns_of(TABLES[name]) if c not in NULLABLE.get(name, ())}
    rules |= {f"{c} is not accepted": F.col(c).isin(*v) for c, v in ACCEPTED.get(name, {}).items()}
    rules |= {"runs": manifest_rules, "detections": detection_rules}.get(name, dict)()
    if name == "ground_truth":
        rules["label and family disagree"] = (F.col("family") == "benign") == (F.col("label") == "benign")
    return rules


def composite_keys(relations: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Repeated keys of several relations, with the relation's name."""
    return reduce(DataFrame.unionByName, [duplicate_keys(df, keys).withColumn("relation", F.lit(name)) for name, df in relations.items()])


def outcomes_not_exhaustive(facts: DataFrame) -> DataFrame:
    flags = ("is_true_positive", "is_false_positive", "is_true_negative", "is_false_negative")
    return facts.where(sum((F.col(c).cast("int") for c in flags), F.lit(0)) != 1)


def family_counts_off(family: DataFrame) -> DataFrame:
    return family.where(F.col("attack_examples") != F.col("caught_attacks") + F.col("missed_attacks"))


def tier_decisions_off(facts: DataFrame, tiers: DataFrame) -> DataFrame:
    rows = facts.groupBy("run_id").agg(F.count("*").alias("fact_rows"))
    decided = tiers.groupBy("run_id").agg(F.sum("decisions").alias("tier_rows"))
    return rows.join(decided, "run_id").where("fact_rows <> tier_rows")


def _out_of_bounds(rates: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).between(0, 1), F.lit(False)) for c in rates])


def rates_out_of_bounds(df: DataFrame, rates: list[str]) -> DataFrame:
    return df.where(_out_of_bounds(rates))


def all_checks(t: RunTables, facts: DataFrame, burden: DataFrame, family: DataFrame, tiers: DataFrame, cases: DataFrame, comparisons: DataFrame) -> dict[str, DataFrame]:
    """Every check over one store and its models, by name."""
    raw = {"runs": t.runs, "events": t.events, "ground_truth": t.ground_truth, "detections": t.detections}
    key = KEYS["events"]
    return {
        "c1_label_family": label_family_mismatch(t.ground_truth),
        **{f"c2_nulls_{n}": required_nulls(n, df) for n, df in raw.items()},
        "c3_run_ids": duplicate_keys(t.runs, KEYS["runs"]),
        **{f"c4_accepted_{n}": unaccepted(raw[n], v) for n, v in ACCEPTED.items()},
        "c5_event_runs": orphans(t.events, t.runs, KEYS["runs"]),
        "c6_runs": broken_rules(t.runs, run_rules()),
        "c6_detections": broken_rules(t.detections, detection_rules()),
        "c7_truth": orphans(t.ground_truth, t.events, key),
        "c7_detections": orphans(t.detections, t.events, key),
        "c8_composite_keys": composite_keys({"events": t.events, "ground_truth": t.ground_truth, "detections": t.detections, "facts": facts}, key),
        "c9_complete": incomplete(t.events, t.ground_truth, t.detections),
        "c10_outcomes": outcomes_not_exhaustive(facts),
        "c11_family_counts": family_counts_off(family),
        "c12_tier_decisions": tier_decisions_off(facts, tiers),
        "c13_burden_rates": rates_out_of_bounds(burden, ["false_positive_rate", "evaluation_mix_false_alarm_share_of_blocks"]),
        "c13_family_rates": rates_out_of_bounds(family, ["catch_rate"]),
        "c13_comparison_rates": rates_out_of_bounds(comparisons, ["baseline_catch_rate", "candidate_catch_rate", "baseline_false_positive_rate", "candidate_false_positive_rate"]),
        "c14_burden_grain": duplicate_keys(burden, ["run_id"]),
        "c14_family_grain": duplicate_keys(family, ["run_id", "evaluation_family"]),
        "c14_tier_grain": duplicate_keys(tiers, ["run_id", "decided_by"]),
        "c15_case_grain": duplicate_keys(cases, ["candidate_run_id", "event_id"]),
        "c15_comparison_grain": duplicate_keys(comparisons, ["candidate_run_id", "evaluation_family"]),
        "c16_compatible": incompatible_cases(t.runs, facts),
    }


def row_checks(name: str) -> dict[str, Column]:
    """The checks that a row of a stored table or of ``facts`` fails by itself, by name; a null condition passes."""
    broken = lambda rules: ~reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(True)) for r in rules])
    if name == "facts":
        flags = ("is_true_positive", "is_false_positive", "is_true_negative", "is_false_negative")
        return {"c10_outcomes": sum((F.col(c).cast("int") for c in flags), F.lit(0)) != 1}
    own = {f"c2_nulls_{name}": broken(F.col(c).isNotNull() for c in columns_of(TABLES[name]) if c not in NULLABLE.get(name, ()))}
    if name in ACCEPTED:
        own[f"c4_accepted_{name}"] = broken(F.col(c).isin(*v) for c, v in ACCEPTED[name].items())
    if rules := {"runs": run_rules, "detections": detection_rules}.get(name):
        own[f"c6_{name}"] = broken(rules().values())
    if name == "ground_truth":
        own["c1_label_family"] = (F.col("family") == "benign") != (F.col("label") == "benign")
    return own


def _inlined(counts: DataFrame) -> DataFrame:
    """One row of counts as rows of check and violations; a sum over no rows is 0."""
    return counts.select(F.inline(F.array(*(F.struct(F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations"), F.lit(c).alias("check")) for c in counts.columns))))


def stored_violations(t: RunTables, facts: DataFrame, tiers: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Violations per check of the stored tables and the facts, with one scan of each and no join.

    A scan turns a row into its key, its relation and the checks it fails, a bit each.  These meet in one
    aggregate by run and event, which decides what needs a key (repeated keys, orphans,
    completeness), then in one by run (unknown and repeated runs, decisions of tiers).  A key
    with a null is nobody's partner, as in a join.  ``partitions``: rows are dealt out into so
    many by key, each with a bounded part of the keys.
    """
    relations = {"runs": t.runs.withColumn("event_id", F.lit(None).cast("string")), "events": t.events, "ground_truth": t.ground_truth, "detections": t.detections, "facts": facts}
    failed = {n: row_checks(n) for n in relations}
    names = [c for own in failed.values() for c in own]
    bit = {c: 1 << i for i, c in enumerate(names)}
    failures = lambda n: reduce(lambda a, b: a.bitwiseOR(b), [F.when(bad, bit[c]).otherwise(0) for c, bad in failed[n].items()], F.lit(0))
    place = {n: i for i, n in enumerate(relations)}
    marked = reduce(DataFrame.unionByName, [df.select(*KEYS["events"], F.lit(place[n]).alias("_relation"), failures(n).alias("_failed")) for n, df in relations.items()])
    if partitions is not None:
        marked = marked.repartition(partitions, *KEYS["events"])
    columns = [*relations, *names]
    key = marked.groupBy(*KEYS["events"]).agg(
        *(F.count_if(F.col("_relation") == i).alias(n) for n, i in place.items()), *(F.count_if(F.col("_failed").bitwiseAND(F.lit(i)) != 0).alias(c) for c, i in bit.items())
    )
    run, lost = F.col("run_id"), F.col("run_id").isNull() | F.col("event_id").isNull() | (F.col("events") == 0)
    none = lambda c: F.col(c) == 0
    keyed = {
        "c7_truth": F.when(lost, F.col("ground_truth")),
        "c7_detections": F.when(lost, F.col("detections")),
        "c8_composite_keys": sum(((F.col(n) > 1).cast("long") for n in ("events", "ground_truth", "detections", "facts")), F.lit(0)),
        "c9_complete": ((F.col("events") > 0) & (run.isNull() | F.col("event_id").isNull() | none("ground_truth") | none("detections"))).cast("long"),
    }
    by_key = key.select("run_id", *columns, *(c.alias(n) for n, c in keyed.items()))
    decided = tiers.select("run_id", "decisions", F.lit(1).alias("tiers"))
    by_run = by_key.unionByName(decided, allowMissingColumns=True).groupBy("run_id").agg(*(F.sum(c).alias(c) for c in (*columns, *keyed, "decisions", "tiers")))
    return _inlined(by_run.agg(
        *(F.sum(c).alias(c) for c in (*names, *keyed)),
        F.count_if(F.col("runs") > 1).alias("c3_run_ids"),
        F.sum(F.when(run.isNull() | (F.coalesce("runs", F.lit(0)) == 0), F.col("events"))).alias("c5_event_runs"),
        F.count_if(run.isNotNull() & (F.col("facts") > 0) & (F.col("tiers") > 0) & (F.col("facts") != F.col("decisions"))).alias("c12_tier_decisions"),
    ))


def _model_violations(df: DataFrame, keys: list[str], grain: str, rules: dict[str, Column], *, partitions: int | None = None) -> DataFrame:
    """Repeated keys of a model, counted as ``grain``, and rows for which a rule's column holds, in one pass."""
    if partitions is not None:
        df = df.repartition(partitions, *keys)
    each = df.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.count_if(bad).alias(c) for c, bad in rules.items()))
    return _inlined(each.agg(F.count_if(F.col("_n") > 1).alias(grain), *(F.sum(c).alias(c) for c in rules)))


def all_violations(t: RunTables, facts: DataFrame, burden: DataFrame, family: DataFrame, tiers: DataFrame, cases: DataFrame, comparisons: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """What ``violations`` counts over :func:`all_checks`, check by check, from one pass over each table and model.

    ``partitions``: into how many the joins and aggregates by key deal the rows; None leaves it to Spark.
    """
    rates = ["baseline_catch_rate", "candidate_catch_rate", "baseline_false_positive_rate", "candidate_false_positive_rate"]
    off = F.col("attack_examples") != F.col("caught_attacks") + F.col("missed_attacks")
    return reduce(DataFrame.unionByName, [
        stored_violations(t, facts, tiers, partitions=partitions),
        _model_violations(burden, ["run_id"], "c14_burden_grain", {"c13_burden_rates": _out_of_bounds(["false_positive_rate", "evaluation_mix_false_alarm_share_of_blocks"])}),
        _model_violations(family, ["run_id", "evaluation_family"], "c14_family_grain", {"c11_family_counts": off, "c13_family_rates": _out_of_bounds(["catch_rate"])}),
        _model_violations(tiers, ["run_id", "decided_by"], "c14_tier_grain", {}),
        _model_violations(cases, ["candidate_run_id", "event_id"], "c15_case_grain", {}, partitions=partitions),
        _model_violations(comparisons, ["candidate_run_id", "evaluation_family"], "c15_comparison_grain", {"c13_comparison_rates": _out_of_bounds(rates)}),
        violations({"c16_compatible": incompatible_cases(t.runs, facts, partitions=partitions)}),
    ])


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: its name and how many rows violate it."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).withColumn("check", F.lit(name)) for name, df in checks.items()])
