"""Registered queries of the measurement library, each with its SQL where SQL can express it.

Names start with the inventory number of the operator they show.  The SQL runs on the
driver's tables; ``RUN_SQL`` repeats the mapping of ``plans.driver_tables``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, text
from .operators import checks, compare, facts, fast_tier, gate, judge, metrics, routing, staging, term_regression
from .plans import copartition, measure
from .plans import driver_tables as tables
from .schemas import RunTables
from .sources.corpus import read_corpus, write_corpus
from .sources.shared import new_folder, written
from .sources.store import RunStore
from .streaming import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ the mapping, in SQL
RUN_SQL = """
with run_rows(run_id, k, low_threshold, high_threshold, baseline_run_id) as (
  values ('r1', 0, 0.5::double, 0.85::double, null), ('r2', 137, 0.45::double, 0.8::double, 'r1'), ('r3', 311, 0.5::double, 0.85::double, 'r1')),
runs as (select *, 'sha256:d' as dataset_hash from run_rows),
base as (
  select run_id, event_id as n, k, low_threshold, high_threshold, format('evt-{:06d}', event_id) as event_id, ts,
    event_type || ' ' || props as text,
    case event_type when 'click' then 'role-play / persona' when 'purchase' then 'prefix-injection'
      when 'signup' then 'encoding / obfuscation' when 'error' then 'many-shot' else 'benign' end as family,
    ((event_id * 7919 + k) % 1000) / 1000.0::double as tier1_score,
    (event_id % 97) / 4.0::double as latency_ms
  from events cross join run_rows),
banded as (
  select *, case when family = 'benign' then 'benign' else 'attack' end as label, substr(sha256(text), 1, 16) as prompt_hash,
    case when tier1_score < low_threshold then 'clear_benign' when tier1_score > high_threshold then 'clear_attack' else 'ambiguous' end as tier1_band
  from base),
rows as (
  select *, tier1_score > high_threshold as tier1_flag, tier1_band = 'ambiguous' as escalated_to_judge,
    case when tier1_band = 'ambiguous' then (n * 31 + k) % 3 <> 0 end as judge_verdict,
    case when tier1_band = 'ambiguous' then (n * 31 + k) % 3 <> 0 else tier1_band = 'clear_attack' end as final_flag,
    case when tier1_band = 'ambiguous' then 'judge' else 'fast' end as decided_by,
    case when tier1_band = 'ambiguous' then (n % 8) / 1024.0::double else 0.0::double end as judge_cost_usd
  from banded),
facts as (
  select run_id, event_id, ts as event_ts, prompt_hash, text as prompt_text, family as evaluation_family, label as ground_truth_label,
    tier1_score, tier1_band, tier1_flag, escalated_to_judge, judge_verdict, final_flag, decided_by, latency_ms, judge_cost_usd,
    label = 'attack' as is_actual_attack, label = 'attack' and final_flag as is_true_positive, label <> 'attack' and final_flag as is_false_positive,
    label <> 'attack' and not final_flag as is_true_negative, label = 'attack' and not final_flag as is_false_negative
  from rows),
burden as (
  select run_id, count(*) filter (ground_truth_label = 'benign') as benign_examples, count(*) filter (is_false_positive) as false_positives,
    count(*) filter (is_true_negative) as true_negatives, count(*) filter (is_true_positive) as true_positive_blocks, count(*) filter (final_flag) as total_blocks
  from facts group by run_id),
burden_rates as (
  select *, false_positives::double / nullif(benign_examples, 0) as false_positive_rate,
    false_positives::double / nullif(total_blocks, 0) as evaluation_mix_false_alarm_share_of_blocks from burden),
family as (
  select run_id, evaluation_family, count(*) as attack_examples, count(*) filter (is_true_positive) as caught_attacks, count(*) filter (is_false_negative) as missed_attacks
  from facts where ground_truth_label = 'attack' group by all),
pairs as (
  select c.run_id as candidate_run_id, c.baseline_run_id, c.dataset_hash as candidate_dataset_hash, b.dataset_hash as baseline_dataset_hash
  from runs c join runs b on c.baseline_run_id = b.run_id),
cases as (
  select p.candidate_run_id, p.baseline_run_id, c.event_id, b.prompt_hash as baseline_prompt_hash, c.prompt_hash as candidate_prompt_hash,
    b.evaluation_family as baseline_evaluation_family, c.evaluation_family, b.ground_truth_label as baseline_ground_truth_label, c.ground_truth_label,
    b.final_flag as baseline_final_flag, c.final_flag as candidate_final_flag, b.decided_by as baseline_decided_by, c.decided_by as candidate_decided_by,
    b.latency_ms as baseline_latency_ms, c.latency_ms as candidate_latency_ms, b.judge_cost_usd as baseline_judge_cost_usd,
    c.judge_cost_usd as candidate_judge_cost_usd, b.final_flag = b.is_actual_attack as baseline_correct, c.final_flag = c.is_actual_attack as candidate_correct,
    b.prompt_hash = c.prompt_hash and b.evaluation_family = c.evaluation_family and b.ground_truth_label = c.ground_truth_label as is_compatible
  from pairs p join facts c on c.run_id = p.candidate_run_id join facts b on b.run_id = p.baseline_run_id and b.event_id = c.event_id),
moves as (
  select *, not baseline_correct and candidate_correct as is_fixed, baseline_correct and not candidate_correct as is_regressed,
    ground_truth_label = 'benign' and not baseline_final_flag and candidate_final_flag as is_new_false_positive,
    candidate_latency_ms - baseline_latency_ms as latency_delta_ms, candidate_judge_cost_usd - baseline_judge_cost_usd as judge_cost_delta_usd
  from cases),
deltas as (
  select candidate_run_id, p.baseline_run_id, b.false_positive_rate as baseline_false_positive_rate, c.false_positive_rate as candidate_false_positive_rate,
    c.false_positive_rate - b.false_positive_rate as false_positive_rate_delta
  from pairs p join burden_rates c on c.run_id = candidate_run_id join burden_rates b on b.run_id = p.baseline_run_id),
run_family as (
  select candidate_run_id, baseline_run_id, evaluation_family, count(*) as attack_examples, count(*) filter (baseline_final_flag) as baseline_caught_attacks,
    count(*) filter (candidate_final_flag) as candidate_caught_attacks, count(*) filter (is_fixed) as fixed_attacks, count(*) filter (is_regressed) as regressed_attacks
  from moves where ground_truth_label = 'attack' group by all),
comparisons as (
  select f.*, baseline_caught_attacks::double / attack_examples as baseline_catch_rate, candidate_caught_attacks::double / attack_examples as candidate_catch_rate,
    (candidate_caught_attacks - baseline_caught_attacks)::double / attack_examples as catch_rate_delta,
    baseline_false_positive_rate, candidate_false_positive_rate, false_positive_rate_delta
  from run_family f join deltas using (candidate_run_id, baseline_run_id)),
degraded as (
  select candidate_run_id, baseline_run_id, 'family_catch_rate_drop' as metric, evaluation_family, greatest(0.0::double, -catch_rate_delta) as observed_degradation,
    0.01::double as warn, 0.05::double as fail from comparisons
  union all
  select distinct candidate_run_id, baseline_run_id, 'false_positive_rate_increase', 'benign', greatest(0.0::double, false_positive_rate_delta), 0.001::double, 0.01::double from comparisons),
findings as (
  select candidate_run_id, baseline_run_id, metric, evaluation_family, observed_degradation,
    case when observed_degradation > fail then fail else warn end as threshold, case when observed_degradation > fail then 'fail' else 'warn' end as status
  from degraded where observed_degradation > warn)
"""


def _measured(spark: SparkSession, sf_dir: str) -> tuple[RunTables, measure.Models]:
    t = tables.measurement(spark, sf_dir)
    return t, measure.measured(t, keep=False)


def _gated(spark: SparkSession, sf_dir: str) -> tuple[RunTables, measure.Models]:
    """As ``_measured``, with the facts written once: the gate reads them for each of its metrics."""
    t = tables.measurement(spark, sf_dir)
    return t, measure.measured(t, keep=lambda rows: written(rows, "facts"))


# ------------------------------------------------------------------ projections and scalars
@_query("select event_id, substr(sha256(event_type || ' ' || props), 1, 16) as prompt_hash from events")
def p1_prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", text.prompt_hash(F.concat_ws(" ", "event_type", "props")).alias("prompt_hash"))


_CLOCK = """
with prompts as (
  select doc_id, text, source, case when toxic = 1 then 'novel (synthetic)' else 'benign' end as family, case when toxic = 1 then 'attack' else 'benign' end as label
  from documents join labels using (doc_id)),
placed as (select *, row_number() over (order by doc_id) - 1 as i from prompts)
"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.with_clock(tables.prompts(spark, sf_dir), ["doc_id"])


@_query(_CLOCK + "select format('evt-{:06d}', i) as event_id, timestamp '2026-01-01' + to_milliseconds(i * 100) as ts, substr(sha256(text), 1, 16) as prompt_hash, text from placed")
def p2_p4_blind_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.blind_events(_replayed(spark, sf_dir))


@_query(_CLOCK + "select format('evt-{:06d}', i) as event_id, family, label, true as is_synthetic, source, 'none' as objective from placed")
def p3_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.truth_of(_replayed(spark, sf_dir))


@_query(RUN_SQL + "select run_id, event_id, tier1_band, tier1_flag, escalated_to_judge, judge_verdict, final_flag, decided_by, judge_cost_usd from rows where run_id = 'r1'")
def p5_p7_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tables.table(spark, sf_dir, "events").select(
        F.lit("r1").alias("run_id"), F.format_string("evt-%06d", "event_id").alias("event_id"), (((F.col("event_id") * 7919) % 1000) / F.lit(1000.0)).alias("tier1_score"), F.col("event_id").alias("n")
    )

    def rule(rows: DataFrame) -> DataFrame:
        n = F.col("n")
        return rows.withColumn("verdict", F.struct(((n * 31) % 3 != 0).alias("is_attack"), F.lit("rule").alias("rationale"), F.lit(0.0).alias("latency_ms"), ((n % 8) / F.lit(1024.0)).alias("cost_usd"), F.lit("rule").alias("model")))

    out = routing.decided(scored, rule)
    return out.select("run_id", "event_id", "tier1_band", "tier1_flag", "escalated_to_judge", "judge_verdict", "final_flag", "decided_by", "judge_cost_usd")


@_query(RUN_SQL + "select run_id, event_id, ts as event_ts, prompt_hash, text as prompt_text from rows")
def p9_stg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_events(tables.measurement(spark, sf_dir).events)


@_query(RUN_SQL + "select run_id, event_id, family as evaluation_family, label as ground_truth_label, true as is_synthetic, 'driver:events' as source, family as objective from rows")
def p9_stg_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_ground_truth(tables.measurement(spark, sf_dir).ground_truth)


@_query(
    RUN_SQL + "select run_id, event_id, tier1_score, tier1_band, tier1_flag, escalated_to_judge, judge_verdict, final_flag, decided_by, latency_ms, judge_cost_usd, "
    "case when escalated_to_judge then 'rule' end as judge_rationale, case when escalated_to_judge then 'stub' end as judge_model from rows"
)
def p9_stg_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_detections(tables.measurement(spark, sf_dir).detections)


@_query(
    """select run_id, run_status, cast(n as bigint) as events, configuration_hash from (
  select run_id, 'completed' as run_status, (select count(*) from events) as n,
    'sha256:' || sha256('{"dataset_hash":"sha256:d","detector_version":"two-tier.v1","git_sha":"0000000","high_threshold":' || high || ',"judge_model":"stub","low_threshold":' || low || ',"policy_version":"1","seed":42}') as configuration_hash
  from (values ('r1', '0.5', '0.85'), ('r2', '0.45', '0.8'), ('r3', '0.5', '0.85')) v(run_id, low, high))"""
)
def p9_p10_stg_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    n = t.events.groupBy("run_id").agg(F.count("*").alias("events"))
    return staging.stg_runs(t.runs).join(n, "run_id").select("run_id", "run_status", "events", "configuration_hash")


def _json_text(column: str) -> str:
    """A string as JSON with characters beyond printable ASCII escaped, in SQL."""
    hexed = "printf('\\u%04x', {})".format
    code = "unicode(c)"
    return (
        f"case when {column} is null then 'null' else '\"' || coalesce(array_to_string(list_transform(regexp_extract_all({column}, '(?s).'), lambda c: "
        f"case when c = '\"' then '\\\"' when c = '\\' then '\\\\' when c = chr(8) then '\\b' when c = chr(12) then '\\f' when c = chr(10) then '\\n' "
        f"when c = chr(13) then '\\r' when c = chr(9) then '\\t' when {code} between 32 and 126 then c when {code} < 65536 then {hexed(code)} "
        f"else {hexed(f'55296 + ({code} - 65536) // 1024')} || {hexed(f'56320 + ({code} - 65536) % 1024')} end), ''), '') || '\"' end"
    )


_LINES = _CLOCK + f""", lines as (
  select doc_id, i, '{{"family":"' || family || '","is_synthetic":true,"label":"' || label || '","objective":"none","source":' || {_json_text("source")} || ',"text":' || {_json_text("text")} || '}}' || chr(10) as line from placed)
"""


@_query(_LINES + "select 'sha256:' || sha256(coalesce(string_agg(line, '' order by doc_id), '')) as dataset_hash from lines")
def p11_dataset_hash_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: ordered lines through one digest, in one task that holds a batch at a time; the driver gets the digest."""
    return spark.createDataFrame([(hashing.dataset_hash_exact(tables.prompts(spark, sf_dir), ["doc_id"]),)], "dataset_hash string")


@_query(
    _LINES + ", one as (select i // 1024 as c, sha256(string_agg(upper(sha256(line)), '' order by i)) as d from lines group by 1), "
    "two as (select c // 1024 as c, sha256(string_agg(upper(d), '' order by c)) as d from one group by 1) "
    "select 'sha256-tree:' || case when (select count(*) from one) = 1 then (select d from one) when (select count(*) from two) = 1 then (select d from two) else sha256('') end as dataset_hash"
)
def p11_dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parallel scheme; its SQL has the two levels that suffice for a million rows."""
    return hashing.dataset_hash_tree(tables.prompts(spark, sf_dir), ["doc_id"])


@_query("select event_id, 'time_order' as broken from events where event_id % 3 = 0 union all select event_id, 'threshold_order' from events where event_id % 5 = 0 union all select event_id, 'blank_git_sha' from events where event_id % 7 = 0")
def p12_manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests derived from events, each third, fifth and seventh broken in one way."""
    n = F.col("event_id")
    one = tables.runs(spark).where("run_id = 'r1'").drop("git_sha", "completed_at", "low_threshold")
    rows = tables.table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 7 == 0, " ").otherwise("0000000").alias("git_sha"), F.when(n % 5 == 0, 0.9).otherwise(0.5).alias("low_threshold"),
        F.when(n % 3 == 0, "2025-12-31").otherwise("2026-01-02").cast("timestamp").alias("completed_at"),
    )
    return checks.broken_rules(rows.crossJoin(F.broadcast(one)), checks.manifest_rules()).select("event_id", F.explode("broken").alias("broken"))


# ------------------------------------------------------------------ text functions and judge
_TAILS = f"""
with tailed as (
  select doc_id, text || ' ' || case doc_id % 6 when 1 then '{tables.PHRASE}' when 2 then to_base64(encode('{tables.PHRASE + "!" * (-len(tables.PHRASE) % 3)}'))
    when 3 then translate('{tables.PHRASE}', 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') when 4 then translate('{tables.PHRASE}', 'aeiost', '4310$7')
    when 5 then '{tables.PHRASE} {tables.EXCUSE}' else '' end as text from documents)
"""


# Tokens that can be base64, decoded to hexadecimal digits; then the well-formed UTF-8 sequences in those, U+FFFD left out.
_UTF8 = (
    "F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}|F[1-3](?:[89AB][0-9A-F]){3}|F48[0-9A-F](?:[89AB][0-9A-F]){2}|E0[AB][0-9A-F][89AB][0-9A-F]|"
    "E[1-9A-CEF](?:[89AB][0-9A-F]){2}|ED[89][0-9A-F][89AB][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|[0-9A-F]{2}"
)
_DECODED = _TAILS + rf""", tokens as (
  select doc_id, text, list_transform(regexp_extract_all(text, '[^\t-\r\x{{85}}\p{{Z}}]{{12,}}'), lambda t: {{'body': regexp_replace(t, '=+$', ''), 'pad': length(t) - length(regexp_replace(t, '=+$', ''))}}) as found from tailed),
usable as (
  select doc_id, text, list_filter(found, lambda x: regexp_full_match(x.body, '[A-Za-z0-9]+') and
    (length(x.body) % 4 = 0 or length(x.body) % 4 = 2 and x.pad >= 2 or length(x.body) % 4 = 3 and x.pad >= 1)) as found from tokens),
hexed as (select doc_id, text, list_transform(found, lambda x: hex(from_base64(rpad(x.body, cast(ceil(length(x.body) / 4) * 4 as int), '=')))) as found from usable),
decoded as (
  select doc_id, text, list_transform(found, lambda h: decode(unhex(coalesce(array_to_string(list_filter(regexp_extract_all(h, '{_UTF8}'),
    lambda p: (length(p) > 2 or p < '80') and p <> 'EFBFBD'), ''), '')))) as found from hexed)
"""
_TURN = "translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')"


@_query(_DECODED + f"select doc_id, len(found) as n_decoded, md5(coalesce(array_to_string(found, '|'), '')) as decoded, list_contains(list_transform(found, lambda x: contains(x, '{tables.PHRASE}')), true) as holds_phrase from decoded")
def u1_base64_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decodings of each text, those of long words of the prose included."""
    out = tables.judged_texts(spark, sf_dir).select("doc_id", text.base64_decodings(F.col("text")).alias("d"))
    return out.select("doc_id", F.size("d").cast("long").alias("n_decoded"), F.md5(F.array_join("d", "|")).alias("decoded"), F.exists("d", lambda t: t.contains(tables.PHRASE)).alias("holds_phrase"))


@_query(
    _TAILS + "select doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) as turned, "
    "md5(translate(text, '4310$7', 'aeiost')) as unleet from tailed"
)
def u2_u3_rot13_unleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.judged_texts(spark, sf_dir).select("doc_id", F.md5(text.rot13(F.col("text"))).alias("turned"), F.md5(text.unleet(F.col("text"))).alias("unleet"))


@_query(_DECODED + f"select doc_id, md5(lower(text) || ' ' || coalesce(array_to_string(list_transform(found, lambda x: lower(x) || ' '), ''), '') || lower({_TURN}) || ' ' || lower(translate(text, '4310$7', 'aeiost'))) as effective from decoded")
def u4_effective_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.judged_texts(spark, sf_dir).select("doc_id", F.md5(text.effective_text(F.col("text"))).alias("effective"))


@_query(
    f"""select doc_id, doc_id % 6 between 1 and 4 as is_attack,
  case when doc_id % 6 = 5 then '{judge.BENIGN_WHY}' when doc_id % 6 = 0 then '{judge.NOTHING_WHY}' else '{judge.ATTACK_WHY.replace("'", "''")}' end as rationale,
  0.0::double as cost_usd, 'stub' as model from documents"""
)
def u5_u6_stub_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.judged_texts(spark, sf_dir).select("doc_id", judge.stub_verdict(F.col("text")).alias("v"))
    return out.select("doc_id", "v.is_attack", "v.rationale", "v.cost_usd", "v.model")


# By id modulo 6: JSON with a reason, without one, prose about an attack, a list, JSON with more after it, plain prose.
_REPLIES = """
with replies as (
  select doc_id, doc_id % 6 as k, source, case doc_id % 6 when 0 then '{"verdict": "attack", "reason": "' || source || '"}' when 1 then '{"verdict": "' || lang || '"}'
    when 2 then 'Looks like an ATTACK: ' || coalesce(text, '') when 3 then '["attack"] ' || source when 4 then '{"verdict":"attack"} ' || coalesce(text, '') else coalesce(text, '') end as raw
  from documents)
"""


@_query(_REPLIES + "select doc_id, case when k = 0 then true when k = 1 then false else contains(lower(raw), 'attack') end as is_attack, case when k = 0 then source when k = 1 then '' else substr(raw, 1, 120) end as rationale from replies where raw is not null")
def u7_parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, prose = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    raw = (
        F.when(k == 0, F.concat(F.lit('{"verdict": "attack", "reason": "'), "source", F.lit('"}'))).when(k == 1, F.concat(F.lit('{"verdict": "'), "lang", F.lit('"}')))
        .when(k == 2, F.concat(F.lit("Looks like an ATTACK: "), prose)).when(k == 3, F.concat(F.lit('["attack"] '), "source"))
        .when(k == 4, F.concat(F.lit('{"verdict":"attack"} '), prose)).otherwise(prose)
    )
    out = tables.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).where("raw is not null")
    return out.select("doc_id", judge.parse_reply("raw").alias("v")).select("doc_id", "v.is_attack", "v.rationale")


@_query("select doc_id, case when doc_id % 2 = 0 then n_chars / 1e6 * 5.0::double + (doc_id % 64) / 1e6 * 25.0::double else 0.0::double end as cost_usd from documents")
def u8_judge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "priced").otherwise("unknown").alias("model"), F.col("n_chars").alias("input_tokens"), (F.col("doc_id") % 64).alias("output_tokens"))
    prices = spark.createDataFrame([("priced", 5.0, 25.0)], "model string, input_price double, output_price double")
    return judge.with_cost(replies, prices).select("doc_id", "cost_usd")


@_query("select doc_id, length(text) % 2 = 0 as is_attack from documents")
def h1_custom_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def even(texts: list[str]) -> list[dict]:
        return [{"is_attack": len(t) % 2 == 0, "rationale": "length", "latency_ms": 0.0, "cost_usd": 0.0, "model": "even"} for t in texts]

    rows = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge.batch_judge(even)(rows).select("doc_id", "verdict.is_attack")


# ------------------------------------------------------------------ fast tier
_TERMS = r"""
with words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from documents),
terms as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from words)
"""


@_query(_TERMS + "select doc_id, count(*) as n_terms, count(distinct term) as n_distinct from terms group by doc_id")
def m1_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.table(spark, sf_dir, "documents").select("doc_id", fast_tier.terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_query(_TERMS + "select term, count(distinct doc_id) as documents from terms group by term having count(distinct doc_id) >= 2")
def m2_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_tier.document_frequency(tables.table(spark, sf_dir, "documents"))


@_query()
def m3_m5_fast_tier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted and scored by tables: no term reaches the driver."""
    prompts = tables.scored_prompts(spark, sf_dir)
    model = term_regression.fit(prompts.where("not held_out"))
    return prompts.select("doc_id", "label", "held_out").join(term_regression.scored(prompts, model, "doc_id"), "doc_id")


@_query(
    _TERMS + ", train as (select doc_id from documents join labels using (doc_id) where doc_id % 2 = 0 and toxic is not null), "
    "known as (select term from terms semi join train using (doc_id) group by term having count(distinct doc_id) >= 2) "
    "select (select count(*) from train) as texts, count(*) as terms, true as optimal from known"
)
def m4_fit_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the fitted model, and whether the gradient by each coefficient, taken by plain joins, is next to nothing.

    The loss is strictly convex, so a coefficient is off by no more than its gradient's size.
    """
    train = tables.scored_prompts(spark, sf_dir).where("not held_out")
    model = term_regression.fit(train)
    steepest = F.sqrt(F.sum(F.col("gradient") ** 2))
    return term_regression.gradient(train, model).agg(F.lit(model.texts).cast("long").alias("texts"), F.count("term").alias("terms"), (steepest < 1e-6).alias("optimal"))


#: Coefficients by term that SQL can repeat, and the intercept.
_INTERCEPT = 0.25


def _coefficient() -> Column:
    return ((F.length("term") * 7 + F.ascii("term")) % 11 - 5) / 4


_SCORED = _TERMS + rf""", train as (select doc_id from documents join labels using (doc_id) where doc_id % 2 = 0 and toxic is not null),
size as (select count(*) as n from train),
known as (select term, ln((n + 1.0::double) / (count(distinct doc_id) + 1.0::double)) + 1 as idf from terms semi join train using (doc_id) cross join size group by term, n having count(distinct doc_id) >= 2),
weights as (select doc_id, term, count(*) * any_value(idf) as w from terms join known using (term) group by doc_id, term),
sums as (select doc_id, sum(w * (((length(term) * 7 + unicode(term)) % 11 - 5) / 4.0::double)) / sqrt(sum(w * w)) as dot from weights group by doc_id),
scored as (select doc_id, 1.0::double / (1 + exp(-({_INTERCEPT}::double + coalesce(dot, 0)))) as score, row_number() over (order by doc_id) - 1 as i from documents left join sums using (doc_id))
"""


def _given_model(spark: SparkSession, sf_dir: str) -> tuple[term_regression.TermModel, DataFrame]:
    """Vocabulary of the training half and given coefficients; all documents with and without label."""
    prompts = tables.scored_prompts(spark, sf_dir)
    return term_regression.with_coefficients(prompts.where("not held_out"), _coefficient(), _INTERCEPT), prompts


@_query(_SCORED + "select doc_id, round(score, 6) as tier1_score from scored")
def m3_m5_given_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF and score with the training half's vocabulary and coefficients that are not fitted, so that SQL can follow; all by tables."""
    model, prompts = _given_model(spark, sf_dir)
    return term_regression.scored(prompts, model, "doc_id").select("doc_id", F.round("tier1_score", 6).alias("tier1_score"))


# ------------------------------------------------------------------ facts, metrics, comparison, gate
@_query(RUN_SQL + "select * from facts")
def j1_p8_fct_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    return facts.fct_classifications(t.events, t.ground_truth, t.detections).drop("source", "is_synthetic", "objective", "judge_rationale", "judge_model")


@_query(RUN_SQL + "select run_id, event_id from rows where (run_id = 'r1' and n % 100 = 7) or (run_id = 'r2' and n % 250 = 3)")
def j2_c9_incomplete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    n = F.substring("event_id", 5, 20).cast("long")
    truth = t.ground_truth.where(~((F.col("run_id") == "r1") & (n % 100 == 7)))
    detections = t.detections.where(~((F.col("run_id") == "r2") & (n % 250 == 3)))
    return facts.incomplete(t.events, truth, detections)


@_query(RUN_SQL + "select p.*, (select count(*) from events) as baseline_events from pairs p")
def j3_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    n = t.events.groupBy(F.col("run_id").alias("baseline_run_id")).agg(F.count("*").alias("baseline_events"))
    return compare.lineage(t.runs).join(n, "baseline_run_id").select("candidate_run_id", "baseline_run_id", "candidate_dataset_hash", "baseline_dataset_hash", "baseline_events")


@_query(RUN_SQL + "select * from moves")
def j4_k1_k3_case_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[1].cases


@_query(RUN_SQL + "select * from moves")
def j1_j4_copartitioned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through tables that are bucketed by event: facts and pairs are joined without moving rows."""
    t = tables.measurement(spark, sf_dir)
    with copartition.Copartition(spark, t.events.count()) as place:
        return written(copartition.measured(place, t).cases, "cases")


_FAULTS = """
select 'r2' as candidate_run_id, 'r1' as baseline_run_id, event_id from rows where run_id = 'r2' and n % 1000 in (11, 12)
union all select 'r3', 'r1', event_id from rows where run_id = 'r3' and n % 2000 = 5
union all select 'r3', 'r1', null
"""


def _with_faults(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs and facts: in r2 some hashes changed and some events gone, in r3 some labels changed and other data."""
    t, m = _measured(spark, sf_dir)
    n, run = F.substring("event_id", 5, 20).cast("long"), F.col("run_id")
    rows = m.facts.where(~((run == "r2") & (n % 1000 == 12)))
    rows = rows.withColumn("prompt_hash", F.when((run == "r2") & (n % 1000 == 11), "changed").otherwise(F.col("prompt_hash")))
    rows = rows.withColumn("ground_truth_label", F.when((run == "r3") & (n % 2000 == 5), "other").otherwise(F.col("ground_truth_label")))
    return t.runs.withColumn("dataset_hash", F.when(run == "r3", "sha256:e").otherwise(F.col("dataset_hash"))), rows


@_query(RUN_SQL + _FAULTS)
def j6_c16_incompatible_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.incompatible_cases(*_with_faults(spark, sf_dir))


@_query("select case when toxic = 1 then 'novel (synthetic)' else 'benign' end as family, count(*) as n from documents join labels using (doc_id) group by all")
def a1_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.family_summary(tables.prompts(spark, sf_dir))


@_query(RUN_SQL + "select run_id, relation, case when relation = 'runs' then 1 else (select count(*) from events) end as n from runs cross join (values ('runs'), ('events'), ('ground_truth'), ('detections'), ('joined_results')) v(relation)")
def a2_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    joined = t.events.join(t.ground_truth, facts.KEY).join(t.detections, facts.KEY)
    return metrics.table_counts({"runs": t.runs, "events": t.events, "ground_truth": t.ground_truth, "detections": t.detections, "joined_results": joined}, per_run=True)


@_query(RUN_SQL + "select * from burden_rates")
def a3_false_positive_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[1].burden


@_query(
    RUN_SQL + "select f.*, caught_attacks::double / attack_examples as catch_rate, benign_examples, false_positives, false_positive_rate, "
    "evaluation_mix_false_alarm_share_of_blocks from family f join burden_rates using (run_id)"
)
def a4_performance_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    return metrics.performance_by_family(facts.fct_classifications(t.events, t.ground_truth, t.detections, with_text=False))


@_query(ORACLE_SQL["a4_performance_by_family"])
def j5_performance_beside_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[1].family


@_query(
    RUN_SQL + "select run_id, decided_by, count(*) as decisions, count(*) filter (is_actual_attack) as attack_examples_decided, count(*) filter (is_true_positive) as caught_attacks, "
    "count(*) filter (is_false_positive) as false_positives, avg(latency_ms) as average_end_to_end_latency_ms, sum(judge_cost_usd) as total_judge_cost_usd, "
    "avg(judge_cost_usd) as average_judge_cost_usd from facts group by all"
)
def a5_tier_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[1].tiers


@_query(RUN_SQL + "select * from comparisons")
def k4_k5_run_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[1].comparisons


@_query(RUN_SQL + "select 'r2' as candidate_run_id, 'r1' as baseline_run_id, 'row counts differ' as reason union all select 'r3', 'r1', 'dataset hashes differ'")
def g2_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, rows = _with_faults(spark, sf_dir)
    return gate.comparability(runs, rows, compare.case_comparisons(runs, rows))


@_query(RUN_SQL + "select * from findings")
def g3_g4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.findings(_measured(spark, sf_dir)[1].comparisons, gate.RegressionPolicy())


_STATUS = """
select candidate_run_id, baseline_run_id, case when bool_or(f.status = 'fail') then 'fail' when count(f.status) > 0 then 'warn' else 'pass' end as status,
  count(f.status) as n_findings, cast(null as varchar) as error
from (select distinct candidate_run_id, baseline_run_id from comparisons) c left join findings f using (candidate_run_id, baseline_run_id) group by 1, 2
"""


@_query(RUN_SQL + _STATUS)
def g5_g6_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _gated(spark, sf_dir)
    return measure.gated(t, m)


@_query(
    RUN_SQL + ", status as (" + _STATUS + ") select s.candidate_run_id, s.baseline_run_id, s.status, f.metric, f.evaluation_family, f.observed_degradation, f.threshold, f.status as finding_status "
    "from status s left join findings f using (candidate_run_id, baseline_run_id)"
)
def s7_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports, read back from their JSON."""
    t, m = _gated(spark, sf_dir)
    made = gate.report(measure.gated(t, m), gate.findings(m.comparisons, gate.RegressionPolicy()))
    item = "metric string, evaluation_family string, observed_degradation double, threshold double, status string"
    read = made.select(F.from_json("report", f"candidate_run_id string, baseline_run_id string, status string, findings array<struct<{item.replace(' ', ':').replace(',:', ',')}>>").alias("r"))
    flat = read.select("r.candidate_run_id", "r.baseline_run_id", "r.status", F.explode_outer("r.findings").alias("f"))
    return flat.select("candidate_run_id", "baseline_run_id", "status", "f.metric", "f.evaluation_family", "f.observed_degradation", "f.threshold", F.col("f.status").alias("finding_status"))


@_query("select event_id, (event_id % 7) / 5.0::double <= (event_id % 11) / 10.0::double and (event_id % 11) / 10.0::double <= 1 as in_order from events")
def g1_policy_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that a policy checks its pairs of limits by, on pairs made from event ids."""
    n = F.col("event_id")
    return tables.table(spark, sf_dir, "events").select("event_id", gate.limits_in_order((n % 7) / F.lit(5.0), (n % 11) / F.lit(10.0)).alias("in_order"))


# ------------------------------------------------------------------ checks on planted faults
def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.substring("event_id", 5, 20).cast("long"))


@_query(RUN_SQL + "select run_id, event_id from rows where family = 'benign' and n % 13 = 0")
def c1_label_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _numbered(tables.measurement(spark, sf_dir).ground_truth)
    bad = (F.col("family") == "benign") & (F.col("n") % 13 == 0)
    return checks.label_family_mismatch(truth.withColumn("label", F.when(bad, "attack").otherwise(F.col("label")))).select("run_id", "event_id")


def _blanked(df: DataFrame, column: str, every: int) -> DataFrame:
    return df.withColumn(column, F.when(F.col("n") % every != 0, F.col(column)))


@_query(
    RUN_SQL + "select 'events' as relation, run_id, event_id, case when n % 34 = 0 then 'prompt_hash,text' else 'text' end as null_columns from rows where n % 17 = 0 "
    "union all select 'ground_truth', run_id, event_id, 'objective' from rows where n % 21 = 0 "
    "union all select 'detections', run_id, event_id, 'latency_ms' from rows where n % 25 = 0 union all select 'runs', 'r3', null, 'git_sha'"
)
def c2_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    faulty = {
        "events": _blanked(_blanked(_numbered(t.events), "text", 17), "prompt_hash", 34), "ground_truth": _blanked(_numbered(t.ground_truth), "objective", 21),
        "detections": _blanked(_numbered(t.detections), "latency_ms", 25), "runs": t.runs.withColumns({"git_sha": F.when(F.col("run_id") != "r3", F.col("git_sha")), "event_id": F.lit(None).cast("string")}),
    }
    found = [checks.required_nulls(n, df).select(F.lit(n).alias("relation"), "run_id", "event_id", F.array_join("null_columns", ",").alias("null_columns")) for n, df in faulty.items()]
    return reduce(DataFrame.unionByName, found)


@_query(RUN_SQL + "select run_id, event_id, cast(2 as bigint) as n from rows where n % 29 = 0")
def c3_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _numbered(tables.measurement(spark, sf_dir).events)
    return checks.duplicate_keys(events.unionByName(events.where("n % 29 = 0")), facts.KEY)


@_query(
    RUN_SQL + "select 'detections' as relation, run_id, event_id, 'decided_by' as bad_columns from rows where n % 19 = 0 "
    "union all select 'ground_truth', run_id, event_id, case when n % 66 = 0 then 'label,family' when n % 22 = 0 then 'label' else 'family' end from rows where n % 22 = 0 or n % 33 = 0 "
    "union all select 'runs', 'r2', null, 'status'"
)
def c4_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    other = lambda df, column, every: df.withColumn(column, F.when(F.col("n") % every == 0, "other").otherwise(F.col(column)))
    faulty = {
        "detections": other(_numbered(t.detections), "decided_by", 19), "ground_truth": other(other(_numbered(t.ground_truth), "label", 22), "family", 33),
        "runs": t.runs.withColumns({"status": F.when(F.col("run_id") == "r2", "odd").otherwise(F.col("status")), "event_id": F.lit(None).cast("string")}),
    }
    found = [checks.unaccepted(df, checks.ACCEPTED[n]).select(F.lit(n).alias("relation"), "run_id", "event_id", F.array_join("bad_columns", ",").alias("bad_columns")) for n, df in faulty.items()]
    return reduce(DataFrame.unionByName, found)


@_query(RUN_SQL + "select run_id, event_id from rows where run_id = 'r3'")
def c5_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    return checks.orphans(t.events, t.runs.where("run_id <> 'r3'"), ["run_id"]).select("run_id", "event_id")


@_query(
    RUN_SQL + "select run_id, event_id, 'score_range' as broken from rows where n % 23 = 0 union all "
    "select run_id, event_id, 'routing_consistent' from rows where n % 31 = 0 and not escalated_to_judge"
)
def c6_detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, n = _numbered(tables.measurement(spark, sf_dir).detections), F.col("n")
    found = found.withColumn("tier1_score", F.when(n % 23 == 0, 2.0).otherwise(F.col("tier1_score"))).withColumn("judge_verdict", F.when((n % 31 == 0) & ~F.col("escalated_to_judge"), True).otherwise(F.col("judge_verdict")))
    return checks.broken_rules(found, checks.detection_rules()).select("run_id", "event_id", F.explode("broken").alias("broken"))


@_query(RUN_SQL + "select run_id, event_id from rows where n % 37 = 0")
def c7_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.measurement(spark, sf_dir)
    return checks.orphans(t.ground_truth, _numbered(t.events).where("n % 37 <> 0"), facts.KEY).select("run_id", "event_id")


@_query(RUN_SQL + "select run_id, event_id, cast(2 as bigint) as n, relation from rows join (values ('events', 43), ('ground_truth', 47), ('detections', 41), ('facts', 53)) v(relation, every) on n % every = 0")
def c8_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _measured(spark, sf_dir)
    twice = lambda df, every: df.unionByName(_numbered(df).where(F.col("n") % every == 0).drop("n"))
    return checks.composite_keys({"events": twice(t.events, 43), "ground_truth": twice(t.ground_truth, 47), "detections": twice(t.detections, 41), "facts": twice(m.facts, 53)}, facts.KEY)


@_query(RUN_SQL + "select run_id, event_id from facts where is_true_positive")
def c10_outcomes_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir)[1].facts
    return checks.outcomes_not_exhaustive(rows.withColumn("is_true_positive", F.lit(False))).select("run_id", "event_id")


@_query(RUN_SQL + "select run_id, evaluation_family from family where caught_attacks > 0")
def c11_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = _measured(spark, sf_dir)[1].family
    return checks.family_counts_off(family.withColumn("caught_attacks", F.lit(0))).select("run_id", "evaluation_family")


@_query(RUN_SQL + "select run_id, count(*) as fact_rows, count(*) filter (decided_by = 'judge') as tier_rows from facts group by run_id")
def c12_tier_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)[1]
    return checks.tier_decisions_off(m.facts, m.tiers.where("decided_by = 'judge'"))


@_query(
    RUN_SQL + "select 'burden' as relation, run_id, null as evaluation_family from burden_rates where false_positive_rate > 0 "
    "union all select 'family', run_id, evaluation_family from family where caught_attacks > 0 "
    "union all select 'comparisons', candidate_run_id, evaluation_family from comparisons where candidate_caught_attacks > 0"
)
def c13_rates_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)[1]
    over = lambda df, rate: checks.rates_out_of_bounds(df.withColumn(rate, F.col(rate) + 1), [rate])
    burden = over(m.burden, "false_positive_rate").select(F.lit("burden").alias("relation"), "run_id", F.lit(None).cast("string").alias("evaluation_family"))
    family = over(m.family, "catch_rate").select(F.lit("family").alias("relation"), "run_id", "evaluation_family")
    return burden.unionByName(family).unionByName(over(m.comparisons, "candidate_catch_rate").select(F.lit("comparisons").alias("relation"), F.col("candidate_run_id").alias("run_id"), "evaluation_family"))


@_query(
    RUN_SQL + "select 'burden' as relation, run_id, null as part, cast(2 as bigint) as n from burden where run_id = 'r1' "
    "union all select 'family', run_id, evaluation_family, 2 from family where run_id = 'r2' "
    "union all select distinct 'tiers', run_id, decided_by, 2 from facts where run_id = 'r3'"
)
def c14_metric_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)[1]
    twice = lambda df, run: df.unionByName(df.where(F.col("run_id") == run))
    burden = checks.duplicate_keys(twice(m.burden, "r1"), ["run_id"]).select(F.lit("burden").alias("relation"), "run_id", F.lit(None).cast("string").alias("part"), "n")
    family = checks.duplicate_keys(twice(m.family, "r2"), ["run_id", "evaluation_family"]).select(F.lit("family").alias("relation"), "run_id", F.col("evaluation_family").alias("part"), "n")
    tiers = checks.duplicate_keys(twice(m.tiers, "r3"), ["run_id", "decided_by"]).select(F.lit("tiers").alias("relation"), "run_id", F.col("decided_by").alias("part"), "n")
    return burden.unionByName(family).unionByName(tiers)


@_query(RUN_SQL + "select candidate_run_id, event_id, cast(2 as bigint) as n from moves where is_fixed")
def c15_case_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)[1]
    twice = F.explode(F.when(F.col("is_fixed"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))  # the cases are joined once
    return checks.duplicate_keys(m.cases.select("candidate_run_id", "event_id", twice), ["candidate_run_id", "event_id"], partitions=m.partitions)


_CHECKS = (
    "c1_label_family", "c2_nulls_runs", "c2_nulls_events", "c2_nulls_ground_truth", "c2_nulls_detections", "c3_run_ids", "c4_accepted_runs", "c4_accepted_ground_truth",
    "c4_accepted_detections", "c5_event_runs", "c6_runs", "c6_detections", "c7_truth", "c7_detections", "c8_composite_keys", "c9_complete", "c10_outcomes", "c11_family_counts",
    "c12_tier_decisions", "c13_burden_rates", "c13_family_rates", "c13_comparison_rates", "c14_burden_grain", "c14_family_grain", "c14_tier_grain", "c15_case_grain",
    "c15_comparison_grain", "c16_compatible",
)


@_query(
    RUN_SQL + ", planted as (select 'c2_nulls_events' as c, count(*) as n from rows where n % 17 = 0 and not (run_id = 'r3' and n % 59 = 0) union all select 'c4_accepted_detections', count(*) from rows where n % 19 = 0 and not escalated_to_judge "
    "union all select 'c6_detections', count(*) from rows where n % 23 = 0 union all select 'c4_accepted_runs', 1 union all select 'c6_runs', 1 "
    "union all select 'c7_truth', count(*) from rows where run_id = 'r3' and n % 59 = 0 union all select 'c7_detections', count(*) from rows where run_id = 'r3' and n % 59 = 0 "
    "union all select 'c16_compatible', count(*) from rows where run_id = 'r3' and n % 59 = 0) "
    "select v.c as \"check\", coalesce(p.n, 0) as violations from (values " + ", ".join(f"('{c}')" for c in _CHECKS) + ") v(c) left join planted p on p.c = v.c"
)
def c0_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over tables with faults in some of them: texts that are null, deciders and a status that are not known,
    scores out of range, a run that ends before it begins, and events of r3 that are gone."""
    t = tables.measurement(spark, sf_dir)
    n, run = F.col("n"), F.col("run_id")
    found = _numbered(t.detections)
    found = found.withColumns({"decided_by": F.when((n % 19 == 0) & ~F.col("escalated_to_judge"), "oracle").otherwise(F.col("decided_by")), "tier1_score": F.when(n % 23 == 0, 2.0).otherwise(F.col("tier1_score"))}).drop("n")
    events = _blanked(_numbered(t.events).where(~((run == "r3") & (n % 59 == 0))), "text", 17).drop("n")
    runs = t.runs.withColumns({"status": F.when(run == "r2", "odd").otherwise(F.col("status")), "completed_at": F.when(run == "r3", F.lit("2025-01-01").cast("timestamp")).otherwise(F.col("completed_at"))})
    faulty = RunTables(runs, events, t.ground_truth, found)
    return measure.checked(faulty, measure.measured(faulty))


# ------------------------------------------------------------------ files, store, stream, generation
@_query("select text, case when toxic = 1 then 'novel (synthetic)' else 'benign' end as family, case when toxic = 1 then 'attack' else 'benign' end as label, true as is_synthetic, source, 'none' as objective, substr(sha256(text), 1, 16) as prompt_hash from documents join labels using (doc_id)")
def s1_s2_corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "corpus")
    write_corpus(tables.prompts(spark, sf_dir), path)
    return read_corpus(spark, path)


@_query(RUN_SQL + "select run_id, event_id, ts, prompt_hash, text, family, label, tier1_score, tier1_band, final_flag, decided_by, judge_verdict from rows")
def s3_s5_i1_i3_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the baseline, then its candidates, then the baseline again: nothing is doubled."""
    t = tables.measurement(spark, sf_dir)
    store = RunStore(spark, new_folder(spark, "store"))
    for ids in (["r1"], ["r2", "r3"], ["r1"]):
        store.append(RunTables(*(getattr(t, n).where(F.col("run_id").isin(*ids)) for n in ("runs", "events", "ground_truth", "detections"))))
    return store.joined().select("run_id", "event_id", "ts", "prompt_hash", "text", "family", "label", "tier1_score", "tier1_band", "final_flag", "decided_by", "judge_verdict")


_TABLE_NAMES = ("runs", "events", "ground_truth", "detections")


def _only(t: RunTables, *ids: str) -> RunTables:
    return RunTables(*(getattr(t, n).where(F.col("run_id").isin(*ids)) for n in _TABLE_NAMES))


@_query("select 'events' as relation, 'run_id' as lacking, cast(3 * count(*) as bigint) as events from events")
def s4_schema_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard refuses of a store whose events were written without their run."""
    store, t = RunStore(spark, new_folder(spark, "old-store")), tables.measurement(spark, sf_dir)
    t.events.drop("run_id").write.parquet(f"{store.root}/events")
    missing = spark.createDataFrame([(n, c) for n, columns in store.lacking().items() for c in columns], "relation string, lacking string")
    return missing.crossJoin(spark.read.parquet(f"{store.root}/events").agg(F.count("*").alias("events")))  # one row


@_query(RUN_SQL + "select run_id, low_threshold, high_threshold, baseline_run_id, (select count(*) from events) as events from run_rows where run_id <> 'r3'")
def s6_manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, t = RunStore(spark, new_folder(spark, "store")), tables.measurement(spark, sf_dir)
    store.append(t)
    rows = [store.run(r) for r in ("r1", "r2")]
    read = spark.createDataFrame([tuple(r[c] for c in ("run_id", "low_threshold", "high_threshold", "baseline_run_id")) for r in rows], "run_id string, low_threshold double, high_threshold double, baseline_run_id string")
    return read.join(store.table("events").groupBy("run_id").agg(F.count("*").alias("events")), "run_id")


@_query(RUN_SQL + "select run_id, event_id from rows where run_id = 'r1' and n % 43 = 0")
def i1_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which another payload than the landed one is offered."""
    store, t = RunStore(spark, new_folder(spark, "store")), tables.measurement(spark, sf_dir)
    store.append(_only(t, "r1"))
    offered = _numbered(_only(t, "r1").detections)
    return store.conflicts("detections", offered.withColumn("latency_ms", F.col("latency_ms") + F.when(F.col("n") % 43 == 0, 1).otherwise(0)).drop("n"))


@_query(RUN_SQL + "select run_id, event_id, cast(0 as bigint) as seen_before, count(*) filter (n % 2 = 1) over () as landed from rows where run_id = 'r1'")
def i2_atomic_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of a run's events were written by a job that died: readers see none; a second append completes the run."""
    store, t = RunStore(spark, new_folder(spark, "store")), _only(tables.measurement(spark, sf_dir), "r1")
    _numbered(t.events).where("n % 2 = 0").drop("n").write.partitionBy("run_id").parquet(f"{store.root}/events")
    before = store.table("events").count()
    landed = store.append(t)["events"]
    return store.joined("r1").select("run_id", "event_id", F.lit(before).cast("long").alias("seen_before"), F.lit(landed).cast("long").alias("landed"))


@_query(RUN_SQL + "select run_id, event_id, final_flag from rows where run_id = 'r1'")
def i4_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, t = RunStore(spark, new_folder(spark, "store")), tables.measurement(spark, sf_dir)
    store.append(t)
    store.append(_only(t, "r1"), replace=True)
    return store.joined().select("run_id", "event_id", "final_flag")


@_query(_CLOCK + "select format('evt-{:06d}', i) as event_id, timestamp '2026-01-01' + to_milliseconds(i * 100) as ts, substr(sha256(text), 1, 16) as prompt_hash, text from placed")
def t1_t2_t4_t5_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay labelled documents as a stream and land it twice; the second landing adds nothing."""
    root = new_folder(spark, "replay")
    files = replay.publish(tables.prompts(spark, sf_dir), ["doc_id"], f"{root}/events", f"{root}/truth", rows_per_file=_STREAM_ROWS)
    for attempt in ("a", "b"):
        stream = replay.subscribe(spark, f"{root}/events", files_per_trigger=max(1, files // 2))
        replay.land(stream, f"{root}/landed", f"{root}/checkpoint-{attempt}", keys=["event_id"]).awaitTermination()
    return replay.landed(spark, f"{root}/landed", replay.subscribe(spark, f"{root}/events").schema)


#: Rows of a file of events in the registered queries.
_STREAM_ROWS = 5000


def _streamed(spark: SparkSession, model: term_regression.TermModel, prompts: DataFrame) -> DataFrame:
    """Events land once by key; the new ones of a batch are scored by tables and their detections overwrite that batch's folder."""
    root = new_folder(spark, "detect")
    files = replay.publish(prompts, ["doc_id"], f"{root}/events", f"{root}/truth", rows_per_file=_STREAM_ROWS)
    detections = partial(measure.detections_of, tier=model, low=0.3, high=0.7)
    stream = replay.subscribe(spark, f"{root}/events", files_per_trigger=-(-files // 2))
    detect = lambda batch, n: detections(batch).write.mode("overwrite").parquet(f"{root}/found/batch={n}")
    replay.land(stream, f"{root}/landed", f"{root}/checkpoint", keys=["event_id"], also=(detect,)).awaitTermination()
    return replay.landed(spark, f"{root}/found", detections(spark.createDataFrame([], stream.schema)).schema)


@_query()
def t3_streaming_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-tier detection on the stream of all documents."""
    prompts = tables.scored_prompts(spark, sf_dir)
    return _streamed(spark, term_regression.fit(prompts.where("not held_out")), prompts)


@_query(
    _SCORED + "select format('evt-{:06d}', i) as event_id, round(score, 6) as tier1_score, case when score < 0.3 then 'clear_benign' when score > 0.7 then 'clear_attack' else 'ambiguous' end as tier1_band, "
    "score > 0.7 as final_flag, case when score between 0.3 and 0.7 then 'judge' else 'fast' end as decided_by from scored"
)
def t3_streaming_given_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with coefficients that SQL can follow; the prose holds none of the judge's phrases."""
    out = _streamed(spark, *_given_model(spark, sf_dir))
    return out.select("event_id", F.round("tier1_score", 6).alias("tier1_score"), "tier1_band", "final_flag", "decided_by")


@_query(
    _SCORED + ", truth as (select doc_id, score, toxic = 1 as attack from scored join labels using (doc_id)), "
    "flagged as (select run_id, attack, score > high as flag from truth cross join (values ('base', 0.7::double), ('cand', 0.55::double)) v(run_id, high)), "
    "rates as (select run_id, count(*) filter (not attack and flag)::double / nullif(count(*) filter (not attack), 0) as fpr, count(*) filter (attack and flag) as caught, count(*) filter (attack) as attacks from flagged group by run_id), "
    "delta as (select greatest(0.0, -(c.caught - b.caught)::double / c.attacks) as drop, greatest(0.0, c.fpr - b.fpr) as rise from rates c, rates b where c.run_id = 'cand' and b.run_id = 'base') "
    "select 'cand' as candidate_run_id, 'base' as baseline_run_id, case when drop > 0.05 or rise > 0.01 then 'fail' when drop > 0.01 or rise > 0.001 then 'warn' else 'pass' end as status, "
    "cast((drop > 0.01)::int + (rise > 0.001)::int as bigint) as n_findings, cast(null as varchar) as error from delta"
)
def w1_w3_corpus_to_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents scored, landed and measured twice, the second time with a lower upper threshold, and gated."""
    tier, _ = _given_model(spark, sf_dir)
    corpus, store = tables.prompts(spark, sf_dir), RunStore(spark, new_folder(spark, "store"))
    one = tables.runs(spark).where("run_id = 'r1'")
    for run_id, high, baseline in (("base", 0.7, None), ("cand", 0.55, "base")):
        manifest = one.withColumns({"run_id": F.lit(run_id), "low_threshold": F.lit(0.3), "high_threshold": F.lit(high), "baseline_run_id": F.lit(baseline).cast("string")})
        measure.land(store, measure.scored_run(corpus, ["doc_id"], tier, manifest))
    t = store.tables()
    return measure.gated(t, measure.measured(t, keep=lambda rows: written(rows, "facts")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch rate per run and attack family, with the false-positive burden beside it."""
    return a4_performance_by_family(spark, sf_dir)
