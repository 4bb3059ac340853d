"""Queries over evaluation metrics, and the same in SQL written on its own. A case record is a scored run; what the scores don't
hold of it follows from the run's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import metrics as M
from papyrine.functions.text import retrieval_terms
from papyrine.sources.tables import table

STAGES = ("reader_parallel", "evidence", "critic", "verifier", "full_system")
SYSTEMS = ("frozen_small", "hybrid_answer", "fixed_workflow", "bounded_react", "single_agent", "plan_replan", "plan_completion", *STAGES)


def runs(spark, d):
    """One run per system and case: the first by number."""
    s = table(spark, d, "case_scores").where("system_id is not null and case_id is not null and score_id is not null")
    rest = [c for c in s.columns if c not in ("system_id", "case_id", "recorded_at", "ingested_at")]
    return s.groupBy("system_id", "case_id").agg(F.min_by(F.struct(*rest), "score_id").alias("r")).select("system_id", "case_id", "r.*")


def records(spark, d):
    k = F.col("score_id")
    tools = F.array(*[F.lit(x) for x in "abcd"])
    maybe = lambda m, x: F.when(k % m > 0, x)
    n = lambda m: (k % m).cast("int")
    return runs(spark, d).where("latency_ms > 0 and task_success is not null").select(
        "system_id", "case_id", "task_success", F.col("claim_support_rate").alias("answer_correctness"), n(5).alias("citation_true_positive"), n(3).alias("citation_false_positive"), n(4).alias("citation_false_negative"),
        n(6).alias("supported_claims"), (n(6) + n(2)).alias("total_claims"), n(2).alias("hallucinated_claims"), maybe(7, n(4) + 1).alias("intent_rank"), maybe(3, n(5) + 1).alias("skill_rank"),
        F.slice(tools, 1, n(4)).alias("expected_tools"), F.slice(tools, n(3) + 1, n(2)).alias("selected_tools"), maybe(5, k % 2 == 0).alias("argument_exact"), maybe(4, k % 3 == 0).alias("argument_schema_valid"), maybe(6, k % 5 == 0).alias("plan_valid"),
        n(4).alias("required_steps_matched"), (n(4) + n(3)).alias("required_steps_total"), n(2).alias("invalid_steps"), n(7).alias("total_steps"), n(3).alias("successful_tool_calls"), (n(3) + n(2)).alias("total_tool_calls"),
        (k % 3 == 0).alias("replan_attempted"), maybe(2, k % 7 == 0).alias("replan_succeeded"), (k % 13 == 0).alias("loop_detected"), n(9).alias("model_calls"), n(8).alias("tool_calls"), F.coalesce("total_tokens", F.lit(0)).alias("input_tokens"), n(100).alias("output_tokens"),
        "latency_ms", n(4).alias("four_b_calls"), n(9).alias("total_model_calls"), F.col("omission_rate").alias("gpu_seconds"), F.col("severe_unsupported_rate").alias("monetary_cost"), (k % 4 == 0).alias("recovery_attempted"), maybe(5, k % 8 == 0).alias("recovery_succeeded"),
        (k % 10 == 0).alias("partial_failure_case"), maybe(3, k % 20 == 0).alias("partial_result_usable"), (k % 11 == 0).alias("cancellation_case"), maybe(2, n(50)).alias("cancellation_response_ms"), (k % 9 == 0).alias("prompt_injection_case"), maybe(2, k % 18 == 9).alias("prompt_injection_blocked"),
    )


def q_metrics_engine(spark, d):
    r = M.report(records(spark, d), ["system_id"])
    return r.select("system_id", "metric", F.round("value", 7).alias("value"), F.round("numerator", 5).alias("numerator"), "denominator", "excluded")


def q_metrics_compare(spark, d):
    r = records(spark, d)
    c = M.compare(r.where("system_id = 'full_system'"), r.where("system_id = 'single_agent'"), "case_id")
    return c.select("metric", "cases", *[(F.round(x, 7) + F.lit(0.0)).alias(x) for x in ("absolute", "baseline", "delta")])


def results(spark, d):
    """Runs as results of an experiment: error categories and codes of failed ones."""
    k = F.col("score_id")
    cats = F.array(*[F.lit(x) for x in ("routing", "planning", "retrieval", "tool_parameters", "generation", "verification", "data", "system")])
    failed = ~F.col("task_success")
    return runs(spark, d).where("task_success is not null").select("system_id", "case_id", F.col("task_success").alias("passed"), F.when(failed & (k % 9 > 0), F.element_at(cats, (k % 8 + 1).cast("int"))).alias("error_category"), F.when(failed & (k % 5 > 0), F.concat(F.lit("e"), (k % 4).cast("string"))).alias("error_code"), (k % 9).alias("model_calls"), F.col("total_tokens").alias("tokens"))


def q_system_summary(spark, d):
    s = M.system_summary(results(spark, d), SYSTEMS)
    errors = F.array_join(F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("system_id", F.col("place").cast("bigint").alias("place"), "cases", "passed", F.round("pass_rate", 9).alias("pass_rate"), "model_calls", "tokens", F.round("system_error_rate", 9).alias("system_error_rate"), errors.alias("errors"))


def q_failure_clusters(spark, d):
    return M.failure_clusters(results(spark, d))


def _means(spark, d):
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count(c)
    return runs(spark, d).groupBy("system_id").agg((F.count_if("task_success") / F.count("task_success")).alias("task_success"), exact("claim_support_rate").alias("claim_support"), exact("omission_rate").alias("omission"), (F.sum("total_tokens") / F.count("total_tokens")).alias("tokens"))


def q_marginal(spark, d):
    m = M.marginal(_means(spark, d), STAGES, ["task_success", "claim_support", "tokens"])
    return m.select("step", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("task_success", "claim_support", "tokens")])


def q_gates(spark, d):
    g = M.gates(_means(spark, d), {"task_success": (">=", 0.5), "claim_support": (">=", 0.5), "omission": ("<=", 0.4)})
    return g.select("system_id", "task_success_ok", "claim_support_ok", "omission_ok", "passed")


def board(spark, d):
    """Dashboard rows: runs with their case's family, difficulty and language."""
    k = F.col("score_id")
    e = table(spark, d, "eval_cases").where("case_id is not null").groupBy("case_id").agg(F.min(F.struct("task_family", "difficulty", "language")).alias("c"))
    r = runs(spark, d).where("latency_ms > 0 and task_success is not null and total_tokens is not null")
    return r.join(e, "case_id").select("case_id", "system_id", "c.*", "task_success", F.col("claim_support_rate").alias("claim_support"), "total_tokens", (k % 5).alias("model_calls"), F.least(k % 5, k % 3).alias("four_b_calls"), "latency_ms", F.col("omission_rate").alias("monetary_cost"))


def q_dashboard(spark, d):
    """Each system's dashboard at every difficulty and at the third alone."""
    rows = None
    b = board(spark, d)
    for level in (None, "L3"):
        for system in ("full_system", "single_agent", None):
            one = M.dashboard(b, {"system_id": system, "difficulty": level, "language": None}).select(F.lit(system or "all").alias("system"), F.lit(level or "all").alias("level"), "*")
            rows = one if rows is None else rows.unionByName(one)
    return rows.select("system", "level", "rows", "cases", "supported", *[F.round(c, 6).alias(c) for c in ("task_success", "claim_support", "total_tokens", "four_b_call_rate", "p95_latency_ms", "cost_per_success")])


def q_dashboard_compare(spark, d):
    c = M.dashboard_compare(board(spark, d), "single_agent", "full_system")
    return c.select("cases", F.round("success_delta", 9).alias("success_delta"), "supported", F.round("support_delta", 9).alias("support_delta"))


def q_duplicate_runs(spark, d):
    return M.duplicate_runs(table(spark, d, "case_scores").where("system_id is not null and case_id is not null").distinct())


def q_stratified_take(spark, d):
    rows = table(spark, d, "eval_cases").where("case_id is not null").groupBy("case_id").agg(F.min("task_family").alias("task_family"))
    return M.stratified(rows, "case_id", "task_family", 5, 150)


def q_token_f1(spark, d):
    """Terms of every request against those of the next one of its family."""
    r = table(spark, d, "eval_cases").where("prompt is not null and task_family is not null").groupBy("case_id").agg(F.min(F.struct("task_family", "prompt")).alias("r")).select("case_id", "r.*")
    first = r.groupBy("task_family").agg(F.min_by("prompt", "case_id").alias("gold"))
    t = r.join(first, "task_family").select("case_id", retrieval_terms(F.col("prompt")).alias("a"), retrieval_terms(F.col("gold")).alias("b"))
    return t.select("case_id", F.round(M.token_f1(F.col("a"), F.col("b")), 9).alias("f1"))


def q_bootstrap_ci(spark, d):
    """Intervals of each system's mean support, from 2 000 resamples."""
    r = scores_of(spark, d).select("system_id", "score_id", "s")
    return M.drawn_intervals(r, "system_id", "score_id", ["s"]).select("system_id", *[F.round(F.col(f"s_{k}") / 1e6, 9).alias(k) for k in ("lo", "hi")])


def q_paired_bootstrap(spark, d):
    """Intervals of the mean difference of support between each system and single_agent over the cases that both have, both arms
    drawn together."""
    r = scores_of(spark, d, runs(spark, d))
    base = r.where("system_id = 'single_agent'").select("case_id", F.col("s").alias("base"))
    pairs = r.where("system_id <> 'single_agent'").join(base, "case_id").select("system_id", "case_id", (F.col("s") - F.col("base")).alias("delta"))
    return M.drawn_intervals(pairs, "system_id", "case_id", ["delta"]).select("system_id", *[F.round(F.col(f"delta_{k}") / 1e6, 9).alias(k) for k in ("lo", "hi")])


def scores_of(spark, d, rows=None):
    """Runs with their support in millionths."""
    r = table(spark, d, "case_scores").distinct() if rows is None else rows
    return r.where("system_id is not null and claim_support_rate is not null").select("system_id", "case_id", "score_id", F.round(F.col("claim_support_rate") * 1_000_000).cast("bigint").alias("s"))


QUERIES = {f.__name__: f for f in (q_bootstrap_ci, q_paired_bootstrap, q_metrics_engine, q_metrics_compare, q_system_summary, q_failure_clusters, q_marginal, q_gates, q_dashboard, q_dashboard_compare, q_duplicate_runs, q_stratified_take, q_token_f1)}

_RUNS = "firsts as (select system_id, case_id, min(score_id) as score_id from case_scores where system_id is not null and case_id is not null and score_id is not null group by 1, 2), runs as (select distinct s.* exclude (recorded_at, ingested_at) from case_scores s join firsts f using (system_id, case_id, score_id))"
_F1 = "case when s.ne = 0 and s.ns = 0 then null when s.both_ = 0 then 0.0 else 2.0 * s.both_ / (s.ne + s.ns) end"
_VALUES = f"""k as (select *, score_id as k, total_tokens as tok from runs where latency_ms > 0 and task_success is not null),
s as (select *, k % 4 as ne, case when k % 2 = 0 then 0 else 1 end as ns, case when k % 2 = 1 and k % 3 + 1 <= k % 4 then 1 else 0 end as both_ from k),
v as (select system_id, case_id, unnest([
  {{'m': 'task_success', 'v': task_success::int::double}}, {{'m': 'answer_correctness', 'v': claim_support_rate}}, {{'m': 'citation_precision', 'v': (k % 5)::double / nullif(k % 5 + k % 3, 0)}}, {{'m': 'citation_recall', 'v': (k % 5)::double / nullif(k % 5 + k % 4, 0)}},
  {{'m': 'claim_support_rate', 'v': (k % 6)::double / nullif(k % 6 + k % 2, 0)}}, {{'m': 'hallucination_rate', 'v': (k % 2)::double / nullif(k % 6 + k % 2, 0)}}, {{'m': 'intent_top1', 'v': case when k % 7 > 0 then (k % 4 = 0)::int::double end}}, {{'m': 'intent_top3', 'v': case when k % 7 > 0 then (k % 4 <= 2)::int::double end}},
  {{'m': 'skill_top1', 'v': case when k % 3 > 0 then (k % 5 = 0)::int::double end}}, {{'m': 'skill_top3', 'v': case when k % 3 > 0 then (k % 5 <= 2)::int::double end}}, {{'m': 'tool_selection_f1', 'v': ({_F1})::double}}, {{'m': 'argument_exact_rate', 'v': case when k % 5 > 0 then (k % 2 = 0)::int::double end}},
  {{'m': 'argument_schema_valid_rate', 'v': case when k % 4 > 0 then (k % 3 = 0)::int::double end}}, {{'m': 'plan_validity', 'v': case when k % 6 > 0 then (k % 5 = 0)::int::double end}}, {{'m': 'required_step_recall', 'v': (k % 4)::double / nullif(k % 4 + k % 3, 0)}}, {{'m': 'invalid_step_rate', 'v': (k % 2)::double / nullif(k % 7, 0)}},
  {{'m': 'tool_success_rate', 'v': (k % 3)::double / nullif(k % 3 + k % 2, 0)}}, {{'m': 'replan_success_rate', 'v': case when k % 3 = 0 and k % 2 > 0 then (k % 7 = 0)::int::double end}}, {{'m': 'loop_rate', 'v': (k % 13 = 0)::int::double}}, {{'m': 'model_calls', 'v': (k % 9)::double}}, {{'m': 'tool_calls', 'v': (k % 8)::double}},
  {{'m': 'input_tokens', 'v': coalesce(tok, 0)::double}}, {{'m': 'output_tokens', 'v': (k % 100)::double}}, {{'m': 'latency_p50_ms', 'v': latency_ms::double}}, {{'m': 'latency_p95_ms', 'v': latency_ms::double}}, {{'m': 'tokens_per_success', 'v': case when task_success then (coalesce(tok, 0) + k % 100)::double end}},
  {{'m': 'four_b_call_rate', 'v': (k % 4)::double / nullif(k % 9, 0)}}, {{'m': 'gpu_seconds', 'v': omission_rate}}, {{'m': 'monetary_cost', 'v': severe_unsupported_rate}}, {{'m': 'failure_recovery_rate', 'v': case when k % 4 = 0 and k % 5 > 0 then (k % 8 = 0)::int::double end}},
  {{'m': 'partial_failure_usability', 'v': case when k % 10 = 0 and k % 3 > 0 then (k % 20 = 0)::int::double end}}, {{'m': 'cancellation_response_ms', 'v': case when k % 11 = 0 and k % 2 > 0 then (k % 50)::double end}}, {{'m': 'prompt_injection_block_rate', 'v': case when k % 9 = 0 and k % 2 > 0 then (k % 18 = 9)::int::double end}}]) as x from s),
m as (select system_id, case_id, x.m as metric, x.v as v from v)"""
_SUM = "sum(cast({0} as decimal(28,10)))::double"
_MEAN = "case metric when 'latency_p50_ms' then quantile_cont({0}, 0.5) when 'latency_p95_ms' then quantile_cont({0}, 0.95) else " + _SUM + " / count({0}) end"
_RES = "res as (select system_id, case_id, task_success as passed, case when not task_success and score_id % 9 > 0 then (['routing','planning','retrieval','tool_parameters','generation','verification','data','system'])[score_id % 8 + 1] end as cat, case when not task_success and score_id % 5 > 0 then 'e' || (score_id % 4) end as code, score_id % 9 as calls, total_tokens as tokens from runs where task_success is not null)"
_MEANS = f"means as (select system_id, count(*) filter (task_success) / count(task_success) as ts, {_SUM.format('claim_support_rate')} / count(claim_support_rate) as cs, {_SUM.format('omission_rate')} / count(omission_rate) as om, sum(total_tokens) / count(total_tokens) as tk from runs group by system_id)"
_BOARD = "ec as (select case_id, min({'a': task_family, 'b': difficulty, 'c': language}) as c from eval_cases where case_id is not null group by case_id), board as (select r.*, c.b as difficulty, score_id % 5 as calls, least(score_id % 5, score_id % 3) as four from runs r join ec using (case_id) where latency_ms > 0 and task_success is not null and total_tokens is not null)"
_SETS = ", ".join(f"('{s or 'all'}', '{lv or 'all'}')" for lv in (None, "L3") for s in ("full_system", "single_agent", None))
_TERMS = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[_.-][a-z0-9]+)*'), flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))"

#: The number of draws that are above a cut point of the Poisson distribution, for a quarter of a hash.
_CUTS = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252, 4294967292]
_DRAW = lambda source, value, key: f"""src as ({source}), bl as (select unnest(range(500)) as b), hs as (select system_id, b, {value} as x, md5(b || ':' || {key}) as h from src cross join bl),
  dr as (select system_id, b * 4 + i as r, x, cast('0x' || substring(h, 8 * i + 1, 8) as bigint) as u from hs cross join (select unnest([0, 1, 2, 3])::int as i) p), tm as (select system_id, r, x, {' + '.join(f'(u >= {c})::int' for c in _CUTS)} as w from dr),
  mn as (select system_id, r, sum(w * x)::double / nullif(sum(w), 0) as m from tm group by system_id, r) select system_id, round(quantile_cont(m, 0.025) / 1e6, 9) as lo, round(quantile_cont(m, 0.975) / 1e6, 9) as hi from mn group by system_id"""  # noqa: E731

SQL = {
    "q_bootstrap_ci": "with " + _DRAW("select system_id, score_id, cast(round(claim_support_rate * 1000000) as bigint) as s from (select distinct * from case_scores) z where system_id is not null and claim_support_rate is not null", "s", "score_id"),
    "q_paired_bootstrap": f"with {_RUNS}, sc as (select system_id, case_id, cast(round(claim_support_rate * 1000000) as bigint) as s from runs where claim_support_rate is not null), " + _DRAW("select a.system_id, a.case_id, a.s - b.s as s from sc a join sc b using (case_id) where b.system_id = 'single_agent' and a.system_id <> 'single_agent'", "s", "case_id"),
    "q_metrics_engine": f"with {_RUNS}, {_VALUES} select system_id, metric, round({_MEAN.format('v')}, 7) as value, round({_SUM.format('v')}, 5) as numerator, count(v) as denominator, count(*) - count(v) as excluded from m group by system_id, metric having count(v) > 0",
    "q_metrics_compare": f"""with {_RUNS}, {_VALUES}, p as (select a.metric, a.v as a, b.v as b from m a join m b on a.case_id = b.case_id and a.metric = b.metric where a.system_id = 'full_system' and b.system_id = 'single_agent' and a.v is not null and b.v is not null)
      select metric, count(*) as cases, round({_MEAN.format('a')}, 7) as absolute, round({_MEAN.format('b')}, 7) as baseline, round({_MEAN.format('a')} - {_MEAN.format('b')}, 7) + 0.0 as delta from p group by metric""",
    "q_system_summary": f"""with {_RUNS}, {_RES}, e as (select system_id, string_agg(cat || '=' || n, ',' order by cat) as errors from (select system_id, cat, count(*) as n from res where cat is not null group by 1, 2) x group by 1),
      ord as (select unnest({list(SYSTEMS)!r}) as system_id, unnest(range({len(SYSTEMS)})) as place) select r.system_id, coalesce(place, 99) as place, count(*) as cases, count(*) filter (passed) as passed, round(count(*) filter (passed) / count(*), 9) as pass_rate, cast(sum(calls) as bigint) as model_calls, cast(sum(tokens) as bigint) as tokens,
      round(count(*) filter (cat = 'system') / count(*), 9) as system_error_rate, coalesce(any_value(errors), '') as errors from res r left join ord using (system_id) left join e using (system_id) group by r.system_id, place""",
    "q_failure_clusters": f"with {_RUNS}, {_RES}, f as (select coalesce(cat, 'system') as category, case_id, coalesce(code, 'unclassified_exception') as error_code from res where not passed) select distinct category, case_id, (select count(*) from f g where g.category = f.category) as failures, error_code from f",
    "q_marginal": f"with {_RUNS}, {_MEANS}, o as (select unnest({list(STAGES)!r}) as system_id, unnest(range({len(STAGES)})) as p) select b.system_id || '_to_' || a.system_id as step, round(ma.ts - mb.ts, 6) as task_success, round(ma.cs - mb.cs, 6) as claim_support, round(ma.tk - mb.tk, 6) as tokens from o a join o b on a.p = b.p + 1 join means ma on ma.system_id = a.system_id join means mb on mb.system_id = b.system_id",
    "q_gates": f"with {_RUNS}, {_MEANS} select system_id, ts >= 0.5 as task_success_ok, cs >= 0.5 as claim_support_ok, om <= 0.4 as omission_ok, ts >= 0.5 and cs >= 0.5 and om <= 0.4 as passed from means",
    "q_dashboard": f"""with {_RUNS}, {_BOARD}, sets(system, level) as (values {_SETS})
      select system, level, count(b.case_id) as "rows", count(distinct b.case_id) as cases, count(claim_support_rate) as supported, round(count(*) filter (task_success) / count(b.case_id), 6) as task_success, round({_SUM.format('claim_support_rate')} / count(claim_support_rate), 6) as claim_support, round(sum(total_tokens) / count(b.case_id), 6) as total_tokens,
      round(sum(four) / sum(calls), 6) as four_b_call_rate, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms, round({_SUM.format('omission_rate')} / count(*) filter (task_success), 6) as cost_per_success from sets left join board b on (system = 'all' or b.system_id = system) and (level = 'all' or b.difficulty = level) group by system, level""",
    "q_dashboard_compare": f"""with {_RUNS}, {_BOARD}, p as (select a.task_success::int as c, b.task_success::int as b, cast(a.claim_support_rate as decimal(18,10)) as cs, cast(b.claim_support_rate as decimal(18,10)) as bs from board a join board b using (case_id) where a.system_id = 'full_system' and b.system_id = 'single_agent')
      select count(*) as cases, round((sum(c) - sum(b)) / count(*), 9) as success_delta, count(cs - bs) as supported, round(sum(cs - bs)::double / count(cs - bs), 9) as support_delta from p""",
    "q_duplicate_runs": "select system_id, case_id, count(*) as n from (select distinct * from case_scores where system_id is not null and case_id is not null) x group by 1, 2 having count(*) > 1",
    "q_stratified_take": """with r as (select case_id, min(task_family) as task_family, sha256(case_id) as h from eval_cases where case_id is not null group by case_id), k as (select *, row_number() over (partition by task_family order by h) <= 5 as early from r)
      select case_id, task_family from k order by early desc, h limit 150""",
    "q_token_f1": f"""with r as (select case_id, min({{'a': task_family, 'b': prompt}}) as r from eval_cases where prompt is not null and task_family is not null group by case_id), q as (select case_id, r.a as fam, r.b as prompt from r), g as (select fam, arg_min(prompt, case_id) as gold from q group by fam),
      a as (select case_id, t, count(*) as n from (select case_id, unnest({_TERMS.format('prompt')}) as t from q) x group by 1, 2), b as (select fam, t, count(*) as n from (select fam, unnest({_TERMS.format('gold')}) as t from g) x group by 1, 2),
      na as (select case_id, sum(n) as n from a group by 1), nb as (select fam, sum(n) as n from b group by 1), hit as (select q.case_id, sum(least(a.n, b.n)) as h from q join a using (case_id) join b on b.fam = q.fam and b.t = a.t group by 1)
      select q.case_id, round(coalesce(2.0 * h / (na.n + nb.n), 0.0), 9)::double as f1 from q left join na using (case_id) left join nb using (fam) left join hit using (case_id)""",
}
