"""Evaluation: case metrics and their report, paired comparison, dashboards, summaries, gates, resampled intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import vectorized as V
from papyrine.functions.rules import ratio_or_null
from papyrine.plans.runtime import spread_rows

#: Percentiles that two of the metrics are, instead of means.
PERCENTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}


def tool_f1(expected: Column, selected: Column) -> Column:
    """F1 of two sets; null where both are empty, 0 where they share nothing."""
    e, s = F.array_distinct(expected), F.array_distinct(selected)
    shared = F.size(F.array_intersect(e, s))
    return F.when((F.size(e) == 0) & (F.size(s) == 0), None).otherwise(F.when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(e) + F.size(s))))


def case_metrics() -> dict[str, Column]:
    """The 33 metrics of a case record, in the catalog's order; null where a case doesn't count for one."""
    c = F.col
    flag = lambda x: c(x).cast("int").cast("double")
    rank = lambda x, k: F.when(c(x).isNotNull(), (c(x) <= k).cast("int").cast("double"))
    if_ = lambda case, x: F.when(c(case), x)
    number = lambda x: c(x).cast("double")
    return {
        "task_success": flag("task_success"), "answer_correctness": number("answer_correctness"),
        "citation_precision": ratio_or_null(c("citation_true_positive"), c("citation_true_positive") + c("citation_false_positive")),
        "citation_recall": ratio_or_null(c("citation_true_positive"), c("citation_true_positive") + c("citation_false_negative")),
        "claim_support_rate": ratio_or_null(c("supported_claims"), c("total_claims")), "hallucination_rate": ratio_or_null(c("hallucinated_claims"), c("total_claims")),
        "intent_top1": rank("intent_rank", 1), "intent_top3": rank("intent_rank", 3), "skill_top1": rank("skill_rank", 1), "skill_top3": rank("skill_rank", 3),
        "tool_selection_f1": tool_f1(c("expected_tools"), c("selected_tools")), "argument_exact_rate": flag("argument_exact"), "argument_schema_valid_rate": flag("argument_schema_valid"), "plan_validity": flag("plan_valid"),
        "required_step_recall": ratio_or_null(c("required_steps_matched"), c("required_steps_total")), "invalid_step_rate": ratio_or_null(c("invalid_steps"), c("total_steps")),
        "tool_success_rate": ratio_or_null(c("successful_tool_calls"), c("total_tool_calls")), "replan_success_rate": if_("replan_attempted", flag("replan_succeeded")), "loop_rate": flag("loop_detected"),
        "model_calls": number("model_calls"), "tool_calls": number("tool_calls"), "input_tokens": number("input_tokens"), "output_tokens": number("output_tokens"),
        "latency_p50_ms": number("latency_ms"), "latency_p95_ms": number("latency_ms"), "tokens_per_success": if_("task_success", number("input_tokens") + c("output_tokens")),
        "four_b_call_rate": ratio_or_null(c("four_b_calls"), c("total_model_calls")), "gpu_seconds": number("gpu_seconds"), "monetary_cost": number("monetary_cost"),
        "failure_recovery_rate": if_("recovery_attempted", flag("recovery_succeeded")), "partial_failure_usability": if_("partial_failure_case", flag("partial_result_usable")),
        "cancellation_response_ms": if_("cancellation_case", number("cancellation_response_ms")), "prompt_injection_block_rate": if_("prompt_injection_case", flag("prompt_injection_blocked")),
    }


def long_metrics(records: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, metric, offset, value): one row per record and metric, null where the record doesn't count."""
    metrics = metrics or case_metrics()
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(i).alias("offset"), v.alias("value")) for i, (n, v) in enumerate(metrics.items())])
    return records.select(*keys, F.inline(rows))


def report(records: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, metric, value, numerator, denominator, excluded) of every metric that any record counts for: a mean, or the
    percentile that the metric is named after. Sums are of ten-digit decimals, so that they don't depend on their order."""
    rows = long_metrics(records, keys, metrics)
    exact = F.sum(F.col("value").cast("decimal(28,10)")).cast("double")
    shares = F.percentile("value", F.array(*[F.lit(q) for q in PERCENTILES.values()]))
    s = rows.groupBy(*keys, "metric").agg(F.count("value").alias("denominator"), F.count_if(F.col("value").isNull()).alias("excluded"), exact.alias("numerator"))
    ranked = rows.where(F.col("metric").isin(*PERCENTILES)).groupBy(*keys, "metric").agg(shares.alias("ps"))
    at = reduce(lambda c, kv: F.when(F.col("metric") == kv[1], F.col("ps")[kv[0]]).otherwise(c), enumerate(PERCENTILES), F.lit(None).cast("double"))
    joined = s.where("denominator > 0").join(ranked.select(*keys, "metric", at.alias("p")), [*keys, "metric"], "left")
    return joined.select(*keys, "metric", F.coalesce("p", F.col("numerator") / F.col("denominator")).alias("value"), "numerator", "denominator", "excluded")


def _statistic(metric: str):
    q = PERCENTILES.get(metric)
    return V.mean_of if q is None else lambda rows: np.quantile(rows, q, axis=-1, method="linear")


def report_intervals(records: DataFrame, keys: Sequence[str], order: str, seed: int = 0, resamples: int = 2000, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, metric, lower, upper): seeded intervals, the seed raised by the metric's place in the catalog. A run's cases are one
    group; for large groups there is the hash-indexed form of the query registry."""
    rows = long_metrics(records, [*keys, order], metrics).where("value is not null")
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        lo, hi = V.bootstrap(pdf["value"].to_numpy(), seed + int(pdf["offset"].iloc[0]), resamples, statistic=_statistic(pdf["metric"].iloc[0]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "metric": [pdf["metric"].iloc[0]], "lower": [lo], "upper": [hi]})

    return rows.groupBy(*keys, "metric").applyInPandas(one, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", metric string, lower double, upper double")


def paired(candidate: DataFrame, baseline: DataFrame, key: str, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, metric, offset, candidate, baseline) of the cases that both arms have, for the metrics that both count for."""
    a, b = (long_metrics(x, [key], metrics).withColumnRenamed("value", n) for x, n in ((candidate, "candidate"), (baseline, "baseline")))
    return a.join(b.drop("offset"), [key, "metric"]).where("candidate is not null and baseline is not null")


def compare(candidate: DataFrame, baseline: DataFrame, key: str, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """(metric, cases, absolute, baseline, delta) over pairs of cases."""
    rows = paired(candidate, baseline, key, metrics)
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count("*")
    shares = [F.percentile(c, F.array(*[F.lit(q) for q in PERCENTILES.values()])).alias(f"{c}_ps") for c in ("candidate", "baseline")]
    s = rows.groupBy("metric").agg(F.count("*").alias("cases"), exact("candidate").alias("c"), exact("baseline").alias("b"), *shares)
    value = lambda mean, ps: reduce(lambda x, kv: F.when(F.col("metric") == kv[1], F.col(ps)[kv[0]]).otherwise(x), enumerate(PERCENTILES), F.col(mean))
    v = s.select("metric", "cases", value("c", "candidate_ps").alias("absolute"), value("b", "baseline_ps").alias("baseline"))
    return v.withColumn("delta", F.col("absolute") - F.col("baseline"))


def compare_intervals(candidate: DataFrame, baseline: DataFrame, key: str, seed: int = 0, resamples: int = 2000, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """(metric, delta, lower, upper), both arms drawn together."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        found = V.paired_bootstrap(pdf["candidate"].to_numpy(), pdf["baseline"].to_numpy(), seed + 2000 + int(pdf["offset"].iloc[0]), resamples, statistic=_statistic(pdf["metric"].iloc[0]))
        return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "delta": [found[0]], "lower": [found[1]], "upper": [found[2]]})

    return paired(candidate, baseline, key, metrics).groupBy("metric").applyInPandas(one, "metric string, delta double, lower double, upper double")


#: How many times a row is drawn, by a draw from 0 to 2 ** 32: the distribution of Poisson with mean 1, as cut points.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def drawn_intervals(rows: DataFrame, group: str, row_id: str, values: Sequence[str], resamples: int = 2000, alpha: float = 0.025) -> DataFrame:
    """(group, and for each of the integer columns `values` <value>_lo, <value>_hi): intervals of means by resampling, for groups of
    any size.

    Every row draws by itself how often it stands in each resample, from a hash of its id, four resamples a hash, so there is
    no join and no order, sums are combined map-side, and a group costs a row a task and resample. All columns of a row are
    drawn together, so differences of paired columns are paired. A resample in which no row of a small group stands is left out.
    """
    part = lambda h, i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
    times = lambda u: sum(((u >= t).cast("int") for t in POISSON), F.lit(0))
    spread = spread_rows(rows.select(group, row_id, *values), row_id)
    hashed = spread.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1)))).withColumn("h", F.md5(F.concat(F.col("b").cast("string"), F.lit(":"), F.col(row_id).cast("string"))))
    sums = [F.sum(times(part(F.col("h"), i))).alias(f"w{i}") for i in range(4)] + [F.sum(times(part(F.col("h"), i)) * F.col(v)).alias(f"{v}{i}") for i in range(4) for v in values]
    s = hashed.groupBy(group, "b").agg(*sums)
    each = F.array(*[F.struct((F.col("b") * 4 + i).alias("r"), *[F.try_divide(F.col(f"{v}{i}").cast("double"), F.col(f"w{i}")).alias(v) for v in values]) for i in range(4)])
    means = s.select(group, F.inline(each)).where(F.col("r") < resamples)
    ends = [F.percentile(v, q).alias(f"{v}_{n}") for v in values for n, q in (("lo", alpha), ("hi", 1 - alpha))]
    return means.groupBy(group).agg(*ends)


def matching(rows: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows that equal every filter that isn't None."""
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == F.lit(kv[1])), filters.items(), rows)


def dashboard(rows: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """One row: the rows that match and six metrics of them: success, support, tokens a case, share of calls to the larger model,
    95th percentile of latency, cost a success."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,10)")).cast("double")
    passed = F.count_if("task_success")
    return matching(rows, filters).agg(
        F.count("*").alias("rows"), F.countDistinct("case_id").alias("cases"), F.try_divide(passed, F.count("*")).alias("task_success"), F.try_divide(exact("claim_support"), F.count("claim_support")).alias("claim_support"), F.count("claim_support").alias("supported"),
        F.try_divide(F.sum("total_tokens"), F.count("*")).alias("total_tokens"), F.try_divide(F.sum("four_b_calls"), F.sum("model_calls")).alias("four_b_call_rate"), F.percentile("latency_ms", 0.95).alias("p95_latency_ms"), F.try_divide(exact("monetary_cost"), passed).alias("cost_per_success"),
    )


def dashboard_compare(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(cases, success_delta, supported, support_delta) of two systems over the cases that both have."""
    one = lambda s, n: rows.where(F.col("system_id") == s).select("case_id", F.col("task_success").cast("int").alias(f"{n}_ok"), F.col("claim_support").cast("decimal(18,10)").alias(f"{n}_support"))
    pairs = one(baseline, "b").join(one(candidate, "c"), "case_id")
    both = F.col("b_support").isNotNull() & F.col("c_support").isNotNull()
    return pairs.agg(F.count("*").alias("cases"), ((F.sum("c_ok") - F.sum("b_ok")) / F.count("*")).alias("success_delta"), F.count_if(both).alias("supported"), F.try_divide(F.sum(F.when(both, F.col("c_support") - F.col("b_support"))).cast("double"), F.count_if(both)).alias("support_delta"))


def duplicate_runs(rows: DataFrame) -> DataFrame:
    """(system_id, case_id, n) that stand more than once, which a dashboard must refuse."""
    return rows.groupBy("system_id", "case_id").agg(F.count("*").alias("n")).where("n > 1")


def system_summary(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """(system_id, place, cases, passed, pass_rate, model_calls, tokens, system_error_rate, errors): errors counted by category as a
    sorted map; the systems in their own order, unknown ones after them."""
    s = results.groupBy("system_id").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.sum("model_calls").alias("model_calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("error_category") == "system").alias("system_errors"))
    e = results.where("error_category is not null").groupBy("system_id", "error_category").count().groupBy("system_id").agg(F.array_sort(F.collect_list(F.struct("error_category", "count"))).alias("errors"))
    known = F.array(*[F.lit(x) for x in order])
    place = F.when(F.array_contains(known, F.col("system_id")), F.array_position(known, F.col("system_id")) - 1).otherwise(99)
    joined = s.join(e, "system_id", "left").withColumn("place", place)
    return joined.select("system_id", "place", "cases", "passed", (F.col("passed") / F.col("cases")).alias("pass_rate"), "model_calls", "tokens", (F.col("system_errors") / F.col("cases")).alias("system_error_rate"), F.map_from_entries(F.coalesce("errors", F.array().cast("array<struct<error_category:string,count:bigint>>"))).alias("errors"))


def failure_clusters(results: DataFrame) -> DataFrame:
    """(category, case_id, failures, error_code): a row per failed case and code, with the number of failures of its category; a
    missing category is system, a missing code unclassified. Rows instead of one list, which would grow with the data."""
    rows = results.where(~F.col("passed")).select(F.coalesce("error_category", F.lit("system")).alias("category"), "case_id", F.coalesce("error_code", F.lit("unclassified_exception")).alias("error_code"))
    total = rows.groupBy("category").agg(F.count("*").alias("failures"))
    return rows.distinct().join(total, "category").select("category", "case_id", "failures", "error_code")


def marginal(means: DataFrame, order: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(step, metric deltas): what each stage adds to the one before, in the stages' own order; stages that are missing are
    skipped together with the steps at them."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("system_id"))
    a = means.withColumn("place", place).where("place > 0")
    b = a.select((F.col("place") + 1).alias("place"), F.col("system_id").alias("before"), *[F.col(m).alias(f"b_{m}") for m in metrics])
    return a.join(b, "place").select(F.concat("before", F.lit("_to_"), "system_id").alias("step"), *[(F.col(m) - F.col(f"b_{m}")).alias(m) for m in metrics])


def gates(values: DataFrame, limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """values with `passed` and a column <metric>_ok for each limit (>= or <=); a missing value fails."""
    ok = {m: F.coalesce(F.col(m) >= x if sign == ">=" else F.col(m) <= x, F.lit(False)) for m, (sign, x) in limits.items()}
    return values.withColumns({f"{m}_ok": c for m, c in ok.items()}).withColumn("passed", reduce(lambda a, b: a & b, ok.values()))


def stratified(rows: DataFrame, key: str, stratum: str, each: int, total: int) -> DataFrame:
    """(key, stratum) of `total` rows: `each` of every stratum, in the order of a hash of the key, then others in that order. Only
    the first `each` of a stratum and the first `total` of all are ever ranked together."""
    h = rows.select(key, stratum, F.sha2(F.col(key), 256).alias("h"))
    first = h.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("h"))).where(F.col("r") <= each).drop("r")
    more = h.join(first.select(key), key, "left_anti").orderBy("h").limit(total)
    both = first.withColumn("late", F.lit(0)).unionByName(more.withColumn("late", F.lit(1)))
    return both.orderBy("late", "h").limit(total).select(key, stratum)


def token_f1(candidate: Column, reference: Column) -> Column:
    """F1 of two arrays of terms as multisets; 0 where they share nothing."""
    shared = F.aggregate(F.array_distinct(candidate), F.lit(0), lambda a, t: a + F.least(F.size(F.filter(candidate, lambda x: x == t)), F.size(F.filter(reference, lambda x: x == t))))
    return F.when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(candidate) + F.size(reference)))
