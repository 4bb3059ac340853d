"""Queries over joins, sets, measures and logs in DataFrame form; the SQL they are held against is text of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import relations as R
from papyrine.operators.windows import best, numbered
from papyrine.plans.relations_sql import SQL
from papyrine.sources.tables import table

exact = lambda c, kind="decimal(28,10)": F.sum(F.col(c).cast(kind)).cast("double")


def scores(spark, d):
    return table(spark, d, "case_scores").distinct()


def sequenced(spark, d):
    return numbered(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])


def q_join_inner(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


def q_join_left(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("top"), F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("top", "c_mktsegment").alias("label"), F.coalesce("n", F.lit(0)).alias("orders"))


def q_join_semi(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def q_join_anti(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


def q_refcount(spark, d):
    open_ = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    pairs = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(open_, "l_orderkey", "left_semi").where("part is not null").distinct()
    return pairs.groupBy("part").agg(F.count("*").alias("refs"))


def q_paired_join(spark, d):
    per = scores(spark, d).where("latency_ms > 0 and system_id in ('single_agent', 'full_system')").groupBy("case_id", "system_id").agg(F.avg("latency_ms").alias("v"))
    arm = lambda s, n: per.where(F.col("system_id") == s).select("case_id", F.col("v").alias(n))
    return arm("single_agent", "baseline").join(arm("full_system", "candidate"), "case_id").withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6))


def q_asof_prev(spark, d):
    return R.last_before(table(spark, d, "events"), "user_id", "event_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", F.col("previous").alias("previous_purchase"))


def q_group_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), exact("l_quantity", "decimal(12,2)").alias("quantity"))


def q_usage_pivot(spark, d):
    role = F.when(F.col("system_id").isin("frozen_small", "single_agent"), "small").when(F.col("system_id").isin("full_system", "verifier"), "large")
    return R.totals_by_role(scores(spark, d).where("case_id is not null"), "case_id", role, "total_tokens", ["small", "large"])


def q_slices(spark, d):
    c = table(spark, d, "eval_cases").select("case_id", "difficulty", "task_family").distinct()
    rows = scores(spark, d).where("system_id is not null").select("system_id", "case_id", "task_success").join(c, "case_id")
    s = R.slices(rows, [["system_id"], ["system_id", "difficulty"], ["system_id", "task_family"]], [F.count("*").alias("n"), F.round(R.rate(F.col("task_success")), 9).alias("success")])
    return s.select("system_id", "difficulty", "task_family", F.col("all_difficulty").alias("all_difficulties"), F.col("all_task_family").alias("all_families"), "n", "success")


def q_macro_ratio(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left")
    return o.groupBy("o_orderpriority").agg(F.round(F.avg(F.try_divide("o_totalprice", "n")), 4).alias("macro"), F.count_if(F.col("n").isNull()).alias("excluded"))


def q_micro_vs_macro(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.count("*").alias("den"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(per, "o_orderkey")
    return o.groupBy("o_orderstatus").agg(F.round(F.sum("num") / F.sum("den"), 9).alias("micro"), F.round(F.avg(F.col("num") / F.col("den")), 9).alias("macro"))


def q_percentiles(spark, d):
    """Exact percentiles from values with their counts, so that a system's rows are not gathered."""
    s = scores(spark, d).where("latency_ms > 0").groupBy("system_id", "latency_ms").count()
    return s.groupBy("system_id").agg(F.percentile("latency_ms", 0.5, F.col("count")).alias("p50"), F.percentile("latency_ms", 0.95, F.col("count")).alias("p95"))


def q_per_success(spark, d):
    s = scores(spark, d).where("total_tokens is not null")
    return s.groupBy("system_id").agg(F.round(F.try_divide(F.sum("total_tokens").cast("double"), F.count_if("task_success")), 6).alias("per_success"), F.round(F.avg(F.when(F.col("task_success"), F.col("total_tokens"))), 6).alias("mean_of_successes"))


def q_conflict_pr(spark, d):
    low = lambda c: F.lower(F.trim(c))
    v = table(spark, d, "annotation_pairs").where("case_id is not null").groupBy("case_id").agg(F.collect_set(low("annotator_a_label")).alias("gold"), F.collect_set(low("annotator_b_label")).alias("pred"))
    return v.select("case_id", *[F.round(c, 9).alias(n) for c, n in zip(R.set_scores(v, "pred", "gold"), ("precision", "recall"), strict=True)])


def q_kappa(spark, d):
    p = table(spark, d, "annotation_pairs").distinct().where("annotator_a_label is not null and annotator_b_label is not null").select(F.lower(F.trim("annotator_a_label")).alias("a"), F.lower(F.trim("annotator_b_label")).alias("b"))
    return R.kappa(p, "a", "b").select("items", F.round("observed", 9).alias("observed"), F.round("kappa", 9).alias("kappa"))


def q_consistency(spark, d):
    v = table(spark, d, "annotation_pairs").where("annotator_a_label is not null and case_id is not null").select("case_id", "annotator_a_id", F.lower(F.trim("annotator_a_label")).alias("label")).distinct()
    return R.majority(v, "case_id", "label").withColumn("consistency", F.round("consistency", 9))


def failures(spark, d):
    return scores(spark, d).where("not task_success").select(F.coalesce("system_id", F.lit("system")).alias("category"), "case_id")


def q_failure_members(spark, d):
    f = failures(spark, d).groupBy("category", "case_id").agg(F.count("*").alias("n"))
    return f.join(f.groupBy("category").agg(F.sum("n").alias("failures")), "category").select("category", "case_id", "n", "failures")


def q_top_failures(spark, d):
    return failures(spark, d).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "category").limit(3)


def q_coverage(spark, d):
    c = table(spark, d, "eval_cases").drop("paper_ids", "conversation_ids", "created_at", "ingested_at").distinct()
    return R.slices(c, [["task_family"], ["difficulty"], ["language"], ["paper_type"]], [F.count("*").alias("n")]).select("task_family", "difficulty", "language", "paper_type", "n")


def q_dash_filter(spark, d):
    from papyrine.operators.metrics import matching

    c = table(spark, d, "eval_cases").drop("paper_ids", "conversation_ids", "created_at", "ingested_at").distinct()
    return matching(c, {"language": None, "difficulty": "L3", "split": "test"}).select("case_id", "task_family", "difficulty")


def q_param_validity(spark, d):
    s = scores(spark, d)
    return s.groupBy("system_id").agg(F.count_if("task_success").alias("valid"), F.count("task_success").alias("known"), F.round(R.rate(F.col("task_success")), 9).alias("rate"))


def q_set_ops(spark, d):
    o = table(spark, d, "orders")
    by = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(by("F").intersect(by("O")), "both").unionByName(n(by("F").subtract(by("O")), "only_f"))


def q_union(spark, d):
    kind = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("name"), F.lit(t).alias("kind"))
    return kind("supplier", "s_suppkey", "s_name").unionByName(kind("customer", "c_custkey", "c_name"))


def q_recent(spark, d):
    return best(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5, F.col("event_id")).select("user_id", "event_id", "ts")


def q_conv_search(spark, d):
    hit = F.contains(F.lower("c_name"), F.lit("9")) | F.contains(F.lower("c_mktsegment"), F.lit("build"))
    return table(spark, d, "customer").where(hit).orderBy(F.col("c_acctbal").desc(), F.col("c_custkey").desc()).offset(10).limit(20).select("c_custkey", "c_name")


def q_weighted_rank(spark, d):
    p = table(spark, d, "part")
    most = p.groupBy("p_type").agg(F.max("p_retailprice").alias("m"))
    return R.weighted_rank(p.join(most, "p_type"), "p_type", "p_partkey", F.col("p_size"), F.col("p_retailprice") / F.col("m"), 0.65, 3)


def q_ordered_distinct(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


def q_dup_keys(spark, d):
    count = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(t).alias("t"), "k", "n")
    return count("training_samples", "sample_id").unionByName(count("eval_cases", "case_id"))


def q_exact_dups(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


def _rendered(spark, d):
    return table(spark, d, "render_samples").select("file_id", "rendered_at").distinct()


def q_index_freshness(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "file_id", "indexed_at").distinct().join(_rendered(spark, d), "file_id")
    return c.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("indexed_at") < F.col("rendered_at")).alias("stale"), (F.max("indexed_at") >= F.max("rendered_at")).alias("fresh"))


def q_reindex_stale(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "file_id", "indexed_at", F.col("text").isNull().alias("bare")).join(_rendered(spark, d), "file_id")
    return c.where("indexed_at < rendered_at or bare").select("chunk_id", "file_id").distinct()


def q_event_seq(spark, d):
    return sequenced(spark, d).select("event_id", "user_id", "n")


def q_events_after(spark, d):
    return sequenced(spark, d).where("n > 10").select("event_id", "user_id", "n")


def q_until_terminal(spark, d):
    return R.up_to_first(sequenced(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "n")


def q_idempotent(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").groupBy("user_id", "event_type", day.alias("d")).agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type", F.col("d").cast("string").alias("day"))


def q_segment_sources(spark, d):
    s = sequenced(spark, d).withColumn("segment", F.floor((F.col("n") - 1) / 12).cast("bigint"))
    return s.groupBy("user_id", "segment").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("members"))


def q_chain_complete(spark, d):
    has = [F.coalesce(F.bool_or(F.col("event_type") == t), F.lit(False)) for t in ("signup", "view", "purchase")]
    return table(spark, d, "events").groupBy("user_id").agg((has[0] & has[1] & has[2]).alias("complete"))


def q_claim_links(spark, d):
    h = table(spark, d, "search_hits").select("hit_id", "query_id", "chunk_id", "file_id").distinct()
    c = table(spark, d, "chunks").select("chunk_id", F.col("file_id").alias("home"), "page_start").distinct().withColumn("known", F.lit(True))
    issue = F.when(F.col("chunk_id").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("file_id").isNull() | (F.col("file_id") != F.col("home")), "unlinked").when(F.coalesce(F.col("page_start") < 1, F.lit(True)), "invalid").otherwise("ok")
    return h.join(c, "chunk_id", "left").select("hit_id", issue.alias("issue"))


def q_comparison_all(spark, d):
    c = table(spark, d, "case_scores").select("case_id", "system_id", "claim_support_rate").distinct()
    cells = c.select("case_id").distinct().crossJoin(F.broadcast(c.where("system_id is not null").select("system_id").distinct()))  # a run compares a handful of systems
    n = c.groupBy(F.col("case_id").alias("k"), F.col("system_id").alias("s")).agg(F.count("claim_support_rate").alias("n"))
    joined = cells.join(n, F.col("case_id").eqNullSafe(F.col("k")) & (F.col("system_id") == F.col("s")), "left")
    return joined.select("case_id", "system_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == 0).alias("missing"))


def q_ext_sessions(spark, d):
    return R.sessions(table(spark, d, "events"), "user_id", "ts", ["ts", "event_id"], "6 hours").groupBy("user_id", "session").agg(F.count("*").alias("events"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
__all__ = ["QUERIES", "SQL"]
