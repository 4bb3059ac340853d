"""Queries that do the whole job beside one whose SQL cuts it, on rows where the cut shows."""

from __future__ import annotations

import hashlib
import math

from papyrine.functions.vectorized import percentile
from papyrine.operators import metrics
from papyrine.operators import retrieval as R
from papyrine.plans import documents, registry, relational, relations, retrieval


def test_context_admit_goes_on_after_an_overflow(spark, folder):
    rows = [(1, i, 1, 1, q, 1.0) for i, q in enumerate((60.0, 50.0, 40.0, 1.0))] + [(2, 1, 1, 1, 101.0, 1.0), (2, 2, 1, 1, None, 1.0), (2, 3, 1, 1, 7.0, 1.0), (3, 1, 1, 1, 200.0, 1.0)]
    folder("lineitem", rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double")
    got = documents.QUERIES["q_context_admit"](spark, folder.path).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 100), (2, 1, 7)]


def test_failures_of_any_latency_and_all_systems(spark, folder):
    rows = [(1, "a", "critic", False, 0.5, 10), (2, "a", "critic", False, 0.5, 600000), (3, "b", None, False, None, 20), (4, "b", "hybrid", True, 0.1, 30)]
    folder("case_scores", rows, "score_id bigint, case_id string, system_id string, task_success boolean, claim_support_rate double, latency_ms bigint")
    got = relations.QUERIES["q_failure_members"](spark, folder.path).collect()
    assert sorted(map(tuple, got)) == [("critic", "a", 2, 2), ("system", "b", 1, 1)]
    got = relations.QUERIES["q_comparison_all"](spark, folder.path).collect()
    assert sorted(map(tuple, got)) == [("a", "critic", 1, False), ("a", "hybrid", 0, True), ("b", "critic", 0, True), ("b", "hybrid", 1, False)]


def test_leakage_of_papers_and_conversations_in_both_tables(spark, folder):
    folder("eval_cases", [("a", "Train ", ["p", "q"], ["c"], None, None), ("b", "test", ["p"], None, "s", "f"), ("d", "TRAINING", ["q"], [], "s", "g"), ("e", "dev", [], ["c"], None, None)], "case_id string, split string, paper_ids array<string>, conversation_ids array<string>, source_cluster_id string, text_fingerprint string")
    folder("training_samples", [("x", "train", ["r"], ["k"]), ("y", "val", ["r"], None), ("z", "none", ["q"], ["k"])], "sample_id string, dataset_split string, paper_ids array<string>, conversation_ids array<string>")
    got = relational.QUERIES["q_leakage_all"](spark, folder.path).collect()
    assert sorted(map(tuple, got)) == [("eval_cases", "conversation", "c", 2, 2), ("eval_cases", "paper", "p", 2, 2), ("eval_cases", "source", "s", 2, 2), ("training_samples", "paper", "r", 2, 2)]


def test_every_hundredth_vector_is_searched(spark, folder):
    rows = [(0, [1.0, 0.0], 0), (100, [0.0, 2.0], 0), (7, [1.0, 1.0], 0), (8, [-1.0, 0.0], 0), (9, None, 0), (200, [0.0, 0.0], 0)]
    folder("embeddings", rows, "vec_id bigint, embedding array<float>, label int")
    got = retrieval.QUERIES["q_vector_search"](spark, folder.path).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1.0, 1), (0, 7, 0.707107, 2), (100, 7, 0.707107, 2), (100, 100, 1.0, 1)]
    e = spark.read.parquet(f"{folder.path}/embeddings.parquet")
    small = R.nearest(e.where("vec_id % 100 = 0").select(e.vec_id.alias("query_id"), "embedding"), e.select("vec_id", "embedding"), 2, 1, 1).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))


def test_rows_draw_themselves_two_thousand_times(spark, folder):
    folder("case_scores", [(i, "a", "s", True, i / 10, 0.1, 1) for i in range(40)], "score_id bigint, case_id string, system_id string, task_success boolean, claim_support_rate double, omission_rate double, latency_ms bigint")
    assert all(abs(c / 2**32 - sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) < 1e-9 for k, c in enumerate(metrics.POISSON))
    hashes = [[hashlib.md5(f"{b}:{i}".encode()).hexdigest() for i in range(40)] for b in range(500)]
    means = []
    for row in hashes:
        for k in range(4):
            times = [sum(int(h[8 * k : 8 * k + 8], 16) >= c for c in metrics.POISSON) for h in row]
            means.append(sum(t * i * 100_000 for i, t in enumerate(times)) / sum(times))
    want = ("s", round(percentile(means, 0.025) / 1e6, 9), round(percentile(means, 0.975) / 1e6, 9))
    got = [tuple(r) for r in registry.queries()["q_bootstrap_ci"](spark, folder.path).collect()]
    assert got == [want] and want[1] < 1.95 < want[2]
