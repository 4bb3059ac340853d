"""Consensus of several annotators: confidence-aware truth discovery."""

from __future__ import annotations

import math
import statistics
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.plans.runtime import cut, hot_keys, spread_join
from papyrine.sources.tables import table

LABELS = ("yes", "no", "extractive", "abstractive", "unanswerable")
#: Significance of the confidence interval. Alternating minimisation ends when no annotator's loss changes; after DAMPED rounds
#: each weight is the mean of the old and the new, so that labels that swap to and fro come to rest; MAX_ROUNDS is a warning.
ALPHA, DAMPED, MAX_ROUNDS = 0.05, 15, 60
#: From so many degrees of freedom on the quantile is the cube of Wilson and Hilferty, which is right to 1e-7 there.
MANY = 10_000
#: Losses are sums of 0/1 distances; an annotator who was never wrong gets this loss.
LEAST_LOSS = 0.5


def norm_label(col: Column) -> Column:
    """A label in its plain spelling; null for what is no vote."""
    word = F.lower(F.regexp_replace(col, r"[^A-Za-z]", ""))
    return F.when(word.isin(*LABELS), word)


def chi2_low(n: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of chi-squared with n degrees of freedom, by bisection on the regularised gamma function's series."""
    n = np.asarray(n, dtype=float)
    spread = 2 / (9 * n)
    found = n * (1 - spread + statistics.NormalDist().inv_cdf(q) * np.sqrt(spread)) ** 3
    few = n < MANY
    a = n[few] / 2
    log_gamma = np.array([math.lgamma(x + 1) for x in a])

    def below(x: np.ndarray) -> np.ndarray:
        term, total, k = np.ones_like(a), np.ones_like(a), 0
        while np.any(term > total * 1e-14):
            k += 1
            term = term * x / (a + k)
            total = total + term
        with np.errstate(divide="ignore"):
            return np.exp(a * np.log(x) - x - log_gamma) * total

    low, high = np.zeros_like(a), a + 1
    for _ in range(80):
        mid = (low + high) / 2
        under = below(mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    found[few] = low + high
    return found


@F.pandas_udf(T.DoubleType())
def chi2_weight(n: pd.Series) -> pd.Series:
    return pd.Series(chi2_low(n.to_numpy(), ALPHA / 2))


def votes_of(pairs: DataFrame) -> DataFrame:
    """(case_id, annotator, label, fixed) from pairs: one vote per item, annotator and label; fixed is the item's
    adjudicated label, that of the latest adjudication where there are several. Votes without an annotator share
    one reliability. Items whose votes are all void stay as one row with a null label."""
    rows = pairs.where(F.col("case_id").isNotNull()).select("case_id", "annotator_a_label", "annotator_b_label", "annotator_a_id", "annotator_b_id", "adjudication", "annotated_at")
    settled = F.when(F.col("adjudication").startswith("adjudicated:"), norm_label(F.expr("substring(adjudication, 13)")))
    sides = F.array(*[F.struct(F.col(f"annotator_{x}_id").alias("annotator"), norm_label(F.col(f"annotator_{x}_label")).alias("label")) for x in "ab"])
    flat = rows.select("case_id", settled.alias("s"), "annotated_at", F.explode(sides).alias("v"))
    items = flat.groupBy("case_id").agg(
        F.collect_set(F.when(F.col("v.label").isNotNull(), F.struct(F.coalesce("v.annotator", F.lit("")).alias("annotator"), F.col("v.label").alias("label")))).alias("votes"),
        F.max(F.when(F.col("s").isNotNull(), F.struct("annotated_at", "s"))).getField("s").alias("fixed"),
    )
    return items


def weighed(items: DataFrame, weights: DataFrame | None, hot: list | None = None) -> DataFrame:
    """items with each vote's weight: 1 without weights, 0 for an annotator without one. An annotator with a third of all votes
    is found among the hot keys and no single task."""
    if weights is None:
        return items.withColumn("votes", F.transform("votes", lambda v: F.struct(v["annotator"].alias("annotator"), v["label"].alias("label"), F.lit(1.0).alias("w"))))
    flat = items.select("case_id", "fixed", F.explode_outer("votes").alias("v")).select("case_id", "fixed", F.col("v.annotator").alias("annotator"), F.col("v.label").alias("label"))
    flat = spread_join(flat, weights, "annotator", "left", hot=hot).withColumn("w", F.coalesce("w", F.lit(0.0)))
    return flat.groupBy("case_id", "fixed").agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("annotator", "label", "w")))).alias("votes"))


def truths(items: DataFrame, weights: DataFrame | None, hot: list | None = None) -> DataFrame:
    """(case_id, fixed, votes, truth, support): the label with the greatest weight among an item's votes."""
    scored = weighed(items, weights, hot)
    weigh = lambda name: F.aggregate(F.filter("votes", lambda v: v["label"] == name), F.lit(0.0), lambda a, v: a + v["w"])
    sums = F.array(*[F.struct(F.round(weigh(name), 9).alias("w"), F.lit(-k).alias("k"), F.lit(name).alias("label")) for k, name in enumerate(LABELS)])
    best = F.array_max(F.filter(sums, lambda s: F.exists("votes", lambda v: v["label"] == s["label"])))
    total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["w"])
    return scored.select("case_id", "fixed", "votes", F.coalesce("fixed", best["label"]).alias("truth"), F.try_divide(best["w"], total).alias("support"))


def log_odds(bound: Column) -> Column:
    """The log-odds of an error's bound against a guess among the labels, 0 at worst."""
    b = F.least(bound, F.lit(0.999))
    return F.greatest(F.lit(0.0), F.log((1 - b) * (len(LABELS) - 1) / b))


def inverse(bound: Column) -> Column:
    """The plain inverse of the bound, as the method has it; kept to compare with."""
    return 1 / bound


def reliabilities(items: DataFrame, weight_of=log_odds) -> DataFrame:
    """(annotator, w, votes, loss) once alternating minimisation has settled.

    The error of an annotator is bounded from above by the summed distance to the current labels over the
    chi-squared quantile for the number of votes, so that somebody with three votes, all right, doesn't outweigh
    somebody with hundreds, nearly all right. The weight is the log-odds of that bound against a guess among the
    labels, 0 at worst: with 0/1 distances the plain inverse of the bound lets one annotator with almost no error
    outvote any number of good ones. Adjudicated items keep their label.
    Only the annotators' sums, one row each, are written between rounds; the items are read from their checkpoint.
    """
    votes = items.select(F.explode("votes").alias("v")).select("v.annotator")
    hot = hot_keys(votes, "annotator")
    counts = votes.groupBy("annotator").agg(F.count("*").alias("votes"))
    counts = cut(counts.withColumn("chi", chi2_weight("votes")))
    weights = None
    for turn in range(MAX_ROUNDS):
        now = truths(items, None if weights is None else weights.select("annotator", "w"), hot).select("truth", F.explode("votes").alias("v"))
        loss = now.groupBy("v.annotator").agg(F.sum((F.col("v.label") != F.col("truth")).cast("double")).alias("loss"))
        fresh = counts.join(loss, "annotator").withColumn("new", weight_of(F.greatest("loss", F.lit(LEAST_LOSS)) / F.col("chi")))
        if weights is None:
            weights = cut(fresh.select("annotator", F.col("new").alias("w"), "votes", "loss"))
            continue
        both = fresh.join(weights.select("annotator", F.col("w").alias("old"), F.col("loss").alias("before")), "annotator")
        w = F.col("new") if turn < DAMPED else (F.col("new") + F.col("old")) / 2
        weights = cut(both.select("annotator", w.alias("w"), "votes", "loss", (F.col("loss") != F.col("before")).alias("moved")))
        if weights.where("moved").isEmpty():
            return weights.drop("moved")
    warnings.warn(f"labels did not settle in {MAX_ROUNDS} rounds", stacklevel=2)
    return weights.drop("moved")


def p4_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = cut(votes_of(table(spark, sf_dir, "annotation_pairs")))
    return items, reliabilities(items)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, label); ties go to the label that stands first in LABELS, a null case_id is no item; label is null where an item has neither a valid vote nor an adjudicated label."""
    items, weights = p4_items(spark, sf_dir)
    return truths(items, weights.select("annotator", "w")).select("case_id", F.col("truth").alias("label"))


def _pairs_on(name: str) -> Column:
    """Ordered pairs of an item's votes that both have this label."""
    n = F.size(F.filter("votes", lambda v: v["label"] == name))
    return n * (n - 1)


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the label, the share of weight behind it, and the share of agreeing pairs among all pairs of its
    votes (null with fewer than two votes)."""
    items, weights = p4_items(spark, sf_dir)
    found = truths(items, weights.select("annotator", "w"))
    n = F.size("votes")
    agreeing = sum((_pairs_on(name) for name in LABELS), F.lit(0))
    return found.select("case_id", F.col("truth").alias("label"), "support", F.when(n > 1, agreeing / (n * (n - 1))).alias("agreement"), n.cast("int").alias("votes"))


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per annotator the weight, the votes and the share of votes that equal the consensus; the annotators' own
    table adds those without a vote."""
    _, weights = p4_items(spark, sf_dir)
    known = table(spark, sf_dir, "annotators").select(F.col("annotator_id").alias("annotator")).where(F.col("annotator").isNotNull()).distinct()
    return known.join(weights.where("annotator <> ''"), "annotator", "full").select(F.col("annotator").alias("annotator_id"), F.coalesce("votes", F.lit(0)).alias("votes"), F.col("w").alias("weight"), (1 - F.col("loss") / F.col("votes")).alias("accuracy"))


QUERIES = {"p4_found": p4_found, "p4_agreement": p4_agreement, "p4_reliability": p4_reliability}
SQL: dict[str, str] = {}
